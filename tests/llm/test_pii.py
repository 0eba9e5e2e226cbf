from __future__ import annotations

import hashlib
import re
import time

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from tuneline.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """Base spans by the patterns as they are stated."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet="a1.2@-+ (5%", max_size=60), st.text(alphabet="0123456789. -", max_size=60), st.text(alphabet="a@.-é", max_size=40)))
def test_base_equals_the_stated_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(("text", "kind", "inside"), [
    ("iban DE89 3704 0044 0532 0130 00 BIC CODE", "iban", "DE89 3704 0044 0532 0130 00"),
    ("pay to GB82WEST12345698765432 now", "iban", "GB82WEST12345698765432"),
    ("her ssn 219-09-9999.", "national_id", "219-09-9999"),
    ("card 378282246310005", "short_card", "378282246310005"),
    ("call (555) 013-4477 today", "local_phone", "(555) 013-4477"),
    ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ip6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ("write ann.lee [at] example [dot] org", "written_email", "ann.lee [at] example [dot] org"),
])
def test_added_spans(text, kind, inside):
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)] == [(kind, inside)]


@pytest.mark.parametrize("text", ["GB82WEST12345698765433", "part 219-09-9999", "378282246310005", "(555) 013-4477", "look at example dot org", "isbn 378282246310005 card", "call it off", ""])
def test_no_span_without_checksum_or_word(text):
    assert pii.spans(text) == []


def test_context_moves_the_score():
    alone, near, against = (pii.spans(t)[0][3] for t in ("x 8.8.8.8", "server 8.8.8.8", "version 8.8.8.8"))
    assert against < alone < near


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "1." * 700_000, "1 " * 700_000, "@" * 700_000, "a@" * 700_000, "+1 " * 500_000, "+1" + "(" * 1_000_000, "a.b@c." * 200_000, "AB12" * 400_000, "call " * 200_000])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - began < 20


def test_query_equals_plain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in pii.op12_pii(spark, SMALL).collect()}
    assert len(found) == len(docs)
    for d in docs:
        own, r = plain(d["text"]), found[d["doc_id"]]
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in own) for k in pii.BASE]
        assert r["spans"].startswith(spelled)
    assert sum(r["n_email"] + r["n_phone"] for r in found.values()) > 0


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "mail a@b.co", "z"), (3, "é 😀 a@b.co x", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in pii.find_pii(docs).collect())
    assert got == [("1", []), ("1", []), ("2", []), ("3", [("email", 4, 10)]), ("None", [("email", 5, 11)])]
    clean = pii.redact(docs.withColumnRenamed("spans", "_held"))
    assert clean.columns == ["doc_id", "text", "_held"]
    assert sorted(str(r["text"]) for r in clean.collect()) == ["", "None", "None", "mail <EMAIL>", "é 😀 <EMAIL> x"]
    assert pii.find_pii(docs.limit(0)).collect() == []


def test_redact_overlapping_kinds(spark):
    docs = spark.createDataFrame([("ring +1 1.2.3.4 5555 or 4111 1111 1111 1111",)], "text string")
    assert [k for k, *_ in pii.spans(docs.first()[0])] == ["ip", "card", "phone"]
    assert pii.redact(docs).first()[0] == "ring <PHONE> or <CARD>"
