"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Four kinds (``BASE``) are certain once their checks hold: mail addresses, IPv4 addresses, card
numbers (Luhn) and international phone numbers. The method adds weaker proposals that need a
checksum or a telling word beside them: account numbers (mod 97), national numbers, shorter card
numbers, phone numbers without a country, IPv6 addresses and addresses spelled out. Every pattern is
anchored so that a text costs time in proportion to its length, whatever is in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import table, unused
from tuneline.session import require_columns

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "short_card", "local_phone", "ip6", "written_email")
KINDS = BASE + ADDED
#: Score that an added proposal needs, what a passed checksum and a telling or a doubtful word nearby add.
THRESHOLD, CHECKED, TELLING, DOUBTFUL = 0.5, 0.3, 0.3, -0.3
#: Score of a pattern alone.
PATTERN = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.3, "national_id": 0.3, "short_card": 0.1, "local_phone": 0.25, "ip6": 0.6, "written_email": 0.6}
#: Characters before and after a span whose words count.
BEFORE, AFTER = 40, 20
#: Words that tell of a kind, and words that speak against any.
CONTEXT = {
    "email": "mail email e-mail contact write reply", "written_email": "mail email e-mail contact write reply", "ip": "ip address host server client login", "ip6": "ip ipv6 address host server client login",
    "card": "card credit debit visa mastercard amex payment pay", "short_card": "card credit debit visa mastercard amex payment", "phone": "phone tel telephone call mobile cell fax dial", "local_phone": "phone tel telephone call mobile cell fax dial",
    "iban": "iban account bank transfer bic swift", "national_id": "ssn social security national identity taxpayer",
}
AGAINST = frozenset("isbn issn version order invoice tracking sku serial build".split())

_CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_WORDS = re.compile(r"[a-z]+(?:-[a-z]+)?")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_SPELLED = re.compile(r" ?(?:\[ ?at ?\]|\( ?at ?\)) ?[A-Za-z0-9-]++(?: ?(?:\[ ?dot ?\]|\( ?dot ?\)) ?[A-Za-z0-9-]++)++")
# A match always begins where a run of digits does, so that no start inside a run is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_CALL = re.compile(r"\b(?:tele)?(?:phone|tel|call|mobile|cell|fax|dial)\b", re.IGNORECASE)
_NEAR_CALL = re.compile(r"[^0-9+]{0,20}?(\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14})(?![0-9])")

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    own = [int(c) for c in digits[::-1]]
    return (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an account number of letters and digits leaves 1 when its head is put last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _begin(text: str, lo: int, at: int) -> int:
    """Where the characters of a mailbox that end at ``at`` begin, not before ``lo``; looked for in growing steps."""
    step = 64
    while True:
        low = max(lo, at - step)
        found = _LOCAL.match(text[low:at][::-1])
        begin = at - (found.end() if found else 0)
        if begin > low or low == lo:
            return begin
        step *= 4


def _addresses(text: str, tail: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost mailboxes followed by ``tail``, apart from one another."""
    lo = 0
    for m in tail.finditer(text):
        begin = _begin(text, lo, m.start())
        if begin < m.start():
            lo = m.end()
            yield begin, lo


def _small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The certain spans, by kind as in BASE, then by start."""
    out = [("email", a, b) for a, b in _addresses(text, _HOST)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    # A chain shorter than 16 characters can't hold enough digits.
    chains = [m.span() for m in _CHAIN.finditer(text) if m.end() - m.start() >= 16]
    out += [("card", a, b) for a, b in chains if 16 <= len(d := _digits(text[a:b])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Weaker candidates: kind, start, end, and whether a checksum holds."""
    for m in _IBAN.finditer(text):
        # Capital words may follow the groups: the longest prefix of whole groups whose checksum holds.
        end = m.end()
        while end - m.start() >= 12:
            own = text[m.start() : end].replace(" ", "")
            if 15 <= len(own) <= 34 and mod_97(own):
                yield "iban", m.start(), end, True
                break
            end = text.rfind(" ", m.start(), end)
    for m in _NATIONAL.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "national_id", *m.span(), False
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 15 and luhn(d):
            yield "short_card", *m.span(), True
    for c in _CALL.finditer(text):
        if m := _NEAR_CALL.match(text, c.end()):
            yield "local_phone", *m.span(1), False
    for m in _IP6.finditer(text):
        yield "ip6", *m.span(), False
    if "at" in text:
        for a, b in _addresses(text, _SPELLED):
            yield "written_email", a, b, False


def _nearby(text: str, kind: str, start: int, end: int) -> float:
    words = set(_WORDS.findall(text[max(0, start - BEFORE) : start].lower())) | set(_WORDS.findall(text[end : end + AFTER].lower()))
    return (TELLING if words & _CONTEXT[kind] else 0) + (DOUBTFUL if words & AGAINST else 0)


def spans(text: str | None) -> list[Span]:
    """(kind, start, end, score) of a text's personal data by kind as in KINDS, then start; code points, end exclusive.

    Base spans always stay and their score only tells how sure they are; an added one needs THRESHOLD and
    may not touch a base span nor an added one of an earlier kind or place.
    """
    if not text:
        return []
    score = lambda kind, a, b, checked: min(1.0, max(0.0, PATTERN[kind] + checked * CHECKED + _nearby(text, kind, a, b)))
    out = [(k, a, b, score(k, a, b, k == "card")) for k, a, b in base_spans(text)]
    taken = {i for _, a, b, _ in out for i in range(a, min(b, a + 4096))} if out else set()
    wide = [(a, b) for _, a, b, _ in out if b - a > 4096]
    for kind, a, b, checked in sorted(_proposals(text), key=lambda x: (KINDS.index(x[0]), x[1])):
        if taken.isdisjoint(range(a, min(b, a + 4096))) and not any(s < b and a < e for s, e in wide) and (sure := score(kind, a, b, checked)) >= THRESHOLD:
            out.append((kind, a, b, sure))
            taken.update(range(a, b))
    return out


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(x.as_py())] for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], ["_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and ``spans``, an array of (kind, start, end, score) by kind, then start.

    Positions are code points, ends exclusive. Null, empty and clean texts have an empty array; repeated rows
    are searched each; texts are read whole, however long, in time linear in their length. Further
    columns are ignored, whatever their names; an empty table gives an empty table.
    """
    require_columns(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_find, f"_id {kind}, spans {_SPANS}").withColumnRenamed("_id", id_col)


def _blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x in b.column(b.num_columns - 1):
            text, at, parts = x.as_py(), 0, []
            for kind, start, end, _ in sorted(spans(text), key=lambda s: s[1]):
                # Base kinds may overlap one another; what one has blanked, the next doesn't repeat.
                if start >= at:
                    parts += [text[at:start], f"<{kind.upper()}>"]
                at = max(at, end)
            out.append(text if not parts else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], b.schema.names)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in angle brackets.

    Clean, empty and null texts stay as they are, and all other columns, whatever their names; repeated
    rows are treated alike.
    """
    require_columns(docs, text_col)
    (held,) = unused(docs, "_held")
    columns, order = docs.columns, [*[c for c in docs.columns if c != text_col], text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in order]).withColumnRenamed(text_col, held)
    return rows.mapInArrow(_blank, rows.schema).withColumnRenamed(held, text_col).select(*[F.col(f"`{c}`") for c in columns])


def _spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    sure = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    added = F.filter("spans", lambda s: ~s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_spelled(sure).cast("binary"), 256).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"), F.size(added).cast("long").alias("n_added"))
