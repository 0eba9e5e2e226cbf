"""URL filters: pattern rules found through their rarest literal token.

Each rule names literal tokens that every url it fits must hold as whole tokens. The
rarest of them over all urls becomes the rule's only entry in the index. A url looks its
own tokens up in the index, and only the rules found that way run their regular
expression. Everything is a column expression; the rule list is a bounded parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import ascii_lower, escape, table, unused
from tuneline.session import require_columns

#: Bound of the rule list, which travels inside the plan as literals.
MAX_RULES = 2_000
#: What separates the tokens of a lower-cased url.
_BREAK = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host + path (host in lower case); ``tokens`` must all occur in what it fits."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: Rules of a higher tier win over lower ones; inside a tier the longest name wins.
    tier: int = 0


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for ``host`` and its subdomains where the path starts with ``path`` (which begins and ends with /)."""
    if not (path.startswith("/") and path.endswith("/")):
        raise ValueError("a rule's path begins and ends with /")
    tokens = tuple(t for t in _split(f"{host}{path}".lower()) if t)
    return Rule(f"{host}{path}", verdict, f"^(?:[^/]*\\.)?{escape(host)}{escape(path)}", tokens, tier=1)


def _split(s: str) -> list[str]:
    import re

    return re.split(_BREAK, s)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.lower(target), _BREAK))


def rarest_tokens(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, str]:
    """For each rule's name the token of it that the fewest urls hold (ties: the first by name).

    One aggregation over all urls; at most one row for each token of the rule list comes back.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    url = F.col(url_col)
    counts = (
        pages.select(F.explode(F.array_intersect(_tokens(F.concat(host_of(url), path_of(url))), F.lit(wanted))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    n = {c["token"]: c["n"] for c in counts}
    return {r.name: min(r.tokens, key=lambda t: (n.get(t, 0), t)) for r in rules}


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict and method_rule (columns of those names are replaced).

    rule is the name of the fitting rule of tier 1, or null; method_rule that of the fitting
    pattern rule of tier 0; the verdict is that of the first of the two there is, else
    ``default``. A null url, or one without ``://``, has empty host and path and fits nothing.
    Repeated rows are judged alike; urls are read whole, however long; an empty table gives an empty table.
    """
    require_columns(pages, url_col)
    if not rules or len(rules) > MAX_RULES or any(not r.tokens for r in rules):
        raise ValueError(f"1 to {MAX_RULES} rules are needed, each with a literal token")
    rarest = rarest_tokens(pages, rules, url_col)
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(rarest[r.name], []).append(i)
    # One struct a rule; the longest name wins inside a tier, then the smaller name.
    book = F.array(*[F.struct(F.lit(r.tier).alias("tier"), F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")) for r in rules])
    entries = F.create_map(*[x for t, ids in index.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))])
    known = F.lit(sorted(index))

    url = F.col(url_col)
    target = F.concat(host_of(url), path_of(url))
    found = F.flatten(F.transform(F.array_intersect(_tokens(target), known), lambda t: F.element_at(entries, t)))
    fitting = F.filter(F.transform(found, lambda i: F.get(book, i)), lambda r: F.regexp_like(target, r["pattern"]))
    fits, own, other = unused(pages, "_fits", "_own", "_other")
    best = lambda tier: F.array_max(F.transform(F.filter(F.col(fits), lambda r: r["tier"] == tier), lambda r: F.struct(r["size"], r["name"], r["verdict"])))
    out = pages.withColumn(fits, fitting).withColumns({own: best(1), other: best(0)})
    return out.withColumns({
        "host": host_of(url), "path": path_of(url), "rule": F.col(f"{own}.name"), "method_rule": F.col(f"{other}.name"),
        "verdict": F.coalesce(F.col(f"{own}.verdict"), F.col(f"{other}.verdict"), F.lit(default)),
    }).drop(fits, own, other)


#: The rules of the query, and patterns for hosts that sell or cheat.
RULES = [
    prefix_rule("allow", "com", "/"),
    prefix_rule("block", "example.com", "/en/"),
    prefix_rule("allow", "www.example.com", "/en/"),
    prefix_rule("block", "net", "/es/"),
    prefix_rule("block", "net", "/fr/"),
    Rule("spam-farm host", "block", r"^(?:[^/]*\.)?spam-farm\.", ("spam", "farm")),
    Rule("pill shop host", "block", r"^(?:[^/]*\.)?(?:[a-z]+-)?pills\.", ("pills",)),
    Rule("casino host", "block", r"^(?:[^/]*\.)?casino(?:-[a-z]+)?\.", ("casino",)),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "method_rule")


OP10_SQL = r"""
with p as (
  select page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') as raw_host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
h as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
r(rule_host, rule_path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
w as (
  select h.*, (select max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': r.verdict}) from r
    where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as own,
    case when regexp_matches(host || path, '^([^/]*\.)?spam-farm\.') then 'spam-farm host'
         when regexp_matches(host || path, '^([^/]*\.)?([a-z]+-)?pills\.') then 'pill shop host'
         when regexp_matches(host || path, '^([^/]*\.)?casino(-[a-z]+)?\.') then 'casino host' end as method_rule
  from h)
select page_id, host, path, own.rule as rule,
       coalesce(own.verdict, case when method_rule is not null then 'block' end, 'allow') as verdict, method_rule
from w
"""
