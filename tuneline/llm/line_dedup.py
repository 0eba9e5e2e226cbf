"""Line dedup: later copies of runs of lines, found by winnowed line hashes.

Of every ``window`` neighbouring lines the one with the least hash is a fingerprint, and
so is every line that is long enough to be a run by itself; hence two copies of a run share
a fingerprint for certain. Only where a fingerprint occurs twice are runs looked at: from
each line the shortest stretch that reaches the least number of words, forwards and
backwards. A stretch that occurs at an earlier place is a copy; stretches that overlap make
up the maximal run, which is deleted. Column expressions, joins and windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneline.llm.common import count_words, table, unused
from tuneline.session import materialize, require_columns

#: Words of the shortest run that is deleted, and lines of a winnowing window.
MIN_WORDS, WINDOW = 50, 2


def _stretch(lines: Column, min_words: int) -> Column:
    """How many of the first ``lines`` reach ``min_words`` words; null if all of them don't."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("n"))
    step = lambda acc, x: F.when(acc["words"] >= min_words, acc).otherwise(F.struct((acc["words"] + x["words"]).alias("words"), (acc["n"] + 1).alias("n")))
    return F.aggregate(lines, start, step, lambda acc: F.when(acc["words"] >= min_words, acc["n"]))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(_id, _hash, runs) for each text with runs to delete: an array of (first, last) line positions from 0, in order and apart.

    A line goes if it lies in a stretch of neighbouring lines, blank ones passed over, that
    holds ``min_words`` words or more and occurs at an earlier place; places are ordered by id,
    hash of the text and position. Rows of equal id and text are one text.
    """
    if not 1 <= window <= min_words:
        raise ValueError("window lies between 1 and min_words")
    place = ["_id", "_hash"]
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    # A second hash beside the fingerprints' one: 128 bits tell lines apart.
    lines = base.select(*place, "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("more"), count_words(F.col("line")).alias("words")).where("words > 0")
    lines = lines.repartition(*place).distinct()
    order = Window.partitionBy(*place).orderBy("pos")
    all_ = Window.partitionBy(*place)
    lines = lines.withColumns({"i": F.row_number().over(order), "n": F.count(F.lit(1)).over(all_)})
    least = F.min(F.struct("h", (-F.col("i")).alias("at"))).over(order.rowsBetween(0, window - 1))
    lines = lines.withColumn("least", F.when(F.col("i") + window - 1 <= F.col("n"), -least["at"]))
    chosen = F.array_contains(F.collect_list("least").over(order.rowsBetween(1 - window, 0)), F.col("i"))
    lines = materialize(lines.withColumn("chosen", chosen | (F.col("words") >= min_words)).drop("least", "n"), "lines")

    marks = lines.where("chosen").select(*place, "i", "h")
    # Counted lines are written before they are joined, so that both sides of the join have exchanges of their own and a hot line's rows can be split.
    twice = materialize(marks.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h"), "twice")
    anchors = marks.join(twice, "h").select(*place, "i", F.lit(True).alias("anchor"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in place]
    marked = lines.alias("l").join(anchors.alias("r"), [*same, F.col("l.i") == F.col("r.i")], "left").select("l.*", F.coalesce("r.anchor", F.lit(False)).alias("anchor"))
    # Texts without a repeated fingerprint have no run.
    marked = marked.withColumn("any", F.max("anchor").over(all_)).where("any")
    row = F.struct("h", "more", "words", "pos", "anchor")
    ahead, behind = F.collect_list(row).over(order.rowsBetween(0, min_words - 1)), F.reverse(F.collect_list(row).over(order.rowsBetween(1 - min_words, 0)))
    seen = marked.select(*place, "i", ahead.alias("ahead"), behind.alias("behind"))

    def stretch(side: str) -> Column:
        part = F.slice(F.col(side), 1, F.col(f"n_{side}"))
        spelled = F.concat_ws(",", F.transform(part if side == "ahead" else F.reverse(part), lambda x: F.concat_ws(":", x["h"].cast("string"), x["more"].cast("string"))))
        ends = F.transform(part, lambda x: x["pos"])
        found = F.struct(F.md5(spelled.cast("binary")).alias("key"), F.array_min(ends).alias("first"), F.array_max(ends).alias("last"))
        return F.when(F.col(f"n_{side}").isNotNull() & F.exists(part, lambda x: x["anchor"]), found)

    seen = seen.withColumns({f"n_{side}": _stretch(F.col(side), min_words) for side in ("ahead", "behind")})
    # The two stretches of a line are often one and the same.
    both = F.array_distinct(F.array_compact(F.array(stretch("ahead"), stretch("behind"))))
    spans = materialize(seen.select(*place, F.inline(both)), "spans")

    where = F.struct(*place, "first")
    origin = materialize(spans.groupBy("key").agg(F.min(where).alias("origin"), F.count(F.lit(1)).alias("times")).where("times > 1").select("key", "origin"), "origin")
    copies = spans.join(origin, "key").where(where > F.col("origin")).select(*place, "first", "last")
    by_start = Window.partitionBy(*place).orderBy("first", "last")
    apart = F.when(F.col("first") > F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    merged = copies.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    runs = merged.groupBy(*place, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW, counts: tuple[str, str] = ("_lines", "_removed")) -> DataFrame:
    """``docs`` with the text without its repeated runs, and two ``counts``: lines with words, and how many of them went.

    A null or empty text stays as it is; a text all of whose lines go becomes empty. Rows of
    equal id and text get equal results. Texts are read whole, however long. Other columns stay,
    whatever their names; where one has a count's name, the count gets underscores in front.
    """
    require_columns(docs, id_col, text_col)
    counts = unused(docs, *counts)
    key, found, left = unused(docs, "_hash", "_runs", "_left")
    # Sort-merge at every size: whether the runs fit a broadcast depends on the data, and the texts' shuffle is planned for.
    runs = materialize(repeated_runs(docs, id_col, text_col, min_words, window), "runs").hint("merge").alias("r")
    held = docs.withColumn(key, F.xxhash64(text_col)).alias("l")
    joined = held.join(runs, F.col(f"l.{id_col}").eqNullSafe(F.col("r._id")) & (F.col(f"l.{key}") == F.col("r._hash")), "left").select("l.*", F.col("r.runs").alias(found))
    lines = F.split(text_col, "\n")
    inside = lambda i: F.exists(found, lambda r: i.between(r["first"], r["last"]))
    filled = lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))
    kept = F.filter(lines, lambda x, i: ~inside(i))
    out = joined.withColumns({
        counts[0]: F.coalesce(F.size(F.filter(lines, filled)), F.lit(0)),
        left: F.when(F.col(found).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
    })
    rest = F.coalesce(F.size(F.filter(F.split(left, "\n"), filled)), F.lit(0))
    return out.withColumns({counts[1]: F.when(F.col(found).isNull(), 0).otherwise(F.col(counts[0]) - rest), text_col: F.col(left)}).drop(left, found, key)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP1_SQL = r"""
with t as (select distinct doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null),
a as (select doc_id, text, unnest(range(len(ls))) as pos, ls from t),
b as (select doc_id, text, pos, ls[pos + 1] as line, len(regexp_extract_all(ls[pos + 1], '[^\x20\x09-\x0D]+')) as words from a),
l as (select *, sum(words) over w as upto, row_number() over w as i from b where words > 0 window w as (partition by doc_id, text order by pos)),
g as (  -- the shortest stretch of 50 words or more from each line on, and up to it
  select x.doc_id, x.text, x.i as i, min(y.i) as j from l x join l y on x.doc_id = y.doc_id and x.text = y.text and y.i between x.i and x.i + 49 and y.upto >= x.upto - x.words + 50 group by all
  union
  select x.doc_id, x.text, max(y.i) as i, x.i as j from l x join l y on x.doc_id = y.doc_id and x.text = y.text and y.i between x.i - 49 and x.i and y.upto - y.words <= x.upto - 50 group by x.doc_id, x.text, x.i),
k as (
  select g.doc_id, g.text, min(pos) as first, max(pos) as last, string_agg(line, chr(10) order by pos) as spelled
  from g join l on g.doc_id = l.doc_id and g.text = l.text and l.i between g.i and g.j group by g.doc_id, g.text, g.i, g.j),
c as (select *, row_number() over (partition by spelled order by doc_id, text, first) as nth from k),
d as (select b.*, exists (select 1 from c where nth > 1 and c.doc_id = b.doc_id and c.text = b.text and b.pos between c.first and c.last) as gone from b),
r as (
  select doc_id, text, count(*) filter (where words > 0) as n_lines, count(*) filter (where words > 0 and gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as cleaned
  from d group by doc_id, text)
select o.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, length(cleaned) as n_chars, md5(cleaned) as text_md5
from documents o left join r on o.doc_id = r.doc_id and o.text = r.text
"""


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without repeated runs of lines; texts that lose every line go, and ``chars_col`` (where there is one) follows the text."""
    columns, (lines, removed) = docs.columns, unused(docs, "_lines", "_removed")
    out = cleaned(docs, id_col, text_col, counts=(lines, removed)).where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    if chars_col in columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in columns])
