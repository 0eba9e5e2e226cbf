"""Readers and writers: tables by suffix, decimal-comma text, term and candidate files, replica folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneline.operators.factors import Rotation
from tuneline.operators.relational import union_ragged
from tuneline.operators.surface import Surface
from tuneline.session import materialize, require_columns

#: Names that a label column goes by, in order of preference, and those of term files.
LABEL_NAMES = ("y", "target", "label", "class")
TERM_NAMES = ("term", "terms")
COEF_NAMES = ("coef", "coefs", "coefficient", "estimate")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A csv or parquet table, by its suffix (any case). A missing path is Spark's own error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).csv(path) if schema else read_csv_auto(spark, path)
    raise ValueError(f"unknown table format: {path}")


def label_name(df: DataFrame, target: str | None = None) -> str:
    """The label column: as asked for, else the first usual name, else the last column."""
    if target is not None:
        require_columns(df, target)
        return target
    return next((n for n in LABEL_NAMES if n in df.columns), df.columns[-1])


def split_label(df: DataFrame, target: str | None = None, label_map: dict | None = None, out: str = "label") -> DataFrame:
    """Features and, last, the label. Mapped values replace labels, unmapped ones become null; if nothing maps, labels stay as they are."""
    name = label_name(df, target)
    rest = [c for c in df.columns if c != name]
    if out in rest:
        raise ValueError(f"a feature is named {out}")
    label = F.col(name)
    if label_map:
        mapped = F.try_element_at(F.create_map(*[x for k, v in label_map.items() for x in (F.lit(str(k)), F.lit(v))]), label.cast("string"))
        if df.agg(F.count(mapped)).first()[0]:
            label = mapped
    return df.select(*rest, label.alias(out))


def _header(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0] if first else ""


def _trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_text_columns(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return _trimmed(spark.read.option("header", True).option("sep", sep).csv(path))


def read_decimal_comma(spark: SparkSession, path: str, numbers: list[str] | None = None) -> DataFrame:
    """Semicolon-separated text with decimal commas. ``numbers`` become doubles (null where they are none); None: every column that is a number wherever it has a value."""
    df = read_text_columns(spark, path, ";")
    as_double = {c: F.replace(F.col(f"`{c}`"), F.lit(","), F.lit(".")).try_cast("double") for c in df.columns}
    if numbers is None:
        bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & v.isNull()).alias(c) for c, v in as_double.items()]).first()
        numbers = [c for c in df.columns if not bad[c]]
    return df.withColumns({c: as_double[c] for c in numbers})


def read_csv_auto(spark: SparkSession, path: str) -> DataFrame:
    """Sniffs the header: more semicolons than commas mean decimal commas; else plain csv. Column names are trimmed."""
    header = _header(spark, path)
    if header.count(";") > header.count(","):
        return read_decimal_comma(spark, path)
    return _trimmed(spark.read.option("header", True).option("inferSchema", True).csv(path))


def write_decimal_comma(df: DataFrame, path: str) -> None:
    """Semicolon-separated text with decimal commas and a header; a folder of part files. Maps and structs go as JSON."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.replace(c.cast("string"), F.lit("."), F.lit(","))
        elif kind in ("map", "struct", "array"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    df.select(*out).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def find_column(columns: list[str], names: tuple[str, ...]) -> str:
    """A column by name in any case, else one whose name holds a candidate."""
    lower = {c.lower(): c for c in reversed(columns)}
    for n in names:
        if n in lower:
            return lower[n]
    for n in names:
        for c in columns:
            if n in c.lower():
                return c
    raise ValueError(f"no column like {' or '.join(names)}")


def terms_of(df: DataFrame) -> DataFrame:
    """(term, coef) of a table with such columns."""
    term, coef = find_column(df.columns, TERM_NAMES), find_column(df.columns, COEF_NAMES)
    number = F.col(f"`{coef}`") if df.schema[coef].dataType.typeName() == "double" else F.replace(F.col(f"`{coef}`").cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    return df.select(F.col(f"`{term}`").cast("string").alias("term"), number.alias("coef"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return terms_of(read_text_columns(spark, path, ";"))


def read_candidates(df: DataFrame, factors: list[str], text_col: str = "hyperparameters", on_bad: str = "drop") -> DataFrame:
    """``df`` with one double column a factor: its own columns, or a dictionary (text or map) in ``text_col``.

    A row that doesn't parse, lacks a factor or has something else than a number is dropped,
    or keeps nulls there with ``on_bad='null'``.
    """
    if on_bad not in ("drop", "null"):
        raise ValueError("on_bad is drop or null")
    if all(f in df.columns for f in factors):
        out = df.withColumns({f: F.col(f).cast("string").try_cast("double") for f in factors})
    else:
        require_columns(df, text_col)
        held = F.col(text_col) if df.schema[text_col].dataType.typeName() == "map" else F.from_json(text_col, "map<string,double>")
        out = df.withColumns({f: F.try_element_at(held, F.lit(f)) for f in factors})
    return out.dropna(subset=factors) if on_bad == "drop" else out


#: Bytes of a file up to which Spark reads it as one row, and bytes of a step of the others' stream.
WHOLE_FILE, STREAM_STEP = 256 << 20, 8 << 20


def _streamed(batches):
    """Digests of the files of a column of paths, read in steps; null where the path's store can't be opened here."""
    import hashlib

    import pyarrow as pa
    from pyarrow import fs

    for b in batches:
        out = []
        for path in b.column(0).to_pylist():
            digest = hashlib.sha256()
            try:
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as stream:
                    while step := stream.read(STREAM_STEP):
                        digest.update(step)
            except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
                out.append(None)
                continue
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["path", "length", "sha256"])


def _streamed_here(spark: SparkSession, path: str) -> str:
    """The digest of a file by the driver's own file systems, which read every store that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def file_fingerprints(spark: SparkSession, paths: str | list[str], whole: int = WHOLE_FILE) -> DataFrame:
    """(path, length, sha256) of each file, whatever its size; Spark's reader lists no empty files, which have no row.

    Files of up to ``whole`` bytes are rows of Spark's reader. Of larger ones only paths are rows: tasks stream them in
    steps. Where tasks can't open a store themselves, the driver streams, one file after another.
    """
    files = spark.read.format("binaryFile").load(paths)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length")
    if large.isEmpty():
        return small
    done = materialize(large.repartition("path").mapInArrow(_streamed, "path string, length long, sha256 string"), "digests")
    left = [(r["path"], r["length"], _streamed_here(spark, r["path"])) for r in done.where("sha256 is null").toLocalIterator()]
    out = small.unionByName(done.where("sha256 is not null"))
    return out.unionByName(spark.createDataFrame(left, "path string, length long, sha256 string")) if left else out


def collect_replicas(spark: SparkSession, frames: list[DataFrame], seeds: DataFrame, path_col: str = "_path") -> DataFrame:
    """The union of replicas' summaries with replica and seed in front; ``path_col`` holds a folder named replica_<n>, ``seeds`` replica and seed."""
    rows = union_ragged(frames).withColumn("replica", F.regexp_extract(path_col, r"replica[_=](\d+)", 1).try_cast("long"))
    rest = [c for c in rows.columns if c not in ("replica", "seed", path_col)]
    return rows.drop("seed").join(seeds.select("replica", "seed"), "replica").select("replica", "seed", *rest)


def read_replicas(spark: SparkSession, root: str, seeds: DataFrame, kind: str = "parquet") -> DataFrame:
    """Every replica's summary under ``root`` (folders replica_<n> or replica=<n>); missing ones are skipped, ragged columns united."""
    reader = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True)
    df = reader.format(kind).load(root)
    return collect_replicas(spark, [df.withColumn("_path", F.col("_metadata.file_path"))], seeds)


def export_loadings(loadings: DataFrame, path: str) -> None:
    """Metric and one column a factor."""
    n = loadings.agg(F.max("factor")).first()[0] or 0
    loadings.groupBy(F.col("metric").alias("Metric")).pivot("factor", list(range(1, n + 1))).agg(F.first("loading")).select("Metric", *[F.col(str(i)).alias(f"Factor{i}") for i in range(1, n + 1)]).write.mode("overwrite").parquet(path)


def export_scores(scores: DataFrame, row: str, path: str) -> None:
    """Row and the score columns."""
    scores.select(F.col(row).alias("Row"), *[c for c in scores.columns if c.endswith("_SCORE") or c.startswith("Score_")]).write.mode("overwrite").parquet(path)


def export_terms(terms: DataFrame, path: str) -> None:
    write_decimal_comma(terms.select(F.col("term").alias("Term"), F.col("coef").alias("Coef")), path)


def export_summary(summary: DataFrame, path: str) -> None:
    """The method summary; an empty one is an error."""
    if summary.isEmpty():
        raise ValueError("the summary is empty")
    write_decimal_comma(summary, path)


def export_candidates(candidates: DataFrame, path: str) -> None:
    """Candidates with their factors as one JSON column, in weight order."""
    write_decimal_comma(candidates.orderBy("beta_2"), path)


def export_fit(spark: SparkSession, surfaces: dict[str, Surface], found: Rotation, path: str) -> None:
    """One JSON line: r2, r2_adj, alpha and n_terms of each surface, and the numbers of the quality and cost factors from 1."""
    held = {name: {"r2": s.r2, "r2_adj": s.r2_adj, "alpha": s.alpha, "n_terms": len(s.terms)} for name, s in surfaces.items()}
    held["fa"] = {"quality_factor": found.quality + 1, "cost_factor": None if found.cost is None else found.cost + 1}
    spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def number_rows(df: DataFrame, order: list[str], out: str = "seq") -> DataFrame:
    """``df`` with its place in ``order`` from 0: counts by range partition, then a local number, so no task sorts all rows."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    held = materialize(part.withColumn("_i", local), "ranged")
    base = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return held.join(F.broadcast(base), "_p").withColumn(out, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")
