"""Views of the star-schema tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (replica, method), from exact integer sums."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 30 as replica", "42 + l_suppkey % 30 as seed", "concat(l_returnflag, '_', l_linestatus) as method", "cast(round(l_discount * 100) as bigint) as d", "cast(l_quantity as bigint) as q").groupBy("replica", "seed", "method").agg({"d": "sum", "q": "sum", "*": "count"}).selectExpr("replica", "seed", "method", "1 - `sum(d)` / (100.0D * `count(1)`) as Accuracy_Mean", "`sum(q)` / (1.0D * `count(1)`) as Time_MeanFold")


def runs_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level runs with many ties and missing accuracies."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 30 as replica", "concat(l_returnflag, '_', l_linestatus) as method", "case when l_orderkey % 97 = 0 then null else 1 - l_discount end as Accuracy_Mean", "l_quantity as Time_MeanFold", "l_orderkey", "l_linenumber")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled predictions of three cut-offs over five folds."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").selectExpr("explode(array(struct(1 as config_id, 100 as cut), struct(2 as config_id, 500 as cut), struct(3 as config_id, 1000000 as cut))) as t", "doc_id", "quality", "n_chars").selectExpr("t.config_id", "doc_id % 5 as fold", "quality as y", "case when n_chars > t.cut then 1 else 0 end as pred")


def surface_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three factors and a response."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity as double) as a", "cast(l_discount as double) as b", "cast(l_tax as double) as c", "l_extendedprice / 1000 as y")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors with half values, and their dictionaries as text."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey as config_id", "p_size / 2 as a", "p_retailprice as b", "concat('{''a'': ', cast(p_size as string), ', ''b'': ', cast(p_partkey as string), '}') as hyperparameters")


#: The same views in DuckDB's SQL, to stand before a query's own SELECT.
SQL = {
    "runs": """runs as (select l_suppkey % 30 as replica, 42 + l_suppkey % 30 as seed, concat(l_returnflag, '_', l_linestatus) as method,
  1 - sum(cast(round(l_discount * 100) as bigint)) / (100.0::double * count(*)) as "Accuracy_Mean",
  sum(cast(l_quantity as bigint)) / (1.0::double * count(*)) as "Time_MeanFold" from lineitem group by 1, 2, 3)""",
    "runs_ties": """runs_ties as (select l_suppkey % 30 as replica, concat(l_returnflag, '_', l_linestatus) as method,
  case when l_orderkey % 97 = 0 then null else 1 - l_discount end as "Accuracy_Mean", l_quantity as "Time_MeanFold", l_orderkey, l_linenumber from lineitem)""",
    "preds": """preds as (select t.config_id, l.doc_id % 5 as fold, l.quality as y, case when d.n_chars > t.cut then 1 else 0 end as pred
  from labels l join documents d on l.doc_id = d.doc_id cross join (values (1, 100), (2, 500), (3, 1000000)) as t(config_id, cut))""",
    "surface_input": "surface_input as (select l_orderkey, l_linenumber, l_quantity::double as a, l_discount::double as b, l_tax::double as c, l_extendedprice / 1000 as y from lineitem)",
    "configs": """configs as (select p_partkey as config_id, p_size / 2 as a, p_retailprice as b,
  concat('{''a'': ', cast(p_size as string), ', ''b'': ', cast(p_partkey as string), '}') as hyperparameters from part)""",
}
