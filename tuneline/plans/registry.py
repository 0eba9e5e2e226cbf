"""Registered queries of the library, each over whole tables, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.functions import scalars as S
from tuneline.functions.scalars import Factor
from tuneline.operators import evaluate, factors, frontier, linalg, metrics, relational, sampling, search, selection, stacked, surface
from tuneline.plans import pipeline, views
from tuneline.plans.views import table
from tuneline.session import materialize, scratch_root
from tuneline.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, view: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL over a view of views.SQL or over the tables."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"with {views.SQL[view]}\n{sql}" if view else sql
        return f

    return put


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tuneline/{name}-{uuid.uuid4().hex}"


def _r(c, digits: int = 6):
    return F.round(c, digits)


# Sources and sinks


@query("O01_read_table", "select l_returnflag, count(*) as n, sum(l_orderkey)::bigint as keys from lineitem group by l_returnflag")
def _o01(spark, d):
    return tables.read_table(spark, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("O02_split_label", "select o_orderkey, o_totalprice, case o_orderstatus when 'F' then 1 when 'O' then 0 end as label from orders")
def _o02(spark, d):
    return tables.split_label(table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("class")), label_map={"F": 1, "O": 0})


def _part_text(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "part-text")
    tables.write_decimal_comma(table(spark, d, "part").select("p_partkey", F.col("p_name").alias(" p_name "), "p_size", "p_retailprice"), path)
    return path


@query("O03_read_csv_auto", "select p_partkey::double as p_partkey, p_name, p_size::double as p_size, p_retailprice from part")
def _o03(spark, d):
    return tables.read_csv_auto(spark, _part_text(spark, d)).select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("O04_read_decimal_comma", "select p_partkey::varchar as p_partkey, p_retailprice from part")
def _o04(spark, d):
    return tables.read_decimal_comma(spark, _part_text(spark, d), ["p_retailprice"]).select("p_partkey", "p_retailprice")


@query("O05_write_decimal_comma", "select c_custkey::varchar as c_custkey, replace(c_acctbal::varchar, '.', ',') as c_acctbal from customer")
def _o05(spark, d):
    path = _folder(spark, "customer-text")
    tables.write_decimal_comma(table(spark, d, "customer").select("c_custkey", "c_acctbal"), path)
    return tables.read_text_columns(spark, path, ";")


@query("O06_read_terms", "select p_type as term, sum(p_size)::double as coef from part group by p_type")
def _o06(spark, d):
    path = _folder(spark, "terms")
    tables.export_terms(table(spark, d, "part").groupBy(F.col("p_type").alias("term")).agg(F.sum("p_size").cast("double").alias("coef")), path)
    return tables.read_terms(spark, path)


@query("O07_read_candidates", "select p_partkey as config_id, p_size::double as a, p_partkey::double as b from part where p_partkey % 7 <> 0")
def _o07(spark, d):
    text = views.configs(spark, d).select("config_id", F.when(F.col("config_id") % 7 == 0, F.lit("{'a': None}")).otherwise(F.col("hyperparameters")).alias("hyperparameters"))
    return tables.read_candidates(text, ["a", "b"]).drop("hyperparameters")


@query("O08_file_fingerprints", """with f as (select c_custkey // 1000 as part, string_agg(c_name || ';' || c_nationkey || chr(10), '' order by c_custkey) as body from customer group by 1)
select part, strlen(body) as length, sha256(body) as sha256 from f""")
def _o08(spark, d):
    """Text files of a thousand customers each."""
    root, rows = _folder(spark, "files"), table(spark, d, "customer").selectExpr("c_custkey div 1000 as part", "c_custkey", "concat_ws(';', c_name, c_nationkey) as line")
    rows.repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "line").write.partitionBy("part").text(root)
    found = tables.file_fingerprints(spark, root)
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "length", "sha256")


@query("O08_file_fingerprints_streamed", """with f as (select c_custkey // 1000 as part, string_agg(c_name || ';' || c_nationkey || chr(10), '' order by c_custkey) as body from customer group by 1)
select part, strlen(body) as length, sha256(body) as sha256 from f""")
def _o08_streamed(spark, d):
    """The same files, each of which is streamed."""
    root, rows = _folder(spark, "files"), table(spark, d, "customer").selectExpr("c_custkey div 1000 as part", "c_custkey", "concat_ws(';', c_name, c_nationkey) as line")
    rows.repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "line").write.partitionBy("part").text(root)
    found = tables.file_fingerprints(spark, root, whole=0)
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "length", "sha256")


@query("O08_table_fingerprints")
def _o08_tables(spark, d):
    return tables.file_fingerprints(spark, [f"{d}/{t}.parquet" for t in ("orders", "customer", "supplier")])


@query("O09_collect_replicas", 'select replica, seed, method, round("Accuracy_Mean", 9) as accuracy, round("Time_MeanFold", 9) as seconds from runs', "runs")
def _o09(spark, d):
    root, rows = _folder(spark, "replicas"), views.runs(spark, d)
    rows.drop("seed").withColumn("folder", F.format_string("replica_%02d", "replica")).drop("replica").write.partitionBy("folder").parquet(root)
    found = tables.read_replicas(spark, root, rows.select("replica", "seed").distinct())
    return found.select("replica", "seed", "method", _r("Accuracy_Mean", 9).alias("accuracy"), _r("Time_MeanFold", 9).alias("seconds"))


@query("O10_export_summary", "select l_returnflag as method, count(*)::double as budget, sum(l_quantity) as quantity from lineitem group by 1")
def _o10(spark, d):
    path = _folder(spark, "summary")
    tables.export_summary(table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.count(F.lit(1)).alias("budget"), F.sum("l_quantity").alias("quantity")), path)
    return tables.read_decimal_comma(spark, path)


# Projections, predicates, scalar functions


@query("O11_cast_factors", "select config_id, cast(round_even(a, 0) as bigint) as a, b::double as b from configs", "configs")
def _o11(spark, d):
    return S.cast_factors(views.configs(spark, d).drop("hyperparameters"), {"a": Factor(0, 25, True), "b": Factor(0, 2000)})


@query("O12_project_factors", "select l_quantity, l_tax from lineitem")
def _o12(spark, d):
    return S.project_factors(table(spark, d, "lineitem"), ["l_quantity", "gamma", "l_tax"], missing="ignore")


@query("O13_to_number", "select o_orderkey, try_cast(left(o_orderpriority, 1) as double) as rank, try_cast(case when o_orderkey % 5 = 0 then 'x' else o_totalprice::varchar end as double) as price from orders")
def _o13(spark, d):
    price = F.when(F.col("o_orderkey") % 5 == 0, "x").when(F.col("o_orderkey") % 5 == 9, "nan").otherwise(F.col("o_totalprice").cast("string"))
    return S.to_number(table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("rank"), price.alias("price")), ["rank", "price"])


@query("O14_fill_midpoint", 'select l_orderkey, l_linenumber, coalesce("Accuracy_Mean", 0.95::double) as accuracy from runs_ties', "runs_ties")
def _o14(spark, d):
    rows = views.runs_ties(spark, d).select("l_orderkey", "l_linenumber", F.col("Accuracy_Mean").alias("accuracy"))
    return S.fill_midpoint(rows, {"accuracy": Factor(0.9, 1.0)})


@query("O15_transform_time", "select l_orderkey, l_linenumber, round(ln(1 + greatest(l_quantity - 25, 0)), 9) as log1p, round(ln(greatest(l_quantity - 25, 1e-12)), 9) as log, l_quantity - 25 as plain from lineitem")
def _o15(spark, d):
    t = F.col("l_quantity") - 25
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[_r(S.transform_time(t, m), 9).alias(m) for m in ("log1p", "log")], S.transform_time(t, "none").alias("plain"))


@query("O16_zscore", "select l_orderkey, l_linenumber, l_returnflag, round((l_quantity - avg(l_quantity) over w) / stddev_samp(l_quantity) over w, 6) as z from lineitem window w as (partition by l_returnflag)")
def _o16(spark, d):
    z = factors.zscore(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_quantity"], ["l_returnflag"])
    return z.select("l_orderkey", "l_linenumber", "l_returnflag", _r("l_quantity_z").alias("z"))


@query("O17_slug", r"select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(translate(' ' || p_name || '/' || p_brand || '. ', ' .', '__'), '[^\p{L}\p{N}_-]', '', 'g'), '^_+|_+$', '', 'g'), ''), 'item') as slug from part")
def _o17(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slug(F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.lit(". "))).alias("slug"))


@query("O18_term_expr", "select l_orderkey, l_linenumber, round(a * a, 9) as sq, round(a * b, 9) as ab, round(case when abs(b) <= 1e-12 then 0 else 1 / b end, 9) as inv, round(power(a, 1.5), 6) as pw, 1.0::double as one from surface_input", "surface_input")
def _o18(spark, d):
    t = lambda s: S.term_expr(s, ["a", "b", "c"])
    return views.surface_input(spark, d).select("l_orderkey", "l_linenumber", _r(t("(a * a)"), 9).alias("sq"), _r(t("a*b"), 9).alias("ab"), _r(t("1/b"), 9).alias("inv"), _r(t("a^1.5")).alias("pw"), t("Intercept").alias("one"))


@query("O19_predict_terms", "select l_orderkey, l_linenumber, round(2 + 0.5 * a - 3 * b * c + 0.25 * c * c, 9) as predicted from surface_input", "surface_input")
def _o19(spark, d):
    return views.surface_input(spark, d).select("l_orderkey", "l_linenumber", _r(S.predict_terms([("Intercept", 2), ("a", 0.5), ("b*c", -3), ("c^2", 0.25)], ["a", "b", "c"]), 9).alias("predicted"))


@query("O20_quadratic_expand", 'select 1.0::double as "Intercept", a, b, c, round(a*a, 9) as aa, round(b*b, 9) as bb, round(c*c, 9) as cc, round(a*b, 9) as ab, round(a*c, 9) as ac, round(b*c, 9) as bc from surface_input', "surface_input")
def _o20(spark, d):
    wide = S.quadratic_expand(views.surface_input(spark, d), ["a", "b", "c"])
    return wide.select("Intercept", "a", "b", "c", *[_r(F.col(f"`{x}*{y}`"), 9).alias(x + y) for x, y in ("aa", "bb", "cc", "ab", "ac", "bc")])


def _ends(df: DataFrame, c: str) -> DataFrame:
    return df.crossJoin(F.broadcast(metrics.extremes(df, [c])))


@query("O21_normalize_range", "select l_orderkey, l_linenumber, round((y - (select min(y) from surface_input)) / ((select max(y) from surface_input) - (select min(y) from surface_input)), 9) as v, round(least(greatest((y - 5) / 50, 0), 1), 9) as clipped from surface_input", "surface_input")
def _o21(spark, d):
    rows = _ends(views.surface_input(spark, d), "y")
    return rows.select("l_orderkey", "l_linenumber", _r(S.normalize_range(F.col("y"), F.col("y_nadir"), F.col("y_utopia")), 9).alias("v"), _r(S.normalize_range(F.col("y"), F.lit(5.0), F.lit(55.0), clip=True), 9).alias("clipped"))


@query("O22_distance_to_utopia", "select l_orderkey, l_linenumber, round((1 - b) * (1 - b) + (1 - c) * (1 - c), 9) as distance from surface_input", "surface_input")
def _o22(spark, d):
    return views.surface_input(spark, d).select("l_orderkey", "l_linenumber", _r(S.distance_to_utopia(F.col("b"), F.col("c")), 9).alias("distance"))


@query("O23_weighted_score", "select l_orderkey, l_linenumber, round(0.3 * b + 0.7 * c, 9) as score from surface_input", "surface_input")
def _o23(spark, d):
    return views.surface_input(spark, d).select("l_orderkey", "l_linenumber", _r(S.weighted_score(F.col("b"), F.col("c"), F.lit(0.3), F.lit(0.7)), 9).alias("score"))


@query("O24_in_range", "select l_orderkey, l_linenumber, a, b from surface_input where a between 10 and 20 and b between 0.02 and 0.05", "surface_input")
def _o24(spark, d):
    rows = views.surface_input(spark, d)
    return rows.where(S.in_range([(F.col("a"), F.lit(10), F.lit(20)), (F.col("b"), F.lit(0.02), F.lit(0.05))])).select("l_orderkey", "l_linenumber", "a", "b")


# Joins


@query("O25_attach_scores", "select o.o_orderkey, o.o_totalprice, s.lines from orders o left join (select l_orderkey, count(*) as lines from lineitem group by 1) s on o.o_orderkey = s.l_orderkey")
def _o25(spark, d):
    scores = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    return relational.attach_scores(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), scores, "o_orderkey")


@query("O26_grid_product", "select t.l_tax as tax, f.l_discount as discount from (select distinct l_tax from lineitem) t cross join (select distinct l_discount from lineitem) f")
def _o26(spark, d):
    levels = {n: [r[0] for r in table(spark, d, "lineitem").select(c).distinct().orderBy(c).limit(10_001).collect()] for n, c in (("tax", "l_tax"), ("discount", "l_discount"))}
    if any(len(v) > 10_000 for v in levels.values()):
        raise ValueError("a grid takes 10,000 levels of a factor at most")
    return sampling.grid_product(spark, levels).drop("config_id")


_FRONT_SQL = """select x.replica, x.method, round(x."Accuracy_Mean", 9) as accuracy, round(x."Time_MeanFold", 9) as seconds, not exists (
  select 1 from {v} y where y.replica = x.replica and y."Accuracy_Mean" >= x."Accuracy_Mean" and y."Time_MeanFold" <= x."Time_MeanFold"
  and (y."Accuracy_Mean" > x."Accuracy_Mean" or y."Time_MeanFold" < x."Time_MeanFold")) as is_pareto from {v} x"""


def _front(df: DataFrame) -> DataFrame:
    return df.select("replica", "method", _r("Accuracy_Mean", 9).alias("accuracy"), _r("Time_MeanFold", 9).alias("seconds"), "is_pareto")


@query("O27_pareto_front", _FRONT_SQL.format(v="runs"), "runs")
def _o27(spark, d):
    return _front(relational.pareto_front(views.runs(spark, d), ["replica"], "Accuracy_Mean", "Time_MeanFold"))


@query("O27_pareto_front_three", """with r as (select l_suppkey % 30 as replica, l_orderkey, l_linenumber, l_partkey, case when l_orderkey % 97 = 0 then null else l_discount end as d, l_extendedprice as p, l_quantity as q from lineitem),
u as (select distinct replica, d, p, q from r where d is not null),
f as (select * from u x where not exists (select 1 from u y where y.replica = x.replica and y.d >= x.d and y.p <= x.p and y.q <= x.q and (y.d > x.d or y.p < x.p or y.q < x.q)))
select r.replica, r.l_orderkey, r.l_linenumber, r.l_partkey, r.d is null or f.replica is not null as is_pareto from r left join f on r.replica = f.replica and r.d = f.d and r.p = f.p and r.q = f.q""")
def _o27_three(spark, d):
    """The largest discount, the lowest price and the smallest quantity."""
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey % 30 as replica", "l_orderkey", "l_linenumber", "l_partkey", "case when l_orderkey % 97 = 0 then null else l_discount end as d", "l_extendedprice as p", "l_quantity as q")
    return relational.pareto_front(rows, ["replica"], ["d"], ["p", "q"]).select("replica", "l_orderkey", "l_linenumber", "l_partkey", "is_pareto")


# Aggregations

_CONFUSION = """select config_id, fold, (tp + tn)::double / (tp + fp + tn + fn) as accuracy, case when tp + fp = 0 then 0 else tp::double / (tp + fp) end as precision,
  case when tp + fn = 0 then 0 else tp::double / (tp + fn) end as recall, case when tn + fp = 0 then 0 else tn::double / (tn + fp) end as specificity
  from (select config_id, fold, count(*) filter (where y = 1 and pred = 1) as tp, count(*) filter (where y = 0 and pred = 1) as fp,
  count(*) filter (where y = 0 and pred = 0) as tn, count(*) filter (where y = 1 and pred = 0) as fn from preds group by 1, 2)"""


@query("O28_confusion_metrics", f"select config_id, fold, round(accuracy, 9) as accuracy, round(precision, 9) as precision, round(recall, 9) as recall, round(specificity, 9) as specificity from ({_CONFUSION})", "preds")
def _o28(spark, d):
    return metrics.confusion_metrics(views.preds(spark, d), ["config_id", "fold"]).select("config_id", "fold", *[_r(m, 9).alias(m) for m in metrics.METRICS])


@query("O29_fold_means", f'select config_id, round(avg(accuracy), 9) as "Accuracy_Mean", round(avg(precision), 9) as "Precision_Mean", round(avg(recall), 9) as "Recall_Mean", round(avg(specificity), 9) as "Specificity_Mean" from ({_CONFUSION}) group by 1', "preds")
def _o29(spark, d):
    means = metrics.fold_means(metrics.confusion_metrics(views.preds(spark, d), ["config_id", "fold"]), ["config_id"])
    return means.select("config_id", *[_r(c, 9).alias(c) for c in means.columns if c != "config_id"])


_STATS = ", ".join(f'{"round(" if f != "count" else ""}{g}("{c}"){", 9)" if f != "count" else ""} as "{c}_{f}"' for c in ("Accuracy_Mean", "Time_MeanFold") for f, g in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"), ("min", "min"), ("max", "max"), ("count", "count")))


@query("O30_method_stats", f"select method, {_STATS} from runs_ties group by method", "runs_ties")
def _o30(spark, d):
    stats = metrics.method_stats(views.runs_ties(spark, d), "method", pipeline.STAT_COLUMNS)
    return stats.select("method", *[(c if c.endswith("_count") else _r(c, 9).alias(c)) for c in stats.columns if c != "method"])


@query("O30_method_stats_selected", f"select method, {_STATS} from runs_ties group by method", "runs_ties")
def _o30_selected(spark, d):
    """The same statistics, with medians by histograms."""
    stats = metrics.method_stats(views.runs_ties(spark, d), "method", pipeline.STAT_COLUMNS, held=0)
    return stats.select("method", *[(c if c.endswith("_count") else _r(c, 9).alias(c)) for c in stats.columns if c != "method"])


@query("O30_quantiles_by_supplier", """with r as (select l_suppkey, l_extendedprice as v, row_number() over (partition by l_suppkey order by l_extendedprice) - 1 as rank, count(*) over (partition by l_suppkey) as n from lineitem)
select l_suppkey, n, rank, v as value from r where rank in (0, n // 4, n // 2, 3 * n // 4, n - 1)""")
def _o30_quantiles(spark, d):
    n = F.col("n")
    places = F.array(F.lit(0).cast("long"), F.expr("n div 4"), F.expr("n div 2"), F.expr("3 * n div 4"), n - 1)
    return selection.select_ranks(table(spark, d, "lineitem"), ["l_suppkey"], ["l_extendedprice"], places).drop("column")


_WIN_SQL = 'select method, sum(case when "Accuracy_Mean" >= top - 1e-12 then 1 else 0 end)::bigint as wins, count(*) as n, round(sum(case when "Accuracy_Mean" >= top - 1e-12 then 1 else 0 end) / (select count(distinct replica) from {v})::double, 9) as win_rate from (select *, max("Accuracy_Mean") over (partition by replica) as top from {v}) group by method'


def _wins(df: DataFrame) -> DataFrame:
    return df.select("method", "wins", "n", _r("win_rate", 9).alias("win_rate"))


@query("O31_win_rate", _WIN_SQL.format(v="runs"), "runs")
def _o31(spark, d):
    return _wins(metrics.win_rate(views.runs(spark, d), "method", "replica", "Accuracy_Mean"))


@query("O31_win_rate_ties", _WIN_SQL.format(v="runs_ties"), "runs_ties")
def _o31_ties(spark, d):
    return _wins(metrics.win_rate(views.runs_ties(spark, d), "method", "replica", "Accuracy_Mean"))


_RATE_SQL = f"select method, count(*) as pareto_count, round(count(*) / (select count(distinct replica) from runs)::double, 9) as pareto_rate from ({_FRONT_SQL.format(v='runs')}) where is_pareto group by method"


@query("O32_pareto_rate", _RATE_SQL, "runs")
def _o32(spark, d):
    front = relational.skyline_2d(views.runs(spark, d), ["replica"], "Accuracy_Mean", "Time_MeanFold")
    return metrics.pareto_rate(front, "method", "replica").select("method", "pareto_count", _r("pareto_rate", 9).alias("pareto_rate"))


@query("O33_extremes", "select max(b) as b_utopia, min(b) as b_nadir, max(y) as y_utopia, min(y) as y_nadir from surface_input", "surface_input")
def _o33(spark, d):
    return metrics.extremes(views.surface_input(spark, d), ["b", "y"])


_ABCY = ("a", "b", "c", "y")


@query("O34_correlation_matrix", "\nunion all\n".join(f"select '{x}' as a, '{z}' as b, round(corr({x}, {z}), 6) + 0.0 as r from surface_input" for x in _ABCY for z in _ABCY), "surface_input")
def _o34(spark, d):
    return linalg.correlation_matrix(views.surface_input(spark, d), list(_ABCY)).select("a", "b", (_r("r") + F.lit(0.0)).alias("r"))


@query("O35_pca_project")
def _o35(spark, d):
    return factors.pca_project(views.surface_input(spark, d), list(_ABCY), 3).select("l_orderkey", "l_linenumber", "PC1", "PC2", "PC3")


@query("O35_pca_two_columns", """select l_orderkey, l_linenumber, b, round((x + y) / sqrt(2), 6) as "PC1", round(abs(x - y) / sqrt(2), 6) as "PC2" from (
  select *, (a - avg(a) over ()) / stddev_samp(a) over () as x, (b - avg(b) over ()) / stddev_samp(b) over () as y from (select *, l_quantity::double as a, l_quantity + l_extendedprice / 10000.0::double as b from lineitem))""")
def _o35_two(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), (F.col("l_quantity") + F.col("l_extendedprice") / 10000.0).alias("b"))
    return factors.pca_project(rows, ["a", "b"], 2).select("l_orderkey", "l_linenumber", "b", _r("PC1").alias("PC1"), _r(F.abs("PC2")).alias("PC2"))


@query("O36_gram", "select l_returnflag, count(*) as n, " + ", ".join(f"round(sum({x} * {z}), 4) as s_{i}_{i + k}" for i, x in enumerate(("1.0::double", "l_quantity", "l_tax")) for k, z in enumerate(("1.0::double", "l_quantity", "l_tax")[i:])) + " from lineitem group by l_returnflag")
def _o36(spark, d):
    g = linalg.gram(table(spark, d, "lineitem"), [F.lit(1.0), F.col("l_quantity")], F.col("l_tax"), ["l_returnflag"])
    return g.select("l_returnflag", "n", *[_r(c, 4).alias(c) for c in g.columns if c.startswith("s_")])


_POWERS = 5


def _powers(spark: SparkSession, d: str) -> DataFrame:
    """The 64 components and their powers up to the fifth, 320 numbers a row."""
    powers = F.flatten(F.transform("embedding", lambda x: F.array(*[F.pow(x.cast("double"), F.lit(float(i + 1))) for i in range(_POWERS)])))
    return table(spark, d, "embeddings").select("vec_id", "label", powers.alias("v"))


_POWERS_SQL = f"""with e as (select vec_id, label, unnest(range(64)) as c, unnest(embedding)::double as x from embeddings),
v as (select vec_id, label, c * {_POWERS} + k as i, pow(x, k + 1) as x from e, (select unnest(range({_POWERS})) as k))"""


@query("O36_gram_wide", _POWERS_SQL + ' select a.i::int as i, b.i::int as j, count(*) as n, round(sum(a.x * b.x), 5) + 0.0 as s from v a join v b on a.vec_id = b.vec_id and a.i <= b.i group by a.i, b.i')
def _o36_wide(spark, d):
    return linalg.wide_gram(_powers(spark, d), "v", 64 * _POWERS).withColumn("s", _r("s", 5) + F.lit(0.0))


@query("O36_gram_wide_by", _POWERS_SQL + ' select a.label, a.i::int as i, b.i::int as j, count(*) as n, round(sum(a.x * b.x), 5) + 0.0 as s from v a join v b on a.vec_id = b.vec_id and a.i <= b.i group by a.label, a.i, b.i')
def _o36_wide_by(spark, d):
    return linalg.wide_gram(_powers(spark, d), "v", 64 * _POWERS, ["label"]).withColumn("s", _r("s", 5) + F.lit(0.0))


@query("O34_correlation_wide", "with v as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings) select 'e' || a.i as a, 'e' || b.i as b, round(corr(a.x, b.x), 6) + 0.0 as r from v a join v b on a.vec_id = b.vec_id group by a.i, b.i")
def _o34_wide(spark, d):
    return linalg.correlation_matrix(_labelled(spark, d), _FEATURES).withColumn("r", _r("r") + F.lit(0.0))


@query("O37_ols", "select 'Intercept' as term, round(regr_intercept(y, a), 6) as coef, round(regr_r2(y, a), 6) as r2, count(*) as n from surface_input union all select 'a', round(regr_slope(y, a), 6), round(regr_r2(y, a), 6), count(*) from surface_input", "surface_input")
def _o37(spark, d):
    return linalg.ols(views.surface_input(spark, d), ["a"], ["a"], "y").select("term", _r("coef").alias("coef"), _r("r2").alias("r2"), "n")


@query("O38_best_config", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1")
def _o38(spark, d):
    return relational.best_config(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("O39_distinct_count", "select count(distinct l_partkey) as n from lineitem")
def _o39(spark, d):
    return relational.distinct_count(table(spark, d, "lineitem"), "l_partkey")


@query("O40_score_sanity", "select count(*) as n, round(corr(-l_quantity, l_extendedprice), 6) as corr, corr(-l_quantity, l_extendedprice) > -0.3 as warn from lineitem")
def _o40(spark, d):
    rows = table(spark, d, "lineitem").select((-F.col("l_quantity")).alias("cost"), "l_extendedprice")
    return factors.score_sanity(rows, "cost", "l_extendedprice").select("n", _r("corr").alias("corr"), "warn")


# Windows, top-k, set operations, samples


@query("O41_group_max", 'select l_orderkey, l_linenumber, replica, case when replica is not null then max("Accuracy_Mean") over (partition by replica) end as group_max from runs_ties', "runs_ties")
def _o41(spark, d):
    return relational.group_max(views.runs_ties(spark, d), "replica", "Accuracy_Mean").select("l_orderkey", "l_linenumber", "replica", "group_max")


@query("O42_skyline_2d", _FRONT_SQL.format(v="runs_ties"), "runs_ties")
def _o42(spark, d):
    return _front(relational.skyline_2d(views.runs_ties(spark, d), ["replica"], "Accuracy_Mean", "Time_MeanFold"))


@query("O43_assign_folds", """with h as (select o_orderkey, o_orderstatus, md5('42-' || o_orderkey) as h from orders),
b as (select *, ('0x' || h[1:4])::int * 64 // 65536 as b from h)
select o_orderkey, o_orderstatus, ((row_number() over (order by o_orderstatus, b, h, o_orderkey) - 1) % 5)::int as fold from b""")
def _o43(spark, d):
    return relational.assign_folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5, 42)


@query("O44_first_by", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey")
def _o44(spark, d):
    return relational.first_by(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("O45_top_k_by_distance", "select o_orderkey, o_totalprice from orders order by (1 - o_totalprice / 500000) * (1 - o_totalprice / 500000), o_orderkey limit 25")
def _o45(spark, d):
    near = (1 - F.col("o_totalprice") / 500000) * (1 - F.col("o_totalprice") / 500000)
    return relational.top_k_by_distance(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), near, "o_orderkey", 25)


@query("O46_union_ragged", "select s_suppkey as key, s_acctbal as balance, null as segment from supplier union all select c_custkey, c_acctbal, c_mktsegment from customer")
def _o46(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return relational.union_ragged([s, c])


@query("O47_dedup_configs", "select min(p_partkey) as p_partkey, p_size, p_type from part group by p_size, p_type")
def _o47(spark, d):
    return relational.dedup_configs(table(spark, d, "part").select("p_partkey", "p_size", "p_type"), ["p_size", "p_type"], "p_partkey")


def _boxes(spark: SparkSession, d: str) -> dict[str, Factor]:
    """Boxes as wide as the table's own columns."""
    r = table(spark, d, "lineitem").agg(*[f(c) for c in ("l_quantity", "l_tax") for f in (F.min, F.max)]).first()
    return {"quantity": Factor(r[0], r[1], True), "tax": Factor(r[2], r[3])}


@query("O48_factor_levels", """with b as (select min(l_quantity) as q0, max(l_quantity) as q1, min(l_tax) as t0, max(l_tax) as t1 from lineitem), i as (select unnest(range(5)) as i)
select 'quantity' as factor, min(i)::int as level_no, level from (select i, round_even(q0 + (q1 - q0) * i / 4.0::double, 0) as level from b, i) group by level
union all select 'tax', i::int, round(t0 + (t1 - t0) * i / 4.0::double, 9) from b, i""")
def _o48(spark, d):
    return sampling.factor_levels(spark, _boxes(spark, d), 25).withColumn("level", _r("level", 9))


@query("O49_sample_n", "select o_orderkey from orders order by md5('7-' || o_orderkey), o_orderkey limit 500")
def _o49(spark, d):
    return sampling.sample_n(table(spark, d, "orders").select("o_orderkey"), 500, 7, "o_orderkey")


#: A uniform draw as operators/sampling.py makes it.
_DRAW = "(('0x' || md5('{seed}-{name}-' || {key})[1:13])::bigint / 4503599627370496.0::double)"


@query("O50_random_configs", f"""with b as (select min(l_quantity) as q0, max(l_quantity) as q1, min(l_tax) as t0, max(l_tax) as t1 from lineitem), i as (select unnest(range((select count(*) from lineitem))) as i)
select i as config_id, least(q0 + floor({_DRAW.format(seed=42, name="quantity", key="i")} * (q1 - q0 + 1)), q1)::double as quantity, round(t0 + {_DRAW.format(seed=42, name="tax", key="i")} * (t1 - t0), 9) as tax from i, b""")
def _o50(spark, d):
    return sampling.random_configs(spark, _boxes(spark, d), table(spark, d, "lineitem").count(), 42).withColumn("tax", _r("tax", 9))


def _permutation(a: int | str, b: int | str, n: int, seed: int) -> str:
    """The first n pairs of the keyed permutation of a times b as a table perm, as operators/sampling.py makes it."""
    out = f"perm0 as (select i, i % {a} as l, i // {a} as r from (select unnest(range({n})) as i))"
    for t in range(4):
        other, own, size = ("r", "l", a) if t % 2 == 0 else ("l", "r", b)
        moved = f"({own} + ('0x' || md5('{seed}-perm-{t}-' || {other})[1:13])::bigint) % {size} as {own}"
        name = "perm" if t == 3 else f"perm{t + 1}"
        out += f",\n{name} as (select i, {moved}, {other} from perm{t})"
    return out


_WIDE_BOX = 20


def _wide_boxes(spark: SparkSession, d: str) -> dict[str, Factor]:
    """Boxes of twenty components of the embeddings."""
    ends = table(spark, d, "embeddings").agg(*[f(F.get("embedding", F.lit(i))).cast("double").alias(f"{n}{i}") for i in range(_WIDE_BOX) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {f"x{i:02d}": Factor(ends[f"lo{i}"], ends[f"hi{i}"]) for i in range(_WIDE_BOX)}


@query("O57_grid_configs", f"with {_permutation(3**10, 3**10, 50, 42)},\nb as (select i, min(x) as lo, max(x) as hi from (select unnest(range(64)) as i, unnest(embedding)::double as x from embeddings) where i < {_WIDE_BOX} group by i)\nselect perm.i as config_id, " + ", ".join(f"round(lo{i} + (hi{i} - lo{i}) * ({'l' if i < 10 else 'r'} // {3 ** (i % 10)} % 3) / 2.0::double, 6) as x{i:02d}" for i in range(_WIDE_BOX)) + " from perm, (select " + ", ".join(f"max(lo) filter (where i = {i}) as lo{i}, max(hi) filter (where i = {i}) as hi{i}" for i in range(_WIDE_BOX)) + " from b)")
def _o57_configs(spark, d):
    """Fifty points of a grid of 3^20."""
    found = search.grid_configs(spark, _wide_boxes(spark, d), 50, 42)
    return found.select("config_id", *[_r(c).alias(c) for c in found.columns if c != "config_id"])


@query("O50_distinct_configs", f"""with b as (select min(l_quantity) as q0, max(l_quantity) as q1, min(l_tax) as t0, max(l_tax) as t1 from lineitem),
v as (select i, least(q0 + floor({_DRAW.format(seed=7, name="quantity", key="i")} * (q1 - q0 + 1)), q1)::double as quantity, t0 + {_DRAW.format(seed=7, name="tax", key="i")} * (t1 - t0) as tax from (select unnest(range(50)) as i), b),
q as (select quantity, row_number() over (order by min(i)) - 1 as l from v group by quantity),
t as (select tax, row_number() over (order by min(i)) - 1 as r from v group by tax),
{_permutation("(select count(*) from q)", "(select count(*) from t)", 50, 7)}
select i as config_id, quantity, round(tax, 9) as tax from perm join q using (l) join t using (r)""")
def _o50_distinct(spark, d):
    return sampling.distinct_configs(spark, _boxes(spark, d), 50, 7).withColumn("tax", _r("tax", 9))


# Composite operators

_TUNED = {"regParam": Factor(0.0, 0.5), "elasticNetParam": Factor(0.0, 1.0)}
_FEATURES = [f"e{i}" for i in range(64)]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", (F.col("label") < 5).cast("int").alias("y"), *[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate(_FEATURES)])


def _design(spark: SparkSession, rows: int) -> DataFrame:
    return sampling.random_configs(spark, _TUNED, rows, 11)


@query("O51_cv_evaluate")
def _o51(spark, d):
    return evaluate.cv_evaluate(_five(spark, d), [{"config_id": i, "regParam": 0.1 * i, "elasticNetParam": 0.25 * (i % 3)} for i in range(6)])


@query("O51_cv_evaluate_boosting")
def _o51_boosting(spark, d):
    """Boosted trees of all seven factors, of which only the number and depth of trees are kept small."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    rare = {"subsample": 0.7, "colsample_bytree": 0.9, "colsample_bylevel": 0.8, "gamma": 0.0}
    configs = [{"config_id": i, "learning_rate": 0.2, "max_depth": 3, "n_estimators": n, **rare} for i, n in enumerate((2, 4))]
    return evaluate.cv_evaluate(evaluate.prepared(rows, ["o_totalprice", "day"], "y", "o_orderkey", 2, 42), configs, evaluate.boosting, k=2)


#: Newton's steps for logistic models of one variable, of configurations (config_id, reg) and five folds, in SQL.
_NEWTON_CONFIGS, _NEWTON_STEPS = ((0, 0.0), (1, 0.02), (2, 0.5)), 4
_NEWTON = f"""with o as (select o_orderkey, (o_orderstatus = 'F')::int as y, o_totalprice / 100000 as v from orders),
f as (select y, v, v - avg(v) over () as x, avg(v) over () as mid, (row_number() over (order by y, md5('42-' || o_orderkey), o_orderkey) - 1) % 5 as fold from o),
c as (select * from (values {", ".join(f"({i}, {reg}::double)" for i, reg in _NEWTON_CONFIGS)}) as t(config_id, reg)),
e as (select config_id, held, reg * var_samp(x) as ridge, any_value(mid) as mid from f, c, (select unnest(range(5)) as held) where fold <> held group by config_id, held, reg),
s0 as (select config_id, held, 0.0::double as a, 0.0::double as b from e),
""" + ",\n".join(f"""s{i} as (select config_id, held, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b from (
  select config_id, held, a, b, avg(p - y) as g0, avg((p - y) * x) + ridge * b as g1, avg(p * (1 - p)) as h00, avg(p * (1 - p) * x) as h01, avg(p * (1 - p) * x * x) + ridge as h11
  from (select config_id, held, a, b, ridge, x, y, 1 / (1 + exp(-a - b * x)) as p from f join s{i - 1} on fold <> held join e using (config_id, held)) group by config_id, held, a, b, ridge))""" for i in range(1, _NEWTON_STEPS + 1)) + f",\nw as (select config_id, held, a, b, mid from s{_NEWTON_STEPS} join e using (config_id, held))"


def _priced(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 100000).alias("v"))
    return evaluate.prepared(rows, ["v"], "y", "o_orderkey", 5, 42)


_PRICED = [{"config_id": i, "regParam": reg, "maxIter": _NEWTON_STEPS} for i, reg in _NEWTON_CONFIGS]


@query("O51_logistic_coefficients", _NEWTON + " select config_id, held::int as fold, t.term, round(case t.term when 0 then a - b * mid else b end, 6) + 0.0 as coef from w, (values (0), (1)) as t(term)")
def _o51_coefficients(spark, d):
    return stacked.logistic_coefficients(_priced(spark, d), _PRICED, 5).withColumn("coef", _r("coef") + F.lit(0.0))


@query("O51_cv_evaluate_logistic", _NEWTON + f""",
preds as (select config_id, fold, y, (a + b * x > 0)::int as pred from f join w on fold = held)
select config_id, round(avg(accuracy), 9) as "Accuracy_Mean", round(avg(precision), 9) as "Precision_Mean", round(avg(recall), 9) as "Recall_Mean", round(avg(specificity), 9) as "Specificity_Mean" from ({_CONFUSION}) group by config_id""")
def _o51_logistic(spark, d):
    return _means(evaluate.cv_evaluate(_priced(spark, d), _PRICED), "config_id")


@query("O52_run_design")
def _o52(spark, d):
    return evaluate.run_design(_five(spark, d), _design(spark, 8), _TUNED)


@query("O53_evaluate_candidates")
def _o53(spark, d):
    return evaluate.evaluate_candidates(_five(spark, d), _design(spark, 8), _TUNED)[0]


#: Gaussian naive Bayes by folds in SQL: metrics of each configuration of ``c`` (config_id, threshold), with the default five folds.
_BAYES = f"""with e as (select vec_id, (label < 5)::int as y, embedding from embeddings where label is not null and embedding is not null),
f as (select *, (row_number() over (order by y, md5('42-' || vec_id), vec_id) - 1) % 5 as fold from e),
x as (select vec_id, y, fold, unnest(range(64)) as i, unnest(embedding[1:64])::double as v from f),
o as (select unnest(range(5)) as held),
s as (select held, y, i, count(*) as n, avg(v) as mu, sum(v * v) as sq, sum(v) as total from x, o where fold <> held group by all),
a as (select held, max(spread) * 1e-9 as least, any_value(n) as rows from (select held, i, sum(n) as n, sum(sq) / sum(n) - (sum(total) / sum(n)) * (sum(total) / sum(n)) as spread from s group by all) group by held),
g as (select s.held, s.y, s.i, s.mu, ln(s.n / a.rows::double) as prior, a.least + s.sq / s.n - s.mu * s.mu as var from s join a using (held)),
l as (select x.vec_id, x.y, x.fold, g.y as class, any_value(prior) - sum((v - mu) * (v - mu) / var + ln(var)) / 2 as raw from x join g on x.fold = g.held and x.i = g.i group by all),
r as (select vec_id, y, fold, sum(case class when 1 then raw else -raw end) as odds from l group by all),
preds as (select config_id, fold, y, (odds > ln(threshold / (1 - threshold)))::int as pred from r, c),
m as (select config_id, any_value(threshold) as threshold, avg(accuracy) as acc, round(avg(accuracy), 9) as "Accuracy_Mean", round(avg(precision), 9) as "Precision_Mean", round(avg(recall), 9) as "Recall_Mean", round(avg(specificity), 9) as "Specificity_Mean"
  from ({_CONFUSION}) join c using (config_id) group by config_id)"""
_MEANS = ("Accuracy_Mean", "Precision_Mean", "Recall_Mean", "Specificity_Mean")
_CUT = {"threshold": Factor(0.05, 0.95)}
_CUTS = f"c as (select i as config_id, 0.05::double + {_DRAW.format(seed='{seed}', name='threshold', key='i')} * (0.95::double - 0.05::double) as threshold from (select unnest(range({{n}})) as i))"


def _bayes_sql(configs: str, last: str) -> str:
    return _BAYES.replace("with e as", f"with {configs},\ne as", 1) + "\n" + last


def _means(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *[_r(c, 9).alias(c) for c in _MEANS])


def _five(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.prepared(_labelled(spark, d), _FEATURES, "y", "vec_id", 5, 42)


@query("O51_cv_evaluate_bayes", _bayes_sql("c as (select * from (values (0, 0.5::double), (1, 0.2::double)) as t(config_id, threshold))", f'select config_id, {", ".join(f"{chr(34)}{c}{chr(34)}" for c in _MEANS)} from m'))
def _o51_bayes(spark, d):
    return _means(evaluate.cv_evaluate(_five(spark, d), [{"config_id": 0, "threshold": 0.5}, {"config_id": 1, "threshold": 0.2}], evaluate.bayes), "config_id")


@query("O52_run_design_bayes", _bayes_sql(_CUTS.format(seed=11, n=5), f'select config_id, round(threshold, 9) as threshold, {", ".join(f"{chr(34)}{c}{chr(34)}" for c in _MEANS)} from m'))
def _o52_bayes(spark, d):
    out = evaluate.run_design(_five(spark, d), sampling.random_configs(spark, _CUT, 5, 11), _CUT, evaluate.bayes)
    return _means(out.withColumn("threshold", _r("threshold", 9)), "config_id", "threshold")


_BEST = f'select {{head}}round(threshold, 9) as threshold, {", ".join(f"{chr(34)}{c}{chr(34)}" for c in _MEANS)}{{tail}} from m order by acc desc, config_id limit 1'


def _winner(df: DataFrame, *more: str) -> DataFrame:
    return _means(df.withColumn("threshold", F.round(F.element_at("hyperparameters", F.lit("threshold")), 9)), *more, "threshold")


@query("O53_evaluate_candidates_bayes", _bayes_sql(_CUTS.format(seed=12, n=5), _BEST.format(head="config_id, ", tail="")))
def _o53_bayes(spark, d):
    return _winner(evaluate.evaluate_candidates(_five(spark, d), sampling.random_configs(spark, _CUT, 5, 12), _CUT, evaluate.bayes)[0], "config_id")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Five correlated metrics for each supplier."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg(1 - F.col("l_discount")).alias("Accuracy_Mean"), F.avg(1 - F.col("l_discount") - F.col("l_tax") / 2).alias("Precision_Mean"),
        F.avg(1 - F.col("l_tax")).alias("Recall_Mean"), F.avg(F.col("l_extendedprice") / 1e5).alias("Specificity_Mean"), F.avg("l_quantity").alias("Time_MeanFold"))
    return g


@query("O54_factor_scores")
def _o54(spark, d):
    out, _ = factors.factor_scores(_measured(spark, d))
    return out.select("l_suppkey", *[c for c in out.columns if c.endswith("_SCORE") or c.startswith("Score_")])


@query("O54_factor_scores_untimed", """with f as (select l_suppkey, avg(l_quantity) as a, avg(l_quantity + l_extendedprice / 10000.0::double) as b from lineitem group by 1),
z as (select l_suppkey, (a - avg(a) over ()) / stddev_samp(a) over () + (b - avg(b) over ()) / stddev_samp(b) over () as s from f)
select l_suppkey, round(s / sqrt(2), 6) as "FACTOR1_SCORE", round((s - avg(s) over ()) / stddev_samp(s) over (), 6) as "Score_Quality", 0.0::double as "Score_Cost" from z""")
def _o54_untimed(spark, d):
    """Two metrics that go together, without a time: their first component has weights of one half, squared."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"), F.avg(F.col("l_quantity") + F.col("l_extendedprice") / 10000).alias("b"))
    out, _ = factors.factor_scores(rows, ["a", "b"], time_metric=None, k=1, rotation="none")
    return out.select("l_suppkey", *[_r(c).alias(c) for c in ("FACTOR1_SCORE", "Score_Quality", "Score_Cost")])


_SCORES_BY = """with f as (select l_returnflag, l_suppkey, avg(l_quantity) as a, avg(l_quantity + l_extendedprice / 10000.0::double) as b from lineitem group by 1, 2),
z as (select *, (a - avg(a) over w) / stddev_samp(a) over w + (b - avg(b) over w) / stddev_samp(b) over w as s from f window w as (partition by l_returnflag))
select l_returnflag, l_suppkey, round(s / sqrt(2), 6) as "FACTOR1_SCORE", round((s - avg(s) over w) / stddev_samp(s) over w, 6) as "Score_Quality", 0.0::double as "Score_Cost" from z window w as (partition by l_returnflag)"""


@query("O54_factor_scores_by", _SCORES_BY)
def _o54_by(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("a"), F.avg(F.col("l_quantity") + F.col("l_extendedprice") / 10000).alias("b"))
    out = factors.factor_scores_by(rows, ["l_returnflag"], ["a", "b"], time_metric=None, k=1, rotation="none")
    return out.select("l_returnflag", "l_suppkey", *[_r(c).alias(c) for c in ("FACTOR1_SCORE", "Score_Quality", "Score_Cost")])


@query("O54_factor_scores_by_automatic", _SCORES_BY)
def _o54_by_automatic(spark, d):
    """The same, each group with as many factors as have an eigenvalue over 1, which is one."""
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("a"), F.avg(F.col("l_quantity") + F.col("l_extendedprice") / 10000).alias("b"))
    out = factors.factor_scores_by(rows, ["l_returnflag"], ["a", "b"], time_metric=None, automatic=True, rotation="none", on_missing="error")
    return out.select("l_returnflag", "l_suppkey", *[_r(c).alias(c) for c in ("FACTOR1_SCORE", "Score_Quality", "Score_Cost")])


def _surfaces(spark: SparkSession, d: str) -> list[surface.Surface]:
    rows = views.surface_input(spark, d).withColumn("cheap", -F.col("y") - F.col("a") / 10)
    return [surface.fit_surface(rows, ["a", "b", "c"], y) for y in ("y", "cheap")]


@query("O55_fit_surface")
def _o55(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_returnflag", "l_quantity as a", "l_discount as b", "l_tax as c", "l_extendedprice / 1000 as y")
    return surface.surfaces_by(rows, ["a", "b", "c"], "y", ["l_returnflag"])


_QUADRATIC = """with r as (select {by}, l_quantity::double as u, (l_quantity * l_quantity)::double as v, l_extendedprice / 1000 as y from lineitem),
s as (select {by}, count(*) as n, avg(u) as mu, avg(v) as mv, avg(y) as my, var_pop(u) as uu, var_pop(v) as vv, covar_pop(u, v) as uv, covar_pop(u, y) as uy, covar_pop(v, y) as vy, var_pop(y) as yy from r group by {by}),
b as (select *, (uy * vv - vy * uv) / (uu * vv - uv * uv) as p, (vy * uu - uy * uv) / (uu * vv - uv * uv) as q from s)
select {by}, t.term, round(case t.i when 0 then my - p * mu - q * mv when 1 then p else q end, 5) as coef, round((p * uy + q * vy) / yy, 6) as r2, n
from b, (values (0, 'Intercept'), (1, 'a'), (2, 'a*a')) as t(i, term)"""


@query("O55_fit_surface_by_supplier", _QUADRATIC.format(by="l_suppkey"))
def _o55_supplier(spark, d):
    """A surface of one factor for each supplier; with ``alpha`` 1 nothing is eliminated."""
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_quantity as a", "l_extendedprice / 1000 as y")
    return surface.surfaces_by(rows, ["a"], "y", ["l_suppkey"], alpha=1.0).select("l_suppkey", "term", _r("coef", 5).alias("coef"), _r("r2").alias("r2"), "n")


@query("O56_frontier_search")
def _o56(spark, d):
    box = {"a": Factor(1, 50, True), "b": Factor(0.0, 0.1), "c": Factor(0.0, 0.08)}
    ends = metrics.extremes(views.surface_input(spark, d).withColumn("cheap", -F.col("y") - F.col("a") / 10), ["y", "cheap"]).first()
    found = frontier.frontier_search(spark, *_surfaces(spark, d), box, step=0.1, starts=6, samples=60, rounds=4, utopia=(ends[0], ends[2]), nadir=(ends[1], ends[3]))
    return found.withColumn("hyperparameters", F.to_json("hyperparameters"))


@query("O56_frontier_round", f"""with r as (select l_quantity::double as u, (l_quantity * l_quantity)::double as v, l_extendedprice / 1000 as y from lineitem),
s as (select avg(u) as mu, avg(v) as mv, avg(y) as my, var_pop(u) as uu, var_pop(v) as vv, covar_pop(u, v) as uv, covar_pop(u, y) as uy, covar_pop(v, y) as vy, max(y) as y1, min(y) as y0, max(-y - u / 10) as c1, min(-y - u / 10) as c0 from r),
b as (select *, (uy * vv - vy * uv) / (uu * vv - uv * uv) as p, (vy * uu - uy * uv) / (uu * vv - uv * uv) as q from s),
w as (select i as pair, round(1 - i * 0.1::double, 2) as beta_1, round(i * 0.1::double, 2) as beta_2 from (select unnest(range(1, 11)) as i)),
t as (select i as start, case when i = 0 then 25.5 else 1 + {_DRAW.format(seed=42, name="a", key="i")} * 49 end as a from (select unnest(range(4)) as i)),
m as (select start, greatest(1, a - 24.5) as lo, least(50, a + 24.5) as hi, unnest(range(1, 26)) as n from t),
z as (select start, a from t union all select start, lo + {_DRAW.format(seed=1042, name="a", key="start || '-' || n")} * (hi - lo) from m),
x as (select start, a, my - p * mu - q * mv + p * a + q * a * a as p1, y0, y1, c0, c1 from z, b),
k as (select *, -p1 - a / 10 as p2 from x),
g as (select beta_1, beta_2, p1, p2, case when p1 between y0 and y1 and p2 between c0 and c1 then beta_1 * (p1 - y0) / (y1 - y0) + beta_2 * (p2 - c0) / (c1 - c0) end as v, start from k, w)
select beta_1, beta_2, round(v, 6) as score, round(p1, 4) as "Pred_Score_Quality", round(p2, 4) as "Pred_Score_Cost", v is not null as success
from g qualify row_number() over (partition by beta_2 order by v desc nulls last, start) = 1""")
def _o56_round(spark, d):
    """The starts and one round of draws around them, under two surfaces of one factor."""
    rows = views.surface_input(spark, d).withColumn("cheap", -F.col("y") - F.col("a") / 10)
    ends = metrics.extremes(rows, ["y", "cheap"]).first()
    fits = [surface.fit_surface(rows, ["a"], y, alpha=1.0) for y in ("y", "cheap")]
    found = frontier.frontier_search(spark, *fits, {"a": Factor(1.0, 50.0)}, step=0.1, starts=4, samples=25, rounds=1, utopia=(ends[0], ends[2]), nadir=(ends[1], ends[3]), polished=False)
    return found.select("beta_1", "beta_2", _r("score").alias("score"), *[_r(c, 4).alias(c) for c in ("Pred_Score_Quality", "Pred_Score_Cost")], "success")


#: Two surfaces of one factor for each flag, their range and the weights, in SQL.
_FLAGS = """with r as (select l_returnflag, l_quantity::double as u, (l_quantity * l_quantity)::double as v, l_extendedprice / 1000 as y from lineitem),
s as (select l_returnflag, avg(u) as mu, avg(v) as mv, avg(y) as my, var_pop(u) as uu, var_pop(v) as vv, covar_pop(u, v) as uv, covar_pop(u, y) as uy, covar_pop(v, y) as vy, max(y) as y1, min(y) as y0, max(-y - u / 10) as c1, min(-y - u / 10) as c0 from r group by 1),
b as (select l_returnflag, ascii(l_returnflag) as seed, p, q, my - p * mu - q * mv as k, y0, y1, c0, c1 from (select *, (uy * vv - vy * uv) / (uu * vv - uv * uv) as p, (vy * uu - uy * uv) / (uu * vv - uv * uv) as q from s)),
w as (select i as pair, round(1 - i * 0.1::double, 2) as beta_1, round(i * 0.1::double, 2) as beta_2 from (select unnest(range(1, 11)) as i)),"""
_FLAGS_LAST = """k as (select *, p1, -p1 - a / 10 as p2 from x),
g as (select l_returnflag, beta_1, beta_2, p1, p2, case when p1 between y0 and y1 and p2 between c0 and c1 then beta_1 * (p1 - y0) / (y1 - y0) + beta_2 * (p2 - c0) / (c1 - c0) end as v, start from k, w)
select l_returnflag, beta_1, beta_2, round(v, 6) as score, round(p1, 4) as "Pred_Score_Quality", round(p2, 4) as "Pred_Score_Cost", v is not null as success
from g qualify row_number() over (partition by l_returnflag, beta_2 order by v desc nulls last, start) = 1"""


def _by_flag(spark: SparkSession, d: str, **more) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_returnflag", "cast(l_quantity as double) as a", "l_extendedprice / 1000 as y", "-l_extendedprice / 1000 - l_quantity / 10 as cheap")
    by, groups = ["l_returnflag"], metrics.extremes(rows, ["y", "cheap"], ["l_returnflag"])
    groups = groups.select(*by, F.ascii("l_returnflag").alias("seed"), *[F.col(f"{y}_{e}").cast("double").alias(f"{e}_{i}") for i, y in ((1, "y"), (2, "cheap")) for e in ("nadir", "utopia")])
    for y, name in (("y", "quality"), ("cheap", "cost")):
        groups = groups.join(surface.coefficient_arrays(surface.surfaces_by(rows, ["a"], y, by, alpha=1.0), ["a"], by, name), by)
    found = frontier.frontier_search_by(materialize(groups, "groups"), by, {"a": Factor(1.0, 50.0)}, step=0.1, **more)
    return found.select(*by, "beta_1", "beta_2", _r("score").alias("score"), *[_r(c, 4).alias(c) for c in ("Pred_Score_Quality", "Pred_Score_Cost")], "success")


@query("O56_frontier_round_by", _FLAGS + f"""
t as (select *, case when i = 0 then 25.5 else 1 + {_DRAW.format(seed="' || seed || '", name="a", key="i")} * 49 end as a from b, (select unnest(range(4)) as i)),
m as (select *, greatest(1, a - 24.5) as lo, least(50, a + 24.5) as hi from t),
z as (select l_returnflag, k as c, p, q, y0, y1, c0, c1, i as start, a from t
  union all select l_returnflag, k, p, q, y0, y1, c0, c1, i, lo + {_DRAW.format(seed="' || (seed + 1000) || '", name="a", key="i || '-' || n")} * (hi - lo) from m, (select unnest(range(1, 26)) as n)),
x as (select *, c + p * a + q * a * a as p1 from z),
""" + _FLAGS_LAST)
def _o56_round_by(spark, d):
    """Starts and one round of draws of all groups, each with a seed of its own."""
    return _by_flag(spark, d, starts=4, samples=25, rounds=1, polished=False)


@query("O56_frontier_polished_by", _FLAGS + """
e as (select *, beta_1 / (y1 - y0) as s1, beta_2 / (c1 - c0) as s2 from b, w),
t as (  -- where the best point of a box of one factor can be: its ends, the vertex of the sum, and where a prediction meets its range
  select l_returnflag, pair, unnest([1.0, 50.0, -((s1 - s2) * p - s2 / 10) / (2 * (s1 - s2) * q)]) as a from e
  union all select l_returnflag, pair, unnest([(-p + sqrt(p * p - 4 * q * (k - edge))) / (2 * q), (-p - sqrt(p * p - 4 * q * (k - edge))) / (2 * q)]) from (select *, unnest([y0, y1]) as edge from e) where p * p >= 4 * q * (k - edge)
  union all select l_returnflag, pair, unnest([(-(p + 0.1) + sqrt((p + 0.1) * (p + 0.1) - 4 * q * (k + edge))) / (2 * q), (-(p + 0.1) - sqrt((p + 0.1) * (p + 0.1) - 4 * q * (k + edge))) / (2 * q)]) from (select *, unnest([c0, c1]) as edge from e) where (p + 0.1) * (p + 0.1) >= 4 * q * (k + edge)),
h as (select e.*, a, k + p * a + q * a * a as p1, -k - p * a - q * a * a - a / 10 as p2 from e join t using (l_returnflag, pair) where a between 1 and 50)
select l_returnflag, beta_1, beta_2, round(s1 * (p1 - y0) + s2 * (p2 - c0), 6) as score, round(p1, 4) as "Pred_Score_Quality", round(p2, 4) as "Pred_Score_Cost", true as success
from h where p1 between y0 - 1e-9 and y1 + 1e-9 and p2 between c0 - 1e-9 and c1 + 1e-9 qualify row_number() over (partition by l_returnflag, beta_2 order by s1 * (p1 - y0) + s2 * (p2 - c0) desc) = 1""")
def _o56_polished_by(spark, d):
    """The polished frontier of all groups, which for one factor is exact."""
    return _by_flag(spark, d, starts=4, samples=10, rounds=2)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("hyperparameters", F.to_json("hyperparameters"))


@query("O57_grid_search")
def _o57(spark, d):
    return _shown(search.grid_search(_five(spark, d), _TUNED, 8))


@query("O58_random_search")
def _o58(spark, d):
    return _shown(search.random_search(_five(spark, d), _TUNED, 8))


@query("O57_grid_search_bayes", _bayes_sql("c as (select i as config_id, 0.05::double + (0.95::double - 0.05::double) * i / 4 as threshold from (select unnest(range(5)) as i))", _BEST.format(head="'grid' as method, ", tail=", 5 as budget")))
def _o57_bayes(spark, d):
    return _winner(search.grid_search(_five(spark, d), _CUT, 5, factory=evaluate.bayes), "method", "budget")


@query("O58_random_search_bayes", _bayes_sql(_permutation(3, 4, 12, 42) + """,
c as (select i as config_id, threshold from (select i, r * 3 + l as place from perm where r * 3 + l < 10 order by i limit 5) join (select i as place, """ + f"0.05::double + {_DRAW.format(seed=42, name='threshold', key='i')} * (0.95::double - 0.05::double) as threshold from (select unnest(range(10)) as i)) using (place))", _BEST.format(head="'random' as method, ", tail=", 5 as budget")))
def _o58_bayes(spark, d):
    return _winner(search.random_search(_five(spark, d), _CUT, 5, factory=evaluate.bayes), "method", "budget")


@query("O59_surrogate_search")
def _o59(spark, d):
    return _shown(search.surrogate_search(_five(spark, d), _TUNED, 8, pool=5_000))


@query("O59_surrogate_scores", """with h as (select l_returnflag, avg(l_discount) / 0.1::double as x, avg(l_tax) as y from lineitem group by 1),
a as (select l_returnflag as f, x, (y - avg(y) over ()) / stddev_pop(y) over () as z, avg(y) over () as mu, stddev_pop(y) over () as sd, max(y) over () as top from h),
k as (  -- three evaluations: the kernel matrix by its entries, and its inverse by cofactors
  select p.x as xa, q.x as xn, r.x as xr, p.z as za, q.z as zn, r.z as zr, p.mu, p.sd, 1.01::double as d,
    exp((p.x - q.x) * (q.x - p.x) / 0.18) as u, exp((p.x - r.x) * (r.x - p.x) / 0.18) as v, exp((q.x - r.x) * (r.x - q.x) / 0.18) as w from a p, a q, a r where p.f = 'A' and q.f = 'N' and r.f = 'R'),
m as (select *, d * (d * d - w * w) - u * (u * d - v * w) + v * (u * w - v * d) as det from k),
i as (select *, (d * d - w * w) / det as aa, (v * w - u * d) / det as an, (u * w - v * d) / det as ar, (d * d - v * v) / det as nn, (u * v - w * d) / det as nr, (d * d - u * u) / det as rr from m),
g as (select p_partkey as config_id, (p_partkey % 100) / 100.0::double as t from part),
e as (select config_id, i.*, exp((t - xa) * (xa - t) / 0.18) as ka, exp((t - xn) * (xn - t) / 0.18) as kn, exp((t - xr) * (xr - t) / 0.18) as kr from g, i)
select config_id, round(mu + sd * (ka * (aa * za + an * zn + ar * zr) + kn * (an * za + nn * zn + nr * zr) + kr * (ar * za + nr * zn + rr * zr)), 9) as mean,
  round(sd * sqrt(greatest(0, 1 - ka * (aa * ka + an * kn + ar * kr) - kn * (an * ka + nn * kn + nr * kr) - kr * (ar * ka + nr * kn + rr * kr))), 7) as deviation from e""")
def _o59_scores(spark, d):
    """The posterior of three evaluations, one a flag, over all parts."""
    past = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("Accuracy_Mean"))
    pool = table(spark, d, "part").select(F.col("p_partkey").alias("config_id"), ((F.col("p_partkey") % 100) / 1000).alias("x"))
    found = search.surrogate_scores(past, pool, {"x": Factor(0.0, 0.1)}, (0.3,), (0.01,))
    return found.select("config_id", _r("mean", 9).alias("mean"), _r("deviation", 7).alias("deviation"))


@query("O60_density_search")
def _o60(spark, d):
    return _shown(search.density_search(_five(spark, d), _TUNED, 8, pool=5_000))


@query("O60_density_pick", """with b as (select l_suppkey, avg(l_discount) as x, avg(l_tax) as acc from lineitem group by 1),
h as (select x, percent_rank() over (order by acc desc) <= 0.25 as good from b),
p as (select p_partkey as config_id, (p_partkey % 100) / 1000.0::double as x from part),
k as (select p.config_id, avg(case when good then exp(-((p.x - h.x) / 0.02) * ((p.x - h.x) / 0.02) / 2) end) as l, avg(case when not good then exp(-((p.x - h.x) / 0.02) * ((p.x - h.x) / 0.02) / 2) end) as g from p, h group by 1)
select config_id from k order by round(ln(l + 1e-12) - ln(g + 1e-12), 9) desc, config_id limit 10""")
def _o60_pick(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("Accuracy_Mean"))
    pool = table(spark, d, "part").select(F.col("p_partkey").alias("config_id"), ((F.col("p_partkey") % 100) / 1000).alias("x"))
    return search.density_pick(rows, pool, {"x": Factor(0.0, 0.1)}, 10).select("config_id")


@query("O61_combine_scores", """with f as (select l_suppkey, avg(l_discount) as f1, avg(l_tax) as f2, avg(l_quantity) as f3 from lineitem group by 1)
select l_suppkey, round(((f1 - avg(f1) over ()) / stddev_samp(f1) over () + 2 * (f2 - avg(f2) over ()) / stddev_samp(f2) over ()) / 3, 6) as "Score_Quality",
  round(-(f3 - avg(f3) over ()) / stddev_samp(f3) over (), 6) as "Score_Cost" from f""")
def _o61(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("f2"), F.avg("l_quantity").alias("f3"))
    return factors.combine_scores(rows, ["f1", "f2", "f3"], "f3", "f1", [1.0, 2.0]).select("l_suppkey", _r("Score_Quality").alias("Score_Quality"), _r("Score_Cost").alias("Score_Cost"))


@query("O61_combine_scores_single", """with f as (select l_suppkey, avg(l_discount) as f1, avg(l_tax) as f2, avg(l_quantity) as f3 from lineitem group by 1)
select l_suppkey, round((f2 - avg(f2) over ()) / stddev_samp(f2) over (), 6) as "Score_Quality", round(-(f3 - avg(f3) over ()) / stddev_samp(f3) over (), 6) as "Score_Cost" from f""")
def _o61_single(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("f2"), F.avg("l_quantity").alias("f3"))
    return factors.combine_scores(rows, ["f1", "f2", "f3"], "f3", "f2", combine=False).select("l_suppkey", _r("Score_Quality").alias("Score_Quality"), _r("Score_Cost").alias("Score_Cost"))


@query("O62_pick_candidates", """with n as (select p_partkey as config_id, p_size::double as a, p_partkey::double as b, least(greatest((p_retailprice - 950) / 800, 0), 1) as q, least(greatest((p_size - 5) / 40.0::double, 0), 1) as c from part)
select config_id, a, b from n order by (1 - q) * (1 - q) + (1 - c) * (1 - c), config_id limit 25""")
def _o62_pick(spark, d):
    found = views.configs(spark, d).join(table(spark, d, "part").withColumnRenamed("p_partkey", "config_id"), "config_id")
    found = found.select(F.col("p_retailprice").alias("Pred_Score_Quality"), F.col("p_size").cast("double").alias("Pred_Score_Cost"), (F.col("config_id") / 100).alias("beta_2"), (F.col("config_id") % 2 == 0).alias("success"), "hyperparameters")
    return pipeline.pick_candidates(found, {"a": Factor(0, 50), "b": Factor(0, 10**6)}, 25, (1750.0, 45.0), (950.0, 5.0))


def _small(seed: int) -> dict:
    return {"top": 5, "budget": 8, "search": {"step": 0.1, "starts": 6, "samples": 40, "rounds": 3}, "metrics": ["Accuracy_Mean", "Precision_Mean", "Recall_Mean", "Specificity_Mean", "Time_MeanFold"]}


@query("O62_replica_pipeline")
def _o62(spark, d):
    out = pipeline.replica_pipeline(_labelled(spark, d), _FEATURES, "y", "vec_id", _design(spark, 8), _TUNED, 42, **_small(42))
    return _shown(out)


@query("O63_replicate")
def _o63(spark, d):
    out = pipeline.replicate(_labelled(spark, d), _FEATURES, "y", "vec_id", _design(spark, 8), _TUNED, [(0, 42), (1, 43)], baselines=(), **_small(42))
    return _shown(out) if "hyperparameters" in out.columns else out


def _part_of(name: str):
    return lambda spark, d: pipeline.aggregate_runs(views.runs(spark, d))[name]


_RUN_STATS = ", ".join(f'{"round(" if f != "count" else ""}{g}("{c}"){", 9)" if f != "count" else ""} as "{c}_{f}"' for c in ("Accuracy_Mean", "Time_MeanFold") for f, g in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"), ("min", "min"), ("max", "max"), ("count", "count")))


@query("O64_aggregate_stats", f"select method, {_RUN_STATS} from runs group by method", "runs")
def _o64_stats(spark, d):
    out = _part_of("stats")(spark, d)
    return out.select("method", *[(c if c.endswith("_count") else _r(c, 9).alias(c)) for c in out.columns if c != "method"])


@query("O64_aggregate_wins", _WIN_SQL.format(v="runs"), "runs")
def _o64_wins(spark, d):
    return _wins(_part_of("win_rate")(spark, d))


@query("O64_aggregate_pareto", _FRONT_SQL.format(v="runs"), "runs")
def _o64_pareto(spark, d):
    return _front(_part_of("pareto")(spark, d))


@query("O64_aggregate_pareto_rate", _RATE_SQL, "runs")
def _o64_rate(spark, d):
    return _part_of("pareto_rate")(spark, d).select("method", "pareto_count", _r("pareto_rate", 9).alias("pareto_rate"))
