"""Queries of preference pairs, logs, partitions and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scores as V
from quillspark.operators import preference as P
from quillspark.operators import sampling as M
from quillspark.plans.rounding import rounded
from quillspark.sources.tables import image_key, table


def _history(spark, d):
    return table(spark, d, "annotation_history").dropDuplicates(["id"]).select("id", image_key(F.col("image_id")).alias("key"), F.col("version").cast("bigint").alias("version"), "created_at").where("key is not null")


def _candidates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.max(F.round(F.col("l_extendedprice") / 1000, 1)).alias("score"))


def _pairs(spark, d):
    return P.best_and_worst(_candidates(spark, d), "l_orderkey", "line", "score").withColumn("delta", F.round("delta", 1))


def w15_latest(spark, d):
    return P.latest(_history(spark, d).select("key", "id", "version"), ["key"], "id")


def w16_best_worst(spark, d):
    return rounded(_pairs(spark, d), 1)


def f10_pairs_apart(spark, d):
    return rounded(P.at_least(_pairs(spark, d), 50.0).select("l_orderkey", "delta"), 1)


def f14_positive(spark, d):
    return rounded(_candidates(spark, d).withColumn("score", F.round(F.col("score") - 50, 1)).where("score > 0"), 1)


def a31_margins(spark, d):
    return rounded(P.normalised(_pairs(spark, d)).select("l_orderkey", "margin"), 4)


def a31_margins_with_facts(spark, d):
    return rounded(P.normalised(_pairs(spark, d), F.col("l_orderkey") % 3 == 0).select("l_orderkey", "margin"), 4)


def x24_gammas(spark, d):
    return rounded(P.margins(_pairs(spark, d), [1.0, 2.0, 4.0]).select("l_orderkey", "gamma", "margin"), 3)


def x36_adaptive(spark, d):
    m = V.adaptive_margin(F.col("delta") / 10, F.col("delta") / 20, F.col("candidates").cast("double"), F.col("l_orderkey") % 3 + 1)
    return rounded(_pairs(spark, d).select("l_orderkey", m.alias("margin")), 6)


def x37_gamma(spark, d):
    return rounded(P.calibrated_gamma(P.normalised(_pairs(spark, d)), "margin", "delta"), 6)


def x38_flipped(spark, d):
    pairs = _pairs(spark, d).select("l_orderkey", F.col("best").alias("chosen"), F.col("worst").alias("rejected"), (F.col("delta") - 40).alias("fact_delta"))
    return rounded(P.flipped(pairs, "fact_delta", 20.0).select("l_orderkey", "chosen", "rejected", "strong"))


def a37_margin_summary(spark, d):
    m = P.normalised(_pairs(spark, d))
    return rounded(m.agg(F.count(F.lit(1)).alias("n"), F.min("margin").alias("low"), F.max("margin").alias("high"), F.avg("margin").alias("mean"), F.count_if(F.col("margin") >= 1).alias("strong")), 3)


def w17_next_version(spark, d):
    return P.next_version(_history(spark, d), "key")


def w18_parts(spark, d):
    return rounded(P.numbered_parts(table(spark, d, "customer").select("c_custkey"), 7, "c_custkey"))


def m01_uniform(spark, d):
    return M.uniform(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 3)


def m02_stratified(spark, d):
    targets = spark.createDataFrame([("open_crawl", 40), ("desk_charts", 20), ("field_uploads", 1000)], "source string, target int")
    return M.stratified(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", targets, 3)


def m03_by_ratio(spark, d):
    ratios = spark.createDataFrame([("open_crawl", 0.5), ("desk_charts", 0.3), ("wire_scans", 0.17)], "source string, ratio double")
    return M.stratified(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", M.ratio_targets(ratios, "source", 101), 5)


def m05_split(spark, d):
    return M.split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.9, 7)


def m06_expanded(spark, d):
    quotas = table(spark, d, "sampling_targets").where("config_name = 'by_chart'").groupBy("chart_type").agg((F.max("ratio") * 0.9).alias("quota"))
    return rounded(M.expanded(quotas, "chart_type", 777, 9))


def m07_weighted(spark, d):
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", 0.0), ("d", 0.5)], "kind string, weight double")
    return M.weighted_pick(table(spark, d, "documents").select("doc_id"), "doc_id", weights, "kind", 11)


def m08_affinities(spark, d):
    tasks = table(spark, d, "task_definitions").dropDuplicates(["task_id"]).where("chart_type is not null and theme is not null")
    tasks = tasks.select(F.lower(F.trim("chart_type")).alias("chart"), F.translate(F.lower(F.trim("theme")), "-", "_").alias("theme"))
    chances = tasks.groupBy("chart", "theme").agg(F.count(F.lit(1)).cast("double").alias("p"))
    affinity = spark.createDataFrame([("pie", "bonds", 0.9), ("pie", "default", 0.2), ("line", "shipping", 0.0), ("line", "default", 0.7)], "chart string, theme string, affinity double")
    banned = spark.createDataFrame([("bar", "prices"), ("radar", "bonds")], "chart string, theme string")
    return rounded(M.affinity_distribution(chances, affinity, banned, "chart", "theme"), 9)


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__[0] != "_"}

_KEY = "lower(regexp_replace(image_id, '^\\s+|\\s+$', '', 'g'))"
_HISTORY = f"with h as (select distinct on (id) id, nullif({_KEY}, '') as key, cast(version as bigint) as version from annotation_history) "
_PAIRS = """with c as (select l_orderkey, cast(l_linenumber as bigint) as line, max(round(l_extendedprice / 1000, 1)) as score from lineitem group by all),
b as (select l_orderkey, arg_max(line, {'s': score, 'l': -line}) as best, arg_min(line, {'s': score, 'l': line}) as worst, count(*) as candidates,
  round(max(score) - min(score), 1) as delta from c where score > 0 group by 1),
p as (select * from b where best <> worst)"""
_HASH = "md5('{seed}:' || {key})"
_UNIT = "cast('0x' || substr(md5('{seed}:' || {key}), 1, 13) as bigint) / 4503599627370496.0"

SQL = {
    "w15_latest": _HISTORY + "select key, max(id) as id, arg_max(version, id) as version from (select *, row_number() over (partition by key order by id desc) as k from h where key is not null) where k = 1 group by key",
    "w16_best_worst": _PAIRS + " select l_orderkey, best, worst, candidates, delta from p",
    "f10_pairs_apart": _PAIRS + " select l_orderkey, delta from p where delta >= 50",
    "f14_positive": _PAIRS + " select l_orderkey, line, round(score - 50, 1) as score from c where round(score - 50, 1) > 0",
    "a31_margins": _PAIRS + " select l_orderkey, round(delta / (select avg(delta) from p), 4) as margin from p",
    "a31_margins_with_facts": _PAIRS + " select l_orderkey, case when l_orderkey % 3 = 0 then round(delta / (select avg(delta) from p where l_orderkey % 3 = 0), 4) else 1.0 end as margin from p",
    "x24_gammas": _PAIRS + " select l_orderkey, g::double as gamma, round(round(greatest(0, g * delta), 4), 3) as margin from p, (select unnest([1, 2, 4]) as g)",
    "x36_adaptive": _PAIRS
    + ", a as (select *, 0.5::double * least(candidates / 10.0::double, 1) * case l_orderkey % 3 when 0 then 1.0::double when 1 then 0.6::double else 0.0::double end as a from p) select l_orderkey, round(a * delta / 10 + (1 - a) * delta / 20, 6) as margin from a",
    "x37_gamma": _PAIRS + ", m as (select delta, round(delta / (select avg(delta) from p), 4) as margin from p) select round(0.3 * avg(margin) / avg(abs(delta)), 6) as gamma from m",
    "x38_flipped": _PAIRS + " select l_orderkey, case when delta - 40 < 0 then worst else best end as chosen, case when delta - 40 < 0 then best else worst end as rejected, abs(delta - 40) > 20 as strong from p",
    "a37_margin_summary": _PAIRS + ", m as (select round(delta / (select avg(delta) from p), 4) as margin from p) select count(*) as n, round(min(margin), 3) as low, round(max(margin), 3) as high, round(avg(margin), 3) as mean, count(*) filter (margin >= 1) as strong from m",
    "w17_next_version": _HISTORY + "select key, coalesce(max(version), 0) + 1 as next from h where key is not null group by key",
    "w18_parts": "with r as (select c_custkey, row_number() over (order by c_custkey) - 1 as ordinal from customer) select c_custkey, ordinal, ordinal % 7 as robin, ntile(7) over (order by ordinal) - 1 as block from r",
    "m01_uniform": "select doc_id from documents order by " + _HASH.format(seed=3, key="doc_id") + ", doc_id limit 100",
    "m02_stratified": "with t(source, target) as (values ('open_crawl', 40), ('desk_charts', 20), ('field_uploads', 1000)), r as (select doc_id, source, target, row_number() over (partition by source order by "
    + _HASH.format(seed=3, key="doc_id")
    + ", doc_id) as k from documents join t using (source)) select doc_id, source from r where k <= target",
    "m03_by_ratio": "with t(source, target) as (values ('open_crawl', 54), ('desk_charts', 30), ('wire_scans', 17)), r as (select doc_id, source, target, row_number() over (partition by source order by "
    + _HASH.format(seed=5, key="doc_id")
    + ", doc_id) as k from documents join t using (source)) select doc_id, source from r where k <= target",
    "m05_split": "select doc_id, case when row_number() over (order by " + _HASH.format(seed=7, key="doc_id") + ", doc_id) <= floor((select count(*) from documents) * 0.9) then 'train' else 'val' end as split from documents",
    "m06_expanded": "with q as (select chart_type, max(ratio) * 0.9 as quota from sampling_targets where config_name = 'by_chart' group by 1), b as (select *, cast(floor(777 * quota + 1e-9) as bigint) as n, row_number() over (order by "
    + _HASH.format(seed=9, key="chart_type")
    + ") as o, count(*) over () as k from q), g as (select *, 777 - sum(n) over () as gap from b) select chart_type, unnest(range(1, cast(n + gap // k + case when o <= gap % k then 1 else 0 end as bigint) + 1)) as copy from g",
    "m07_weighted": "with u as (select doc_id, " + _UNIT.format(seed=11, key="doc_id") + " as u from documents) select doc_id, case when u < 0.25 then 'a' when u < 0.875 then 'b' else 'd' end as kind from u",
    "m08_affinities": """with t as (select distinct on (task_id) * from task_definitions),
n as (select lower(trim(chart_type)) as chart, replace(lower(trim(theme)), '-', '_') as theme from t where chart_type is not null and theme is not null),
c as (select chart, theme, count(*)::double as p from n group by all),
s as (select *, p * case when (chart, theme) in (('bar', 'prices'), ('radar', 'bonds')) then 0 when chart = 'pie' then case when theme = 'bonds' then 0.9 else 0.2 end
  when chart = 'line' then case when theme = 'shipping' then 0 else 0.7 end else 0.5 end as w from c),
q as (select *, sum(w) over (partition by chart) as al, sum(p) over (partition by chart) as raw from s)
select chart, theme, round(case when al > 0 then w / al else p / raw end, 9) as chance from q where case when al > 0 then w / al else p / raw end > 0""",
}
