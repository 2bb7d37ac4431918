"""Queries of joins, filters, sets, order and aggregates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import aggregates as A
from quillspark.operators import relational as R
from quillspark.plans.rounding import rounded
from quillspark.sources.tables import image_key, table

_KEY = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def _annotations(spark, d):
    """Annotations once each, with the image's key."""
    return table(spark, d, "annotations").dropDuplicates(["id"]).withColumn("key", image_key(F.col("image_id")))


def _images(spark, d):
    """One row for each image: the first by time, then by status."""
    rows = table(spark, d, "images").withColumn("key", image_key(F.col("id"))).where("key is not null")
    return rows.groupBy("key").agg(F.min_by(F.struct("filename", "status", "source", "task_id", "created_at"), F.struct("created_at", "status")).alias("r")).select("key", "r.*")


_ANN = "an as (select distinct on (id) *, nullif(" + _KEY.format(c="image_id") + ", '') as key from annotations)"
_IMG = "im as (select " + _KEY.format(c="id") + " as key, arg_min({'filename': filename, 'status': status, 'source': source, 'task_id': task_id}, {'a': created_at, 'b': status}) as r from images where trim(id) <> '' group by 1)"
_WITH = f"with {_ANN}, {_IMG} "


def j01_annotations_images(spark, d):
    image = _images(spark, d).select("key", F.col("source").alias("image_source"), F.lower("status").alias("image_status"))
    return R.attach(_annotations(spark, d).select("id", "key"), image, "key")


def j02_annotated_filled(spark, d):
    rows = R.filled(_annotations(spark, d), "summary", "annotator").where("key is not null")
    return rows.join(_images(spark, d).where(F.lower("status") == "annotated").select("key", "source"), "key").select("id", "key", "source")


def j03_decontaminated(spark, d):
    tested = table(spark, d, "split_members").where("split != 'train'").select(image_key(F.col("image_id")).alias("key"))
    return R.excluded(_annotations(spark, d).select("id", "key"), tested, "key")[0].select("id")


def j04_excluded(spark, d):
    tested = table(spark, d, "split_members").where("split != 'train'").select(image_key(F.col("image_id")).alias("key"))
    return R.excluded(_annotations(spark, d).select("id", "key"), tested, "key")[1].select("id")


def j05_pending(spark, d):
    return R.pending(_images(spark, d).select("key"), _annotations(spark, d).select("key"), "key")


def j08_default(spark, d):
    tasks = table(spark, d, "task_definitions").select("task_id", F.lower(F.trim("theme")).alias("theme")).where("task_id is not null")
    return R.with_default(_images(spark, d).select("key", "task_id"), tasks, "task_id", "theme", "none", F.col("theme").isNotNull()).select("key", "theme")


def j09_two_hops(spark, d):
    task = table(spark, d, "task_definitions").select("task_id", "indicator").dropDuplicates(["task_id"])
    kinds = table(spark, d, "indicators").select("indicator", "shape", F.col("theme").alias("indicator_theme"))
    hop = R.attach(_images(spark, d).select("key", "task_id").where("task_id is not null"), task, "task_id")
    return hop.join(kinds, "indicator").select("key", "task_id", "indicator", "shape", "indicator_theme")


def j14_history(spark, d):
    history = table(spark, d, "annotation_history").dropDuplicates(["id"]).select(image_key(F.col("image_id")).alias("key"), F.col("id").alias("row"), F.col("version").cast("int").alias("version"))
    nested = R.nested_history(_images(spark, d).select("key"), history.where("key is not null"), "key", ["row"], ["version"])
    return nested.select("key", F.size("history").cast("bigint").alias("versions"), F.array_join(F.transform("history", lambda h: F.coalesce(h["version"].cast("string"), F.lit("-"))), ",").alias("order"))


def j20_without_status(spark, d):
    status = _annotations(spark, d).where("key is not null").groupBy("key").agg(F.max("status").alias("annotation_status"))
    joined = R.attach(_images(spark, d).select("key"), status, "key")
    return joined.where(~F.col("annotation_status").eqNullSafe("annotated")).select("key", "annotation_status")


def j17_cross(spark, d):
    themes = table(spark, d, "indicators").select("theme").distinct()
    return R.cross(themes, table(spark, d, "data_sources").select(F.col("name").alias("source")))


def f02_by_status(spark, d):
    return R.equal_or_all(_images(spark, d).withColumn("status", F.lower("status")), "status", "deleted").select("key", "status")


def f03_filled(spark, d):
    return R.filled(_annotations(spark, d), "summary", "modification_note").select("id")


def f04_complete(spark, d):
    return table(spark, d, "task_definitions").dropDuplicates(["task_id"]).na.drop("any").select("task_id")


def f06_finite(spark, d):
    return R.finite(_annotations(spark, d).select("id", F.col("annotated_at").cast("double").alias("t")), "t").select("id")


def f08_prefixes(spark, d):
    return R.with_prefix(table(spark, d, "indicators"), "indicator", ["prices.", "bonds."]).select("indicator")


def f11_allowed(spark, d):
    tasks = table(spark, d, "task_definitions").dropDuplicates(["task_id"]).select("task_id", F.lower(F.trim("chart_type")).alias("chart_type"), F.lower(F.trim("theme")).alias("theme"))
    banned = spark.createDataFrame([("pie", "bonds"), ("candlestick", "property"), ("line", "shipping")], "chart_type string, theme string")
    return R.without_combinations(tasks, banned).select("task_id", "chart_type", "theme")


def f15_visible(spark, d):
    return R.without_hidden(table(spark, d, "images"), "filename").select("filename").distinct()


def f16_checked(spark, d):
    rows = R.checked(table(spark, d, "task_definitions").dropDuplicates(["task_id"]), "visual_style", ["macro", "quant"])
    return rows.select("task_id", "valid")


def f17_ready(spark, d):
    members = table(spark, d, "split_members").select("member_id", image_key(F.col("image_id")).alias("key")).distinct().where("key is not null")
    told = table(spark, d, "messages").select(image_key(F.col("image_id")).alias("key"))
    return R.pending(R.excluded(members, _annotations(spark, d), "key")[1], told, "key").select("member_id")


def u01_union(spark, d):
    a = _annotations(spark, d).select("key", F.col("summary").alias("text"))
    h = table(spark, d, "annotation_history").dropDuplicates(["id"]).select(image_key(F.col("image_id")).alias("key"), F.col("version").cast("int").alias("version"))
    return rounded(R.union_all(a, None, h).groupBy("key").agg(F.count("text").alias("texts"), F.count("version").alias("versions"), F.count(F.lit(1)).alias("rows")))


def _keys(spark, d):
    return table(spark, d, "split_members").select(image_key(F.col("image_id")).alias("key")).where("key is not null"), _annotations(spark, d).where("key is not null").select("key")


def u04_difference(spark, d):
    return R.key_difference(*_keys(spark, d), "key")


def u05_union_keys(spark, d):
    return R.key_union(*_keys(spark, d), "key")


def u06_intersection(spark, d):
    return R.key_intersection(*_keys(spark, d), "key")


def u07_merged(spark, d):
    m = table(spark, d, "split_members").where("split is not null").select(image_key(F.col("image_id")).alias("key"), "split", "member_id").where("key is not null")
    train = m.where("split = 'train'").groupBy("key").agg(F.min("split").alias("split"))
    other = m.where("split != 'train'").groupBy("key").agg(F.min("split").alias("split"))
    return R.merged(train, other, "key", "split")


def o02_latest(spark, d):
    return rounded(R.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), "o_orderkey"), 2)


def o04_page(spark, d):
    return R.page(table(spark, d, "part").select("p_partkey", "p_name"), 3, 25, "p_name", "p_partkey")


def o06_top_per_group(spark, d):
    orders = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return rounded(R.top_per_group(orders, ["o_orderpriority"], 5, F.desc("o_totalprice"), "o_orderkey"), 2)


def o10_ends(spark, d):
    lists = table(spark, d, "annotation_history").dropDuplicates(["id"]).where("version is not null").groupBy(image_key(F.col("image_id")).alias("key")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return lists.where("key is not null").select("key", F.array_join(R.ends(F.col("ids")), ",").alias("ids"))


def o08_ordinals(spark, d):
    return R.ordinals(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").select("c_custkey", "ordinal")


def a03_describe(spark, d):
    return rounded(A.describe(table(spark, d, "part"), ["p_size", "p_retailprice"]), 3)


def a04_distribution(spark, d):
    return A.distribution(table(spark, d, "task_definitions").dropDuplicates(["task_id"]), ["chart_type", "data_source", "shape"])


def a05_quantiles(spark, d):
    return rounded(A.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.99]), 2)


def a06_shares(spark, d):
    return rounded(A.dimension_shares(table(spark, d, "documents"), ["lang", "source"]))


def a07_rollup(spark, d):
    return rounded(A.rollup_status(_images(spark, d), ["source", "task_id"], F.lower("status") == "annotated"))


def a10_status_counts(spark, d):
    return rounded(A.dimension_shares(_images(spark, d).withColumn("status", F.lower("status")), ["status"]))


def a11_annotators(spark, d):
    rows = _annotations(spark, d)
    return A.conditional_counts(rows, "annotator", annotated=F.col("status") == "annotated", noted=F.col("modification_note").isNotNull())


def a12_table_counts(spark, d):
    return A.table_counts(**{n: table(spark, d, n).distinct() for n in ("images", "annotations", "split_members")})


def a14_difference(spark, d):
    return rounded(A.group_difference(table(spark, d, "lineitem"), "l_returnflag", "A", "R", ["l_extendedprice", "l_quantity"]), 3)


def a15_signs(spark, d):
    return rounded(A.signs(table(spark, d, "customer").withColumn("v", F.col("c_acctbal") / 1000), "v", 0.001))


def a15_histogram(spark, d):
    return rounded(A.histogram(table(spark, d, "lineitem"), "l_discount", 1))


def a16_brackets(spark, d):
    return A.brackets(table(spark, d, "customer"), "c_acctbal", [0.0, 1000.0, 5000.0])


def a17_rank_percentiles(spark, d):
    return rounded(A.rank_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [10, 50, 90]), 2)


def a21_runs(spark, d):
    runs = table(spark, d, "events").withColumn("size", F.get_json_object("props", "$.k").cast("bigint"))
    return rounded(A.run_summary(runs, ["event_type"], F.col("event_type") != "error", "value", "size"), 3)


def a32_completeness(spark, d):
    expected = spark.range(0, table(spark, d, "annotations").agg(F.max("id")).first()[0] + 10).select(F.col("id").alias("id"))
    return R.full_compare(expected, table(spark, d, "annotations"), "id")


def a33_warnings(spark, d):
    sources = table(spark, d, "source_weights").select("source")
    return rounded(A.shares_with_warnings(table(spark, d, "documents"), "source", sources, 0.05))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__[0] in "jfuoa" and f.__name__[1:3].isdigit()}

_TASKS = "with t as (select distinct on (task_id) * from task_definitions) "
_SPLIT = "m as (select member_id, split, " + _KEY.format(c="image_id") + " as key from split_members where trim(image_id) <> '')"

SQL = {
    "j01_annotations_images": _WITH + "select id, an.key, r.source as image_source, lower(r.status) as image_status from an left join im using (key)",
    "j02_annotated_filled": _WITH + "select id, key, r.source as source from an join im using (key) where trim(summary) <> '' and trim(annotator) <> '' and lower(r.status) = 'annotated'",
    "j03_decontaminated": f"with {_ANN}, {_SPLIT} select id from an where key is null or key not in (select key from m where split <> 'train')",
    "j04_excluded": f"with {_ANN}, {_SPLIT} select id from an where key in (select key from m where split <> 'train')",
    "j05_pending": _WITH + "select key from im where key not in (select key from an where key is not null)",
    "j08_default": _WITH + ", t as (select task_id, min(lower(trim(theme))) as theme from task_definitions group by task_id) select key, coalesce(theme, 'none') as theme from im left join t on r.task_id = t.task_id",
    "j09_two_hops": _WITH + ", t as (select distinct task_id, indicator from task_definitions) select key, t.task_id, t.indicator, i.shape, i.theme as indicator_theme from im join t on r.task_id = t.task_id join indicators i on i.indicator = t.indicator",
    "j14_history": _WITH
    + ", h as (select distinct on (id) id, version, "
    + _KEY.format(c="image_id")
    + " as key from annotation_history), g as (select key, count(*) as n, string_agg(coalesce(cast(cast(version as int) as varchar), '-'), ',' order by id) as o from h group by key) select key, coalesce(n, 0) as versions, coalesce(o, '') as \"order\" from im left join g using (key)",
    "j20_without_status": _WITH + ", s as (select key, max(status) as annotation_status from an group by key) select key, annotation_status from im left join s using (key) where annotation_status is distinct from 'annotated'",
    "j17_cross": "select distinct theme, name as source from indicators, data_sources",
    "f02_by_status": _WITH + "select key, lower(r.status) as status from im where lower(r.status) = 'deleted'",
    "f03_filled": f"with {_ANN} select id from an where trim(summary) <> '' and trim(modification_note) <> ''",
    "f04_complete": _TASKS
    + "select task_id from t where "
    + " and ".join(f"{c} is not null" for c in "task_id chart_type language theme visual_style batch_index indicator data_source indicator_description_zh indicator_description_en shape is_frontend time_range_years time_window_start time_window_end".split()),
    "f06_finite": f"with {_ANN} select id from an where isfinite(cast(annotated_at as double))",
    "f08_prefixes": "select indicator from indicators where starts_with(indicator, 'prices.') or starts_with(indicator, 'bonds.')",
    "f11_allowed": _TASKS
    + ", n as (select task_id, lower(trim(chart_type)) as chart_type, lower(trim(theme)) as theme from t) select * from n where not coalesce((chart_type, theme) in (('pie', 'bonds'), ('candlestick', 'property'), ('line', 'shipping')), false)",
    "f15_visible": "select distinct filename from images where not regexp_matches(filename, '^[._]')",
    "f16_checked": _TASKS + "select task_id, coalesce(lower(trim(visual_style)) in ('macro', 'quant'), false) as valid from t",
    "f17_ready": f"with {_ANN}, {_SPLIT}, g as (select distinct "
    + _KEY.format(c="image_id")
    + " as key from messages where trim(image_id) <> '') select member_id from (select distinct member_id, key from m) where key in (select key from an) and key not in (select key from g)",
    "u01_union": f"with {_ANN}, h as (select distinct on (id) nullif("
    + _KEY.format(c="image_id")
    + ", '') as key, version from annotation_history), u as (select key, summary as text, null as version from an union all select key, null, version from h) select key, count(text) as texts, count(version) as versions, count(*) as rows from u group by key",
    "u04_difference": f"with {_ANN}, {_SPLIT} select key from m except select key from an",
    "u05_union_keys": f"with {_ANN}, {_SPLIT} select key from m union select key from an where key is not null",
    "u06_intersection": f"with {_ANN}, {_SPLIT} select key from m intersect select key from an",
    "u07_merged": f"with {_SPLIT} select key, coalesce(min(split) filter (split <> 'train'), 'train') as split from m where split is not null group by key",
    "o02_latest": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "o04_page": "select p_partkey, p_name from part order by p_name, p_partkey limit 25 offset 50",
    "o06_top_per_group": "select o_orderpriority, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as k from orders) where k <= 5",
    "o10_ends": "with h as (select "
    + _KEY.format(c="image_id")
    + " as key, list_sort(list(distinct id)) as ids from annotation_history where version is not null and trim(image_id) <> '' group by 1) select key, array_to_string(case when len(ids) > 6 then list_concat(ids[1:3], ids[-3:]) else ids end, ',') as ids from h",
    "o08_ordinals": "select c_custkey, row_number() over (order by c_mktsegment, c_custkey) - 1 as ordinal from customer",
    "a03_describe": " union all ".join(
        f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as std, min({c})::double as min, round(quantile_cont({c}, 0.25)::double, 3) as q25, round(median({c})::double, 3) as median, round(quantile_cont({c}, 0.75)::double, 3) as q75, max({c})::double as max from part"
        for c in ("p_size", "p_retailprice")
    ),
    "a04_distribution": _TASKS
    + ", l as ("
    + " union all ".join(f"select '{c}' as \"column\", {c} as value from t" for c in ("chart_type", "data_source", "shape"))
    + '), c as (select "column", value, count(*) as n from l where value is not null group by all), p as (select *, count(*) over (partition by "column") as classes, row_number() over (partition by "column" order by n desc, value) as k from c) select "column", value, n, classes from p where classes <= 10 or k <= 5',
    "a05_quantiles": "select l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 2) as q01, round(quantile_cont(l_extendedprice, 0.99), 2) as q99, round(avg(l_extendedprice), 2) as mean, round(stddev_samp(l_extendedprice), 2) as std, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem group by l_returnflag",
    "a06_shares": "with l as (select 'lang' as dimension, coalesce(lang, '(none)') as value from documents union all select 'source', coalesce(source, '(none)') from documents) select dimension, value, n, round(n * 100.0 / sum(n) over (partition by dimension), 4) as percent from (select dimension, value, count(*) as n from l group by dimension, value)",
    "a07_rollup": _WITH
    + ", l as (select 'source' as dimension, coalesce(r.source, '(none)') as value, lower(r.status) = 'annotated' as ok from im union all select 'task_id', coalesce(r.task_id, '(none)'), lower(r.status) = 'annotated' from im) select dimension, value, count(*) as total, count(*) filter (ok) as success, count(*) - count(*) filter (ok) as failed, round(count(*) filter (ok) / count(*)::double, 4) as rate from l group by all",
    "a10_status_counts": _WITH + "select 'status' as dimension, lower(r.status) as value, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 4) as percent from im group by all",
    "a11_annotators": f"with {_ANN} select annotator, count(*) as total, count(*) filter (status = 'annotated') as annotated, count(modification_note) as noted from an where annotator is not null group by annotator",
    "a12_table_counts": " union all ".join(f"select '{n}' as name, count(*) as n from (select distinct * from {n})" for n in ("images", "annotations", "split_members")),
    "a14_difference": "with g as ("
    + " union all ".join(f"select '{c}' as \"column\", avg({c}) filter (l_returnflag = 'A') as base, avg({c}) filter (l_returnflag = 'R') as other from lineitem" for c in ("l_extendedprice", "l_quantity"))
    + ') select "column", round(base, 3) as base, round(other, 3) as other, round(other - base, 3) as difference, round((other - base) / base * 100, 3) as percent from g',
    "a15_signs": "with v as (select c_acctbal / 1000 as v from customer), g as (select count(*) as n, count(*) filter (v > 0.001) as positive, count(*) filter (abs(v) <= 0.001) as zero, count(*) filter (v < -0.001) as negative from v) select *, round(positive / n::double, 4) as positive_share, round(zero / n::double, 4) as zero_share, round(negative / n::double, 4) as negative_share from g",
    "a15_histogram": "select round(l_discount, 1) as bin, count(*) as n from lineitem group by 1",
    "a16_brackets": "select case when c_acctbal < 0 then '[-inf,0.0)' when c_acctbal < 1000 then '[0.0,1000.0)' when c_acctbal < 5000 then '[1000.0,5000.0)' else '[5000.0,inf)' end as bracket, count(*) as n from customer group by 1",
    "a17_rank_percentiles": "with s as (select l_returnflag, list_sort(list(l_extendedprice)) as v from lineitem group by 1) select l_returnflag, v[len(v) * 10 // 100 + 1] as p10, v[len(v) * 50 // 100 + 1] as p50, v[len(v) * 90 // 100 + 1] as p90 from s",
    "a21_runs": "select event_type, count(*) as runs, count(*) filter (event_type <> 'error') as success, round(count(*) filter (event_type <> 'error') / count(*)::double, 3) as rate, round(coalesce(avg(value) filter (value > 0), 0), 3) as mean_duration, cast(coalesce(sum(cast(json_extract(props, '$.k') as bigint)), 0) as bigint) as total_size from events group by 1",
    "a32_completeness": "with e as (select unnest(range(0, (select max(id) + 10 from annotations))) as id) select coalesce(e.id, a.id) as id, case when a.id is null then 'missing' else 'extra' end as kind from e full join (select distinct id from annotations) a on e.id = a.id where e.id is null or a.id is null",
    "a33_warnings": "with e as (select distinct source from source_weights), n as (select source, count(*) as n from documents group by 1), t as (select count(*) as a from documents) select e.source, coalesce(n, 0) as n, round(coalesce(n, 0) / a::double, 4) as share, case when n is null then 'unused' when n / a::double < 0.05 then 'low' end as warning from e left join n using (source), t",
}
