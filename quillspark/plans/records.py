"""Queries on nested records, lists and small projections, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import records as N
from quillspark.functions import text as X
from quillspark.operators import relational as R
from quillspark.operators import sampling as M
from quillspark.plans.rounding import rounded
from quillspark.sources.tables import image_key, table


def _parts(spark, d):
    return table(spark, d, "part")


def proj02_standardised(spark, d):
    from quillspark.sources.series_source import coerced

    return rounded(coerced(_parts(spark, d).select(F.col("p_partkey").alias("Key"), F.concat("p_brand", F.lit("")).alias("Size")), {"Size": "BRAND_NO"}, ["brand_no"]))


def proj04_close_only(spark, d):
    from quillspark.sources.series_source import canonical_value

    return rounded(canonical_value(_parts(spark, d).select("p_partkey", F.col("p_retailprice").alias("Close"))).select("p_partkey", "value"), 2)


def proj07_kept_fields(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.map_from_arrays(F.array(F.lit("price"), F.lit("none")), F.array(F.struct(F.round(F.max("l_extendedprice"), 2).alias("max"), F.min("l_quantity").alias("min"), F.lit(1.0).alias("other")), F.lit(None))).alias("m"))
    return g.select("l_orderkey", F.to_json(N.kept_fields(F.col("m"), ["max", "min"])).alias("facts")).select("l_orderkey", F.get_json_object("facts", "$.price.max").cast("double").alias("max"), F.get_json_object("facts", "$.price.other").alias("other"))


def proj09_translated(spark, d):
    return table(spark, d, "nation").select("n_nationkey", N.translated(F.col("n_name"), {"FRANCE": "Frankreich", "CHINA": "中国", "NATION_1": "eins"}).alias("name"))


def proj13_names(spark, d):
    return table(spark, d, "indicators").select(F.concat_ws("_", "theme", F.lower("shape"), F.replace("indicator", F.lit("."), F.lit("-"))).alias("name"), "indicator")


def proj19_lines(spark, d):
    g = _parts(spark, d).groupBy("p_brand").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"), F.round(F.avg("p_size"), 2).alias("m"))
    return g.select(N.summary_line(F.col("p_brand"), F.col("a"), F.col("b"), F.col("m")).alias("line"))


def proj20_preview(spark, d):
    return N.preview_rows(_parts(spark, d).select("p_partkey", "p_brand"), 10, "p_partkey")


def f07_members(spark, d):
    return R.member_of(table(spark, d, "indicators"), "theme", None, ["prices", "bonds"]).select("indicator")


def f09_both_kinds(spark, d):
    kinds = table(spark, d, "messages").dropDuplicates(["message_id"]).groupBy("sample_id").agg(F.collect_list("role").alias("k"))
    return kinds.where(N.has_both(F.col("k"), "system", "gpt", 3)).select("sample_id")


def f13_skip_reasons(spark, d):
    rows = table(spark, d, "messages").dropDuplicates(["message_id"]).where("role = 'gpt'")
    return rows.select("message_id", N.skip_reason(F.col("content"), F.col("image_id")).alias("reason"))


def j06_with_misses(spark, d):
    members = table(spark, d, "split_members").select("member_id", image_key(F.col("image_id")).alias("key")).distinct()
    notes = table(spark, d, "annotations").select(image_key(F.col("image_id")).alias("key")).where("key is not null").distinct().withColumn("there", F.lit(True))
    return members.join(notes, "key", "left").agg(F.count_if("there").alias("matched"), F.count_if(F.col("there").isNull()).alias("missed"))


def j11_paired(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    a, b = g.where("l_returnflag = 'A'").select("l_partkey", F.col("v").alias("a")), g.where("l_returnflag = 'R'").select("l_partkey", F.col("v").alias("b"))
    return rounded(a.join(b, "l_partkey").withColumn("delta", F.col("b") - F.col("a")), 5)


def j19_listed(spark, d):
    listed = table(spark, d, "split_members").where("split = 'bench_wire'").select(image_key(F.col("image_id")).alias("key"))
    notes = table(spark, d, "annotations").dropDuplicates(["id"]).select("id", image_key(F.col("image_id")).alias("key"))
    return R.excluded(notes, listed, "key")[1].select("id", "key")


def a08_log_statistics(spark, d):
    from quillspark.operators.aggregates import run_summary

    rows = table(spark, d, "events").withColumn("one", F.lit(1))
    return rounded(run_summary(rows, ["user_id"], F.col("event_type") != "error", "value", "one"), 3)


def a09_distinct(spark, d):
    return rounded(table(spark, d, "task_definitions").groupBy(F.lower(F.trim("theme")).alias("theme")).agg(F.count_distinct("indicator").alias("indicators"), F.array_join(F.array_sort(F.collect_set("shape")), ",").alias("shapes")))


def a13_scores(spark, d):
    return rounded(table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n")))


def a20_tiers(spark, d):
    tier = F.col("p_size") % 3 + 1
    return rounded(_parts(spark, d).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(tier != 3, 2).otherwise(0)).alias("calls")))


def a34_first_extremes(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.max("l_quantity").alias("q"))
    return N.first_wins(rows, ["l_returnflag"], "l_orderkey", "q", "l_orderkey")


def a35_candidates(spark, d):
    lists = table(spark, d, "messages").dropDuplicates(["message_id"]).groupBy("sample_id").agg(F.collect_list("message_id").alias("c"), F.count_if(F.col("content").isNull()).alias("e"))
    return rounded(lists.agg(F.sum(F.size("c")).alias("total"), F.avg(F.size("c")).alias("mean"), F.sum("e").alias("errors")))


def w20_batches(spark, d):
    return rounded(R.ordinals(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.floor(F.col("ordinal") / 64).cast("bigint").alias("batch")))


def w21_renumbered(spark, d):
    shuffled = table(spark, d, "customer").select(F.col("c_custkey").alias("old"), M.place(4, F.col("c_custkey")).alias("u"))
    return R.ordinals(shuffled, "u", "old").select("old", "ordinal")


def w25_payload(spark, d):
    return N.first_with_total(_parts(spark, d).select("p_partkey", "p_brand"), 500, "p_partkey")


def o05_last(spark, d):
    return N.last_in_order(table(spark, d, "events").select("event_id", "user_id"), 15, "event_id")


def o07_shortened(spark, d):
    rows = table(spark, d, "annotations").dropDuplicates(["id"]).groupBy("annotator").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("summary").alias("s"))
    return rows.select("annotator", F.array_join(F.slice("ids", 1, 5), ",").alias("ids"), F.md5(F.substring("s", 1, 100)).alias("s"))


def u03_letters(spark, d):
    a, b = X.choice_letters(F.col("p_name")), X.choice_letters(F.col("p_type"))
    return _parts(spark, d).select("p_partkey", F.array_join(F.array_sort(F.array_intersect(a, b)), "").alias("both"), F.array_join(F.array_sort(F.array_except(a, b)), "").alias("first_only"))


def m04_capped(spark, d):
    docs = table(spark, d, "documents").where("text is not null and length(text) > 100 and source is not null").select("doc_id", "source")
    caps = docs.select("source").distinct().withColumn("target", F.lit(50))
    return M.stratified(docs, "doc_id", "source", caps, 6)


def x08_nested(spark, d):
    made = F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit("}}"))
    return table(spark, d, "events").select("event_id", N.nested_value(made, "k").alias("k"))


def x14_unescaped(spark, d):
    return _parts(spark, d).select("p_partkey", X.unescaped(F.concat(F.lit("﻿a\\n"), F.col("p_name"), F.lit('\\"'))).alias("t"))


def x18_windows(spark, d):
    return rounded(table(spark, d, "orders").select("o_orderkey", N.years_before(F.col("o_orderdate").cast("date"), 5).alias("start")))


def x25_not_negative(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", N.not_negative(F.col("c_acctbal"), F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]).alias("v")), 2)


def x32_types(spark, d):
    rows = table(spark, d, "events").withColumn("j", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"type": "'), "event_type", F.lit('"}'))).otherwise(F.col("event_type")))
    return rows.select("event_id", N.type_or_text(F.col("j")).alias("kind"))


def x34_sizes(spark, d):
    return _parts(spark, d).select("p_partkey", N.scaled_size(F.col("p_size") * 40 + 100, F.col("p_size") * 30 + 50, 1_000_000).alias("s")).select("p_partkey", "s.*")


def s18_fallback(spark, d):
    known = table(spark, d, "part").select(F.substring("p_type", 1, 4).alias("code")).distinct()
    codes = table(spark, d, "customer").select(F.substring("c_mktsegment", 1, 4).alias("code")).distinct()
    return N.prefix_fallback(codes, known, 2)


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__[0] != "_"}

_K = "nullif(lower(regexp_replace(image_id, '^\\s+|\\s+$', '', 'g')), '')"

SQL = {
    "proj02_standardised": "select p_partkey as key, try_cast(p_brand as double) as brand_no from part",
    "proj04_close_only": "select p_partkey, round(p_retailprice, 2) as value from part",
    "proj07_kept_fields": "select l_orderkey, round(max(l_extendedprice), 2) as max, cast(null as varchar) as other from lineitem group by 1",
    "proj09_translated": "select n_nationkey, case n_name when 'FRANCE' then 'Frankreich' when 'CHINA' then '中国' when 'NATION_1' then 'eins' else n_name end as name from nation",
    "proj13_names": "select concat_ws('_', theme, lower(shape), replace(indicator, '.', '-')) as name, indicator from indicators",
    "proj19_lines": "select p_brand || ': ' || printf('%.2f', min(p_size)::double) || ' to ' || printf('%.2f', max(p_size)::double) || ', mean ' || printf('%.2f', round(avg(p_size), 2)) as line from part group by p_brand",
    "proj20_preview": "select cast(row_number() over (order by p_partkey) as varchar) as row, cast(json_object('p_partkey', p_partkey, 'p_brand', p_brand) as varchar) as json from (select * from part order by p_partkey limit 10)",
    "f07_members": "select indicator from indicators where theme in ('prices', 'bonds')",
    "f09_both_kinds": "with m as (select distinct on (message_id) * from messages) select sample_id from m group by 1 having count(role) >= 3 and bool_or(role = 'system') and bool_or(role = 'gpt')",
    "f13_skip_reasons": "with m as (select distinct on (message_id) * from messages where role = 'gpt') select message_id, case when trim(coalesce(image_id, '')) = '' then 'no reference' when length(trim(coalesce(content, ''))) < 10 then 'short prediction' end as reason from m",
    "j06_with_misses": f"with m as (select distinct member_id, {_K} as key from split_members), a as (select distinct {_K} as key from annotations) select count(a.key) as matched, count(*) filter (a.key is null) as missed from m left join a on m.key = a.key",
    "j11_paired": "with g as (select l_partkey, l_returnflag, avg(l_extendedprice) as v from lineitem group by all) select a.l_partkey, round(a.v, 5) as a, round(b.v, 5) as b, round(b.v - a.v, 5) as delta from g a join g b using (l_partkey) where a.l_returnflag = 'A' and b.l_returnflag = 'R'",
    "j19_listed": f"with n as (select distinct on (id) id, {_K} as key from annotations) select id, key from n where key in (select {_K} from split_members where split = 'bench_wire')",
    "a08_log_statistics": "select user_id, count(*) as runs, count(*) filter (event_type <> 'error') as success, round(count(*) filter (event_type <> 'error') / count(*)::double, 3) as rate, round(coalesce(avg(value) filter (value > 0), 0), 3) as mean_duration, count(*) as total_size from events group by 1",
    "a09_distinct": "select lower(trim(theme)) as theme, count(distinct indicator) as indicators, array_to_string(list_sort(list_distinct(list(shape))), ',') as shapes from task_definitions group by 1",
    "a13_scores": "select event_type, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std, min(value) as min, max(value) as max, count(value) as n from events group by 1",
    "a20_tiers": "select cast(p_size % 3 + 1 as bigint) as tier, count(*) as n, cast(sum(case when p_size % 3 + 1 <> 3 then 2 else 0 end) as bigint) as calls from part group by 1",
    "a34_first_extremes": "select l_returnflag, arg_min(l_orderkey, {'q': -l_quantity, 'k': l_orderkey}) as l_orderkey from lineitem group by 1",
    "a35_candidates": "with m as (select distinct on (message_id) * from messages), g as (select sample_id, count(*) as n, count(*) filter (content is null) as e from m group by 1) select cast(sum(n) as bigint) as total, round(avg(n), 4) as mean, cast(sum(e) as bigint) as errors from g",
    "w20_batches": "select c_custkey, (row_number() over (order by c_custkey) - 1) // 64 as batch from customer",
    "w21_renumbered": "select c_custkey as old, row_number() over (order by md5('4:' || c_custkey), c_custkey) - 1 as ordinal from customer",
    "w25_payload": "select p_partkey, p_brand, (select count(*) from part) as total from part order by p_partkey limit 500",
    "o05_last": "select event_id, user_id from events order by event_id desc limit 15",
    "o07_shortened": "with a as (select distinct on (id) * from annotations) select annotator, array_to_string(list_sort(list(id))[1:5], ',') as ids, md5(substring(min(summary), 1, 100)) as s from a group by 1",
    "u03_letters": "with l as (select p_partkey, list_distinct(regexp_extract_all(upper(p_name), '[A-N]')) as a, list_distinct(regexp_extract_all(upper(p_type), '[A-N]')) as b from part) select p_partkey, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), '') as both, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), '') as first_only from l",
    "m04_capped": "with r as (select doc_id, source, row_number() over (partition by source order by md5('6:' || doc_id), doc_id) as k from documents where text is not null and length(text) > 100 and source is not null) select doc_id, source from r where k <= 50",
    "x08_nested": "select event_id, json_extract_string(props, '$.k') as k from events",
    "x14_unescaped": "select p_partkey, 'a' || chr(10) || p_name || '\"' as t from part",
    "x18_windows": "select o_orderkey, cast(cast(cast(o_orderdate as date) - interval 5 year as date) as varchar) as start from orders",
    "x25_not_negative": "select c_custkey, case when c_mktsegment in ('MACHINERY', 'BUILDING') then abs(c_acctbal) else c_acctbal end as v from customer",
    "x32_types": "select event_id, event_type as kind from events",
    "x34_sizes": "with p as (select p_partkey, p_size * 40 + 100 as w, p_size * 30 + 50 as h from part), f as (select *, least(1.0, sqrt(1000000.0 / (w * h))) as f from p) select p_partkey, cast(floor(w * f) as bigint) as width, cast(floor(h * f) as bigint) as height from f",
    "s18_fallback": "with k as (select o, substr(o, 1, 2) as p, row_number() over (partition by substr(o, 1, 2) order by md5('2:' || o), o) - 1 as k, count(*) over (partition by substr(o, 1, 2)) as n from (select distinct substr(p_type, 1, 4) as o from part)), c as (select distinct substr(c_mktsegment, 1, 4) as code from customer) select code, case when code in (select o from k) then code else (select o from k where k.p = substr(code, 1, 2) and k.k = cast('0x' || substr(md5('2:' || code), 1, 8) as bigint) % k.n) end as chosen from c",
}
