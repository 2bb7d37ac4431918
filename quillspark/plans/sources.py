"""Queries through files, sources and streams: tables are written in a format, read again and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.rounding import rounded
from quillspark.session import scratch
from quillspark.sources import files, series_source
from quillspark.sources.tables import image_key, table
from quillspark.streaming import steps


def s01_csv(spark, d):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, d, "part"), path)
    return rounded(files.read_csv(spark, path, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"), 2)


def s02_csv_dates(spark, d):
    path = scratch(spark, "dates")
    files.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), path)
    return rounded(files.read_csv(spark, path, "o_orderkey bigint, o_orderdate string", "o_orderdate"))


def s04_lines(spark, d):
    path = scratch(spark, "lines")
    files.write_lines(table(spark, d, "events").select("event_id", "user_id", "props"), path)
    return files.read_lines(spark, path, "event_id bigint, user_id bigint, props string")


def s05_latest_lines(spark, d):
    path = scratch(spark, "latest")
    rows = table(spark, d, "events").select(F.to_json(F.struct("user_id", "event_id", "event_type")).alias("value"))
    rows.unionByName(spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    return files.latest_lines(spark, path, "user_id bigint, event_id bigint, event_type string", "user_id", "event_id")


def s06_folders(spark, d):
    path = scratch(spark, "folders")
    tables = table(spark, d, "data_sources").select("name", F.concat(F.lit("x,"), "prefix").alias("value"))
    tables.write.partitionBy("name").text(path)
    listed = files.list_files(spark, path, "*.txt")
    return listed.select("folder").distinct()


def s11_series(spark, d):
    names = [r.prefix for r in table(spark, d, "data_sources").select("prefix").orderBy("prefix").collect()]
    return rounded(series_source.fetch(spark, "Offline", [*names, "bad_one"], "2024-01-01", "2024-03-31"))


def s17_codes(spark, d):
    mapping = table(spark, d, "indicators").where("theme = 'prices'").select("indicator", F.upper("shape").alias("code"))
    return series_source.resolved_codes(table(spark, d, "indicators").withColumn("indicator", F.concat_ws(", ", "indicator", "theme")), mapping)


def s20_flow(spark, d):
    return series_source.synthetic_flow(spark, ["a", "b", "c"], ["x", "y"], 4)


def k05_manifest(spark, d):
    rows = table(spark, d, "split_members").where("split is not null").distinct()
    return files.write_splits(rows, scratch(spark, "splits"))


def k09_export(spark, d):
    rows = table(spark, d, "annotation_history").dropDuplicates(["id"]).select(image_key(F.col("image_id")).alias("key"), F.col("id").alias("row"))
    parents = rows.where("key is not null").select("key").distinct()
    return files.nested_export(parents, rows.where("key is not null"), "key", ["row"])


def k10_clean(spark, d):
    path = scratch(spark, "dual")
    files.clean_and_full(table(spark, d, "part").select("p_partkey", F.struct("p_size", "p_brand").alias("_meta")), path)
    return files.read_lines(spark, f"{path}/clean", "p_partkey bigint")


def k11_soft_delete(spark, d):
    images = table(spark, d, "images").groupBy(image_key(F.col("id")).alias("key")).agg(F.min(F.lower("status")).alias("status")).where("key is not null")
    told = table(spark, d, "messages").select(image_key(F.col("image_id")).alias("key")).where("key is not null")
    return files.with_status(images, told, "key", "deleted")


def t01_latest_state(spark, d):
    path = scratch(spark, "log")
    table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("string").alias("ts")).write.json(f"{path}/in")
    stream = steps.log_stream(spark, f"{path}/in", "event_id bigint, user_id bigint, event_type string, ts string")
    steps.drain(steps.latest_state(stream.select("user_id", "event_id", "event_type"), "user_id", "event_id"), f"{path}/check", f"{path}/out", "complete")
    return spark.read.parquet(f"{path}/out")


def t02_only_new(spark, d):
    path = scratch(spark, "new")
    members = table(spark, d, "split_members").select("member_id").distinct()
    steps.process_new(spark, members.where("member_id % 2 = 0"), f"{path}/done", "member_id", lambda df: df.withColumn("run", F.lit(1)))
    return rounded(steps.process_new(spark, members, f"{path}/done", "member_id", lambda df: df.withColumn("run", F.lit(2))))


QUERIES = {f.__name__: f for f in (s01_csv, s02_csv_dates, s04_lines, s05_latest_lines, s06_folders, s11_series, s17_codes, s20_flow, k05_manifest, k09_export, k10_clean, k11_soft_delete, t01_latest_state, t02_only_new)}

_KEY = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"

SQL = {
    "s01_csv": "select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size, round(p_retailprice, 2) as p_retailprice from part",
    "s02_csv_dates": "select o_orderkey, cast(cast(o_orderdate as date) as varchar) as o_orderdate from orders",
    "s04_lines": "select event_id, user_id, props from events",
    "s05_latest_lines": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id",
    "s06_folders": "select distinct 'name=' || name as folder from data_sources",
    "s11_series": "with c as (select prefix as series from data_sources), f as (select series, day, 1 + (cast('0x' || substr(md5(series || strftime(day, '%Y-%m-%d')), 1, 4) as bigint) / 65535.0::double - 0.5) / 50 as f from c, (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-03-31', interval 1 day)) as day)) select series, strftime(day, '%Y-%m-%d') as d, round(100 * product(f) over (partition by series order by day), 4) as value, null::varchar as error from f union all select 'bad_one', null, null, 'ValueError: no series bad_one'",
    "s17_codes": "with e as (select indicator || coalesce(', ' || theme, '') as indicator, unnest([indicator, theme]) as part from indicators), m as (select indicator as part, upper(shape) as code from indicators where theme = 'prices') select e.indicator, e.part, coalesce(code, e.part) as code from e left join m using (part) where e.part is not null",
    "s20_flow": "select s as source, t as target, round(cast('0x' || substr(md5('4:' || s || ':' || t), 1, 8) as bigint) / 4294967296.0 * 100, 2) as value from (select unnest(['a', 'b', 'c']) as s), (select unnest(['x', 'y']) as t)",
    "k05_manifest": "select split, count(*) as rows from (select distinct * from split_members where split is not null) group by split",
    "k09_export": "with h as (select distinct on (id) id, " + _KEY.format(c="image_id") + " as key from annotation_history where trim(image_id) <> '') select key, '{\"key\":' || to_json(key) || ',\"history\":[' || string_agg('{\"row\":' || id || '}', ',' order by id) || ']}' as json from h group by key",
    "k10_clean": "select p_partkey from part",
    "k11_soft_delete": "with i as (select " + _KEY.format(c="id") + " as key, min(lower(status)) as status from images where trim(id) <> '' group by 1) select key, case when key in (select " + _KEY.format(c="image_id") + " from messages where image_id is not null) then 'deleted' else status end as status from i",
    "t01_latest_state": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id",
    "t02_only_new": "select member_id, cast(case when member_id % 2 = 0 then 1 else 2 end as bigint) as run from (select distinct member_id from split_members)",
}
