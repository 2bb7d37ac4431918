"""Queries through further formats: JSON documents, folders, manifests, SQLite, market and cross-section sources, outside
models."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import relational as R
from quillspark.plans.rounding import rounded
from quillspark.session import scratch
from quillspark.sources import files, judged, quotes, series_source, sqlite_source
from quillspark.sources.tables import table
from quillspark.streaming import steps


def _nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def s03_json_array(spark, d):
    path = scratch(spark, "array")
    files.write_json_array(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return rounded(files.read_json(spark, path, "p_partkey bigint, p_name string, p_size int"))


def k02_json_dates(spark, d):
    path = scratch(spark, "dates")
    files.write_json_array(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.lit("ünï码").alias("mark")), path, 2)
    return files.read_json(spark, path, "o_orderkey bigint, day string, mark string")


def k01_csv_index(spark, d):
    path = scratch(spark, "index")
    files.write_csv(_nations(spark, d), path, "n_name")
    return files.read_csv(spark, path, "n_name string, n_nationkey bigint, n_regionkey bigint")


def k03_appended(spark, d):
    path, rows = scratch(spark, "append"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    files.write_lines(rows.where("c_custkey % 2 = 0"), path)
    files.write_lines(rows.where("c_custkey % 2 = 1"), path, append=True)
    files.write_lines(rows.where("c_custkey % 3 = 0"), path, append=True)
    return files.read_lines(spark, path, "c_custkey bigint, c_mktsegment string").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("times"))


def k04_in_steps(spark, d):
    """The first attempt fails in its third part; the second goes on from there."""
    path, rows, calls = scratch(spark, "steps"), table(spark, d, "customer").select("c_custkey"), []

    def work(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return part.withColumn("call", F.lit(len(calls)).cast("bigint"))

    try:
        files.write_in_steps(rows, path, "c_custkey", 4, work)
    except RuntimeError:
        pass
    done = files.write_in_steps(rows, path, "c_custkey", 4, work)
    left = files.exists(spark, f"{path}-parts")
    return done.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c_custkey").alias("keys"), F.count_distinct("call").alias("parts")).withColumn("parts_left", F.lit(left))


def k06_entities(spark, d):
    path = scratch(spark, "entities")
    rows = table(spark, d, "data_sources").select("name", "prefix", "category", F.concat(F.lit("About "), "name").alias("about"), F.encode("prefix", "UTF-8").alias("content"))
    files.write_entities(rows, path, "name", "about", "content")
    told = spark.read.text(f"{path}/text").select("name", F.col("value").alias("about"))
    copied = spark.read.text(f"{path}/copy").select("name", F.decode(F.unbase64("value"), "UTF-8").alias("content"))
    meta = spark.read.schema("prefix string, category string, name string").json(f"{path}/meta")
    return meta.join(told, "name").join(copied, "name")


def k07_merged_shards(spark, d):
    path, rows = scratch(spark, "shards"), table(spark, d, "customer").select("c_custkey")
    shards = [f"{path}/{k}" for k in range(3)]
    for k in (0, 1):
        files.write_lines(rows.where(F.col("c_custkey") % 2 == k), shards[k])
    files.merge_shards(spark, shards, "c_custkey bigint", "c_custkey", f"{path}/all")
    left = sum(files.exists(spark, s) for s in shards)
    return files.read_lines(spark, f"{path}/all", "c_custkey bigint").withColumn("shards_left", F.lit(left).cast("bigint"))


def k08_manifest(spark, d):
    path = scratch(spark, "manifest")
    files.write_manifest(spark, path, "1.2", {"seed": 4, "size": [1, 2]}, _nations(spark, d))
    version, config, tasks = files.read_manifest(spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint")
    return tasks.withColumns({"version": F.lit(version), "seed": F.lit(config["seed"]).cast("bigint")})


def k10_full(spark, d):
    path = scratch(spark, "dual")
    files.clean_and_full(table(spark, d, "part").select("p_partkey", F.struct("p_size", "p_brand").alias("_meta")), path)
    full = files.read_lines(spark, f"{path}/full", "p_partkey bigint, _meta struct<p_size: bigint, p_brand: string>").select("p_partkey", F.col("_meta.p_size").alias("size"), F.col("_meta.p_brand").alias("brand"))
    clean = files.read_lines(spark, f"{path}/clean", "p_partkey bigint, _meta string").select("p_partkey", F.col("_meta").isNull().alias("clean"))
    return full.join(clean, "p_partkey")


def _folders(spark, d):
    """Folders of nations: each has a.json, those of an even region b_en.txt, of region 1 b_de.txt, of region 3 z.log."""
    path, rows = scratch(spark, "folders"), _nations(spark, d).orderBy("n_nationkey").limit(12).collect()
    system, _ = files._file_system(spark, path)
    for r in rows:
        names = {"a.json": f'{{"nation": "{r.n_name}", "region": {r.n_regionkey}}}', "metadata.json": f'{{"id": {r.n_nationkey}}}'}
        names |= {"b_en.txt": f"  in English {r.n_name}\n"} if r.n_regionkey % 2 == 0 else {}
        names |= {"b_de.txt": f"auf Deutsch {r.n_name}"} if r.n_regionkey in (1, 2) else {}
        names |= {"z.log": " \n"} if r.n_regionkey == 3 else {}
        for name, text in names.items():
            out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/f{r.n_nationkey}/{name}"))
            out.write(bytearray(text.encode()))
            out.close()
    return path


def s06_with_files(spark, d):
    return files.folders_with(files.list_files(spark, _folders(spark, d)), ["a.json", "b_en.txt"])


def s07_first_match(spark, d):
    found = files.first_match(files.list_files(spark, _folders(spark, d)), ["b_de.txt", "b_en.txt"])
    return found.select("folder", X.stem(F.col("path")).alias("stem"))


def s08_texts(spark, d):
    path = _folders(spark, d)
    texts = files.read_texts(spark, path).where("path like '%.txt'")
    wanted = files.list_files(spark, path).select("folder").distinct().crossJoin(spark.createDataFrame([("en",), ("de",)], "language string"))
    return files.texts_by_language(texts, wanted, {"en": ["b_en.txt"], "de": ["b_de.txt"]}).select("folder", "language", "text")


def s09_settings(spark, d):
    path = scratch(spark, "settings")
    for k, text in enumerate(('{"seed": 1, "kept": "yes"}', '{"seed": 2, "more": [1, "ü"]}')):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{k}.json")
    return files.read_settings(spark, [f"{path}/0.json", f"{path}/1.json"])


def s10_sqlite(spark, d):
    path = scratch(spark, "database").removeprefix("file:").replace("//", "/")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("create table nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        db.executemany("insert into nation values (?, ?, ?)", [tuple(r) for r in _nations(spark, d).collect()])
    return sqlite_source.read_sqlite(spark, path, "nation", 3, [["n_regionkey", ">=", 2], ["n_name", "<>", "FRANCE"]])


def _codes(spark, d):
    return [r.prefix for r in table(spark, d, "data_sources").select("prefix").orderBy("prefix").collect()]


def _told(df):
    return df.select("code", F.col("d").cast("string").alias("d"), *[F.round(F.col(c), 2).alias(c) for c in ("open", "high", "low", "close", "volume")])


def s12_equity(spark, d):
    return _told(quotes.quotes(spark, "equity", [*_codes(spark, d), "bad1", "none1", "gap1"], "2024-01-01", "2024-02-10"))


def s13_global(spark, d):
    return _told(quotes.quotes(spark, "global", [*_codes(spark, d), "gap1"], "2024-01-01", "2024-02-10"))


def s14_futures(spark, d):
    return _told(quotes.quotes(spark, "futures", [*_codes(spark, d), "bad1"], "2024-01-20", "2024-02-10"))


def s15_cross_sections(spark, d):
    named = [quotes.cross_section(spark, code, "zh-CN" if k % 2 else "en-US", ["e01", "e02", "e11"] if k == 2 else None).withColumn("code", F.lit(code)) for k, code in enumerate(sorted(quotes.CROSS_SECTIONS))]
    return R.union_all(*named)


def s16_registry(spark, d):
    names = ["Walk", " OFFLINE", "synthetic", "nowhere"]
    found = []
    for name in names:
        try:
            found.append((name, series_source.resolve(name).rpartition(":")[2]))
        except ValueError:
            found.append((name, "unknown"))
    return spark.createDataFrame(found, "name string, transport string")


def s19_generated(spark, d):
    specs = table(spark, d, "indicators").select("indicator")
    return rounded(quotes.generated_series(specs, "indicator", quotes.truncating_model, parallel=2), 2)


def s21_longer_window(spark, d):
    found = quotes.quotes_or_longer(spark, "equity", [*_codes(spark, d), "gap1", "none1"], "2024-01-01", "2024-01-31", 1)
    return found.groupBy("code", "window").agg(F.count(F.lit(1)).alias("rows"), F.min("d").cast("string").alias("first"), F.round(F.sum("close"), 2).alias("close"))


def s22_made_up(spark, d):
    wanted = table(spark, d, "task_definitions").where("indicator is not null and chart_type is not null").select(F.col("indicator").alias("code"), F.lower(F.trim("chart_type")).alias("chart_type")).distinct()
    real = table(spark, d, "indicators").where("theme = 'prices'").select(F.col("indicator").alias("code"), F.lit("2024-01-01").cast("date").alias("d"), F.lit(1.0).alias("value"))
    made_up = table(spark, d, "indicators").where("theme <> 'bonds'").select(F.col("indicator").alias("code"), F.lit("2024-01-02").cast("date").alias("d"), F.lit(2.0).alias("value"))
    return rounded(quotes.real_or_made_up(wanted, real, made_up))


def s23_metadata(spark, d):
    return files.read_metadata(spark, _folders(spark, d), "id bigint")


def o09_file_order(spark, d):
    path = scratch(spark, "order")
    files.write_lines(_nations(spark, d).orderBy(F.desc("n_nationkey")).coalesce(1), path)
    return files.in_file_order(spark, path, "n_nationkey bigint, n_name string").where("place < 10").select(F.col("place").cast("bigint").alias("place"), "n_nationkey")


def x15_base64(spark, d):
    encoded = files.read_encoded(spark, _folders(spark, d), "a.json")
    return encoded.select("base64")


def proj01_roles(spark, d):
    frames = {"orders": table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "text": table(spark, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("when_made"), "o_totalprice", "o_orderstatus"), "nation": _nations(spark, d)}
    found = [(name, *series_source.roles(df)) for name, df in frames.items()]
    return spark.createDataFrame([(n, r, ",".join(v)) for n, r, v in found], "frame string, date string, values string")


def t03_stages(spark, d):
    """Rows go through two stages, each of which takes what the one before has finished."""
    path = scratch(spark, "stages")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment").write.json(f"{path}/in")
    first = lambda df: df.withColumn("size", F.length("c_mktsegment"))
    second = lambda df: df.withColumn("double", F.col("size") * 2)
    steps.staged(spark, f"{path}/in", "c_custkey bigint, c_mktsegment string", [first, second], path)
    return rounded(spark.read.parquet(f"{path}/stage-1").select("c_custkey", "size", "double"))


_attempts: dict = {}


def _unsteady(text: str) -> str:
    """Fails once for names that begin with C, always for names that begin with J."""
    _attempts[text] = _attempts.get(text, 0) + 1
    if text.startswith("J") or (text.startswith("C") and _attempts[text] < 3):
        raise RuntimeError("busy")
    return text.lower()


def t04_retried(spark, d):
    told = judged.judged(_nations(spark, d), "n_name", judged.one_by_one(_unsteady), 3, 3, 0.01)
    return told.select("n_nationkey", "reply", "error")


def e04_recorded(spark, d):
    """Replies are asked for once and kept by key; the second time only new keys are asked."""
    path, rows = scratch(spark, "replies"), _nations(spark, d)
    judged.recorded(rows.where("n_nationkey < 10"), "n_nationkey", "n_name", judged.one_by_one(str.lower), path)
    done = judged.recorded(rows, "n_nationkey", "n_name", judged.one_by_one(str.upper), path)
    return done.select("n_nationkey", "reply")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__[0] != "_"}

_N = "(select * from nation order by n_nationkey limit 12)"
_DAYS = "with c as (select prefix as code from data_sources{more}), q as (select code, strftime(day, '%Y-%m-%d') as d, cast('0x' || substr(md5(code || '|' || strftime(day, '%Y-%m-%d')), 1, 4) as bigint) as v from c, (select unnest(generate_series(timestamp '{a}', timestamp '{b}', interval 1 day)) as day))"
_OHLC = " select code, d, round(v / 100.0 + 1, 2) as open, round(v / 100.0 + 2, 2) as high, round(v / 100.0 - 1, 2) as low, round(v / 100.0, 2) as close, v * 10.0::double as volume from q where not (code = 'gap1' and substr(d, 6, 2) = '01')"

SQL = {
    "s03_json_array": "select p_partkey, p_name, cast(p_size as bigint) as p_size from part",
    "k02_json_dates": "select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as day, 'ünï码' as mark from orders",
    "k01_csv_index": "select n_name, cast(n_nationkey as bigint) as n_nationkey, cast(n_regionkey as bigint) as n_regionkey from nation",
    "k03_appended": "select c_custkey, case when c_custkey % 3 = 0 then 2 else 1 end::bigint as times from customer",
    "k04_in_steps": "select count(*) as rows, count(distinct c_custkey) as keys, 4::bigint as parts, false as parts_left from customer",
    "k06_entities": "select name, prefix, category, 'About ' || name as about, prefix as content from data_sources",
    "k07_merged_shards": "select c_custkey, 0::bigint as shards_left from customer",
    "k08_manifest": "select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey, '1.2' as version, 4::bigint as seed from nation",
    "k10_full": "select p_partkey, cast(p_size as bigint) as size, p_brand as brand, true as clean from part",
    "s06_with_files": f"select 'f' || n_nationkey as folder from {_N} where n_regionkey % 2 = 0",
    "s07_first_match": f"select 'f' || n_nationkey as folder, case when n_regionkey in (1, 2) then 'b_de' when n_regionkey % 2 = 0 then 'b_en' else 'a' end as stem from {_N}",
    "s08_texts": f"select 'f' || n_nationkey as folder, l as language, case when n_regionkey in (1, 2) and (l = 'de' or n_regionkey = 1) then 'auf Deutsch ' else 'in English ' end || n_name as text from {_N}, (select unnest(['en', 'de']) as l) where n_regionkey % 2 = 0 or n_regionkey in (1, 2)",
    "s09_settings": "select * from (values ('seed', '2'), ('kept', '\"yes\"'), ('more', '[1, \"ü\"]')) v(key, value)",
    "s10_sqlite": "select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey from nation where n_regionkey >= 2 and n_name <> 'FRANCE'",
    "s12_equity": _DAYS.format(a="2024-01-01", b="2024-02-10", more=" union all select 'gap1'") + _OHLC,
    "s13_global": _DAYS.format(a="2024-01-01", b="2024-02-10", more=" union all select 'gap1'") + _OHLC,
    "s14_futures": _DAYS.format(a="2024-01-20", b="2024-02-10", more="") + _OHLC,
    "s15_cross_sections": "with s as (select * from (values ('region_output', 31, 1e4, 'zh'), ('region_population', 31, 1e2, 'en'), ('price_growth', 24, 1.0, 'en'), ('output_growth', 24, 1.0, 'zh'), ('country_output', 24, 1e6, 'en'), ('country_population', 24, 1e6, 'zh'), ('crops', 12, 1e3, 'en')) v(code, n, unit, l)), e as (select *, 'e' || lpad(i::varchar, 2, '0') as entity from s, lateral (select unnest(range(n)) as i)) select entity, case l when 'zh' then '地区' else 'Area ' end || substr(entity, 2) as label, round(cast('0x' || substr(md5(code || '|' || entity), 1, 6) as bigint) / unit::double, 6) as value, code from e where code <> 'crops' or entity in ('e01', 'e02', 'e11')",
    "s16_registry": "select * from (values ('Walk', 'walk'), (' OFFLINE', 'walk'), ('synthetic', 'walk'), ('nowhere', 'unknown')) v(name, transport)",
    "s19_generated": "select indicator, '2024-01-0' || k as d, round(cast('0x' || substr(md5(indicator || '|' || k), 1, 4) as bigint) / 100.0, 2) as value from indicators, (select unnest([1, 2]) as k)",
    "s21_longer_window": _DAYS.format(a="2023-01-31", b="2024-01-31", more=" union all select 'gap1'")
    + ", r as (select *, d >= '2024-01-01' as asked from q where not (code = 'gap1' and substr(d, 6, 2) = '01')) select code, case when asked then 'asked' else 'longer' end as window, count(*) as rows, min(d) as first, round(sum(v / 100.0), 2) as close from r where asked or code = 'gap1' group by all",
    "s22_made_up": "with w as (select distinct indicator as code, lower(trim(chart_type)) as chart_type from task_definitions where indicator is not null and chart_type is not null), i as (select indicator as code, theme from indicators) select w.code, chart_type, case when theme = 'prices' then '2024-01-01' when theme <> 'bonds' and chart_type not in ('candlestick', 'ohlc', 'kline', 'k_line') then '2024-01-02' end as d, case when theme = 'prices' then 1.0 when theme <> 'bonds' and chart_type not in ('candlestick', 'ohlc', 'kline', 'k_line') then 2.0 end::double as value, case when theme = 'prices' then 'real' when theme <> 'bonds' and chart_type not in ('candlestick', 'ohlc', 'kline', 'k_line') then 'made up' else 'none' end as origin from w left join i using (code)",
    "s23_metadata": f"select cast(n_nationkey as bigint) as id, 'f' || n_nationkey as folder from {_N}",
    "o09_file_order": "select row_number() over (order by n_nationkey desc) - 1 as place, cast(n_nationkey as bigint) as n_nationkey from nation qualify place < 10",
    "x15_base64": f"select base64(encode('{{\"nation\": \"' || n_name || '\", \"region\": ' || n_regionkey || '}}')) as base64 from {_N}",
    "proj01_roles": "select * from (values ('orders', 'o_orderdate', 'o_orderkey,o_totalprice'), ('text', 'when_made', 'o_totalprice'), ('nation', null, 'n_nationkey,n_regionkey')) v(frame, date, values)",
    "t03_stages": "select c_custkey, length(c_mktsegment) as size, 2 * length(c_mktsegment) as double from customer",
    "t04_retried": "select cast(n_nationkey as bigint) as n_nationkey, case when n_name not like 'J%' then lower(n_name) end as reply, case when n_name like 'J%' then 'RuntimeError: busy' end as error from nation",
    "e04_recorded": "select cast(n_nationkey as bigint) as n_nationkey, case when n_nationkey < 10 then lower(n_name) else upper(n_name) end as reply from nation",
}
