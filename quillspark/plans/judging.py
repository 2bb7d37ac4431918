"""Queries on judged and scored records: facts, pairs, sections, rewards, evaluators, positions and assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import records as N
from quillspark.functions import scores as V
from quillspark.functions import text as X
from quillspark.operators import evaluators as E
from quillspark.operators import metrics as M
from quillspark.operators import relational as R
from quillspark.operators import sampling as S
from quillspark.operators import series as W
from quillspark.operators.preference import numbered_parts
from quillspark.plans.rounding import rounded
from quillspark.plans.texts import PARTS, pairs, text_oracle
from quillspark.sources.quotes import scaled
from quillspark.sources.series_source import canonical_value
from quillspark.sources.tables import table


def _facts(spark, d):
    """doc_id, facts (id, value), claims (id, ref_id, value) of the JSON documents."""
    body = F.from_json("text", "facts array<struct<id: bigint, type: string, value: double>>")["facts"]
    rows = table(spark, d, "documents").where("text like '{\"subject\"%'").select("doc_id", body.alias("f")).where("f is not null")
    claims = F.transform("f", lambda f: F.struct(f["id"].alias("id"), ((f["id"] * 3 + 1) % 5).alias("ref_id"), (f["value"] + 1).alias("value")))
    return rows.select("doc_id", "f", claims.alias("claims"))


def j10_matched_facts(spark, d):
    return rounded(N.matched_facts(_facts(spark, d), "doc_id", "claims", "f"))


def e07_exploded(spark, d):
    """One row of many facts to many rows, each with its place."""
    return rounded(_facts(spark, d).select("doc_id", F.posexplode("f").alias("place", "fact")).select("doc_id", "place", F.col("fact.type").alias("type"), F.col("fact.value").alias("value")))


def j13_zipped_lists(spark, d):
    rows = table(spark, d, "messages").dropDuplicates(["message_id"]).groupBy("sample_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "message_id")))), lambda m: m["message_id"]).alias(name) for role, name in (("human", "asked"), ("gpt", "told"))])
    return N.zipped_lists(rows, "sample_id", "asked", "told").select("sample_id", F.col("place").cast("bigint").alias("place"), "asked", "told")


def j13_zipped(spark, d):
    return N.zipped(table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier").select("s_suppkey"), "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


def _preferences(spark, d):
    sampled = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    told = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s")).select("c_custkey", F.when(F.col("s") == "F", "success").otherwise("skipped").alias("status"))
    return N.with_preferences(sampled, told, "c_custkey")


def j07_preferences(spark, d):
    return _preferences(spark, d)[0]


def j07_counts(spark, d):
    return _preferences(spark, d)[1]


def j14_chunks(spark, d):
    """Histories in lists of seven rows; one image holds a tenth of all."""
    from quillspark.sources.tables import image_key

    rows = table(spark, d, "annotation_history").dropDuplicates(["id"]).select(image_key(F.col("image_id")).alias("key"), "id").where("key is not null")
    parents = rows.select("key").unionByName(table(spark, d, "images").select(image_key(F.col("id")).alias("key")).where("key is not null")).distinct()
    cut = R.chunked_history(parents, rows, "key", ["id"], ["id"], 7)
    return cut.select("key", F.col("chunk").cast("bigint").alias("chunk"), F.array_join(F.transform("history", lambda h: h["id"].cast("string")), ",").alias("ids"))


def j16_assigned(spark, d):
    tasks = table(spark, d, "task_definitions").where("chart_type is not null and theme is not null").select(F.lower(F.trim("chart_type")).alias("chart"), F.lower(F.trim("theme")).alias("theme"))
    charts = tasks.groupBy("chart").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chart").limit(6)
    quotas = charts.crossJoin(F.broadcast(charts.agg(F.sum("n").alias("all")))).select("chart", (F.col("n") / F.col("all")).alias("quota"))
    themes = tasks.groupBy("theme").agg(F.count(F.lit(1)).alias("p"))
    affinities = quotas.select("chart", F.lit("default").alias("theme"), F.lit(1.0).alias("affinity"))
    banned = quotas.select("chart", F.lit("bonds").alias("theme"))
    return S.assigned(quotas, themes, affinities, banned, "chart", "theme", 300, 5).select("chart", F.col("copy").cast("bigint").alias("copy"), "theme")


def m13_best_of(spark, d):
    """The mean of the best, the first and the worst candidate of each item."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"), F.min_by("l_extendedprice", F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("first"), F.min("l_extendedprice").alias("worst"))
    return rounded(g.agg(*[F.avg(c).alias(c) for c in ("best", "first", "worst")]), 2)


def f05_positions(spark, d):
    """Rows without a value leave before rows are numbered."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("series"), F.col("event_id").alias("d"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return rounded(W.numbered(rows))


def w19_blocks(spark, d):
    return rounded(numbered_parts(table(spark, d, "supplier").select("s_suppkey"), 7, "s_suppkey").select("s_suppkey", "block", "robin"))


def o01_by_date(spark, d):
    rows = table(spark, d, "orders").select(F.lit("a").alias("series"), F.col("o_orderkey").alias("d"), F.col("o_totalprice").alias("value")).where("d % 10 = 1")
    return rounded(W.numbered(rows).where("i < 20").select("d", "i", "value"), 2)


def o03_offset(spark, d):
    return R.page(table(spark, d, "customer").select("c_custkey"), 4, 15, F.desc("c_custkey"))


def o11_piece(spark, d):
    return R.piece(table(spark, d, "customer").select("c_custkey", "c_name"), 17, 9, "c_name", "c_custkey")


def u02_union_all(spark, d):
    rows = table(spark, d, "nation").select("n_name")
    return R.union_all(rows, None, rows, table(spark, d, "region").select(F.col("r_name").alias("n_name"), F.lit("r").alias("kind"))).select("n_name", "kind")


def proj03_canonical(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    frames = {"value": rows.select("s_suppkey", F.lit(7).alias("close"), F.col("s_acctbal").alias("Value")), "close": rows.select("s_suppkey", F.col("s_acctbal").alias("CLOSE")), "first": rows.select(F.col("s_acctbal"), "s_suppkey"), "none": rows.select(F.col("s_suppkey").cast("string").alias("s_suppkey"))}
    return rounded(R.union_all(*[canonical_value(df).select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "value", F.lit(name).alias("case")) for name, df in frames.items()]), 2)


def proj06_without_field(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.struct("p_brand", "p_size", F.struct("p_name", "p_type").alias("in")).alias("meta"))
    return rows.select("p_partkey", F.to_json(F.col("meta").dropFields("p_size", "in.p_type")).alias("meta"))


def proj11_scaled(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", scaled(F.col("c_acctbal"), 1e3).alias("thousands")), 6)


def proj17_defaults(spark, d):
    source = F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct("event_type", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user"))))
    return table(spark, d, "events").select("event_id", N.with_fallbacks({"event_type": "none", "user": "0", "label": "untitled"}, source).alias("f")).select("event_id", "f.*")


def proj18_raw_or_summary(spark, d):
    return N.raw_or_summary(table(spark, d, "events").select("user_id", "event_id", F.round("value", 2).alias("value")), "user_id", "value", "event_id", 9).select("user_id", "form", F.when(F.col("form") == "raw", F.col("payload")).otherwise(F.get_json_object("payload", "$.n")).alias("payload"))


def a19_by_source(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    return rounded(docs.groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean")), 4)


def a23_bleu_smoothed(spark, d):
    """With the usual tokeniser, and against references of another kind, so that a precision is 0."""
    return rounded(M.corpus_bleu(pairs(spark, d).withColumn("reference", F.reverse(F.lower("reference"))), X.tokens_13a, True), 8)


def a24_rouge_stemmed(spark, d):
    return rounded(M.rouge_n(pairs(spark, d), 2, M.stems), 6)


def a25_meteor_stemmed(spark, d):
    return rounded(M.meteor_exact(pairs(spark, d), True), 6)


def a28_sections(spark, d):
    """Each document against the next one of its source and language, section by section."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "source", "lang")
    both = docs.withColumn("reference", F.lead("text").over(Window.partitionBy("source", "lang", F.floor(F.col("doc_id") / 1000)).orderBy("doc_id")))
    some = both.select(F.col("doc_id").alias("pair"), F.col("text").alias("prediction"), "reference")
    return rounded(M.by_section(some, PARTS, X.section), 6)


def a39_flags(spark, d):
    k = F.col("p_partkey")
    flags = M.quality_flags(numeric=(k % 11) / 10.0, grounding=(k % 7) / 6.0, entity=F.when(k % 5 != 0, (k % 13) / 12.0), structure=F.col("p_size") / 10.0)
    return table(spark, d, "part").select("p_partkey", flags.alias("f")).select("p_partkey", "f.*")


def x09_scores(spark, d):
    made = F.concat(F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(""), F.col("p_size").cast("string"), F.lit(".7"))
    return rounded(table(spark, d, "part").select("p_partkey", X.bounded_score(made).alias("of_100"), X.bounded_score(made, 1, 10, 5).alias("of_10")))


def x23_rewards(spark, d):
    a, b = X.scaled_reward(F.col("p_size"), 100), X.scaled_reward(F.col("p_partkey") % 11, 10)
    return table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"), F.round(a - b, 4).alias("delta"))


def x27_trends(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.trend(F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") / 200 - 10)).alias("trend"))


def x35_bars(spark, d):
    return table(spark, d, "part").select("p_partkey", X.progress(F.col("p_size"), F.when(F.col("p_size") % 6 != 0, F.lit(50)), 10).alias("bar"))


def x07_closed(spark, d):
    """Replies cut anywhere, brackets inside strings included, are closed again."""
    whole = F.concat(F.lit('{"a": [{"t": "x]} \\" {", "k": "'), F.col("event_type"), F.lit('"}, {"u": [1, 2'))
    return table(spark, d, "events").select("event_id", X.fenced_json(F.concat(F.lit("so ```json "), whole)).alias("j")).select("event_id", F.get_json_object("j", "$.a[0].k").alias("k"), F.get_json_object("j", "$.a[1].u[1]").alias("u"))


def e02_rewards(spark, d):
    solution = F.concat(F.lit("<think>Answer: no</think> Layout Figures answer: "), F.col("p_size").cast("string"))
    score = lambda name, truth: E.compute_score(name, F.lit("part"), solution, truth)
    return rounded(table(spark, d, "part").select("p_partkey", score("format", F.lit("")).alias("format"), score("answer", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("1")).alias("answer"), score("number", (F.col("p_size") * 1.02).cast("string")).alias("number")))


def e03_evaluators(spark, d):
    some = pairs(spark, d)
    return rounded(E.evaluated(some, [E.Sections(["Layout", "版面"]), E.Values(), E.Overlap(1)]), 6)


def e05_weights(spark, d):
    """Weights that don't sum to one within a hundredth are refused."""
    found = []
    for name, weights in {"right": {"a": 0.5, "b": 0.495}, "short": {"a": 0.5, "b": 0.4}, "long": {"a": 0.8, "b": 0.3}}.items():
        try:
            V.weighted({"a": F.lit(4.0), "b": F.lit(2.0)}, weights)
            found.append((name, True))
        except ValueError:
            found.append((name, False))
    return spark.createDataFrame(found, "weights string, taken boolean")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__[0] != "_"}

_FACTS = """with j as (select doc_id, from_json(json_extract(text, '$.facts'), '[{"id": "BIGINT", "type": "VARCHAR", "value": "DOUBLE"}]') as f from documents where text like '{"subject"%' and json_valid(text)),
u as (select doc_id, unnest(f) as x, unnest(range(len(f))) as place from j)"""
_PREFERENCES = "with t as (select o_custkey as c_custkey, case when arg_max(o_orderstatus, o_orderkey) = 'F' then 'success' else 'skipped' end as status from orders group by 1), s as (select c.c_custkey, c_mktsegment, status from customer c left join t using (c_custkey)) "

SQL = {
    "j10_matched_facts": _FACTS + " select u.doc_id, u.x.id as id, (u.x.id * 3 + 1) % 5 as ref_id, round(u.x.value + 1, 4) as value, round(r.value, 4) as reference from u left join (select doc_id, x.id as id, arg_min(x.value, place) as value from u group by all) r on r.doc_id = u.doc_id and r.id = (u.x.id * 3 + 1) % 5",
    "e07_exploded": _FACTS + " select doc_id, place, x.type as type, round(x.value, 4) as value from u",
    "j13_zipped_lists": "with m as (select distinct on (message_id) * from messages), r as (select sample_id, role, message_id, row_number() over (partition by sample_id, role order by turn, message_id) - 1 as place from m where role in ('human', 'gpt')) select a.sample_id, a.place, a.message_id as asked, b.message_id as told from r a join r b on a.sample_id is not distinct from b.sample_id and a.place = b.place where a.role = 'human' and b.role = 'gpt'",
    "j13_zipped": "with a as (select c_custkey, row_number() over (order by c_custkey) as k from customer), b as (select s_suppkey, row_number() over (order by s_suppkey) as k from supplier) select c_custkey, s_suppkey from a join b using (k)",
    "j07_preferences": _PREFERENCES + "select * from s where status = 'success'",
    "j07_counts": _PREFERENCES + "select count(*) filter (status = 'success') as kept, count(*) filter (status is null) as absent, count(*) filter (status <> 'success') as other from s",
    "j14_chunks": "with r as (select distinct on (id) id, lower(regexp_replace(image_id, '^\\s+|\\s+$', '', 'g')) as key from annotation_history where trim(image_id) <> ''), n as (select *, (row_number() over (partition by key order by id) - 1) // 7 as chunk from r), g as (select key, chunk, string_agg(id::varchar, ',' order by id) as ids from n group by all), p as (select distinct key from (select key from r union all select lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) from images where trim(id) <> '')) select p.key, coalesce(chunk, 0) as chunk, coalesce(ids, '') as ids from p left join g using (key)",
    "j16_assigned": """with t as (select lower(trim(chart_type)) as chart, lower(trim(theme)) as theme from task_definitions where chart_type is not null and theme is not null),
c as (select chart, count(*) as n from t group by 1 order by n desc, chart limit 6), q as (select chart, n / (select sum(n) from c)::double as quota from c),
b as (select *, cast(floor(300 * quota + 1e-9) as int) as n0, row_number() over (order by md5('5:' || chart)) as o, count(*) over () as k, sum(cast(floor(300 * quota + 1e-9) as int)) over () as s from q),
e as (select chart, unnest(range(1, 1 + cast(n0 + (300 - s) // k + case when o <= (300 - s) % k then 1 else 0 end as int))) as copy from b),
h as (select theme, count(*) as p from t where theme <> 'bonds' group by 1), w as (select theme, sum(p) over (order by theme) / sum(p) over ()::double as hi from h),
u as (select chart, copy, cast('0x' || substr(md5('5:' || chart || ':' || copy), 1, 13) as bigint) / 4503599627370496.0 as u from e)
select chart, copy, (select arg_min(theme, hi) from w where u < hi) as theme from u""",
    "m13_best_of": "with g as (select max(l_extendedprice) as best, arg_min(l_extendedprice, {'l': l_linenumber, 'p': l_partkey, 'e': l_extendedprice}) as first, min(l_extendedprice) as worst from lineitem group by l_orderkey) select round(avg(best), 2) as best, round(avg(first), 2) as first, round(avg(worst), 2) as worst from g",
    "f05_positions": "select cast(user_id as varchar) as series, event_id as d, round(value, 4) as value, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events where event_id % 5 <> 0 and value is not null",
    "w19_blocks": "with n as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i, count(*) over () as c from supplier) select s_suppkey, case when i < (c % 7) * (c // 7 + 1) then i // (c // 7 + 1) else c % 7 + (i - (c % 7) * (c // 7 + 1)) // nullif(c // 7, 0) end as block, i % 7 as robin from n",
    "o01_by_date": "select o_orderkey as d, row_number() over (order by o_orderkey) - 1 as i, round(o_totalprice, 2) as value from orders where o_orderkey % 10 = 1 qualify i < 20",
    "o03_offset": "select c_custkey from customer order by c_custkey desc limit 15 offset 45",
    "o11_piece": "select c_custkey, c_name from customer order by c_name, c_custkey limit 9 offset 17",
    "u02_union_all": "select n_name, null::varchar as kind from nation union all select n_name, null from nation union all select r_name, 'r' from region",
    "proj03_canonical": "select s_suppkey, case c when 'none' then 0.0 else round(s_acctbal, 2) end::double as value, c as \"case\" from supplier, (select unnest(['value', 'close', 'first', 'none']) as c)",
    "proj06_without_field": "select p_partkey, cast(json_object('p_brand', p_brand, 'in', json_object('p_name', p_name)) as varchar) as meta from part",
    "proj11_scaled": "select c_custkey, round(c_acctbal / 1000.0, 6) as thousands from customer",
    "proj17_defaults": "select event_id, case when event_id % 3 <> 0 then event_type else 'none' end as event_type, case when event_id % 6 in (2, 4) then user_id::varchar else '0' end as user, 'untitled' as label from events",
    "proj18_raw_or_summary": "select user_id, case when count(*) <= 9 then 'raw' else 'summary' end as form, case when count(*) <= 9 then '[' || string_agg(round(value, 2)::double::varchar, ',' order by event_id) || ']' else count(*)::varchar end as payload from events group by user_id",
    "a19_by_source": "select source, coalesce(lang, 'none') as lang, count(*) as n, round(avg(n_chars), 4) as mean from documents where source is not null group by all",
    "a39_flags": "with f as (select p_partkey, (p_partkey % 11) / 10.0 >= 0.8 as numeric, (p_partkey % 7) / 6.0 >= 0.85 as grounding, coalesce(case when p_partkey % 5 <> 0 then (p_partkey % 13) / 12.0 end >= 0.9, false) as entity, p_size / 10.0 >= 4.5 as structure from part) select *, numeric and grounding and entity and structure as \"all\" from f",
    "x09_scores": "select p_partkey, case when p_size % 4 = 0 then 50 else greatest(1, least(100, p_size)) end::bigint as of_100, case when p_size % 4 = 0 then 5 else greatest(1, least(10, p_size)) end::bigint as of_10 from part",
    "x23_rewards": "select p_partkey, round(p_size / 100.0::double, 4) as a, round((p_partkey % 11) / 10.0::double, 4) as b, round(round(p_size / 100.0::double, 4) - round((p_partkey % 11) / 10.0::double, 4), 4) as delta from part",
    "x27_trends": "with t as (select c_custkey, case when c_custkey % 9 <> 0 then c_acctbal / 200 - 10 end as c from customer) select c_custkey, case when c is null then 'unknown' when abs(c) < 1 then 'flat' when c >= 10 then 'strong rise' when c > 0 then 'rise' when c <= -10 then 'strong fall' else 'fall' end as trend from t",
    "x35_bars": "select p_partkey, repeat('█', case when p_size % 6 <> 0 then cast(floor(p_size * 10 / 50) as int) else 0 end) || repeat('░', 10 - case when p_size % 6 <> 0 then cast(floor(p_size * 10 / 50) as int) else 0 end) as bar from part",
    "x07_closed": "select event_id, event_type as k, '2' as u from events",
    "e02_rewards": "select p_partkey, 0.5::double as format, case when p_size % 2 = 0 or p_size = 1 then 1.0 else 0.0 end::double as answer, 1.0::double as number from part",
    "e05_weights": "select * from (values ('right', true), ('short', false), ('long', false)) v(weights, taken)",
} | text_oracle()
