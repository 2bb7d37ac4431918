"""Queries on texts, conversations and JSON, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scores as V
from quillspark.functions import text as X
from quillspark.operators import metrics as M
from quillspark.plans.rounding import rounded
from quillspark.sources.tables import image_key, table

LAYOUT = ["版面", "Layout", "Aufbau", "Mise en page", "Diseño"]
#: The sections of a text by name, with their headers in every language.
PARTS = {"layout": LAYOUT, "figures": ["数值", "Figures", "Werte", "Valeurs", "Cifras"], "shape": ["形态", "Shape", "Form", "Forme", "Forma"], "reading": ["解读", "Reading", "Deutung", "Lecture", "Lectura"]}
SECTIONS = ["版面|Layout|Aufbau|Mise en page|Diseño", "数值|Figures|Werte|Valeurs|Cifras", "形态|Shape|Form|Forme|Forma", "解读|Reading|Deutung|Lecture|Lectura"]


def _documents(spark, d):
    return table(spark, d, "documents")


def x01_section(spark, d):
    found = X.section(F.col("text"), LAYOUT)
    return _documents(spark, d).select("doc_id", found.alias("part")).where("part is not null").select("doc_id", F.md5("part").alias("part"), F.length("part").cast("bigint").alias("size"))


def x02_without_thoughts(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(X.without_thoughts(F.col("text"))).alias("text"))


def x03_plain_answer(spark, d):
    made = F.concat(F.lit("**\\boxed{"), F.col("p_type"), F.lit("}** \\$"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", X.plain_answer(made).alias("answer"))


def x02_answer(spark, d):
    made = F.concat(F.lit("<think>Answer: no</think> ANSWER: "), F.col("p_brand"), F.lit(" because"))
    return table(spark, d, "part").select("p_partkey", X.answer(made).alias("answer"))


def x04_letters(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.choice_letters(F.col("p_name")), "").alias("letters"))


def x05_number(spark, d):
    return _documents(spark, d).select("doc_id", X.first_number(F.col("text")).alias("number"))


def x06_after_thoughts(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(F.regexp_replace(X.after_thoughts(F.col("text")), r"^\s+|\s+$", "")).alias("text"))


def x07_json_scores(spark, d):
    made = F.concat(F.lit("Here it is: ```json "), F.col("props"), F.lit(" ```"))
    score = X.bounded_score(F.get_json_object(X.fenced_json(made), "$.k"), 1, 80, 50)
    return rounded(table(spark, d, "events").select("event_id", score.alias("score")))


def x07_repaired_json(spark, d):
    cut = F.concat(F.lit("so: {\"a\": "), F.col("props"))
    return table(spark, d, "events").select("event_id", F.get_json_object(X.fenced_json(cut), "$.a.k").alias("k"))


def x10_folders(spark, d):
    name = F.concat(F.lit("20240105_101112_"), F.coalesce("chart_type", F.lit("x")), F.lit("_en-US_"), F.coalesce("theme", F.lit("y")), F.lit("_"), F.col("task_id"))
    tasks = table(spark, d, "task_definitions").dropDuplicates(["task_id"])
    return tasks.select("task_id", X.folder_parts(name).alias("p")).select("task_id", "p.*")


def x11_stems(spark, d):
    return table(spark, d, "images").select("filename", X.stem(F.col("filename")).alias("stem"), X.media_type(F.col("filename")).alias("media")).distinct()


def x12_format_score(spark, d):
    return rounded(_documents(spark, d).select("doc_id", X.format_score(F.col("text"), SECTIONS).alias("score")))


def x13_preview(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", F.md5(X.preview(F.col("text"))).alias("preview"))


def x17_lookback(spark, d):
    tasks = table(spark, d, "task_definitions").dropDuplicates(["task_id"])
    return rounded(tasks.select("task_id", X.lookback_days(F.concat(F.col("time_range_years").cast("int").cast("string"), F.lit("Y"))).alias("days")))


def x19_close(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return rows.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", V.close(F.col("total"), F.col("o_totalprice"), 0.25).alias("close"))


def _facts(spark, d):
    """Facts of JSON answers; every third has a slightly, every fifth a greatly different reference."""
    schema = "struct<subject:string,facts:array<struct<id:int,type:string,value:double>>>"
    facts = _documents(spark, d).where("text like '{\"subject\"%' and try_parse_json(text) is not null").select("doc_id", F.inline(F.from_json("text", schema)["facts"]))
    k = F.col("id")
    return facts.withColumns(
        {
            "reference": F.when(k % 5 == 4, F.col("value") * 2).when(k % 3 == 2, F.col("value") * 1.01).otherwise(F.col("value")),
            "chart": F.when(k % 2 == 0, F.col("value")),
            "said": F.when(k == 3, "incorrect"),
        }
    )


def x20_verdicts(spark, d):
    v = V.verdict(F.col("value"), F.col("reference"), F.col("chart"), F.col("said"))
    return rounded(_facts(spark, d).select("doc_id", "id", v.alias("v")).select("doc_id", "id", "v.correct", "v.how"))


def x21_ranges(spark, d):
    rows = _facts(spark, d)
    return rounded(rows.select("doc_id", "id", V.range_verdict(F.col("value"), F.col("value") + 1, F.col("reference"), F.col("reference") + 1).alias("in_range"), V.rank_verdict(F.col("type"), F.upper("type")).alias("rank")))


def a22_fact_precision(spark, d):
    v = V.verdict(F.col("value"), F.col("reference"), F.col("chart"), F.col("said"))
    return rounded(M.fact_summary(_facts(spark, d).select("doc_id", v.alias("v")).select("doc_id", "v.*"), "doc_id"))


def _answers(spark, d):
    rows = table(spark, d, "part")
    chosen, right = X.choice_letters(F.col("p_name")), X.choice_letters(F.col("p_type"))
    kind = F.when(F.col("p_size") % 3 == 0, "single").when(F.col("p_size") % 3 == 1, "multiple").otherwise("number")
    score = F.when(kind == "single", V.single_choice(F.slice(chosen, 1, 1), F.slice(right, 1, 1))).when(kind == "multiple", V.multiple_choice(chosen, right)).otherwise(V.numeric_answer(F.round("p_retailprice"), F.col("p_retailprice"), F.lit(0.3)))
    return rows.select("p_partkey", kind.alias("kind"), score.alias("score"))


def x22_answer_scores(spark, d):
    return rounded(_answers(spark, d))


def a18_answer_summary(spark, d):
    return rounded(M.answer_summary(_answers(spark, d), "kind", "score"))


def a29_weighted(spark, d):
    s = {"faith": F.when(F.col("p_size") > 10, F.col("p_size") % 5 + 1).cast("double"), "depth": (F.col("p_partkey") % 5 + 1).cast("double"), "style": F.lit(None).cast("double")}
    return rounded(table(spark, d, "part").select("p_partkey", V.weighted(s, {"faith": 0.5, "depth": 0.3, "style": 0.2}).alias("score")))


def a30_mean_or_zero(spark, d):
    return rounded(M.mean_or_zero(table(spark, d, "events"), "value", F.col("event_type") == "error"))


def x31_lists(spark, d):
    rows = table(spark, d, "indicators").withColumn("list", F.concat_ws(" , ", "indicator", "theme", F.lit("")))
    return rows.select("indicator", F.array_join(X.comma_list(F.col("list")), "|").alias("parts"))


def x26_stars(spark, d):
    return table(spark, d, "part").select("p_partkey", X.stars(F.col("p_size") / 8).alias("stars"), X.progress(F.col("p_size"), F.lit(50)).alias("bar"))


def x16_times(spark, d):
    rows = table(spark, d, "images").select("id", "created_at").distinct()
    return rows.select("id", F.date_format(F.to_utc_timestamp(F.timestamp_millis("created_at"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("time"), "created_at")


def proj05_conversations(spark, d):
    rows = table(spark, d, "messages").dropDuplicates(["message_id"]).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("turn", "message_id", F.col("role").alias("from"), F.coalesce("content", F.lit("")).alias("value")))).alias("m"))
    return rows.select("sample_id", F.array_join(F.transform("m", lambda x: x["from"]), ">").alias("roles"), F.md5(F.array_join(F.transform("m", lambda x: x["value"]), "\n")).alias("content"))


def _dialogues(spark, d):
    return table(spark, d, "messages").dropDuplicates(["message_id"]).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("turn", "message_id", "role", F.coalesce("content", F.lit("")).alias("value")))).alias("m"))


def proj14_without_answers(spark, d):
    kept = F.filter("m", lambda x: x["role"] != "gpt")
    return _dialogues(spark, d).select("sample_id", F.size(kept).cast("bigint").alias("turns"), F.md5(F.array_join(F.transform(kept, lambda x: x["value"]), "\n")).alias("content"))


def proj15_last_answer(spark, d):
    last = F.try_element_at(F.filter("m", lambda x: x["role"] == "gpt"), F.lit(-1))["value"]
    return _dialogues(spark, d).select("sample_id", F.md5(last).alias("answer"))


def proj16_first_of_role(spark, d):
    first = F.try_element_at(F.filter("m", lambda x: x["role"] == "system"), F.lit(1))["value"]
    return _dialogues(spark, d).select("sample_id", first.alias("system"))


def proj08_categories(spark, d):
    rules = [("lmf_", "final"), ("lm_", "batch"), ("fgb_", "forge b"), ("fg_", "forge"), ("dk_", "desk"), ("ws_", "wire")]
    return table(spark, d, "images").select("filename", X.prefix_category(F.col("filename"), rules, "other").alias("category")).distinct()


def proj10_paths(spark, d):
    rules = [("/images/lm", "/data/loom"), ("/images/", "/data/all/")]
    return table(spark, d, "images").select("path", X.rewritten_path(F.col("path"), rules).alias("new_path")).distinct()


def proj12_language(spark, d):
    return table(spark, d, "images").select("filename", X.declared_language(F.col("filename")).alias("language")).distinct()


def proj21_records(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("record"))


def pairs(spark, d):
    """Answers against the summary of the same image."""
    key = image_key(F.col("image_id")).alias("key")
    summary = table(spark, d, "annotations").select(key, "id", "summary").where("summary is not null and key is not null").groupBy("key").agg(F.min_by("summary", F.struct("id", "summary")).alias("reference"))
    answers = table(spark, d, "messages").where("role = 'gpt' and content is not null").select(F.col("message_id").alias("pair"), key, F.col("content").alias("prediction")).distinct()
    return answers.join(summary, "key").select("pair", "prediction", "reference")


def a23_bleu(spark, d):
    return rounded(M.corpus_bleu(pairs(spark, d)), 6)


def a24_rouge_n(spark, d):
    return rounded(M.rouge_n(pairs(spark, d)), 6)


def a24_rouge_l(spark, d):
    return rounded(M.rouge_l(pairs(spark, d)), 6)


def a25_meteor(spark, d):
    return rounded(M.meteor_exact(pairs(spark, d)), 6)


def a26_cider(spark, d):
    return rounded(M.cider(pairs(spark, d)), 4)


def a36_lengths(spark, d):
    return rounded(pairs(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("prediction")).alias("prediction"), F.avg(F.length("reference")).alias("reference")))


def a38_value_f1(spark, d):
    return rounded(M.value_f1(pairs(spark, d)), 6)


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and any(map(str.isdigit, f.__name__)) and f.__name__[0] != "_"}

_FACTS = """with j as (select doc_id, unnest(from_json(json_extract(text, '$.facts'), '[{"id": "INTEGER", "type": "VARCHAR", "value": "DOUBLE"}]')) as f from documents where text like '{"subject"%' and json_valid(text)),
f as (select doc_id, cast(f.id as bigint) as id, f.type as type, f.value as value, case when f.id % 5 = 4 then f.value * 2 when f.id % 3 = 2 then f.value * 1.01 else f.value end as reference,
  case when f.id % 2 = 0 then f.value end as chart, case when f.id = 3 then 'incorrect' end as said from j),
v as (select *, case when said = 'incorrect' then 'keyword' when abs(value - reference) <= abs(reference) * 0.03 then 'reference'
  when abs(value - chart) <= abs(chart) * 0.03 then 'chart' else 'none' end as how from f)"""
_ANSWERS = """with l as (select *, list_sort(list_distinct(regexp_extract_all(upper(p_name), '[A-N]'))) as chosen, list_sort(list_distinct(regexp_extract_all(upper(p_type), '[A-N]'))) as r,
  case p_size % 3 when 0 then 'single' when 1 then 'multiple' else 'number' end as kind from part),
s as (select p_partkey, kind, case kind when 'single' then case when len(chosen) > 0 and len(r) > 0 and chosen[1] = r[1] then 1.0 else 0.0 end
  when 'multiple' then greatest(0.0, coalesce(len(list_intersect(chosen, r)) / nullif(len(r)::double, 0), 0) - len(list_filter(chosen, lambda x: not list_contains(r, x))) / greatest(len(chosen), 1)::double)
  else case when abs(round(p_retailprice) - p_retailprice) <= 0.3 then 1.0 else 0.0 end end as score from l)"""
_DIALOGUES = "with m as (select distinct on (message_id) message_id, sample_id, turn, role, coalesce(content, '') as v from messages) "
_KEY = "nullif(lower(regexp_replace(image_id, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g')), '')"
_PAIRS = f"""with su as (select {_KEY} as key, arg_min(summary, {{'i': id, 's': summary}}) as reference from annotations where summary is not null group by 1),
an as (select distinct message_id as pair, {_KEY} as key, content as prediction from messages where role = 'gpt' and content is not null),
pr as (select pair, prediction, reference from an join su using (key) where key is not null)"""
_GRAMS = (
    _PAIRS
    + """,
w as (select pair, 'p' as side, regexp_extract_all(lower(prediction), '[a-z0-9]+|[一-鿿]') as w from pr union all select pair, 'r', regexp_extract_all(lower(reference), '[a-z0-9]+|[一-鿿]') from pr),
e as (select pair, side, n, array_to_string(w[i:i + n - 1], ' ') as gram from w, (select unnest([1::bigint, 2, 3, 4]) as n), lateral (select unnest(range(1, len(w) - n + 2)) as i)),
g as (select pair, n, gram, count(*) filter (side = 'p') as p, count(*) filter (side = 'r') as r from e group by all)"""
)
_CUT = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '([{{-~\\[-` -&(-+:-@/])', ' \\1 ', 'g'), '([^0-9])([.,])', '\\1 \\2 ', 'g'), '([.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g'), '\\s+'), lambda w: w <> '')"
_SECTION = "nullif(trim(regexp_replace(coalesce(nullif(trim(regexp_extract(text, '(?is)[【\\[][^】\\]]*(?:{n})[^】\\]]*[】\\]]([^【\\[]*)', 1)), ''), regexp_extract(text, '(?is)\\*\\*[^*]*(?:{n})[^*]*\\*\\*([^*]*)', 1)), '^\\s+|\\s+$', '', 'g')), '')"

SQL = {
    "x01_section": "with s as (select doc_id, " + _SECTION.replace("{n}", "|".join(LAYOUT)) + " as part from documents) select doc_id, md5(part) as part, length(part) as size from s where part is not null",
    "x02_without_thoughts": "select doc_id, md5(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g')) as text from documents",
    "x03_plain_answer": "select p_partkey, p_type || ' ' || p_size as answer from part",
    "x02_answer": "select p_partkey, p_brand as answer from part",
    "x04_letters": "select p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(p_name), '[A-N]'))), '') as letters from part",
    "x05_number": "select doc_id, try_cast(nullif(regexp_extract(translate(text, ',%', ''), '(-?[0-9]+\\.?[0-9]*)', 1), '') as double) as number from documents",
    "x06_after_thoughts": "select doc_id, md5(regexp_replace(regexp_replace(text, '(?s)^.*</think>', ''), '^\\s+|\\s+$', '', 'g')) as text from documents",
    "x07_json_scores": "select event_id, coalesce(greatest(1, least(80, cast(floor(try_cast(json_extract_string(props, '$.k') as double)) as bigint))), 50) as score from events",
    "x07_repaired_json": "select event_id, json_extract_string(props, '$.k') as k from events",
    "x10_folders": "with t as (select distinct on (task_id) * from task_definitions), n as (select task_id, '20240105_101112_' || coalesce(chart_type, 'x') || '_en-US_' || coalesce(theme, 'y') || '_' || task_id as n from t) select task_id, "
    + ", ".join(f"case when regexp_matches(n, '^([0-9]{{8}})_([0-9]{{6}})_(.+?)_([a-z]{{2}}-[A-Z]{{2}})_(.+)_([^_]+)$') then regexp_extract(n, '^([0-9]{{8}})_([0-9]{{6}})_(.+?)_([a-z]{{2}}-[A-Z]{{2}})_(.+)_([^_]+)$', {k}) else 'unknown' end as {c}" for k, c in ((3, "chart"), (4, "locale"), (5, "theme")))
    + " from n",
    "x11_stems": "select distinct filename, regexp_replace(regexp_extract(filename, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') as stem, case lower(regexp_extract(filename, '\\.([^./\\\\]+)$', 1)) when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'webp' then 'image/webp' when 'gif' then 'image/gif' else 'image/png' end as media from images",
    "x12_format_score": "with s as (select doc_id, text, ("
    + " + ".join(f"cast(regexp_matches(text, '(?i){s}') as int)" for s in SECTIONS)
    + ") / 4.0 as h from documents) select doc_id, round(cast(case when text is null or trim(text) = '' then 0.0 when length(text) between 500 and 3000 then least(h + 0.1, 1.0) when length(text) > 5000 then greatest(h - 0.3, 0.0) else h end as double), 4) as score from s",
    "x13_preview": "select doc_id, md5(substring(text, 1, 50) || '...') as preview from documents where text is not null",
    "x17_lookback": "select distinct task_id, coalesce(cast(time_range_years as bigint) * 365, 30) as days from task_definitions",
    "x19_close": "with t as (select l_orderkey, round(sum(l_extendedprice), 2) as total from lineitem group by 1) select o_orderkey, case when o_totalprice = 0 then abs(total) < 0.001 else abs(total - o_totalprice) <= abs(o_totalprice) * 0.25 end as close from t join orders on o_orderkey = l_orderkey",
    "x20_verdicts": _FACTS + " select doc_id, id, how in ('reference', 'chart') as correct, how from v",
    "x21_ranges": _FACTS + " select doc_id, id, abs(value - reference) <= abs(reference) * 0.03 and abs(value - reference) <= abs(reference + 1) * 0.03 as in_range, true as rank from f",
    "a22_fact_precision": _FACTS
    + " select doc_id, count(*) as facts, count(*) filter (how in ('reference', 'chart')) as correct, round(count(*) filter (how in ('reference', 'chart')) / count(*)::double, 4) as precision, "
    + ", ".join(f"count(*) filter (how = '{h}') as by_{h}" for h in ("keyword", "reference", "chart", "reference_chart", "none"))
    + " from v group by doc_id",
    "x22_answer_scores": _ANSWERS + " select p_partkey, kind, round(score, 4) as score from s",
    "a18_answer_summary": _ANSWERS + " select kind, count(*) as answers, round(avg(score), 4) as mean, round(avg(cast(score >= 1 as double)), 4) as full, round(avg(1 - score), 4) as miss from s group by kind",
    "a29_weighted": "select p_partkey, round(((case when p_size > 10 then p_size % 5 + 1 else 3 end) * 0.5::double + (p_partkey % 5 + 1) * 0.3::double + 3 * 0.2::double) / 5, 4) as score from part",
    "a30_mean_or_zero": "select round(coalesce(avg(value) filter (event_type <> 'error'), 0), 4) as mean, count(*) filter (event_type <> 'error') as n from events",
    "x31_lists": "select indicator, indicator || coalesce('|' || theme, '') as parts from indicators",
    "x26_stars": "select p_partkey, repeat('★', least(5, cast(floor(p_size / 8) as int))) as stars, repeat('█', cast(floor(p_size * 20 / 50) as int)) || repeat('░', 20 - cast(floor(p_size * 20 / 50) as int)) as bar from part",
    "x16_times": "select distinct id, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d %H:%M:%S') as time, created_at from images",
    "proj05_conversations": _DIALOGUES + "select sample_id, string_agg(role, '>' order by turn, message_id) as roles, md5(string_agg(v, chr(10) order by turn, message_id)) as content from m group by 1",
    "proj14_without_answers": _DIALOGUES + "select sample_id, count(*) filter (role <> 'gpt') as turns, md5(coalesce(string_agg(v, chr(10) order by turn, message_id) filter (role <> 'gpt'), '')) as content from m group by 1",
    "proj15_last_answer": _DIALOGUES + "select sample_id, md5(arg_max(v, {'t': turn, 'm': message_id}) filter (role = 'gpt')) as answer from m group by 1",
    "proj16_first_of_role": _DIALOGUES + "select sample_id, arg_min(v, {'t': turn, 'm': message_id}) filter (role = 'system') as system from m group by 1",
    "proj08_categories": "with s as (select distinct filename, regexp_extract(filename, '([^/\\\\]*)$', 1) as n from images) select filename, case when n ^@ 'lmf_' then 'final' when n ^@ 'lm_' then 'batch' when n ^@ 'fgb_' then 'forge b' when n ^@ 'fg_' then 'forge' when n ^@ 'dk_' then 'desk' when n ^@ 'ws_' then 'wire' else 'other' end as category from s",
    "proj10_paths": "select distinct path, case when path ^@ '/images/lm' then '/data/loom' || substr(path, 11) when path ^@ '/images/' then '/data/all/' || substr(path, 9) else path end as new_path from images",
    "proj12_language": "select distinct filename, coalesce(nullif(regexp_extract(filename, '(zh|en|de|fr|es)-[A-Z]{2}', 1), ''), 'en') as language from images",
    "proj21_records": "select event_id, cast(json_object('event_type', event_type, 'user_id', user_id) as varchar) as record from events",
    "a23_bleu": _GRAMS
    + """,
b as (select n, sum(least(p, r))::double as hit, sum(p)::double as al, sum(r)::double as ref from g group by n),
q as (select """
    + ", ".join(f"coalesce(max(hit / nullif(al, 0)) filter (n = {n}), 0) as p{n}" for n in range(1, 5))
    + """, max(al) filter (n = 1) as c, max(ref) filter (n = 1) as r from b)
select round(p1, 6) as p1, round(p2, 6) as p2, round(p3, 6) as p3, round(p4, 6) as p4, round(case when c >= r then 1.0 else exp(1 - r / c) end, 6) as brevity,
  round(case when c >= r then 1.0 else exp(1 - r / c) end * case when least(p1, p2, p3, p4) > 0 then exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) else 0 end, 6) as bleu from q""",
    "a24_rouge_n": _GRAMS
    + """,
b as (select pair, n, sum(least(p, r))::double as hit, sum(p)::double as sp, sum(r)::double as sr from g where n <= 2 group by all),
q as (select pair, n, coalesce(hit / nullif(sp, 0), 0) as precision, coalesce(hit / nullif(sr, 0), 0) as recall from b)
select pair, n, round(precision, 6) as precision, round(recall, 6) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f from q""",
    "a26_cider": _GRAMS
    + """,
df as (select n, gram, count(*) as df from g where r > 0 group by all),
x as (select g.*, ln((select count(*) from pr) / greatest(coalesce(df, 0), 1)::double) as w from g left join df using (n, gram)),
b as (select pair, n, sum(p * r * w * w) as dot, sum(p * p * w * w) as pp, sum(r * r * w * w) as rr from x group by all)
select pair, round(10 * sum(coalesce(dot / nullif(sqrt(pp) * sqrt(rr), 0), 0)) / 4, 4) as cider from b group by pair""",
    "a36_lengths": _PAIRS + " select count(*) as n, round(avg(length(prediction)), 4) as prediction, round(avg(length(reference)), 4) as reference from pr",
    "a38_value_f1": _PAIRS
    + """,
n as (select pair, list_transform(regexp_extract_all(prediction, '([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: x::double) as a, list_transform(regexp_extract_all(reference, '([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: x::double) as b from pr),
q as (select pair, len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x - y) <= 0.01 * abs(y))) > 0)) / nullif(len(a)::double, 0) as p, len(list_filter(b, lambda y: len(list_filter(a, lambda x: abs(x - y) <= 0.01 * abs(y))) > 0)) / nullif(len(b)::double, 0) as r from n)
select pair, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f, coalesce(2 * p * r / nullif(p + r, 0), 0) >= 0.8 as enough from q""",
}


def text_oracle() -> dict[str, str]:
    """SQL of queries elsewhere that compare texts."""
    part = {name: _SECTION.replace("{n}", "|".join(heads)) for name, heads in PARTS.items()}
    sides = " union all ".join(f"select pair, '{name}' as section, {cut} as p, {cut.replace('regexp_extract(text', 'regexp_extract(reference')} as r from d" for name, cut in part.items())
    counted = """e as (select pair, section, side, n, array_to_string(w[i:i + n - 1], ' ') as gram from w, (select unnest([1::bigint, 2]) as n), lateral (select unnest(range(1, len(w) - n + 2)) as i)),
g as (select pair, section, n, gram, count(*) filter (side = 'p') as p, count(*) filter (side = 'r') as r from e group by all),
b as (select pair, section, n, sum(least(p, r))::double as hit, sum(p)::double as sp, sum(r)::double as sr from g group by all),
q as (select *, coalesce(hit / nullif(sp, 0), 0) as precision, coalesce(hit / nullif(sr, 0), 0) as recall from b),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f from q)"""
    words = "regexp_extract_all(lower({c}), '[a-z0-9]+|[一-鿿]')"
    return {
        "a28_sections": "with d as (select doc_id as pair, text, lead(text) over (partition by source, lang, doc_id // 1000 order by doc_id) as reference from documents where text is not null), s as (" + sides + "), v as (select * from s where p is not null and r is not null), "
        + f"w as (select pair, section, 'p' as side, {words.format(c='p')} as w from v union all select pair, section, 'r', {words.format(c='r')} from v), " + counted
        + ", m as (select section, round(avg(f) filter (n = 1), 6) as f1, round(avg(f) filter (n = 2), 6) as f2, round(avg(precision) filter (n = 1), 6) as precision, round(avg(recall) filter (n = 1), 6) as recall from f group by 1) select section, pairs, valid, f1, f2, precision, recall from (select section, count(*) as pairs, count(*) filter (p is not null and r is not null) as valid from s group by 1) left join m using (section)",
        "a23_bleu_smoothed": _PAIRS + ", w as (select pair, 'p' as side, " + _CUT.format(t="prediction") + " as w from pr union all select pair, 'r', " + _CUT.format(t="reverse(lower(reference))") + """ from pr),
e as (select pair, side, n, array_to_string(w[i:i + n - 1], chr(1)) as gram from w, (select unnest([1::bigint, 2, 3, 4]) as n), lateral (select unnest(range(1, len(w) - n + 2)) as i)),
g as (select pair, n, gram, count(*) filter (side = 'p') as p, count(*) filter (side = 'r') as r from e group by all),
b as (select n, sum(least(p, r))::double as hit, sum(p)::double as al, sum(r)::double as ref from g group by n),
z as (select *, sum(case when hit = 0 then 1 else 0 end) over (order by n) as z from b),
q as (select """ + ", ".join(f"max(case when hit = 0 then pow(0.5, z) else hit end / al) filter (n = {n}) as p{n}" for n in range(1, 5)) + """, max(al) filter (n = 1) as c, max(ref) filter (n = 1) as r from z)
select round(p1, 8) as p1, round(p2, 8) as p2, round(p3, 8) as p3, round(p4, 8) as p4, round(case when c >= r then 1.0 else exp(1 - r / c) end, 8) as brevity, round(case when c >= r then 1.0 else exp(1 - r / c) end * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 8) as bleu from q""",
        "e03_evaluators": _GRAMS + """,
b as (select pair, sum(least(p, r))::double as hit, sum(p)::double as sp, sum(r)::double as sr from g where n = 1 group by all),
v as (select pair, prediction, try_cast(nullif(regexp_extract(translate(prediction, ',%', ''), '(-?[0-9]+\\.?[0-9]*)', 1), '') as double) as a, try_cast(nullif(regexp_extract(translate(reference, ',%', ''), '(-?[0-9]+\\.?[0-9]*)', 1), '') as double) as t, (cast(regexp_matches(prediction, '(?i)Layout') as int) + cast(regexp_matches(prediction, '版面') as int)) / 2.0 as h from pr)
select v.pair, round(cast(case when trim(prediction) = '' then 0.0 when length(prediction) between 500 and 3000 then least(h + 0.1, 1.0) when length(prediction) > 5000 then greatest(h - 0.3, 0.0) else h end as double), 6) as sections,
  coalesce(case when t = 0 then case when abs(a) < 0.001 then 1.0 else 0.0 end when abs(a - t) <= abs(t) * 0.03 then 1.0 else case when a is null or t is null then 0.0 else 0.0 end end, 0.0)::double as values,
  round(coalesce(2 * coalesce(hit / nullif(sp, 0), 0) * coalesce(hit / nullif(sr, 0), 0) / nullif(coalesce(hit / nullif(sp, 0), 0) + coalesce(hit / nullif(sr, 0), 0), 0), 0), 6) as overlap from v left join b using (pair)""",
    }
