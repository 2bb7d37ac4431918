"""Queries of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.languages import LanguageCheck, annotation_texts, check_languages, declared_languages
from quillspark.llm.mixing import mix_sources
from quillspark.llm.overlap import Overlap, cross_split_overlap
from quillspark.llm.proportions import ProportionSample, proportion_sample
from quillspark.llm.spam import spam_pages
from quillspark.llm.tokens import token_ids
from quillspark.llm.truncation import length_histogram, length_peaks, measured, rates, summaries_and_answers, truncated
from quillspark.sources.tables import table


def _languages(spark: SparkSession, d: str) -> LanguageCheck:
    return check_languages(annotation_texts(table(spark, d, "annotations")), declared_languages(table(spark, d, "images"), table(spark, d, "task_definitions"), table(spark, d, "data_sources")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).mismatches().select(F.col("rec_id").alias("annotation_id"), "lang")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).segments().withColumnRenamed("rec_id", "annotation_id")


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).documents().withColumnRenamed("rec_id", "annotation_id")


def _sample(spark: SparkSession, d: str) -> ProportionSample:
    return proportion_sample(table(spark, d, "task_definitions"), table(spark, d, "sampling_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).unmet()


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).sample()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    report = _sample(spark, d).report()
    return report.select("target_id", "config_name", F.round("need", 6).alias("need"), "available", "drawn", F.round("deficit", 6).alias("deficit"), F.round("share", 6).alias("share"))


def _overlap(spark: SparkSession, d: str) -> Overlap:
    return cross_split_overlap(table(spark, d, "split_members"), table(spark, d, "images"), table(spark, d, "annotations"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).found()


def p4_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation and training members of one image id."""
    return _overlap(spark, d).same_marks().where("how = 'id'").select("evaluation", "training")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).report()


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of text classes, not of their members."""
    return _overlap(spark, d).near().select(F.hex("a").alias("class_evaluation"), F.hex("b").alias("class_training"), F.round("containment", 6).alias("containment"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership in classes by id, file name and text, and the links of each class."""
    return _overlap(spark, d).membership()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return summaries_and_answers(table(spark, d, "annotations"), table(spark, d, "images"), table(spark, d, "messages"))


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncated(_texts(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("cut").select("tab", "rec_id").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(_truncated(spark, d))


def p5_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which a source has far too many texts, whole ones included."""
    return length_peaks(length_histogram(measured(_texts(spark, d)))).select("tab", "source", "unit", F.col("length").cast("bigint").alias("length"), "texts")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), keep=["doc_id"])


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights")).copies()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "source_weights")
    return mix_sources(table(spark, d, "documents"), weights).shares(weights)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents")).found()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents")).scores()


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_segments, p1_documents, p3_found, p3_sample, p3_report, p4_found, p4_by_id, p4_report, p4_links, p4_classes, p5_found, p5_rates, p5_peaks, p6_ids, p7_copies, p7_shares, p8_found, p8_scores)
}

_TARGETS = r"""
with wanted as (
  select distinct target_id, config_name,
    replace(lower(regexp_replace(chart_type, '^\s+|\s+$', '', 'g')), '-', '_') as chart,
    replace(lower(regexp_replace(theme, '^\s+|\s+$', '', 'g')), '-', '_') as theme,
    greatest(coalesce(ratio * total_samples, 0.0), cast(coalesce(min_rows, 0) as double)) as need
  from sampling_targets),
own as (
  select distinct task_id,
    replace(lower(regexp_replace(chart_type, '^\s+|\s+$', '', 'g')), '-', '_') as c,
    replace(lower(regexp_replace(theme, '^\s+|\s+$', '', 'g')), '-', '_') as t
  from task_definitions where task_id is not null),
members as (
  select distinct target_id, config_name, need, task_id,
    cast('0x' || substr(md5('0:' || target_id || ':' || task_id), 1, 13) as bigint) / 4503599627370496.0 as draw
  from wanted join own on (chart is null or chart = c) and (theme is null or theme = t)),
counts as (
  select w.target_id, w.config_name, w.need, count(distinct m.task_id) as available
  from wanted w left join members m on w.target_id = m.target_id group by all)
"""

_PEAKS = r"""
with images_of as (
  select lower(regexp_replace(id, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g')) as key, min(source) as source from images group by 1),
texts as (
  select 'annotations' as tab, coalesce(i.source, '') as source, summary as text from annotations a
    left join images_of i on lower(regexp_replace(a.image_id, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g')) = i.key and i.key <> ''
  union all select 'messages', coalesce(source, ''), content from messages where lower(trim(role)) = 'gpt'),
lengths as (
  select tab, source, unnest(['chars', 'bytes']) as unit, unnest([length(text), strlen(text)]) as length from texts
  where regexp_matches(text, '[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')),
counts as (select tab, source, unit, length, count(*) as texts from lengths group by all),
near as (
  select *, (sum(texts) over (partition by tab, source, unit order by length range between 12 preceding and 12 following) - texts) / 24.0 as others from counts)
select tab, source, unit, length, texts from near where texts >= 8 and texts >= 4 * greatest(others, 0.5)
"""

_ID = "lower(regexp_replace(image_id, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g'))"

SQL = {
    "p4_by_id": f"with m as (select distinct member_id, {_ID} as key, lower(trim(split)) = 'train' as train from split_members where trim(split) <> '') select distinct e.member_id as evaluation, t.member_id as training from m e join m t using (key) where key <> '' and not e.train and t.train and e.member_id <> t.member_id",
    "p5_peaks": _PEAKS,
    "p3_found": _TARGETS + "select target_id from counts where available < need",
    "p3_sample": _TARGETS
    + """select config_name, target_id, task_id from (
  select *, row_number() over (partition by target_id order by draw, task_id) as place from members)
where place <= ceil(need)""",
    "p3_report": _TARGETS
    + """select target_id, config_name, round(need, 6) as need, available,
  least(cast(ceil(need) as bigint), available) as drawn, round(greatest(0.0, need - available), 6) as deficit,
  round(least(cast(ceil(need) as bigint), available) / cast(sum(least(cast(ceil(need) as bigint), available)) over (partition by config_name) as double), 6) as share
from counts""",
}
