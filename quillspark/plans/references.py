"""Queries on references between tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.references import OrphanCheck, orphan_references, references_of
from quillspark.sources.tables import table


def _check(spark: SparkSession, d: str) -> OrphanCheck:
    return orphan_references(
        [
            references_of(table(spark, d, "annotations"), "annotations", "id", "image_id", "annotated_at"),
            references_of(table(spark, d, "annotation_history"), "annotation_history", "id", "image_id", "created_at"),
        ],
        table(spark, d, "images"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d).orphans().select("tab", "rec_id").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d).report()


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}

_ORPHANS = r"""
with made as (
  select lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) as key, lower(trim(coalesce(status, ''))) <> 'deleted' as alive,
    case when abs(created_at) < 100000000000 then created_at * 1000 else created_at end as ms
  from images),
states as (
  select key, bool_or(alive) as alive, case when count(ms) = count(*) then min(ms) end as first_ms
  from made where key <> '' group by key),
raw as (
  select 'annotations' as tab, id as rec_id, image_id, annotated_at as t from annotations
  union all select 'annotation_history', id, image_id, created_at from annotation_history),
refs as (
  select distinct tab, rec_id, lower(regexp_replace(image_id, '^\s+|\s+$', '', 'g')) as key,
    case when abs(t) < 100000000000 then t * 1000 else t end as own_ms
  from raw where regexp_replace(image_id, '^\s+|\s+$', '', 'g') <> ''),
judged as (
  select *, coalesce(strftime(make_timestamp(cast(own_ms as bigint) * 1000), '%Y-%m'), 'unknown') as period,
    case when alive is null then 'missing' when not alive then 'deleted' when first_ms > own_ms then 'late' else 'ok' end as verdict
  from refs left join states using (key))
"""

SQL = {
    "p2_found": _ORPHANS + "select distinct tab, rec_id from judged where verdict <> 'ok'",
    "p2_report": _ORPHANS
    + """select tab, period, count(*) as "references", count(*) filter (verdict = 'missing') as missing,
  count(*) filter (verdict = 'deleted') as deleted, count(*) filter (verdict = 'late') as late,
  round(count(*) filter (verdict <> 'ok') / cast(count(*) as double), 6) as orphan_share
from judged group by tab, period""",
}
