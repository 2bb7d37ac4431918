"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

#: A key with at least this share of the left rows is hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001

#: Operators that are worth running once only.
COSTLY = ("Exchange", "Arrow", "Python", "Pandas")


def hot_keys(left: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """key, rows of the keys with at least ``share`` of all rows that have a key: at most 1 / share of them, whatever the
    size. Only they are written."""
    some = left.where(F.col(key).isNotNull())
    least = max(1.0, some.count() * share)
    return cut_lineage(some.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least))


def written_once(df: DataFrame) -> DataFrame:
    """``df`` for several uses: as it is where it only scans and filters, else written to the checkpoint folder."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return cut_lineage(df) if any(name in plan for name in COSTLY) else df


def lookup_join(left: DataFrame, right: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Left join of ``left`` with ``right``, which has at most one row for each key.

    Rows with a hot key meet a broadcast of those keys' right rows (at most 1 / share, one row each) and aren't
    shuffled, nor are rows with a null key; the others are joined as Spark sees fit. ``left`` is computed once, or
    scanned if it is a scan. Columns other than the key must differ in name.
    """
    left = written_once(left)
    hot = hot_keys(left, key, share).select(key)
    told = F.broadcast(hot.join(right, key, "left").withColumn("_hot", F.lit(True)))
    columns = [*left.columns, *[c for c in right.columns if c != key]]
    still = left.join(told, key, "left").where(F.col("_hot") | F.col(key).isNull())
    moved = left.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return still.select(columns).unionByName(moved.select(columns))


def matched(left: DataFrame, right: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Inner join in which both sides may have many rows for one key.

    The right rows of a key with at least ``share`` of them are cut into parts of that size by the hash of their other
    columns, and its left rows meet every part, so no task gets a whole hot key. Hot keys are at most 1 / share, as are
    one key's parts. Columns other than the key must differ in name.
    """
    hot = hot_keys(right, key, share)
    size = hot.agg(F.min("rows")).first()[0]
    if size is None:
        return left.join(right, key)
    parts = F.broadcast(hot.select(key, F.ceil(F.col("rows") / F.lit(size)).cast("int").alias("_parts")))
    others = [c for c in right.columns if c != key]
    cut = right.join(parts, key, "left").withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*others), F.col("_parts"))).otherwise(0).cast("int")).drop("_parts")
    met = left.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return met.join(cut, [key, "_part"]).drop("_part")
