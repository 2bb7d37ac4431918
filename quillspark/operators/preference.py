"""Candidates, preference pairs and margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in an append log. max_by keeps one row for each key in every task, so a hot key's rows
    are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def best_and_worst(df: DataFrame, item: str, index: str, score: str) -> DataFrame:
    """item, best, worst, delta: the first candidates with the highest and lowest positive score, if they differ."""
    g = df.where(F.col(score) > 0).groupBy(item).agg(
        F.max_by(index, F.struct(score, -F.col(index))).alias("best"), F.max(score).alias("best_score"),
        F.min_by(index, F.struct(score, index)).alias("worst"), F.min(score).alias("worst_score"), F.count(F.lit(1)).alias("candidates"),
    )
    return g.where("best != worst").select(item, "best", "worst", "candidates", (F.col("best_score") - F.col("worst_score")).alias("delta"))


def at_least(pairs: DataFrame, delta: float) -> DataFrame:
    return pairs.where(F.col("delta") >= delta)


def normalised(pairs: DataFrame, with_facts=None, fallback: float = 20.0) -> DataFrame:
    """Add margin = delta / mean delta, to four digits; with ``with_facts`` the mean is over those rows, others get 1."""
    mean = pairs.where(with_facts).agg(F.avg("delta").alias("_m")) if with_facts is not None else pairs.agg(F.avg("delta").alias("_m"))
    ratio = F.round(F.try_divide(F.col("delta").cast("double"), F.coalesce(F.when(F.col("_m") != 0, F.col("_m")), F.lit(fallback))), 4)
    joined = pairs.crossJoin(F.broadcast(mean))
    return joined.withColumn("margin", F.when(with_facts, ratio).otherwise(1.0) if with_facts is not None else ratio).drop("_m")


def margins(pairs: DataFrame, gammas: list[float]) -> DataFrame:
    """A row for each gamma: margin = max(0, gamma x delta)."""
    return pairs.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas]))).withColumn("margin", F.round(F.greatest(F.lit(0.0), F.col("gamma") * F.col("delta")), 4))


def calibrated_gamma(pairs: DataFrame, margin: str, delta: str, share: float = 0.3) -> DataFrame:
    """One row: share x mean margin / mean absolute delta."""
    return pairs.agg(F.try_divide(share * F.avg(margin), F.avg(F.abs(F.col(delta)))).alias("gamma"))


def flipped(pairs: DataFrame, fact_delta: str, strong: float = 0.2) -> DataFrame:
    """Pairs whose rejected side has more facts change sides; ``strong`` marks large differences."""
    d = F.col(fact_delta)
    return pairs.withColumns({"_c": F.when(d < 0, F.col("rejected")).otherwise(F.col("chosen")), "_r": F.when(d < 0, F.col("chosen")).otherwise(F.col("rejected")), "strong": F.abs(d) > strong}).drop("chosen", "rejected").withColumnsRenamed({"_c": "chosen", "_r": "rejected"})


def next_version(history: DataFrame, key: str, version: str = "version") -> DataFrame:
    """key, next: one above the highest version, 1 where there is none."""
    return history.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).cast("long").alias("next"))


def numbered_parts(df: DataFrame, parts: int, *order) -> DataFrame:
    """Add ``robin`` (row % parts), ``block`` (contiguous parts, the first ones one row larger) and ``batch``."""
    from quillspark.operators.relational import ordinals

    n = df.agg(F.count(F.lit(1)).alias("_n"))
    i, base, more = F.col("ordinal"), F.floor(F.col("_n") / parts), F.col("_n") % parts
    block = F.when(i < more * (base + 1), F.floor(i / (base + 1))).otherwise(more + F.floor(F.try_divide(i - more * (base + 1), base)))
    return ordinals(df, *order).crossJoin(F.broadcast(n)).withColumns({"robin": F.pmod(i, F.lit(parts)).cast("int"), "block": block.cast("int")}).drop("_n")


def row_windows(df: DataFrame, group: str, *order) -> DataFrame:
    return df.withColumn("row", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
