"""Profiles, rollups, histograms and checks. All aggregate in part before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage


def spread_quantiles(df: DataFrame, group: list[str], value: str, at: list[float]) -> DataFrame:
    """group, q: interpolated quantiles of each group as an array, exact, and without any task that holds a group.

    Equal values are counted first; the counts are range-partitioned by group and value, so a hot group lies in many
    tasks, and each task's counts tell the next ones where their ranks begin.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    parts = cut_lineage(counts.repartitionByRange(*group, "_v").withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy(*group, "_p").agg(F.sum("_n").alias("_s"))
    whole = Window.partitionBy(*group)
    before = sums.select(*group, "_p", (F.sum("_s").over(whole.orderBy("_p")) - F.col("_s")).alias("_b"), F.sum("_s").over(whole).alias("_all"))
    inner = F.sum("_n").over(Window.partitionBy(*group, "_p").orderBy("_v"))
    same = F.lit(True)
    for name in [*group, "_p"]:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    placed = parts.withColumn("_to", inner).alias("a").join(before.alias("b"), same).select(*[F.col(f"a.{g}").alias(g) for g in group], "_v", "_all", (F.col("_to") + F.col("_b")).alias("_to"), "_n")
    place = [(F.col("_all") - 1) * q for q in at]
    holds = lambda rank: (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n"))
    low = [F.max(F.when(holds(F.floor(p)), F.col("_v"))) for p in place]
    high = [F.max(F.when(holds(F.ceil(p)), F.col("_v"))) for p in place]
    rest = [F.max(p - F.floor(p)) for p in place]
    return placed.groupBy(*group).agg(F.array(*[a + (b - a) * r for a, b, r in zip(low, high, rest)]).alias("q"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std (sample), min, q25, median, q75, max of each numeric column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    told = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = spread_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75])
    return told.join(q, "column", "left").select("column", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max")


def distribution(df: DataFrame, columns: list[str], whole: int = 10, top: int = 5) -> DataFrame:
    """column, value, n, classes: all values of a column with up to ``whole`` classes, else its ``top`` most frequent."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("column")
    placed = counts.withColumns({"classes": F.count(F.lit(1)).over(by), "place": F.row_number().over(by.orderBy(F.desc("n"), "value"))})
    return placed.where((F.col("classes") <= whole) | (F.col("place") <= top)).drop("place")


def quantiles(df: DataFrame, group: list[str], column: str, at: list[float]) -> DataFrame:
    """Interpolated quantiles as q01 ... for each group, with mean, deviation and extremes."""
    told = df.groupBy(*group).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    q = spread_quantiles(df, group, column, at).withColumnsRenamed({g: f"_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    joined = told.join(q, same, "left")
    return joined.select(*group, *[F.col("q")[k].alias(f"q{round(x * 100):02d}") for k, x in enumerate(at)], "mean", "std", "min", "max")


def rank_percentiles(df: DataFrame, group: list[str], column: str, percents: list[int]) -> DataFrame:
    """Values at the truncated rank n x p // 100 (from 0) of each group's order; not interpolated.

    Works on counts of distinct values, so a group's rows are never gathered.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*group)
    placed = counts.withColumns({"_to": F.sum("_n").over(by.orderBy(column)), "_all": F.sum("_n").over(by)})
    return placed.groupBy(*group).agg(*[F.min(F.when(F.col("_to") > F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1), F.col(column))).alias(f"p{p}") for p in percents])


def dimension_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n, percent: one distribution for each column, by grouping sets in one pass."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in columns])))
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("dimension")))


def rollup_status(df: DataFrame, columns: list[str], success) -> DataFrame:
    """dimension, value, total, success, failed, rate for each value of each column."""
    long = df.withColumn("_ok", success).select("_ok", F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in columns])))
    ok = F.count_if("_ok")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("total"), ok.alias("success"), (F.count(F.lit(1)) - ok).alias("failed"), (ok / F.count(F.lit(1))).alias("rate"))


def conditional_counts(df: DataFrame, group: str, **conditions) -> DataFrame:
    """Rows of each group and how many meet each condition; rows without a group don't count."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def table_counts(**frames: DataFrame) -> DataFrame:
    """name, n of each table."""
    return reduce(DataFrame.unionAll, [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, f in frames.items()])


def group_difference(df: DataFrame, group: str, base: str, other: str, columns: list[str]) -> DataFrame:
    """column, base, other, difference, percent of base: two groups' means of each column."""
    long = df.where(F.col(group).isin(base, other)).select(group, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    g = long.groupBy("column").agg(F.avg(F.when(F.col(group) == base, F.col("v"))).alias("base"), F.avg(F.when(F.col(group) == other, F.col("v"))).alias("other"))
    return g.withColumn("difference", F.col("other") - F.col("base")).withColumn("percent", F.try_divide(F.col("difference"), "base") * 100)


def signs(df: DataFrame, column: str, dead: float = 0.0) -> DataFrame:
    """Counts and shares of values above, within and below a dead band around zero."""
    v = F.col(column)
    return df.where(v.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(v > dead).alias("positive"), F.count_if(F.abs(v) <= dead).alias("zero"), F.count_if(v < -dead).alias("negative")).withColumns(
        {f"{s}_share": F.try_divide(F.col(s).cast("double"), F.col("n")) for s in ("positive", "zero", "negative")}
    )


def histogram(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Counts of rounded values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.round(column, digits).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def brackets(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts of values in [edge, next edge), from minus infinity to plus infinity; empty brackets are left out."""
    low, high = [None, *edges], [*edges, None]
    v = F.col(column)
    label = F.lit(None)
    for a, b in zip(low, high):
        inside = (v >= a if a is not None else F.lit(True)) & (v < b if b is not None else F.lit(True))
        label = F.when(inside & v.isNotNull(), F.lit(f"[{'-inf' if a is None else a},{'inf' if b is None else b})")).otherwise(label)
    return df.withColumn("bracket", label).where("bracket is not null").groupBy("bracket").agg(F.count(F.lit(1)).alias("n"))


def shares_with_warnings(df: DataFrame, column: str, expected: DataFrame, least: float) -> DataFrame:
    """value, n, share, warning: each expected value's share, with a warning if unused or under ``least``."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    rows = expected.select(column).distinct().join(counts, column, "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    share = F.try_divide(F.col("n").cast("double"), F.col("_all"))
    return rows.select(column, "n", share.alias("share"), F.when(F.col("n") == 0, "unused").when(share < least, "low").alias("warning"))


def run_summary(df: DataFrame, group: list[str], success, duration: str, size: str) -> DataFrame:
    """Runs, successes, success rate, mean of positive durations and total size; 0 where there is nothing to divide."""
    d = F.col(duration)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(success).alias("success"), F.coalesce(F.try_divide(F.count_if(success).cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("rate"),
        F.coalesce(F.avg(F.when(d > 0, d)), F.lit(0.0)).alias("mean_duration"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"),
    )
