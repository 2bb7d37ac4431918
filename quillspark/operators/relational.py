"""Joins, filters, set operations, ordering and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.skew import hot_keys, lookup_join

# --- filters -----------------------------------------------------------------------------------------------------


def equal_or_all(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows with the value; None and ``all`` keep every row."""
    return df if value in (None, "all") else df.where(F.col(column) == value)


def filled(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the text columns is null or blank."""
    return reduce(lambda d, c: d.where(F.col(c).isNotNull() & (F.trim(c) != "")), columns, df)


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the numbers is null, NaN or infinite."""
    return reduce(lambda d, c: d.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), columns, df)


def member_of(df: DataFrame, column: str, given: list | None, default: list) -> DataFrame:
    """Rows whose value is among the given ones, or among the default ones if none are given."""
    return df.where(F.col(column).isin(given or default))


def with_prefix(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose value starts with one of the prefixes; no prefixes keep every row."""
    return df.where(reduce(lambda a, b: a | b, [F.startswith(F.col(column), F.lit(p)) for p in prefixes])) if prefixes else df


def without_hidden(df: DataFrame, column: str) -> DataFrame:
    """Rows whose name doesn't start with a dot or an underscore."""
    return df.where(~F.col(column).rlike(r"^[._]"))


def without_combinations(df: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Rows whose combination of the forbidden table's columns isn't forbidden; nulls are in no combination."""
    return df.join(forbidden.distinct(), forbidden.columns, "left_anti")


def checked(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Add ``valid``: whether the value, in small letters, is one of the domain; null isn't."""
    return df.withColumn("valid", F.coalesce(F.lower(F.trim(column)).isin([d.lower() for d in domain]), F.lit(False)))


# --- joins -------------------------------------------------------------------------------------------------------


def attach(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a table with one row for each key; hot keys don't gather in one task."""
    return lookup_join(left, right, key)


def excluded(df: DataFrame, exclusions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key isn't in the exclusions, and those whose key is. Null keys are never excluded."""
    keys = exclusions.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def pending(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that aren't done yet."""
    return excluded(every, done, key)[0]


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default, usable=None) -> DataFrame:
    """Left join of one column; where it is missing or its row isn't usable, the default."""
    rows = right.select(key, F.when(usable, F.col(column)).alias(column)) if usable is not None else right.select(key, column)
    return lookup_join(left, rows.dropDuplicates([key]), key).withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def chunked_history(parents: DataFrame, rows: DataFrame, key: str, order: list[str], fields: list[str], size: int = 1000) -> DataFrame:
    """key, chunk, history: the rows of each parent as ordered lists of up to ``size`` each, in order of chunk; one empty
    list if there are none. No list grows with a hot parent: rows are range-partitioned by key and order, so that one
    parent's rows may lie in many tasks, and chunks follow its rows' places in that order."""
    placed = ordinals(rows.where(F.col(key).isNotNull()), key, *order)
    first = placed.groupBy(key).agg(F.min("ordinal").alias("_first"))
    cut = placed.join(first, key).withColumn("chunk", F.floor((F.col("ordinal") - F.col("_first")) / size))
    packed = cut.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("history"))
    joined = parents.join(packed, key, "left")
    return joined.withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "history": F.coalesce("history", F.expr("cast(array() as " + packed.schema["history"].dataType.simpleString() + ")"))})


def nested_history(parents: DataFrame, rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Add ``history``: the rows of each parent as an ordered list, empty if there are none.

    The list of one parent must fit into one row; where a parent may have any number of rows, take chunked_history.
    Ordering is inside the list, so rows aren't sorted as a whole.
    """
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("history"))
    joined = parents.join(packed, key, "left")
    return joined.withColumn("history", F.coalesce("history", F.expr("cast(array() as " + packed.schema["history"].dataType.simpleString() + ")")))


def full_compare(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or extra."""
    e, a = expected.select(key).distinct().withColumn("_e", F.lit(1)), actual.select(key).distinct().withColumn("_a", F.lit(1))
    return e.join(a, key, "full").where("_e is null or _a is null").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("kind"))


def cross(left: DataFrame, right: DataFrame, most: int = 100_000) -> DataFrame:
    """All combinations of two small tables; refused where either has more than ``most`` rows."""
    for side in (left, right):
        if side.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} rows in a cross product")
    return left.crossJoin(F.broadcast(right))


# --- sets --------------------------------------------------------------------------------------------------------


def union_all(*frames: DataFrame | None) -> DataFrame:
    """All rows of all frames by column name; absent frames and absent columns are tolerated."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f for f in frames if f is not None])


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().exceptAll(right.select(key).distinct())


def key_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct()


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def merged(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: of both tables, the second's value where both have the key. Each must have one row for a key."""
    right = over.select(key, F.col(value).alias("_over"), F.lit(True).alias("_there"))
    return base.select(key, value).join(right, key, "full").select(key, F.when(F.col("_there"), F.col("_over")).otherwise(F.col(value)).alias(value))


# --- order -------------------------------------------------------------------------------------------------------


def top(df: DataFrame, count: int, *order) -> DataFrame:
    """The first rows of an order; the order must end in a unique column. No global sort: each task keeps ``count``."""
    return df.orderBy(*order).limit(count)


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """One page (from 1) of an order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def piece(df: DataFrame, start: int, count: int, *order) -> DataFrame:
    """``count`` rows from place ``start`` (from 0) of an order; each task keeps start + count at most."""
    return df.orderBy(*order).offset(start).limit(count)


def top_per_group(df: DataFrame, group: list[str], count: int, *order) -> DataFrame:
    """The first rows of each group; Spark cuts groups before the shuffle, so none is gathered whole."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= count).drop("_n")


def ends(column, count: int = 3):
    """The first and the last ``count`` elements of a long array; a short one as it is."""
    return F.when(F.size(column) > 2 * count, F.concat(F.slice(column, 1, count), F.slice(column, -count, count))).otherwise(column)


def ordinals(df: DataFrame, *order) -> DataFrame:
    """Add ``ordinal`` (from 0) in a total order without one task that sorts everything.

    Rows are range-partitioned by the order; each partition's count gives the next one its offset.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    from quillspark.session import cut_lineage

    kept = cut_lineage(parts)
    counts = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_first"))
    before = F.broadcast(counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b", "_first"))
    return kept.join(before, "_p").withColumn("ordinal", (F.col("_m") - F.col("_first") + F.col("_b")).cast("long")).drop("_p", "_m", "_b", "_first")
