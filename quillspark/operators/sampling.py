"""Seeded samples, splits and allocations. A row's place depends on the hash of seed and key alone, so that results are
the same for every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.skew import lookup_join


def place(seed: int, *keys):
    """The sort key of a row: md5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def unit(seed: int, *keys):
    """A number in [0, 1) from the same hash."""
    return F.conv(F.substring(place(seed, *keys), 1, 13), 16, 10).cast("double") / float(16**13)


def uniform(df: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` rows, or all if there are fewer; each task keeps only ``count``."""
    return df.withColumn("_u", place(seed, F.col(key))).orderBy("_u", key).limit(count).drop("_u")


def stratified(df: DataFrame, key: str, stratum: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Up to ``target`` rows of each stratum of targets (stratum, target); a short stratum gives all it has.

    A stratum's rows are ordered by hash. Rows are counted by the first six digits of it, and only those of the prefix in
    which the last row lies, one in sixteen million, are ranked; no rows are moved but for those, and hot strata aren't
    gathered.
    """
    wanted = targets.groupBy(stratum).agg(F.max("target").alias("target"))
    prefix = F.substring(place(seed, F.col(key)), 1, 6)
    rows = lookup_join(df, wanted, stratum).where("target is not null").withColumn("_b", prefix)
    # counts of hash prefixes tell which prefixes are taken whole, and in which one a stratum's last row lies
    counts = rows.groupBy(stratum, "_b", "target").agg(F.count(F.lit(1)).alias("_c"))
    coarse = counts.groupBy(stratum, F.substring("_b", 1, 3).alias("_a"), "target").agg(F.sum("_c").alias("_c"))
    until = F.sum("_c").over(Window.partitionBy(stratum).orderBy("_a"))
    edges = coarse.withColumn("_until", until).where((F.col("_until") - F.col("_c")) < F.col("target")).groupBy(stratum).agg(F.max("_a").alias("_last"), F.max_by(F.col("_until") - F.col("_c"), "_a").alias("_before"))
    fine = counts.join(edges, stratum).where(F.substring("_b", 1, 3) == F.col("_last"))
    inner = F.sum("_c").over(Window.partitionBy(stratum).orderBy("_b")) + F.col("_before")
    border = fine.withColumn("_until", inner).where((F.col("_until") - F.col("_c")) < F.col("target")).groupBy(stratum).agg(F.max("_b").alias("_edge"), F.max_by(F.col("_until") - F.col("_c"), "_b").alias("_taken"))
    told = lookup_join(rows, border, stratum)
    whole = told.where(F.col("_b") < F.col("_edge"))
    order = Window.partitionBy(stratum).orderBy(place(seed, F.col(key)), key)
    last = told.where(F.col("_b") == F.col("_edge")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") + F.col("_taken") <= F.col("target"))
    return whole.select(df.columns).unionByName(last.select(df.columns))


def ratio_targets(ratios: DataFrame, stratum: str, total: int) -> DataFrame:
    """stratum, target: int(total x ratio), what is left over to the stratum with the largest ratio."""
    base = ratios.withColumn("target", F.floor(F.lit(total) * F.col("ratio") + 1e-9))
    whole = Window.partitionBy(F.lit(1))
    first = F.row_number().over(whole.orderBy(F.desc("ratio"), stratum)) == 1
    return base.withColumn("target", (F.col("target") + F.when(first, F.lit(total) - F.sum("target").over(whole)).otherwise(0)).cast("long")).select(stratum, "target")


def split(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Add ``split``: train for the first int(n x ratio) rows in the order of hashes, else val.

    The border is found from counts of hash prefixes; the rows before and behind it stay where they are, and only those
    of its prefix, one in 65,536, are ranked.
    """
    rows = df.withColumn("_u", place(seed, F.col(key))).withColumn("_b", F.substring("_u", 1, 4))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.orderBy("_b")
    placed = counts.select("_b", F.sum("_c").over(order).alias("_until"), F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_n"), "_c")
    edge = placed.where(F.col("_until") >= F.floor(F.col("_n") * ratio)).agg(F.min_by(F.struct(F.col("_b").alias("_edge"), (F.floor(F.col("_n") * ratio) - F.col("_until") + F.col("_c")).alias("_left")), "_b").alias("_e")).select("_e.*")
    told = rows.crossJoin(F.broadcast(edge))
    sure = told.where(F.col("_b") != F.col("_edge")).withColumn("split", F.when(F.col("_b") < F.col("_edge"), "train").otherwise("val"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_u", key))
    border = told.where(F.col("_b") == F.col("_edge")).withColumn("split", F.when(rank <= F.col("_left"), "train").otherwise("val"))
    return sure.unionByName(border).drop("_u", "_b", "_edge", "_left")


def expanded(quotas: DataFrame, item: str, total: int, seed: int = 0) -> DataFrame:
    """item, copy: int(total x quota) rows of each item, the gap filled one by one in the order of hashes."""
    base = quotas.withColumn("_n", F.floor(F.lit(total) * F.col("quota") + 1e-9).cast("int"))
    whole = Window.partitionBy(F.lit(1))
    gap = F.lit(total) - F.sum("_n").over(whole)
    filled = base.withColumns({"_gap": gap, "_o": F.row_number().over(whole.orderBy(place(seed, F.col(item)))), "_k": F.count(F.lit(1)).over(whole)})
    more = F.floor(F.col("_gap") / F.col("_k")) + (F.col("_o") <= F.col("_gap") % F.col("_k")).cast("int")
    return filled.select(item, F.explode(F.sequence(F.lit(1), (F.col("_n") + more).cast("int"))).alias("copy")).where("copy >= 1")


def weighted_pick(df: DataFrame, key: str, weights: DataFrame, item: str, seed: int = 0) -> DataFrame:
    """Add ``item``: for each row the weight interval that its hash falls into. Weights are a small parameter table."""
    ordered = Window.orderBy(item)
    total = Window.partitionBy(F.lit(1))
    ranges = weights.where("weight > 0").select(item, F.try_divide(F.sum("weight").over(ordered) - F.col("weight"), F.sum("weight").over(total)).alias("_lo"), F.try_divide(F.sum("weight").over(ordered), F.sum("weight").over(total)).alias("_hi"))
    packed = ranges.agg(F.array_sort(F.collect_list(F.struct("_lo", "_hi", item))).alias("_w"))
    rows = df.withColumn("_u", unit(seed, F.col(key))).crossJoin(F.broadcast(packed))
    hit = F.filter("_w", lambda w: (F.col("_u") >= w["_lo"]) & (F.col("_u") < w["_hi"]))
    return rows.withColumn(item, F.coalesce(hit[0][item], F.element_at("_w", -1)[item])).drop("_u", "_w")


def affinity_distribution(chances: DataFrame, affinities: DataFrame, forbidden: DataFrame, group: str, item: str, default: float = 0.5) -> DataFrame:
    """group, item, chance: p x affinity / sum within each group.

    Affinities are looked up for the pair, else for the group's ``default`` item, else ``default``; items with no
    affinity and forbidden pairs are left out. A group that would lose all keeps its unadjusted chances.
    """
    pair = affinities.where(F.col(item) != "default").select(group, item, F.col("affinity").alias("_a"))
    other = affinities.where(F.col(item) == "default").select(group, F.col("affinity").alias("_d"))
    banned = forbidden.select(group, item).distinct().withColumn("_x", F.lit(True))
    rows = chances.join(pair, [group, item], "left").join(other, group, "left").join(banned, [group, item], "left")
    a = F.when(F.col("_x"), 0.0).otherwise(F.coalesce("_a", "_d", F.lit(default)))
    w = Window.partitionBy(group)
    scored = rows.withColumn("_p", F.col("p") * a).withColumns({"_all": F.sum("_p").over(w), "_raw": F.sum("p").over(w)})
    chance = F.when(F.col("_all") > 0, F.col("_p") / F.col("_all")).otherwise(F.col("p") / F.col("_raw"))
    return scored.withColumn("chance", chance).where("chance > 0").select(group, item, "chance")


def grouped_pick(df: DataFrame, key: str, group: str, chances: DataFrame, item: str, seed: int = 0) -> DataFrame:
    """Add ``item``: for each row the interval of its group's chances (group, item, chance) that its hash falls into. A
    group's chances are a short list, packed into one row; groups without any give null."""
    order = Window.partitionBy(group).orderBy(item)
    upper = F.sum("chance").over(order) / F.sum("chance").over(Window.partitionBy(group))
    packed = chances.where("chance > 0").select(group, F.struct(upper.alias("hi"), item).alias("_s")).groupBy(group).agg(F.array_sort(F.collect_list("_s")).alias("_w"))
    rows = lookup_join(df.withColumn("_u", unit(seed, F.col(key))), packed, group)
    hit = F.get(F.filter("_w", lambda w: F.col("_u") < w["hi"]), F.lit(0))[item]
    return rows.withColumn(item, F.coalesce(hit, F.try_element_at("_w", F.lit(-1))[item])).drop("_u", "_w")


def assigned(quotas: DataFrame, chances: DataFrame, affinities: DataFrame, forbidden: DataFrame, group: str, item: str, total: int, seed: int = 0) -> DataFrame:
    """group, copy, item: rows by quota of the group (group, quota), each with an item drawn by chance (item, p) times the
    group's affinity, without forbidden pairs."""
    rows = expanded(quotas, group, total, seed).withColumn("_key", F.concat_ws(":", group, "copy"))
    base = quotas.select(group).distinct().crossJoin(F.broadcast(chances))
    return grouped_pick(rows, "_key", group, affinity_distribution(base, affinities, forbidden, group, item), item, seed).drop("_key")
