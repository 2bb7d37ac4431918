"""Samples whose categories have given shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators.skew import matched
from quillspark.session import cut_lineage

#: The unit interval of the draws is counted in this many parts; only the part in which a target's last row lies is
#: ranked row by row.
PARTS = 4096

#: Targets are a parameter table; up to this many rows are broadcast, more are joined by a shuffle.
BROADCAST_TARGETS = 100_000

ANY = "\x00any"


def category(column):
    """How chart types and themes are compared: no surrounding blanks, no case, ``-`` equal to ``_``."""
    return F.translate(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), "-", "_")


def unit_draw(seed: int, *columns):
    """A number in [0, 1) that depends only on the seed and the columns' values."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


class ProportionSample:
    """Targets, their members and what is drawn for them."""

    def __init__(self, tasks: DataFrame, targets: DataFrame, seed: int = 0):
        wanted = targets.select("target_id", "config_name", category(F.col("chart_type")).alias("chart"), category(F.col("theme")).alias("theme"), "ratio", "min_rows", "total_samples").dropDuplicates(["target_id"])
        need = F.greatest(F.coalesce(F.col("ratio") * F.col("total_samples"), F.lit(0.0)), F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"))
        self.targets = wanted.withColumn("need", need)
        small = self.targets.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
        keyed = self.targets.select("target_id", F.coalesce("chart", F.lit(ANY)).alias("chart_key"), F.coalesce("theme", F.lit(ANY)).alias("theme_key"))
        own = tasks.select("task_id", category(F.col("chart_type")).alias("c"), category(F.col("theme")).alias("t")).where("task_id is not null")
        # a task is looked up under its own values and under "any", so the join is on equality; no null value is looked up
        pairs = F.array(
            F.struct(F.col("c").alias("chart_key"), F.col("t").alias("theme_key")),
            F.struct(F.col("c").alias("chart_key"), F.lit(ANY).alias("theme_key")),
            F.struct(F.lit(ANY).alias("chart_key"), F.col("t").alias("theme_key")),
            F.struct(F.lit(ANY).alias("chart_key"), F.lit(ANY).alias("theme_key")),
        )
        looked = own.select("task_id", F.inline(pairs)).where("chart_key is not null and theme_key is not null")
        draw = unit_draw(seed, F.col("target_id"), F.col("task_id"))
        # many targets are met by a shuffle, in which the tasks under "any", which are all, are cut into parts
        on = F.struct("chart_key", "theme_key")
        met = looked.join(F.broadcast(keyed), ["chart_key", "theme_key"]) if small else matched(keyed.select("target_id", on.alias("_k")), looked.select("task_id", on.alias("_k")), "_k")
        self.members = (
            met
            .select("target_id", "task_id")
            .distinct()
            .withColumn("draw", draw)
            .withColumn("part", F.floor(draw * PARTS).cast("int"))
        )
        # at most targets x PARTS rows, whatever the number of tasks
        self._parts = cut_lineage(self.members.groupBy("target_id", "part").agg(F.count(F.lit(1)).alias("n")))

    def _plan(self) -> DataFrame:
        """For each target the acceptance probability, and for each part how many rows come before it."""
        whole = Window.partitionBy("target_id")
        running = whole.orderBy("part")
        wanted = F.ceil("need")
        rate = F.least(F.lit(1.0), (wanted + 4 * F.sqrt(wanted.cast("double")) + 16) / F.col("available"))
        parts = self._parts.join(self.targets.select("target_id", "need"), "target_id").withColumns({"available": F.sum("n").over(whole), "until": F.sum("n").over(running)})
        drawn = parts.withColumn("rate", rate)
        # oversampling that fell short of the need is drawn again with certainty
        enough = F.max(F.when((F.col("part") + 1) <= F.floor(F.col("rate") * PARTS), F.col("until"))).over(whole)
        return drawn.withColumn("rate", F.when(F.coalesce(enough, F.lit(0)) >= F.least(wanted, F.col("available")), F.col("rate")).otherwise(1.0)).select(
            "target_id", "part", "rate", wanted.cast("long").alias("wanted"), (F.col("until") - F.col("n")).alias("before"), F.col("until")
        )

    def sample(self) -> DataFrame:
        """config_name, target_id, task_id: exactly min(need, available) tasks of each target."""
        rows = self.members.join(self._plan(), ["target_id", "part"]).where((F.col("draw") < F.col("rate")) & (F.col("before") < F.col("wanted")))
        certain = rows.where(F.col("until") <= F.col("wanted"))
        edge = rows.where(F.col("until") > F.col("wanted"))
        order = Window.partitionBy("target_id").orderBy("draw", "task_id")
        cut = edge.withColumn("rank", F.row_number().over(order)).where(F.col("rank") + F.col("before") <= F.col("wanted")).drop("rank")
        return certain.unionByName(cut).join(self.targets.select("target_id", "config_name"), "target_id").select("config_name", "target_id", "task_id")

    def report(self) -> DataFrame:
        """For each target: need, available, drawn, the share reached in its config, and the deficit."""
        counts = self._parts.groupBy("target_id").agg(F.sum("n").alias("available"))
        available = F.coalesce("available", F.lit(0)).cast("long")
        drawn = F.least(F.ceil("need").cast("long"), available)
        whole = Window.partitionBy("config_name")
        return (
            self.targets.join(counts, "target_id", "left")
            .select("target_id", "config_name", "chart", "theme", "ratio", F.col("need"), available.alias("available"), drawn.alias("drawn"), F.greatest(F.lit(0.0), F.col("need") - available).alias("deficit"))
            .withColumn("share", F.try_divide(F.col("drawn").cast("double"), F.sum("drawn").over(whole)))
        )

    def unmet(self) -> DataFrame:
        """target_id of targets with fewer tasks than they need."""
        return self.report().where("deficit > 0").select(F.col("target_id").cast("int").alias("target_id"))


def proportion_sample(tasks: DataFrame, targets: DataFrame, seed: int = 0) -> ProportionSample:
    """Draw from tasks (task_id, chart_type, theme) a sample for each target (target_id, config_name, chart_type,
    theme, ratio, min_rows, total_samples).

    A target needs the greater of ratio x total_samples and min_rows tasks, rounded up. Each member of its category is
    accepted with the probability need / available, raised by four standard deviations; what is accepted too much is
    taken off by the order of the draws, so counts are exact. Only one of PARTS parts of a category is ever ranked.

    A null chart type or theme of a target matches any task; a null of a task matches only those. Null ratio, total or
    min_rows count as 0. Tasks without an id don't count, exact copies count once, a task of several targets' categories
    may be drawn for each. Ties of draws are broken by task_id. No tasks: every target with a need is unmet. No targets:
    empty results. Other columns are not read, so their names can't clash.
    """
    return ProportionSample(tasks, targets, seed)
