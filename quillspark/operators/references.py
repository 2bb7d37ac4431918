"""References to records that don't exist, exist only as deleted, or came later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage
from quillspark.sources.tables import epoch_millis, image_key

#: A key with at least this share of all references is heavy; so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 0.001


def references_of(df: DataFrame, tab: str, rec_id: str, ref: str, time: str) -> DataFrame:
    """The references of one table in common columns; rows whose ``ref`` is null or blank refer to nothing."""
    own = epoch_millis(F.col(time).cast("double")).cast("long")
    return df.select(
        F.lit(tab).alias("tab"),
        F.col(rec_id).cast("long").alias("rec_id"),
        image_key(F.col(ref)).alias("key"),
        own.alias("own_ms"),
        # by days since 1970, so that the period doesn't depend on the session's time zone
        F.coalesce(F.date_format(F.date_from_unix_date(F.floor(own / 86_400_000).cast("int")), "yyyy-MM"), F.lit("unknown")).alias("period"),
    ).where("key is not null")


def target_states(targets: DataFrame, key: str = "id", status: str = "status", created: str = "created_at") -> DataFrame:
    """One row for each key of the target table: whether any row is alive, and since when a row exists.

    first_ms is null if any row has no time, as that row can't be later than a reference.
    """
    made = epoch_millis(F.col(created).cast("double")).cast("long")
    return (
        targets.select(
            image_key(F.col(key)).alias("key"),
            (F.lower(F.trim(F.coalesce(F.col(status), F.lit("")))) != "deleted").alias("alive"),
            made.alias("made"),
        )
        .where("key is not null")
        .groupBy("key")
        .agg(F.max("alive").alias("alive"), F.when(F.count("made") == F.count(F.lit(1)), F.min("made")).alias("first_ms"))
    )


def _verdicts(counted: DataFrame, states: DataFrame, heavy: bool) -> DataFrame:
    """The orphan counts of each key and period, by reason: an anti-join finds those without a target ("missing"), a join
    those whose targets are all deleted ("deleted") or later than all of the group ("late") or than some ("partly")."""
    missing = counted.join(states.select("key"), "key", "left_anti").withColumns({"first_ms": F.lit(None).cast("long"), "verdict": F.lit("missing")})
    late = F.when(F.col("min_ms") < F.col("first_ms"), F.when((F.col("max_ms") < F.col("first_ms")) & (F.col("n") == F.col("timed")), "late").otherwise("partly"))
    there = counted.join(states, "key").withColumn("verdict", F.when(~F.col("alive"), "deleted").otherwise(late)).where("verdict is not null").drop("alive")
    return missing.unionByName(there).withColumn("heavy", F.lit(heavy))


class OrphanCheck:
    """The parts of one check: references, their counts per key and period, and a verdict for each group of orphans.

    References are written once, and counted per table, key and period before anything is joined. Keys that hold at least
    HEAVY_SHARE of all references (at most 1000 keys, whatever the size) are checked against a broadcast of their
    targets' states; the others by shuffled joins of the counts, so no task gets more than one row for each key and
    period. The orphan counts of both are united.
    """

    def __init__(self, references: list[DataFrame], targets: DataFrame, heavy_share: float = HEAVY_SHARE):
        every = reduce(DataFrame.unionByName, references)
        self.rows = cut_lineage(every.dropDuplicates(["tab", "rec_id", "key", "own_ms"]))
        self.counted = cut_lineage(
            self.rows.groupBy("tab", "key", "period").agg(
                F.count(F.lit(1)).alias("n"),
                F.count("own_ms").alias("timed"),
                F.min("own_ms").alias("min_ms"),
                F.max("own_ms").alias("max_ms"),
            )
        )
        total = self.counted.agg(F.sum("n")).first()[0] or 0
        heavy = cut_lineage(self.counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1.0, total * heavy_share)).select("key"))
        states = target_states(targets)
        heavy_states = F.broadcast(target_states(targets.withColumn("_key", image_key(F.col("id"))).join(F.broadcast(heavy.withColumnRenamed("key", "_key")), "_key", "left_semi")))
        hot, cold = self.counted.join(F.broadcast(heavy), "key", "left_semi"), self.counted.join(F.broadcast(heavy), "key", "left_anti")
        self.groups = _verdicts(hot, heavy_states, True).unionByName(_verdicts(cold, states, False))

    def orphans(self) -> DataFrame:
        """tab, rec_id, period, verdict: each orphan reference once. An id that refers to two missing keys has one row
        for each of its periods and verdicts."""
        bad = cut_lineage(self.groups.select("tab", "key", "period", "verdict", "first_ms", "heavy"))
        on = ["tab", "key", "period"]
        late = (F.col("verdict") != "partly") | (F.col("own_ms") < F.col("first_ms"))
        heavy, light = bad.where("heavy").drop("heavy"), bad.where("not heavy").drop("heavy")
        # heavy groups are bounded by the number of heavy keys times periods; their rows are never shuffled
        keys = F.broadcast(heavy.select("key").distinct())
        found = self.rows.join(F.broadcast(heavy), on, "inner").unionByName(self.rows.join(keys, "key", "left_anti").join(light, on, "inner"))
        return found.where(late).select("tab", "rec_id", "period", F.when(F.col("verdict") == "partly", "late").otherwise(F.col("verdict")).alias("verdict")).distinct()

    def report(self) -> DataFrame:
        """Counts per table and period: references, orphans by reason, and the share of orphans."""
        orphans = self.orphans().groupBy("tab", "period").pivot("verdict", ["missing", "deleted", "late"]).count()
        every = self.counted.groupBy("tab", "period").agg(F.sum("n").alias("references"))
        counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("missing", "deleted", "late")]
        joined = every.join(orphans, ["tab", "period"], "left").select("tab", "period", "references", *counts)
        return joined.withColumn("orphan_share", F.round((F.col("missing") + F.col("deleted") + F.col("late")) / F.col("references"), 6))


def orphan_references(references: list[DataFrame], targets: DataFrame, heavy_share: float = HEAVY_SHARE) -> OrphanCheck:
    """Check references (frames of references_of) against a target table with id, status and created_at.

    A reference is an orphan if the target table has no row with its key ("missing"), only rows with status deleted
    ("deleted"), or only rows made after the reference's own time ("late"); the first that holds is its verdict.
    Ids are compared without surrounding blanks and without regard to case. Null and blank references are none. A null
    time of the reference or of a target is never too late or too early; times in seconds become milliseconds. Exact
    copies of a row count once; a null rec_id is kept as such. Empty references give no orphans, an empty target table
    makes all references "missing". Other columns of the tables, whatever their names, are not read.
    """
    return OrphanCheck(references, targets, heavy_share)
