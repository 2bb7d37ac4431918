"""Append-only logs as streams: the latest state of each key, and only-new ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Lines appended to a folder, as a stream; bad lines are left out. ``ts`` becomes an event time."""
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def latest_state(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The latest record of each key. State is one record for each key."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def counted_windows(stream: DataFrame, group: str, width: str, late: str) -> DataFrame:
    """Rows of each group and time window; state older than the watermark is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), group).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("start"), group, "rows")


def only_new(stream: DataFrame, key: str, late: str) -> DataFrame:
    """The first record of each key within the watermark; repeats are left out."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call goes on where this one ended. ``complete`` and ``update`` results
    are written anew as a whole for each batch, append results are added."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()


def process_new(spark: SparkSession, every: DataFrame, done_path: str, key: str, work) -> DataFrame:
    """Batch form: rows whose key isn't in the results yet go through ``work``, and its rows are appended."""
    try:
        done = spark.read.parquet(done_path).select(key).distinct()
        todo = every.join(done, key, "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        todo = every
    work(todo).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def staged(spark: SparkSession, source: str, schema: str, stages: list, path: str) -> None:
    """Chained stages, each a stream over what the one before has written: every stage keeps its own place, so a stage
    that fails or falls behind stops no other, and a later call goes on where each one ended."""
    for k, work in enumerate(stages):
        if k == 0:
            rows = log_stream(spark, source, schema)
        else:
            before = f"{path}/stage-{k - 1}"
            rows = spark.readStream.schema(spark.read.parquet(before).schema).parquet(before)
        drain(work(rows), f"{path}/check-{k}", f"{path}/stage-{k}")
