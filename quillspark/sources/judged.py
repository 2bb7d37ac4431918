"""Calls to outside judges (models, services) within a partition: batched, retried, and recorded before anything else
reads them, since a repeated call may answer otherwise."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import cut_lineage, ship_package


def one_by_one(call: Callable[[str], str]) -> Callable[[list], list]:
    """A judge of single texts as one of lists."""
    return lambda texts: [call(text) for text in texts]


def judged(df: DataFrame, text: str, judge: Callable[[list], list], parallel: int = 8, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """Add ``reply`` and ``error``. At most ``parallel`` calls run at once (one for each partition). A batch that fails is
    split into its items, and each of those is tried ``tries`` times with doubled waits before it gets its own error; so
    one bad item costs no other its reply. Items are told apart by their text: equal texts of a batch are asked once.
    The result is written once to the shared folder."""
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def asked(texts: list) -> dict:
        try:
            return {t: (r, None) for t, r in zip(texts, judge(texts), strict=True)}
        except Exception:
            pass
        out = {}
        for t in texts:
            for attempt in range(tries):
                try:
                    out[t] = (judge([t])[0], None)
                    break
                except Exception as failure:
                    out[t] = (None, f"{type(failure).__name__}: {failure}"[:500])
                    if attempt + 1 < tries:
                        time.sleep(wait * 2**attempt)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                known = asked(list(dict.fromkeys(texts)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([known[t][0] for t in texts], pa.string()), pa.array([known[t][1] for t in texts], pa.string())], names=schema.names)

    ship_package(df.sparkSession)
    return cut_lineage(df.repartition(parallel).mapInArrow(run, schema))


def recorded(df: DataFrame, key: str, text: str, judge: Callable[[list], list], path: str, **kwargs) -> DataFrame:
    """Replies kept by key under ``path``: only keys without a reply there are asked for, and failures are asked for again.
    Returns the rows with their replies."""
    from quillspark.sources.files import exists

    spark = df.sparkSession
    todo = df
    if exists(spark, path):
        known = spark.read.parquet(path).where("error is null").select(key)
        todo = df.join(known, key, "left_anti")
    judged(todo, text, judge, **kwargs).select(key, "reply", "error").write.mode("append").parquet(path)
    replies = spark.read.parquet(path).groupBy(key).agg(F.max("reply").alias("reply"))
    return df.join(replies, key, "left")
