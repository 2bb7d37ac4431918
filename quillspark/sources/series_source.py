"""Time-series sources behind one interface: a Python data source with an injected transport, and a registry.

A transport is a function (code, start, end) -> iterable of (date text, value text); it may use a network, while the
``walk`` transport here makes figures from the code alone, for tests and offline work. One code is one partition; a
code whose transport fails gives no rows but a note in the ``error`` column.
"""

from __future__ import annotations

import datetime
import hashlib
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.session import ship_package

SCHEMA = "series string, d date, value double, error string"


def walk(code: str, start: str, end: str):
    """A random walk that depends on the code only; codes that begin with ``bad`` fail."""
    if code.startswith("bad"):
        raise ValueError(f"no series {code}")
    day, last, value = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end), 100.0
    while day <= last:
        value *= 1 + (int(hashlib.md5(f"{code}{day}".encode()).hexdigest()[:4], 16) / 65535 - 0.5) / 50
        yield day.isoformat(), f"{value:.4f}"
        day += datetime.timedelta(days=1)


class _Code(InputPartition):
    def __init__(self, code: str):
        self.code = code


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Code(c.strip()) for c in self.options.get("codes", "").split(",") if c.strip()]

    def read(self, partition):
        module, _, name = self.options.get("transport", "quillspark.sources.series_source:walk").partition(":")
        fetch = getattr(importlib.import_module(module), name)
        try:
            rows = list(fetch(partition.code, self.options.get("start", "2024-01-01"), self.options.get("end", "2024-12-31")))
        except Exception as failure:
            yield partition.code, None, None, f"{type(failure).__name__}: {failure}"[:500]
            return
        for day, value in rows:
            try:
                number = float(value)
            except (TypeError, ValueError):
                number = None
            yield partition.code, datetime.date.fromisoformat(day[:10]), number, None


class SeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


#: Source names, in small letters, and their transports.
TRANSPORTS = {"walk": "quillspark.sources.series_source:walk"}
ALIASES = {"synthetic": "walk", "offline": "walk"}


def resolve(source: str) -> str:
    """The transport of a source in any case or by an alias; an unknown source is an error."""
    name = source.strip().lower()
    name = ALIASES.get(name, name)
    if name not in TRANSPORTS:
        raise ValueError(f"unknown source {source}; known: {', '.join(sorted(TRANSPORTS))}")
    return TRANSPORTS[name]


def fetch(spark: SparkSession, source: str, codes: list[str], start: str, end: str) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(SeriesSource)
    return spark.read.format("quill_series").option("transport", resolve(source)).option("codes", ",".join(codes)).option("start", start).option("end", end).load()


def fetch_or(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first frame, or the second if the first has no row without an error."""
    return first if first.where("error is null").limit(1).count() else second


def coerced(df: DataFrame, renames: dict[str, str], numbers: list[str]) -> DataFrame:
    """Columns renamed and in small letters, texts made numbers where they are some; null otherwise."""
    df = df.withColumnsRenamed(renames)
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.withColumns({n: F.col(n).cast("string").try_cast("double") for n in numbers})


def canonical_value(df: DataFrame) -> DataFrame:
    """Add ``value``: the column value, else close, else the first numeric column, else 0."""
    lower = {c.lower(): c for c in df.columns}
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int")]
    source = lower.get("value") or lower.get("close") or (numeric[0] if numeric else None)
    return df.withColumn("value", F.col(source).cast("double") if source else F.lit(0.0))


def roles(df: DataFrame) -> tuple[str | None, list[str]]:
    """The date column (by usual names, else by type, else the first text column that parses) and the value columns."""
    names = {c.lower(): c for c in df.columns}
    date = next((names[n] for n in ("date", "datetime", "time", "timestamp", "trade_date", "d", "ts") if n in names), None)
    date = date or next((c for c, t in df.dtypes if t.startswith(("date", "timestamp"))), None)
    texts = [c for c, t in df.dtypes if t == "string"]
    if date is None and texts:
        # one look at a few rows tells of all text columns
        looks = df.limit(20).agg(*[((F.count(c) > 0) & (F.count(F.col(c).try_cast("date")) == F.count(c))).alias(f"_{k}") for k, c in enumerate(texts)]).first()
        date = next((c for k, c in enumerate(texts) if looks[k]), None)
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int", "smallint") or t.startswith("decimal")]
    return date, [c for c in (numbers or df.columns) if c != date]


def resolved_codes(indicators: DataFrame, mapping: DataFrame) -> DataFrame:
    """indicator, part, code: comma lists taken apart, each part's code by the mapping (indicator, code), else itself."""
    parts = indicators.select("indicator", F.explode(F.filter(F.transform(F.split("indicator", "[,，]"), lambda x: F.trim(x)), lambda x: x != "")).alias("part"))
    return parts.join(mapping.select(F.col("indicator").alias("part"), "code"), "part", "left").select("indicator", "part", F.coalesce("code", "part").alias("code"))


def synthetic_flow(spark: SparkSession, sources: list[str], targets: list[str], seed: int = 0) -> DataFrame:
    """source, target, value: every combination of two short lists with a number that depends on names and seed only."""
    if len(sources) * len(targets) > 1_000_000:
        raise ValueError("too many combinations")
    left = spark.createDataFrame([(s,) for s in sources], "source string")
    right = spark.createDataFrame([(t,) for t in targets], "target string")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "source", "target")), 1, 8), 16, 10).cast("double")
    return left.crossJoin(right).withColumn("value", F.round(h / 4294967296.0 * 100, 2))
