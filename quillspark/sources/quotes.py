"""Market and cross-section sources: a provider's raw rows, as texts under its own column names, and the adapter that
brings each provider's rows into one form.

Transports yield raw rows as dicts; those here make figures from code and day alone, for tests and offline work. A
networked one is registered under its module path, like those of series_source.
"""

from __future__ import annotations

import datetime
import hashlib
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions.text import fenced_json
from quillspark.session import ship_package
from quillspark.sources.judged import judged

#: Types of charts that need open, high, low and close; made-up rows are never shown in them.
OHLC_TYPES = ("candlestick", "ohlc", "kline", "k_line")

#: Each adapter's columns: the provider's name and ours. Ours are numbers, but for the day.
COLUMNS = {
    "equity": {"date": "d", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"},
    "global": {"Date|": "d", "Open|": "open", "High|": "high", "Low|": "low", "Close|": "close", "Volume|": "volume"},
    "futures": {"day": "d", "start_price": "open", "top_price": "high", "bottom_price": "low", "end_price": "close", "turnover": "volume"},
}


def _figure(*parts, digits: int = 4) -> int:
    """A number below 16**digits from the parts alone."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:digits], 16)


def _days(start: str, stop: str):
    day, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(stop)
    while day <= last:
        yield day.isoformat()
        day += datetime.timedelta(days=1)


def offline_quotes(adapter: str, code: str, start: str, stop: str):
    """Raw rows as the provider of an adapter sends them. Codes that begin with ``bad`` fail, those that begin with
    ``none`` have no rows, ``gap`` ones have an empty close in January."""
    if code.startswith("bad"):
        raise ValueError(f"no code {code}")
    if code.startswith("none"):
        return
    # the futures provider knows no range and sends all it has
    for day in _days("2023-12-01" if adapter == "futures" else start, "2024-02-29" if adapter == "futures" else stop):
        v = _figure(code, day)
        close = "" if code.startswith("gap") and day[5:7] == "01" else f"{v / 100:.2f}"
        values = [day, f"{v / 100 + 1:.2f}", f"{v / 100 + 2:.2f}", f"{v / 100 - 1:.2f}", close, str(v * 10)]
        names = list(COLUMNS[adapter])
        if adapter == "global":
            # a header of two levels, field and code
            names = [n.replace("|", f"|{code}") for n in names]
        yield dict(zip(names, values))


class _Code(InputPartition):
    def __init__(self, code: str):
        self.code = code


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Code(c.strip()) for c in self.options.get("codes", "").split(",") if c.strip()]

    def read(self, partition):
        module, _, name = self.options.get("transport", "quillspark.sources.quotes:offline_quotes").partition(":")
        try:
            for row in getattr(importlib.import_module(module), name)(self.options["adapter"], partition.code, self.options["start"], self.options["stop"]):
                yield partition.code, {str(k): None if v is None else str(v) for k, v in row.items()}, None
        except Exception as failure:
            yield partition.code, None, f"{type(failure).__name__}: {failure}"[:500]


class QuoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_quotes"

    def schema(self) -> str:
        return "code string, raw map<string, string>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def raw_quotes(spark: SparkSession, adapter: str, codes: list[str], start: str, stop: str, transport: str = "quillspark.sources.quotes:offline_quotes") -> DataFrame:
    """code, raw, error: the provider's rows as they come; one task for each code, a failing code gives one row with its
    error."""
    if adapter not in COLUMNS:
        raise ValueError(f"unknown adapter {adapter}; known: {', '.join(sorted(COLUMNS))}")
    ship_package(spark)
    spark.dataSource.register(QuoteSource)
    options = {"adapter": adapter, "codes": ",".join(codes), "start": start, "stop": stop, "transport": transport}
    return spark.read.format("quill_quotes").options(**options).load()


def adapted(raw: DataFrame, adapter: str, start: str | None = None, stop: str | None = None) -> DataFrame:
    """code, d, open, high, low, close, volume of raw rows: columns renamed, headers of two levels made one, texts made
    numbers or null, days within the range, rows without a close left out."""
    level = F.transform_keys("raw", lambda k, _: F.concat(F.substring_index(k, "|", 1), F.lit("|"))) if adapter == "global" else F.col("raw")
    out = raw.where("error is null").select("code", level.alias("raw"))
    names = COLUMNS[adapter]
    out = out.select("code", *[F.col("raw")[theirs].try_cast("date" if ours == "d" else "double").alias(ours) for theirs, ours in names.items()])
    out = out.where("d is not null and close is not null")
    if start:
        out = out.where(F.col("d") >= F.lit(start).cast("date"))
    return out.where(F.col("d") <= F.lit(stop).cast("date")) if stop else out


def quotes(spark: SparkSession, adapter: str, codes: list[str], start: str, stop: str, **kwargs) -> DataFrame:
    return adapted(raw_quotes(spark, adapter, codes, start, stop, **kwargs), adapter, start, stop)


def quotes_or_longer(spark: SparkSession, adapter: str, codes: list[str], start: str, stop: str, years: int = 5, **kwargs) -> DataFrame:
    """The rows of a window; of codes without any, those of the ``years`` before ``stop``."""
    first = quotes(spark, adapter, codes, start, stop, **kwargs)
    longer = quotes(spark, adapter, codes, (datetime.date.fromisoformat(stop) - datetime.timedelta(days=365 * years)).isoformat(), stop, **kwargs)
    return first.withColumn("window", F.lit("asked")).unionByName(longer.join(first.select("code").distinct(), "code", "left_anti").withColumn("window", F.lit("longer")))


def may_be_made_up(chart_type):
    """Whether made-up rows may stand in for missing ones: never in charts of open, high, low and close."""
    return ~F.coalesce(F.lower(F.trim(chart_type)), F.lit("")).isin(*OHLC_TYPES)


def real_or_made_up(wanted: DataFrame, real: DataFrame, made_up: DataFrame) -> DataFrame:
    """wanted (code, chart_type) with its rows (code, d, value): real ones, else made-up ones where they are allowed;
    ``origin`` tells which, and is ``none`` where there is nothing."""
    found = wanted.join(real, "code").withColumn("origin", F.lit("real"))
    rest = wanted.join(real.select("code").distinct(), "code", "left_anti")
    allowed = may_be_made_up(F.col("chart_type"))
    other = rest.where(allowed).join(made_up, "code").withColumn("origin", F.lit("made up"))
    none = rest.where(~allowed).unionByName(rest.where(allowed).join(made_up.select("code").distinct(), "code", "left_anti")).select("code", "chart_type", F.lit(None).cast("date").alias("d"), F.lit(None).cast("double").alias("value"), F.lit("none").alias("origin"))
    return found.unionByName(other).select("code", "chart_type", "d", "value", "origin").unionByName(none)


#: Cross-section sets: how many entities each has, and what its raw figures are divided by.
CROSS_SECTIONS = {"region_output": (31, 1e4), "region_population": (31, 1e2), "price_growth": (24, 1.0), "output_growth": (24, 1.0), "country_output": (24, 1e6), "country_population": (24, 1e6), "crops": (12, 1e3)}


def cross_section(spark: SparkSession, code: str, locale: str = "en", entities: list[str] | None = None, raw: DataFrame | None = None) -> DataFrame:
    """entity, label, value of one set: raw figures (entity, figure), here made from the set's name, scaled to its unit;
    labels by locale; given entities only, if any are given."""
    if code not in CROSS_SECTIONS:
        raise ValueError(f"unknown set {code}; known: {', '.join(sorted(CROSS_SECTIONS))}")
    count, unit = CROSS_SECTIONS[code]
    if raw is None:
        entity = F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 2, "0"))
        raw = spark.range(count).select(entity.alias("entity")).withColumn("figure", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(code), "entity")), 1, 6), 16, 10).cast("double"))
    some = raw.where(F.col("entity").isin(entities)) if entities else raw
    return some.select("entity", F.concat(F.lit("地区" if locale.startswith("zh") else "Area "), F.substring("entity", 2, 9)).alias("label"), F.round(scaled(F.col("figure"), unit), 6).alias("value"))


def scaled(value, unit: float):
    """A figure in units of ``unit``."""
    return value / F.lit(float(unit))


def generated_series(specs: DataFrame, text: str, judge, **kwargs) -> DataFrame:
    """spec columns, d, value: rows asked from an outside model for each spec, tried again on failure; replies are taken
    out of fences and cut ones are closed before they are read. Replies without rows give one row with null d."""
    replies = judged(specs, text, judge, **kwargs)
    body = F.from_json(fenced_json(F.col("reply")), "data array<struct<date: string, value: string>>")
    rows = replies.withColumn("_rows", F.filter(body["data"], lambda r: r["value"].try_cast("double").isNotNull()))
    return rows.select(*specs.columns, F.explode_outer("_rows").alias("_r")).select(*specs.columns, F.col("_r.date").try_cast("date").alias("d"), F.col("_r.value").try_cast("double").alias("value"))


def truncating_model(texts: list[str]) -> list[str]:
    """An offline stand-in: three figures from each text, in a fence, the last one cut."""
    out = []
    for text in texts:
        rows = [{"date": f"2024-01-0{k}", "value": f"{_figure(text, k) / 100:.2f}"} for k in (1, 2, 3)]
        whole = "Here: ```json\n" + json.dumps({"data": rows})
        out.append(whole[: whole.rindex(": ") + 3])
    return out
