"""Files as sources and sinks. Readers take explicit schemas where they can, so that no scan is spent on inference."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- sources -----------------------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: str | None = None, dates: str | None = None) -> DataFrame:
    """A CSV file with a header; types by schema, or inferred. ``dates`` names an index column to parse as a date."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumn(dates, F.to_date(F.col(dates).cast("string").substr(1, 10))) if dates else df


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document that holds an array of records. Such a file can't be split; write lines for large data."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records one a line. Strict: a bad line fails the scan; else bad lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def latest_lines(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Tolerant lines, of each key the last by ``order``."""
    from quillspark.operators.preference import latest

    return latest(read_lines(spark, path, schema, strict=False).where(F.col(key).isNotNull()), [key], order)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder, name, length, changed of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("changed"))


def folders_with(files: DataFrame, required: list[str]) -> DataFrame:
    """folder: those that hold every required file."""
    return files.groupBy("folder").agg(*[F.bool_or(F.col("name") == n).alias(f"_{k}") for k, n in enumerate(required)]).where(" and ".join(f"_{k}" for k in range(len(required)))).select("folder")


def first_match(files: DataFrame, names: list[str]) -> DataFrame:
    """folder, path: of each folder the file that comes first in ``names``, else the first by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("name")), F.lit(0))
    return files.groupBy("folder").agg(F.min_by("path", F.struct(F.when(rank > 0, rank).otherwise(len(names) + 1), "name")).alias("path"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files, stripped; empty ones are left out."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))
    return rows.where("text != ''")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON file in each folder, with the folder's name."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{path}/*/metadata.json").withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def read_settings(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """key, value (JSON) of several YAML or JSON files; a later file wins. Settings are small; Spark reads them, so they may
    lie wherever it can read."""
    merged: dict = {}
    for path in paths:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        try:
            merged |= json.loads(text)
        except ValueError:
            import yaml

            merged |= yaml.safe_load(text) or {}
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in merged.items()], "key string, value string")


def texts_by_language(texts: DataFrame, wanted: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """folder, language, path, text: for each wanted (folder, language) the first file of that language's names that the
    folder has, else the first of the others' names; folders without any are left out."""
    found = texts.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "text")
    every = [n for some in names.values() for n in some]
    rank = F.lit(None).cast("int")
    for language, own in names.items():
        order = F.array(*[F.lit(n) for n in [*own, *[n for n in every if n not in own]]])
        rank = F.when(F.col("language") == language, F.array_position(order, F.col("name")).cast("int")).otherwise(rank)
    ranked = wanted.join(found, "folder").withColumn("_r", rank).where("_r > 0")
    return ranked.groupBy("folder", "language").agg(F.min_by(F.struct("path", "text"), "_r").alias("_f")).select("folder", "language", "_f.path", "_f.text")


def read_encoded(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, base64 of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.base64("content").alias("base64"))


def in_file_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records one a line, with the line's place in its file as ``place``. A file is read by one task, as only then lines
    can be counted."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("place", "line"))
    return lines.where("trim(line) != ''").select("file", "place", F.from_json("line", schema).alias("_r")).select("file", "place", "_r.*")


# --- sinks -------------------------------------------------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def write_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """A header and rows; ``index`` names a column that comes first."""
    some = df.select(index, *[c for c in df.columns if c != index]) if index else df
    some.write.mode("overwrite").option("header", True).csv(path)


def write_json_array(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON documents that hold an array of records each, in UTF-8 with ISO dates: one for each task, or ``files`` in all.
    Records become text in the JVM; each task only sets brackets and commas around them."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS", "dateFormat": "yyyy-MM-dd"}
    rows = (df.coalesce(files) if files else df).select(F.to_json(F.struct("*"), options).alias("value"))

    def run(batches):
        last = None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{last},"])], names=["value"])
                last = f"[{text}" if last is None else text
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if last is None else f"{last}]"])], names=["value"])

    def joined(batches):
        # few large batches instead of one for each record
        some = []
        for batch in run(batches):
            some.append(batch.column(0)[0].as_py())
            if len(some) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(some)], names=["value"])
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some)], names=["value"])

    rows.mapInArrow(joined, "value string").write.mode("overwrite").text(path)


def write_in_steps(df: DataFrame, path: str, key: str, steps: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Put ``df`` through costly ``work`` in ``steps`` parts by the hash of its key. A part that is done is kept beside
    ``path``, so a run that fails goes on where it ended; when all are done they become ``path`` and the parts are
    deleted."""
    spark, parts = df.sparkSession, f"{path}-parts"
    for step in range(steps):
        part = f"{parts}/{step}"
        if not exists(spark, f"{part}/_SUCCESS"):
            work(df.where(F.pmod(F.xxhash64(key), F.lit(steps)) == step)).write.mode("overwrite").parquet(part)
    spark.read.parquet(*[f"{parts}/{step}" for step in range(steps)]).write.mode("overwrite").parquet(path)
    remove(spark, parts)
    return spark.read.parquet(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Records one a line. Each task writes its own file, so appending needs no lock."""
    df.write.mode("append" if append else "overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Records partitioned by split, and a manifest with the rows of each, which is also returned."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/data")
    counts = df.sparkSession.read.parquet(f"{path}/data").groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.schema(counts.schema).json(f"{path}/manifest")


def write_entities(df: DataFrame, path: str, entity: str, text: str | None = None, content: str | None = None) -> None:
    """One folder for each entity, under ``meta`` with its other fields as JSON, under ``text`` with its text, under
    ``copy`` with its content (binary, as base64 lines). For few entities only, as each needs a file."""
    rows = df.repartition(entity)
    rows.drop(*[c for c in (text, content) if c]).write.mode("overwrite").partitionBy(entity).json(f"{path}/meta")
    if text:
        rows.where(F.col(text).isNotNull()).select(entity, F.col(text).alias("value")).write.mode("overwrite").partitionBy(entity).text(f"{path}/text")
    if content:
        rows.where(F.col(content).isNotNull()).select(entity, F.base64(content).alias("value")).write.mode("overwrite").partitionBy(entity).text(f"{path}/copy")


def merge_shards(spark: SparkSession, paths: list[str], schema: str, key: str, out: str) -> None:
    """Shards of lines merged in key order, range-partitioned, so that no task holds all; absent shards are left out, and
    merged ones are removed once the result is there."""
    existing = [p for p in paths if exists(spark, p)]
    if existing:
        read_lines(spark, existing, schema, strict=False).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(out)
        for path in existing:
            remove(spark, path)


def write_manifest(spark: SparkSession, path: str, version: str, config: dict, tasks: DataFrame) -> None:
    """Tasks, beside a header with version and settings."""
    spark.createDataFrame([(version, json.dumps(config, sort_keys=True))], "version string, config string").coalesce(1).write.mode("overwrite").json(f"{path}/header")
    write_lines(tasks, f"{path}/tasks")


def read_manifest(spark: SparkSession, path: str, schema: str) -> tuple[str, dict, DataFrame]:
    head = spark.read.schema("version string, config string").json(f"{path}/header").first()
    return head.version, json.loads(head.config), read_lines(spark, f"{path}/tasks", schema)


def clean_and_full(df: DataFrame, path: str, meta: str = "_meta") -> None:
    """The rows with their meta field and, beside them, without it."""
    write_lines(df, f"{path}/full")
    write_lines(df.drop(meta), f"{path}/clean")


def with_status(df: DataFrame, keys: DataFrame, key: str, status: str) -> DataFrame:
    """Soft delete or restore: the status of rows with these keys replaced; nothing is moved."""
    marked = keys.select(key).distinct().withColumn("_m", F.lit(True))
    return df.join(marked, key, "left").withColumn("status", F.when(F.col("_m"), F.lit(status)).otherwise(F.col("status"))).drop("_m")


def nested_export(parents: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One JSON text for each parent, with its ordered rows inside."""
    from quillspark.operators.relational import nested_history

    return nested_history(parents, rows, key, fields[:1], fields).select(key, F.to_json(F.struct("*")).alias("json"))
