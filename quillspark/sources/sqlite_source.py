"""Tables of a SQLite file as a source, read in row ranges by several tasks. The file must lie where all tasks see it."""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.session import ship_package

KINDS = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


def _open(path: str):
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


#: Comparisons that a predicate may use.
OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "like", "is null", "is not null")


def _condition(where: list) -> tuple[str, list]:
    """SQL and values of a predicate: [column, operator, value] each, all of which must hold."""
    parts, values = [], []
    for column, operator, *value in where:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator}; known: {', '.join(OPERATORS)}")
        parts.append(f"{_quoted(column)} {operator}{' ?' if value else ''}")
        values += value
    return " and ".join(parts), values


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", "4"))
        self.condition, self.values = _condition(json.loads(options.get("where", "[]")))

    def partitions(self):
        with _open(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.parts))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition):
        with _open(self.path) as db:
            more = f" and {self.condition}" if self.condition else ""
            yield from db.execute(f"select * from {_quoted(self.table)} where rowid >= ? and rowid < ?{more}", (partition.low, partition.high, *self.values))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {KINDS.get(str(c[2]).upper().split('(')[0], 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 4, where: list | None = None) -> DataFrame:
    """The rows of a table, those that meet ``where`` ([column, operator, value] each) only; the database filters them. An
    empty table gives an empty frame."""
    _condition(where or [])
    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("quill_sqlite").option("path", path).option("table", table).option("parts", parts).option("where", json.dumps(where or [])).load()
