"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def image_key(column):
    """How image ids are compared: without surrounding blanks and without regard to case; blank ids give null.

    Blanks are all white space that Unicode knows, so a no-break space or a tab counts as well. Most ids are plain letters
    without any, which one look tells.
    """
    plain = column.rlike(r"^[!-~]*+$")
    trimmed = F.lower(F.when(plain, column).otherwise(F.regexp_replace(column, r"(?U)^\s++|(?<!\s)\s++$", "")))
    return F.when(trimmed != "", trimmed)


def epoch_millis(column):
    """Milliseconds of an epoch column in which some values are seconds: all below 10^11 (March 1973 in ms) are."""
    return F.when(F.abs(column) < 100_000_000_000, column * 1000).otherwise(column)
