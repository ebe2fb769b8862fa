"""Signals as Parquet tables in folders by UTC day, so that a range reads the days that it touches and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import day_of, within
from ..plans.ranges import DAY, Range


def write(records: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """Rows in folders by the day of `column`; rows of a day are brought together first, which skewed days are split for."""
    records.withColumn("day", day_of(F.col(column))).hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, column: str, r: Range | None = None) -> DataFrame:
    """All rows, or those of a range: its days become partition filters, its ends filters that reach the files."""
    rows = spark.read.parquet(path)
    if r is None:
        return rows.drop("day")
    first, last = (F.date_from_unix_date(F.lit(t // DAY)) for t in (r.start, r.end - 1))
    return within(rows.filter(F.col("day").between(first, last)), column, r).drop("day")


def identity(*columns: str | Column) -> Column:
    """The identity of a series: a hash of its canonical columns. Maps are taken as their entries in order of keys."""
    return F.xxhash64(*columns)


def series_identity(service: str, name: str, unit: str, kind: str, attributes: str, resource: str) -> Column:
    """The identity of a metric series from what makes it; an attribute map counts by its entries, in any order."""
    entries = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    return identity(service, name, unit, kind, entries(attributes), entries(resource))
