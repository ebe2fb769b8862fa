"""Retention by dropping days: folders go, no file of facts is written anew, and what they alone referred to is told."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stored
from .steps import day_of


def key_sets(records: DataFrame, column: str, key: Column, path: str) -> None:
    """The different keys of each day, in folders by day beside the facts: a repeated write replaces its days."""
    rows = records.select(key.alias("key"), day_of(F.col(column)).alias("day")).filter("key IS NOT NULL").distinct()
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def _days(spark: SparkSession, path: str) -> list[date]:
    return [date.fromisoformat(n.split("=")[1]) for n in stored.children(spark, path) if n.startswith("day=2") or n.startswith("day=1")]


def orphans(spark: SparkSession, sets: str, first: date) -> DataFrame:
    """Keys that only days before `first` refer to. Reads the key sets, never the facts: of old days first, then of the rest."""
    rows = spark.read.parquet(sets)
    old = rows.filter(F.col("day") < F.lit(first)).select("key").distinct()
    return old.join(rows.filter(F.col("day") >= F.lit(first)).select("key").distinct(), "key", "left_anti")


def drop_days(spark: SparkSession, first: date, *paths: str) -> int:
    """Drop the folders of all days before `first` in these tables; how many there were. Stopped midway, it goes on when run again."""
    n = 0
    for path in paths:
        for day in _days(spark, path):
            if day < first:
                stored.remove(spark, f"{path}/day={day.isoformat()}")
                n += 1
    return n
