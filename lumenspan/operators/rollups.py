"""Summaries by minute and hour, reading a range from them, retention and late data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import HOUR, MINUTE, Range, parts
from .sketch import bucket
from .steps import step_of, within


def span_cells(spans: DataFrame, keys: list[str], unit: int) -> DataFrame:
    """Per key, unit of time and duration bucket: count, sum, least, greatest. Cells of finer units add up to coarser ones."""
    return spans.groupBy(*keys, step_of(F.col("started_at"), unit).alias("unit_at"), bucket(F.col("duration_ns")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("sum_ns"), F.min("duration_ns").alias("low_ns"), F.max("duration_ns").alias("high_ns")
    )


def coarser(cells: DataFrame, keys: list[str], unit: int) -> DataFrame:
    return cells.groupBy(*keys, step_of(F.col("unit_at"), unit).alias("unit_at"), "bucket").agg(F.sum("n").alias("n"), F.sum("sum_ns").alias("sum_ns"), F.min("low_ns").alias("low_ns"), F.max("high_ns").alias("high_ns"))


def read_range(raw: DataFrame, minutes: DataFrame, hours: DataFrame, keys: list[str], r: Range) -> DataFrame:
    """Cells of a range from whole hours, whole minutes and the raw rows of the minutes that it cuts."""
    found = []
    cut = parts(r)
    for kind, table in (("1h", hours), ("1m", minutes)):
        found += [within(table, "unit_at", p).select(*keys, "bucket", "n", "sum_ns") for p in cut[kind]]
    for p in cut["raw"]:
        found.append(within(raw, "started_at", p).select(*keys, bucket(F.col("duration_ns")).alias("bucket"), F.lit(1).cast("long").alias("n"), F.col("duration_ns").alias("sum_ns")))
    return reduce(DataFrame.unionByName, found).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("sum_ns").alias("sum_ns"))


def minutes_and_hours(spans: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    minutes = span_cells(spans, keys, MINUTE)
    return minutes, coarser(minutes, keys, HOUR)


def metric_summary(points: DataFrame, keys: list[str], unit: int, since: int | None = None) -> DataFrame:
    """Points, least, greatest, sum, last, increase and its time of each series and unit, for a cumulative counter.

    Points before `since` are only what the first ones after it grew from.
    """
    w = Window.partitionBy(*keys).orderBy("recorded_at")
    before = F.lag("value").over(w)
    grown = F.when(before.isNull(), 0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    took = F.coalesce(F.col("recorded_at") - F.lag("recorded_at").over(w), F.lit(0))
    told = points.withColumns({"grown": grown, "took": took})
    return (told if since is None else told.filter(F.col("recorded_at") >= since)).groupBy(*keys, step_of(F.col("recorded_at"), unit).alias("unit_at")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("sum"), F.max_by("value", "recorded_at").alias("last"), F.sum("grown").alias("increase"), F.sum("took").alias("elapsed_ns")
    )


def coarser_metrics(cells: DataFrame, keys: list[str], unit: int) -> DataFrame:
    """Summaries of a coarser unit from those of a finer one: equal to summing up the points."""
    return cells.groupBy(*keys, step_of(F.col("unit_at"), unit).alias("unit_at")).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("sum").alias("sum"), F.max_by("last", "unit_at").alias("last"), F.sum("increase").alias("increase"), F.sum("elapsed_ns").alias("elapsed_ns")
    )


def due(indexed_until: int, unit: int, late: int = 2 * MINUTE) -> int:
    """The end of what can be summed up: whole units that ended `late` before what has arrived."""
    return (indexed_until - late) // unit * unit


def retained(records: DataFrame, column: str, today: int, days: int = 7) -> DataFrame:
    """Records of the last `days` whole UTC days, today included; today is any instant of it."""
    day = 86_400_000_000_000
    return records.filter(F.col(column) >= today - today % day - (days - 1) * day)


def unreferenced(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Dimension rows that no fact refers to any more."""
    return dimension.join(facts.select(key).distinct(), key, "left_anti")


def latest_write(points: DataFrame, keys: list[str], arrival: Column) -> DataFrame:
    """Of points of one series and instant the one that arrived last."""
    return points.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(arrival.desc()))).filter("__rank = 1").drop("__rank")


def first_series(points: DataFrame, metric: str, series: str, limit: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """Points of the first `limit` series of each metric by first appearance, and those of the others."""
    seen = points.groupBy(metric, series).agg(F.min("recorded_at").alias("__first"))
    placed = seen.withColumn("__rank", F.row_number().over(Window.partitionBy(metric).orderBy("__first", series)))
    joined = points.join(placed.select(metric, series, "__rank"), [metric, series])
    return joined.filter(F.col("__rank") <= limit).drop("__rank"), joined.filter(F.col("__rank") > limit).drop("__rank")
