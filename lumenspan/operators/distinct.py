"""Distinct values that merge: exact lists while they are short, sketches beyond, kept by day and merged over any days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = 64  # values that a cell lists
LG_K = 12  # of the sketches: about 1.6 per cent of relative error


def value_cells(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, n, exact, listed, sketch: of each group the number of rows, its values if there are at most EXACT, and a sketch.

    Equal values are counted before anything is gathered, and of each group no more than EXACT + 1 values are listed.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__v"))
    first = counted.withColumn("__place", place).filter(F.col("__place") <= EXACT + 1).groupBy(*by).agg(F.collect_list("__v").alias("listed"))
    whole = counted.groupBy(*by).agg(F.sum("__n").alias("n"), F.hll_sketch_agg("__v", LG_K).alias("sketch"))
    joined = whole.join(first, by)
    exact = F.size("listed") <= EXACT
    return joined.select(*by, "n", exact.alias("exact"), F.when(exact, F.array_sort("listed")).alias("listed"), "sketch")


def merged_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of coarser groups from those of finer ones: lists are joined while all are exact and the union is short."""
    joined = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.bool_and("exact").alias("__exact"), F.collect_set("listed").alias("__lists"), F.hll_union_agg("sketch").alias("sketch"))
    union = F.array_sort(F.array_distinct(F.flatten("__lists")))
    exact = F.col("__exact") & (F.size(union) <= EXACT)
    return joined.select(*by, "n", exact.alias("exact"), F.when(exact, union).alias("listed"), "sketch")


def n_values() -> Column:
    """The number of different values of a cell: exact, or the sketch's estimate."""
    return F.when(F.col("exact"), F.size("listed").cast("long")).otherwise(F.hll_sketch_estimate("sketch"))


def first_values(values: DataFrame, value: str = "value", limit: int = 200) -> DataFrame:
    """value, n, has_more: the most frequent values, and whether there are others."""
    top = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit + 1)
    w = Window.orderBy(F.desc("n"), "value")  # over limit + 1 rows
    placed = top.withColumns({"__place": F.row_number().over(w), "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > limit})
    return placed.filter(F.col("__place") <= limit).select("value", "n", "has_more")
