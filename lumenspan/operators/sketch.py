"""Duration percentiles from exponential buckets, 64 to a doubling: within one percent, and mergeable by adding counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_DOUBLING = 64


def bucket(duration: Column) -> Column:
    """Index of a duration's bucket, -1 for none at all. The exponent is taken from the bits, as log2 is inexact."""
    e = F.length(F.bin(duration)) - 1
    m = duration / F.pow(F.lit(2.0), e)
    return F.when(duration <= 0, F.lit(-1)).otherwise((e * PER_DOUBLING + F.ceil(F.log2(m) * PER_DOUBLING) - 1 + 1).cast("int"))


def midpoint(index: Column) -> Column:
    """Value of a bucket: 2 b^i / (b + 1) with b the bucket base; indexes are shifted by one so that -1 is free."""
    base = 2.0 ** (1.0 / PER_DOUBLING)
    return F.when(index < 0, F.lit(0)).otherwise(F.round(2.0 * F.pow(F.lit(2.0), (index / PER_DOUBLING)) / (base + 1.0))).cast("long")


def quantiles(durations: DataFrame, keys: list[str], column: str = "duration_ns", probabilities: dict[str, float] | None = None) -> DataFrame:
    """keys and a column for each probability. Counts by bucket are combined before the shuffle and read in order once."""
    counts = durations.groupBy(*keys, bucket(F.col(column)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(counts, keys, probabilities)


def quantiles_of_counts(counts: DataFrame, keys: list[str], probabilities: dict[str, float] | None = None, also: list[Column] | None = None) -> DataFrame:
    """Of cells (keys, bucket, n), one for each bucket; `also` has more aggregates over the cells of a group."""
    probabilities = probabilities or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    up, whole = Window.partitionBy(*keys).orderBy("bucket"), Window.partitionBy(*keys)
    seen = counts.withColumns({"seen": F.sum("n").over(up), "total": F.sum("n").over(whole)})
    rank = lambda q: F.greatest(F.ceil(q * F.col("total")), F.lit(1)) - 1
    first = [midpoint(F.min(F.when(F.col("seen") > rank(q), F.col("bucket")))).alias(name) for name, q in probabilities.items()]
    return seen.groupBy(*keys).agg(*(also or []), *first)
