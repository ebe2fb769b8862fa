"""Which attribute keys and values there are, and what completion offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import json_type, key_of


def entries(records: DataFrame, map_col: str = "attributes", *also: str) -> DataFrame:
    """key, value of each entry, with the columns named in `also`."""
    return records.select(*also, F.explode(map_col).alias("key", "value"))


TYPES = ("string", "int", "float", "bool", "array", "object", "null")


def type_bits(value: Column) -> Column:
    """A bit for the type of a value: their union is a number, which a hash aggregate updates in place, as it can't a text."""
    bits = F.create_map(*[F.lit(x) for k, t in enumerate(TYPES) for x in (t, 1 << k)])
    return F.try_element_at(bits, json_type(value))


def type_of_bits(bits: Column) -> Column:
    """The one type that is in a union of bits, or `mixed`."""
    one = F.create_map(*[F.lit(x) for k, t in enumerate(TYPES) for x in (1 << k, t)])
    return F.when(bits.isNotNull(), F.coalesce(F.try_element_at(one, bits), F.lit("mixed")))


def keys(records: DataFrame, map_col: str = "attributes", limit: int = 500) -> DataFrame:
    """Keys by count, with the type of their values or `mixed`."""
    found = entries(records, map_col).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_or(type_bits(F.col("value"))).alias("bits"))
    return found.select("key", "n", type_of_bits(F.col("bits")).alias("type")).orderBy(F.desc("n"), "key").limit(limit)


def keys_by_day(records: DataFrame, day: Column, map_col: str = "attributes") -> DataFrame:
    return records.select(day.alias("day"), F.explode(map_col).alias("key", "value")).groupBy("day", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


def values(records: DataFrame, key: str, map_col: str = "attributes", limit: int = 500, most_bytes: int = 100) -> DataFrame:
    """Values of a key by count: scalars, and strings that are short enough to offer. limit + 1 tells if there are more."""
    v = F.try_element_at(F.col(map_col), key_of(key))
    found = records.select(v.alias("value")).filter(F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\[{]") & (F.octet_length("value") <= most_bytes + 2))
    return found.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def counts_of(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def help_on(records: DataFrame, key: str, map_col: str = "attributes", limit: int = 10) -> DataFrame:
    """A row about a field: type (`mixed` of several), origin, number of values, the most common ones."""
    v = F.try_element_at(F.col(map_col), key_of(key))
    counts = records.select(v.alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    about = counts.agg(F.bit_or(type_bits(F.col("value"))).alias("bits"), F.count(F.lit(1)).alias("n_values"))
    top = counts.orderBy(F.desc("n"), "value").limit(limit).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))), lambda x: x["value"]).alias("common"))
    return about.crossJoin(top).select(F.lit(key).alias("key"), type_of_bits(F.col("bits")).alias("type"), F.lit(map_col).alias("origin"), "n_values", "common")  # one row each


def suggestions(records: DataFrame, context: Column, newest: list[Column], key: str, prefix: str, sample: int = 10_000, limit: int = 50, map_col: str = "attributes") -> DataFrame:
    """Values of a key that start with what was typed, among the newest records that match the rest of the filter.

    Records without such a value don't count for the sample, and the most frequent values are cut last, so that a value
    is found however rare it is.
    """
    own = F.lower(F.ltrim(F.try_element_at(F.col(map_col), key_of(key)), F.lit('"')))
    recent = records.filter(context & own.startswith(prefix.lower())).orderBy(*newest).limit(sample)
    return values(recent, key, map_col, limit)
