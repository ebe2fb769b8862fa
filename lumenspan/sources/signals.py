"""The three signals as DataFrames, made from the event and order tables.

Instants and durations are BIGINT nanoseconds. An attribute set is a map from key to the canonical JSON text of the value
("7" for the number, "\\"7\\"" for the string), so that types stay apart and maps stay groupable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DAY = 86_400 * SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts: str) -> Column:
    """Unix nanoseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ)) * 1000")


def hex_id(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def entries(**values: Column) -> Column:
    """A map of the values that aren't null; keys use __ for dots."""
    pairs = [F.struct(F.lit(k.replace("__", ".")).alias("key"), v.alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log for each event: errors are errors, purchases warnings, and so on down to trace."""
    e = table(spark, sf_dir, "events").withColumn("logged_at", nanos("ts"))
    user = F.col("user_id").cast("string")
    day = F.col("logged_at") - F.pmod(F.col("logged_at"), F.lit(DAY))
    severity = F.create_map(*[F.lit(x) for kv in {"error": 17, "purchase": 13, "signup": 9, "click": 5, "view": 1}.items() for x in kv])
    return e.select(
        F.col("event_id").alias("row_id"), "logged_at", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.coalesce(F.try_element_at(severity, F.col("event_type")), F.lit(0)).alias("severity"),
        F.concat_ws(" ", F.lit("user"), user, "event_type", F.col("value").cast("decimal(18,2)").cast("string")).alias("body"),
        hex_id(F.col("user_id") * 100_000 + (day / DAY).cast("long"), 32).alias("trace_id"), F.when(F.col("event_type") != "view", hex_id(F.col("event_id") + 1, 16)).alias("span_id"),
        entries(
            user__id=F.when(F.col("event_id") % 7 == 0, quoted(user)).otherwise(user), event__type=quoted(F.col("event_type")),
            k=F.when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k")), ok=(F.col("event_type") != "error").cast("string"),
        ).alias("attributes"),
        entries(host__name=quoted(F.concat(F.lit("host-"), (F.col("user_id") % 3).cast("string")))).alias("resource"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are root spans of a trace each, their lines the children; those of every 50th order name a parent that is missing.

    The children's query texts have four shapes, one of them with bound values, and every seventh order's are no SQL.
    """
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    roots = o.select(
        hex_id(F.col("o_orderkey"), 32).alias("trace_id"), hex_id(F.col("o_orderkey") * 1000, 16).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        F.col("o_orderpriority").alias("name"), F.lit(2).alias("kind"), (nanos("o_orderdate") + (F.col("o_orderkey") % 86_400) * SECOND).alias("started_at"),
        (F.round(F.col("o_totalprice") * 100).cast("long") * 10_000).alias("duration_ns"), F.when(F.col("o_orderkey") % 20 == 1, 2).when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("status"),
        F.concat(F.lit("svc-"), (F.col("o_custkey") % 5).cast("string")).alias("service"),
        entries(http__request__method=quoted(F.when(F.col("o_custkey") % 4 == 0, "POST").otherwise("GET")), http__route=quoted(F.concat(F.lit("/r"), (F.col("o_custkey") % 7).cast("string"), F.lit("/{id}"))), user__id=F.col("o_custkey").cast("string")).alias("attributes"),
        (F.col("o_orderkey") * 1000).alias("row_id"),
    )
    number = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)")
    part, supplier, shape = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_orderkey") % 4
    statement = (
        F.when(shape == 0, F.concat(F.lit("SELECT * FROM part WHERE id = "), part, F.lit(" AND qty > "), F.col("l_quantity").cast("int").cast("string")))
        .when(shape == 1, F.concat(F.lit("SELECT name FROM supplier WHERE note IN ('it''s', 'b') AND id = "), supplier))
        .when(shape == 2, F.concat(F.lit("INSERT INTO shipped (id, mode) VALUES ("), part, F.lit(", 'air'), ("), supplier, F.lit(", 'rail')")))
        .otherwise("SELECT * FROM part WHERE id = $1 -- 42")
    )
    children = line.withColumn("n", number).select(
        hex_id(F.col("l_orderkey"), 32).alias("trace_id"), hex_id(F.col("l_orderkey") * 1000 + F.col("n"), 16).alias("span_id"),
        hex_id(F.col("l_orderkey") * 1000 + F.when(F.col("l_orderkey") % 50 == 0, 999).when(F.col("n") % 3 == 0, F.col("n") - 1).otherwise(0), 16).alias("parent_span_id"),
        F.concat(F.lit("ship "), "l_linestatus").alias("name"), F.lit(3).alias("kind"), (nanos("l_shipdate") + F.col("n") * 1_000_000).alias("started_at"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000).alias("duration_ns"), F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("status"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 5).cast("string")).alias("service"),
        entries(db__system__name=quoted(F.when(F.col("l_orderkey") % 7 == 0, "mongodb").otherwise("postgresql")), db__query__text=quoted(statement)).alias("attributes"),
        (F.col("l_orderkey") * 1000 + F.col("n")).alias("row_id"),
    )
    return roots.unionByName(children)


def gauge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as a gauge: a series for each event type and last digit of the user."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", (F.col("user_id") % 10).cast("string"), "event_type").alias("series"), (F.col("user_id") % 10).alias("shard"), F.col("event_type").alias("type"), nanos("ts").alias("recorded_at"), F.round(F.col("value") * 100).cast("long").alias("value")
    )


def counter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values added up by series, starting again each day: a cumulative counter with restarts."""
    points = gauge_points(spark, sf_dir).withColumn("day", F.col("recorded_at") - F.pmod("recorded_at", F.lit(DAY)))
    return points.withColumn("value", F.expr("sum(value) OVER (PARTITION BY series, day ORDER BY recorded_at ROWS UNBOUNDED PRECEDING)")).drop("day")
