"""Streams: landing files to day-partitioned Parquet, and minute summaries of spans with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketch import bucket
from ..operators.steps import day_of, step_of
from ..plans.ranges import MINUTE
from ..sources import otlp


def land_logs(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 64) -> StreamingQuery:
    """Log records of arriving request files, appended by day. Exactly once by the checkpoint; back-pressure by file count."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(source)
    rows = otlp.logs(lines.select(F.from_json("value", otlp.REQUEST).alias("r")).select("r.*"))
    return rows.withColumn("day", day_of(F.col("logged_at"))).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()


def minute_counts(spans: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Counts, errors and total time of spans by service, minute and duration bucket, closed `late` after their minute."""
    timed = spans.withColumn("event_time", F.timestamp_micros((step_of(F.col("started_at"), 1_000) / 1_000).cast("long"))).withWatermark("event_time", late)
    by = [F.window("event_time", "1 minute"), "service", bucket(F.col("duration_ns")).alias("bucket")]
    found = timed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 2).alias("errors"), F.sum("duration_ns").alias("sum_ns"))
    return found.select((F.unix_micros("window.start") * 1_000).alias("minute_at"), "service", "bucket", "n", "errors", "sum_ns")


def upsert_minutes(target: str):
    """A batch writer for foreachBatch in update mode: each batch has its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def read_minutes(spark: SparkSession, target: str) -> DataFrame:
    """The latest state of every minute over all batches."""
    rows = spark.read.parquet(target)
    keys = ["minute_at", "service", "bucket"]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "errors", "sum_ns")])
