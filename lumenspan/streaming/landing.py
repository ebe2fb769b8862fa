"""Landing of request files: one pass over each batch splits it into records by day, rejected ones by reason, and unreadable lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollups import span_cells
from ..operators.steps import day_of, within
from ..plans.ranges import DAY, MINUTE, Range
from ..sources import otlp, stored
from .deltas import Deltas

TIMES = {"logs": "logged_at", "spans": "started_at", "points": "recorded_at"}


def minutes_table(target: str) -> Deltas:
    """Minute cells of spans; late spans change the minute that they belong to, however old."""
    return Deltas(f"{target}/minutes", ("service", "unit_at", "bucket"), {"n": "sum", "sum_ns": "sum", "low_ns": "min", "high_ns": "max"})


def land_batch(target: str):
    """For foreachBatch over text lines; a repeated batch replaces all that it wrote."""

    def write(lines: DataFrame, batch: int) -> None:
        lines = lines.select("value").persist()
        try:
            whole = F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False))
            request = lines.select(F.from_json("value", otlp.REQUEST).alias("r")).select("r.*")
            spans, bad_spans = otlp.spans(request)
            points, bad_points = otlp.metrics(request)
            records = {"logs": otlp.logs(request), "spans": spans, "points": points}
            for signal, rows in records.items():
                stored.put(rows.withColumn("day", day_of(F.col(TIMES[signal]))), f"{target}/{signal}/batch={batch}", ("day",))
            minutes_table(target).add(span_cells(spark_rows(lines, target, "spans", batch), ["service"], MINUTE), batch)
            rejected = [
                lines.filter((F.trim("value") != "") & ~whole).agg(F.lit("lines").alias("signal"), F.lit("a line is no JSON object").alias("reason"), F.count(F.lit(1)).alias("n")),
                bad_spans.select(F.lit("spans").alias("signal"), F.lit("an ID of a span is missing").alias("reason"), F.col("rejected").alias("n")),
                bad_points.select(F.lit("points").alias("signal"), "reason", F.col("rejected").alias("n")),
            ]
            stored.put(reduce(DataFrame.unionByName, rejected).filter("n > 0"), f"{target}/rejected/batch={batch}")
        finally:
            lines.unpersist()

    return write


def spark_rows(any_frame: DataFrame, target: str, signal: str, batch: int) -> DataFrame:
    """What a batch has written of a signal: its summaries are made of what landed, not of the requests once more."""
    return any_frame.sparkSession.read.parquet(f"{target}/{signal}/batch={batch}")


def land(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 64) -> StreamingQuery:
    """Logs, spans and points of arriving files, with minute cells of spans. Back-pressure by the number of files."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(source)
    return lines.writeStream.foreachBatch(land_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records(spark: SparkSession, target: str, signal: str, r: Range | None = None) -> DataFrame:
    """All landed records of a signal, or those of a range, of whose days alone the files are read."""
    rows = spark.read.parquet(f"{target}/{signal}")
    if r is not None:
        first, last = (F.date_from_unix_date(F.lit(t // DAY)) for t in (r.start, r.end - 1))
        rows = within(rows.filter(F.col("day").between(first, last)), TIMES[signal], r)
    return rows.drop("day", "batch")


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """signal, reason, n over all batches."""
    return spark.read.parquet(f"{target}/rejected").groupBy("signal", "reason").agg(F.sum("n").alias("n"))
