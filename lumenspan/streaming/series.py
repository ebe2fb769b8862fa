"""Series of metric points as streams: increases since the previous point, and the guard on the number of series."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..plans.ranges import HOUR
from ..sources import stored
from .deltas import Deltas

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROWN = StructType([StructField("series", StringType()), *(StructField(n, LongType()) for n in ("step_at", "increase", "elapsed_ns", "late"))])


class Increases(StatefulProcessor):
    """Per series the points of the last `horizon` nanoseconds and the one before them.

    Each batch's points are put where they belong in time; what comes out is the difference that they make to the steps'
    sums, so the sums don't depend on how the points were dealt to batches. Points older than all that is held, once some
    were let go, are counted as late. A timer at its last point, which the watermark passes once the newest point of all is
    `idle` ahead, forgets a series.
    """

    def __init__(self, step: int, cumulative: bool, horizon: int):
        self.step, self.cumulative, self.horizon = step, cumulative, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("points", "times array<long>, counts array<long>, let_go boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, counts, let_go = self.held.get() if self.held.exists() else ([], [], False)
        times, counts = list(times), list(counts)
        new = sorted((int(t), int(v)) for frame in rows for t, v in zip(frame["recorded_at"], frame["value"], strict=True))
        late = [p for p in new if let_go and p[0] < times[0]]
        new = new[len(late) :]
        sums: dict[int, list[int]] = {}
        if new:
            # Only what follows the first new point can change; the point before it is the base.
            a = max(0, bisect_left(times, new[0][0]) - 1)
            before = list(zip(times[a:], counts[a:], strict=True))
            after = sorted(before + new)
            first = a == 0 and not let_go
            self._add(sums, before, first, -1)
            self._add(sums, after, first, 1)
            times[a:], counts[a:] = [t for t, _ in after], [v for _, v in after]
            cut = max(0, bisect_right(times, times[-1] - self.horizon) - 1)
            self.held.update((times[cut:], counts[cut:], let_go or cut > 0))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(times[-1] // 1_000_000 + 1)
        found = [(key[0], s, grown, took, 0) for s, (grown, took) in sorted(sums.items()) if grown or took]
        found += [(key[0], new_step, 0, 0, 1) for new_step in (t - t % self.step for t, _ in late)]
        yield pd.DataFrame(found, columns=GROWN.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame([], columns=GROWN.names)

    def _add(self, sums: dict[int, list[int]], points: list[tuple[int, int]], first: bool, sign: int) -> None:
        """Increases of the points after the first one; of that, too, if it is a delta series' first of all."""
        if points and first and not self.cumulative:
            own = sums.setdefault(points[0][0] - points[0][0] % self.step, [0, 0])
            own[0] += sign * points[0][1]
        for (t, v), (u, w) in zip(points, points[1:], strict=False):
            own = sums.setdefault(u - u % self.step, [0, 0])
            own[0] += sign * (w - v if self.cumulative and w >= v else w)
            own[1] += sign * (u - t)

    def close(self) -> None:
        pass


def grown(points: DataFrame, step: int, cumulative: bool = True, horizon: int = HOUR, idle: str = "7 days") -> DataFrame:
    """series, step_at, increase, elapsed_ns, late of a stream of points (series, recorded_at, value): changes to be summed.

    What arrives more than `idle` behind the newest point of all is left out by the watermark.
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = points.select("series", "recorded_at", "value", F.timestamp_micros(F.expr("recorded_at div 1000")).alias("event_time")).withWatermark("event_time", idle)
    return timed.groupBy("series").transformWithStateInPandas(Increases(step, cumulative, horizon), GROWN, "Update", "EventTime")


def increases_table(path: str) -> Deltas:
    return Deltas(path, ("series", "step_at"), {"increase": "sum", "elapsed_ns": "sum", "late": "sum"})


def land_increases(points: DataFrame, step: int, path: str, checkpoint: str, cumulative: bool = True, horizon: int = HOUR, idle: str = "7 days"):
    """A query that keeps the table of increases by series and step up to date; it can be stopped and started again."""
    table = increases_table(path)
    return grown(points, step, cumulative, horizon, idle).writeStream.outputMode("update").foreachBatch(table.writer(lambda rows: rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SeriesGuard:
    """At most `limit` series of each metric: later ones are rejected, whatever the batches.

    The catalog of accepted series is a table with a folder for each batch; a batch reads those before it, so repeating it
    accepts the same series. Within a batch the first series are those that appear first in time. Points aren't gathered:
    only series that are new in a batch are ranked, and of those no more than the limit of each metric goes on from a task.
    """

    def __init__(self, path: str, limit: int = 1_000):
        self.path, self.limit = path, limit

    def catalog(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        parts = [p for k, p in sorted(stored.folders(spark, f"{self.path}/series", "batch").items()) if before is None or k < before]
        return spark.read.schema("metric string, series string, first_at long").parquet(*parts) if parts else spark.createDataFrame([], "metric string, series string, first_at long")

    def split(self, points: DataFrame, batch: int) -> DataFrame:
        """points (metric, series, recorded_at, ...) with `accepted`; the batch's new series are in the catalog after it."""
        spark = points.sparkSession
        known = self.catalog(spark, batch)
        seen = points.groupBy("metric", "series").agg(F.min("recorded_at").alias("first_at"))
        new = seen.join(known.select("metric", "series"), ["metric", "series"], "left_anti")
        taken = known.groupBy("metric").agg(F.count(F.lit(1)).alias("taken"))
        place = F.row_number().over(Window.partitionBy("metric").orderBy("first_at", "series"))
        first = new.withColumn("place", place).filter(F.col("place") <= self.limit).join(taken, "metric", "left")
        stored.put(first.filter(F.col("place") + F.coalesce("taken", F.lit(0)) <= self.limit).select("metric", "series", "first_at"), f"{self.path}/series/batch={batch}")
        accepted = self.catalog(spark, batch + 1).select("metric", "series", F.lit(True).alias("__in"))
        return points.join(accepted, ["metric", "series"], "left").withColumn("accepted", F.coalesce("__in", F.lit(False))).drop("__in")

    def writer(self):
        """For foreachBatch: accepted points and the number of rejected ones of each metric, by batch."""

        def write(points: DataFrame, batch: int) -> None:
            told = self.split(points, batch)
            stored.put(told.filter("accepted").drop("accepted"), f"{self.path}/points/batch={batch}")
            stored.put(told.groupBy("metric").agg(F.count_if(~F.col("accepted")).alias("rejected")), f"{self.path}/rejected/batch={batch}")

        return write

    def points(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*stored.folders(spark, f"{self.path}/points", "batch").values())

    def rejected(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*stored.folders(spark, f"{self.path}/rejected", "batch").values()).groupBy("metric").agg(F.sum("rejected").alias("rejected"))
