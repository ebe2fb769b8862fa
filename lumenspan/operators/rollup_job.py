"""The roll-up of metric points as a job: hours are summed up once they are due, a re-run replaces them, a rebuild replaces all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranges import HOUR, MINUTE
from ..sources import stored
from .rollups import coarser_metrics, due, metric_summary
from .steps import day_of


@dataclass(frozen=True)
class MetricRollup:
    """Summaries of cumulative series by minute and hour in a folder.

    Every run sums up the hours from where the last one came to until what is due, in folders of its own (with the days
    as partitions), and then writes how far it came, with the last point of each series, from which the next hour's first
    points grew. Folders count once that is written: killed in between, the next run sums up the same hours again, and
    what a dead run left is not read. Versions are whole: a rebuild fills a new one, which readers see once it is pointed
    to.
    """

    path: str
    keys: tuple[str, ...] = ("series",)

    def version(self, spark: SparkSession) -> int:
        return max(stored.folders(spark, f"{self.path}/current", "version"), default=0)

    def runs(self, spark: SparkSession, version: int | None = None) -> list[int]:
        """Where each complete run came to."""
        return sorted(stored.folders(spark, f"{self._root(spark, version)}/progress", "upto"))

    def _root(self, spark: SparkSession, version: int | None) -> str:
        return f"{self.path}/version={self.version(spark) if version is None else version}"

    def run(self, points: DataFrame, indexed_until: int, version: int | None = None) -> int | None:
        """Sum up the hours that are due; points: keys, recorded_at, value, of which those of these hours are read."""
        spark = points.sparkSession
        root, done, until = self._root(spark, version), max(self.runs(spark, version), default=None), due(indexed_until, HOUR)
        if done is not None and until <= done:
            return done
        rows = points.select(*self.keys, "recorded_at", "value").filter(F.col("recorded_at") < until)
        if done is not None:
            rows = rows.filter(F.col("recorded_at") >= done).unionByName(spark.read.parquet(f"{root}/progress/upto={done}"))
        made = metric_summary(rows, list(self.keys), MINUTE, done)
        self._write(made, f"{root}/minutes/upto={until}")
        minutes = spark.read.schema(made.schema).parquet(f"{root}/minutes/upto={until}")
        self._write(coarser_metrics(minutes, list(self.keys), HOUR), f"{root}/hours/upto={until}")
        last = rows.groupBy(*self.keys).agg(F.max("recorded_at").alias("recorded_at"), F.max_by("value", "recorded_at").alias("value"))
        stored.put(last, f"{root}/progress/upto={until}")
        return until

    @staticmethod
    def _write(cells: DataFrame, path: str) -> None:
        stored.put(cells.withColumn("day", day_of(F.col("unit_at"))).hint("rebalance", "day"), path, ("day",))

    def rebuild(self, points: DataFrame, indexed_until: int) -> int:
        """Sum up everything anew as the next version and point to it; readers keep the old one until then."""
        spark = points.sparkSession
        version = self.version(spark) + 1
        stored.remove(spark, f"{self.path}/version={version}")
        self.run(points, indexed_until, version)
        stored.put(spark.range(1), f"{self.path}/current/version={version}")
        return version

    def read(self, spark: SparkSession, unit: str) -> DataFrame:
        """`minutes` or `hours` of the version that is pointed to."""
        root = f"{self._root(spark, None)}/{unit}"
        paths = [f"{root}/upto={k}" for k in self.runs(spark)]
        own = [p for p in paths if stored.children(spark, p)]  # a run without points has no days
        return spark.read.option("basePath", root).parquet(*own).drop("day", "upto")
