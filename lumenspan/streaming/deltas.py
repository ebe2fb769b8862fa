"""Tables that batches add to: each batch leaves a folder of partial sums, which are merged when read and compacted.

A batch's folder goes by its id, so that repeating a batch replaces what it wrote; nothing is ever closed, so rows that
come late still add. Compaction writes everything up to a batch as one version; the newest complete version and the
batches after it are the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stored

#: How a column of partial results is merged; `last` goes with a column that tells which of two is later.
MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Deltas:
    """keys and, by column, sum, min, max or `last:<column>` (the value at the greatest of that column)."""

    path: str
    keys: tuple[str, ...]
    merges: dict[str, str] = field(default_factory=dict)

    def _merged(self) -> list[Column]:
        return [(F.max_by(c, how.split(":")[1]) if how.startswith("last:") else MERGES[how](c)).alias(c) for c, how in self.merges.items()]

    def merge(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*self._merged())

    def add(self, cells: DataFrame, batch: int) -> None:
        """What a batch brings, as merged cells; repeating the batch replaces it."""
        stored.put(self.merge(cells), f"{self.path}/delta/batch={batch}")

    def writer(self, cells_of):
        """For foreachBatch: cells_of makes a batch's cells of its rows."""

        def write(rows: DataFrame, batch: int) -> None:
            self.add(cells_of(rows), batch)

        return write

    def _parts(self, spark: SparkSession) -> tuple[int, list[str]]:
        versions = stored.folders(spark, f"{self.path}/version", "upto")
        upto = max(versions, default=-1)
        after = {k: p for k, p in stored.folders(spark, f"{self.path}/delta", "batch").items() if k > upto}
        return max([upto, *after]), [*([versions[upto]] if versions else []), *(after[k] for k in sorted(after))]

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last complete batch: one row for each key."""
        _, parts = self._parts(spark)
        if not parts:
            raise FileNotFoundError(f"nothing was added to {self.path} yet")
        return self.merge(reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in parts]))

    def compact(self, spark: SparkSession, keep: bool = False) -> int:
        """Write the table as one version and, unless kept, drop what went into it. Returns the last batch that is in it.

        Killed at any point, the next run does it again: an unfinished version isn't complete and isn't read.
        """
        upto, parts = self._parts(spark)
        if len(parts) > 1 or parts and "/delta/" in parts[0]:
            stored.put(self.read(spark), f"{self.path}/version/upto={upto}")
        if not keep:
            for k, p in stored.folders(spark, f"{self.path}/delta", "batch").items():
                if k <= upto:
                    stored.remove(spark, p)
            for k, p in stored.folders(spark, f"{self.path}/version", "upto").items():
                if k < upto:
                    stored.remove(spark, p)
        return upto
