"""Derivations of host snapshots: shares of CPU time, file systems counted once, time of units that never falls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cpu_shares(ticks: DataFrame) -> DataFrame:
    """host, mode, at, ticks (running) to the share of each mode in the time since the snapshot before."""
    grown = F.col("ticks") - F.lag("ticks").over(Window.partitionBy("host", "mode").orderBy("at"))
    rows = ticks.withColumn("grown", grown).filter("grown IS NOT NULL")
    return rows.withColumn("share", F.try_divide(F.col("grown"), F.sum("grown").over(Window.partitionBy("host", "at")))).drop("grown")


def file_systems(mounts: DataFrame) -> DataFrame:
    """host, device, mount and more: each device once, with its shortest mount point."""
    order = Window.partitionBy("host", "device").orderBy(F.length("mount"), "mount")
    return mounts.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def unit_times(times: DataFrame) -> DataFrame:
    """host, unit, process, at, cpu_ns to a total of each unit that keeps what ended processes had used."""
    by_process = Window.partitionBy("host", "unit", "process").orderBy("at")
    before = F.lag("cpu_ns").over(by_process)
    grown = F.when(before.isNull() | (F.col("cpu_ns") < before), F.col("cpu_ns")).otherwise(F.col("cpu_ns") - before)
    steps = times.withColumn("grown", grown).groupBy("host", "unit", "at").agg(F.sum("grown").alias("grown"))
    return steps.withColumn("cpu_ns", F.sum("grown").over(Window.partitionBy("host", "unit").orderBy("at"))).drop("grown")
