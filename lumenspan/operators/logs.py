"""Lists, counts and templates of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import template
from ..plans.ranges import Range, group_limit
from .steps import step_of, within, zero_filled


def newest(logs: DataFrame, condition: Column, limit: int, after: tuple[int, int] | None = None) -> DataFrame:
    """A page, newest first; `after` is the (instant, row) of the last line of the page before."""
    if after:
        condition = condition & (F.col("logged_at") <= after[0]) & ((F.col("logged_at") < after[0]) | (F.col("row_id") < after[1]))
    return logs.filter(condition).orderBy(F.desc("logged_at"), F.desc("row_id")).limit(limit)


def counts_by_step(logs: DataFrame, r: Range, step: int) -> DataFrame:
    found = within(logs, "logged_at", r).groupBy(step_of(F.col("logged_at"), step).alias("step_at")).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(found, None, r, step, ["n"])


def top_groups(logs: DataFrame, keys: dict[str, Column], limit: int, highest: bool = True) -> DataFrame:
    """Groups by count, ties by their values, missing first."""
    counted = logs.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n") if highest else F.asc("n"), *[F.asc_nulls_first(k) for k in keys]).limit(limit)


def group_steps(logs: DataFrame, keys: dict[str, Column], r: Range, step: int, limit: int) -> DataFrame:
    """The steps of the first groups, zero filled. One pass counts by group and step; groups are ranked from that."""
    cells = within(logs, "logged_at", r).groupBy(*[c.alias(k) for k, c in keys.items()], step_of(F.col("logged_at"), step).alias("step_at")).agg(F.count(F.lit(1)).alias("n"))
    ranked = cells.groupBy(*keys).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), *[F.asc_nulls_first(k) for k in keys]).limit(group_limit(limit, r.steps(step)))
    return zero_filled(cells, ranked.select(*keys), r, step, ["n"])


def everything(logs: DataFrame, key: Column, r: Range, step: int) -> DataFrame:
    """Total, steps, groups and steps of groups in one pass; grp_id tells them apart."""
    base = within(logs, "logged_at", r).select(key.alias("grp"), step_of(F.col("logged_at"), step).alias("step_at"))
    return base.groupingSets([[], ["step_at"], ["grp"], ["grp", "step_at"]], "grp", "step_at").agg(F.grouping_id().alias("grp_id"), F.count(F.lit(1)).alias("n"))


def templates(logs: DataFrame, scan: int = 50_000, limit: int = 50, samples: int = 3) -> DataFrame:
    """Templates of the newest `scan` lines: count, worst severity, services, first and last time, newest distinct samples."""
    lines = logs.orderBy(F.desc("logged_at"), F.desc("row_id")).limit(scan).withColumn("template", template(F.col("body")))
    bodies = lines.groupBy("template", "body").agg(F.max(F.struct("logged_at", "row_id")).alias("at"))
    numbered = bodies.withColumn("rank", F.row_number().over(Window.partitionBy("template").orderBy(F.desc("at")))).filter(F.col("rank") <= samples)
    shown = numbered.groupBy("template").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"]).alias("samples"))
    groups = lines.groupBy("template").agg(
        F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"), F.sort_array(F.collect_set("service")).alias("services"), F.min("logged_at").alias("first_at"), F.max("logged_at").alias("last_at")
    )
    return groups.join(shown, "template").orderBy(F.desc("n"), F.desc("last_at"), "template").limit(limit)
