"""Reading days from the newest: a page stops once it is full, whatever the table's age."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stored
from .steps import after

DAYS_FIRST = 1  # days of the first window; each further window is twice as long


@dataclass(frozen=True)
class Page:
    """A page of records, newest first, and what is known about the rest.

    rows: at most `limit`. truncated: more records match. next: the last row's (time, row), the cursor of the next page.
    partial: time ran out before the page was full or the oldest day was reached. days: how many days were read.
    """

    rows: DataFrame
    truncated: bool
    next: tuple[int, int] | None
    partial: bool
    days: int


def _page(rows: DataFrame, column: str, limit: int, cursor: tuple[int, int] | None) -> DataFrame:
    order = [(column, True), ("row_id", True)]
    rows = rows.filter(after(order, list(cursor))) if cursor else rows
    return rows.orderBy(F.desc(column), F.desc("row_id")).limit(limit)


def newest_page(spark: SparkSession, path: str, column: str, condition: Column, limit: int, cursor: tuple[int, int] | None = None, seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> Page:
    """The newest records of a table by day (`sources.daily`) that match: windows of 1, 2, 4 ... days are read back from the
    newest, or from the cursor's, until limit + 1 rows are found.

    At most limit + 1 rows come to the driver, limit being a page. Each window's days are partition filters, so a page of a
    long table reads a day or two, and a rare match reads each day once. With `seconds`, no window begins later.
    """
    began = clock()
    days = sorted((name.split("=")[1] for name in stored.children(spark, path) if name.startswith("day=") and "HIVE" not in name), reverse=True)
    table = spark.read.parquet(path) if days else None
    if cursor:
        last = spark.range(1).select(F.date_from_unix_date((F.lit(cursor[0]) / F.lit(86_400_000_000_000)).cast("int")).cast("string")).first()[0]
        days = [d for d in days if d <= last]
    found, read, window = [], 0, DAYS_FIRST
    while read < len(days) and len(found) <= limit and (seconds is None or read == 0 or clock() - began < seconds):
        now = days[read : read + window]
        rows = table.filter(F.col("day").between(F.lit(now[-1]).cast("date"), F.lit(now[0]).cast("date")) & F.coalesce(condition, F.lit(False)))
        found += _page(rows.drop("day"), column, limit + 1 - len(found), cursor).collect()
        read, window = read + len(now), 2 * window
    schema = table.drop("day").schema if table is not None else f"{column} long, row_id long"
    page = found[:limit]
    more = len(found) > limit
    partial = not more and read < len(days)
    following = (page[-1][column], page[-1]["row_id"]) if page and (more or partial) else None
    return Page(spark.createDataFrame(page, schema), more, following, partial, read)
