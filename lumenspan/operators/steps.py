"""Time steps: flooring, the grid of a range, zero fill and fill-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ranges import Range


def step_of(t: Column, step: int) -> Column:
    """Start of the step that holds t, floored, also before 1970; no division, which would go through doubles."""
    return t - F.pmod(t, F.lit(step).cast("long"))


def day_of(t: Column) -> Column:
    return F.date_from_unix_date((step_of(t, 86_400_000_000_000) / 86_400_000_000_000).cast("int"))


def grid(spark: SparkSession, r: Range, step: int) -> DataFrame:
    """The starts of all steps of a range, at most 10,000."""
    first = r.first_step(step)
    return spark.range(r.steps(step)).select((F.col("id") * step + first).alias("step_at"))


def within(df: DataFrame, column: str, r: Range) -> DataFrame:
    return df.filter((F.col(column) >= r.start) & (F.col(column) < r.end))


def zero_filled(counts: DataFrame, keys: DataFrame | None, r: Range, step: int, columns: list[str]) -> DataFrame:
    """counts with a row for every step (and every row of keys), zeros where there was none."""
    steps = grid(counts.sparkSession, r, step)
    names = keys.columns if keys is not None else []
    # The grid is at most 10,000 rows and keys at most a page, both bounded by the plan.
    cells = F.broadcast(steps) if keys is None else keys.crossJoin(F.broadcast(steps))
    found = counts.select(*[F.col(n).alias(f"__{n}") for n in ("step_at", *names)], *columns)
    same = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in ("step_at", *names)]
    return cells.join(found, same, "left").select(*names, "step_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def fill_forward(df: DataFrame, keys: list[str], column: str, step: int, most_age: int = 300_000_000_000) -> DataFrame:
    """Empty steps take the last value while it is under most_age old."""
    reach = max(0, -(-most_age // step) - 1)
    w = Window.partitionBy(*keys).orderBy("step_at").rowsBetween(-reach, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def page(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order, with `truncated`: whether there are more. One row more than the page is read."""
    top = rows.orderBy(*order).limit(limit + 1)
    numbered = top.withColumns({"__place": F.row_number().over(Window.orderBy(*order)), "truncated": F.count(F.lit(1)).over(Window.partitionBy()) > limit})
    return numbered.filter(F.col("__place") <= limit).drop("__place")


def after(order: list[tuple[str, bool]], values: list) -> Column:
    """Rows that come after a row with these values in an order of (column, descending): a keyset cursor."""
    if len(values) != len(order):
        raise ValueError(f"a cursor has {len(order)} values")
    out, same = F.lit(False), F.lit(True)
    for (name, descending), x in zip(order, values, strict=True):
        out = out | (same & ((F.col(name) < x) if descending else (F.col(name) > x)))
        same = same & (F.col(name) == x)
    return out


def table_order(name: str, descending: bool) -> Column:
    """How a table is sorted by a column: missing values come last both ways."""
    return F.desc_nulls_last(name) if descending else F.asc_nulls_last(name)
