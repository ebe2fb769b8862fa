"""Steps of metric series: levels, counter increases, histograms; grouping, ranking, top N and the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import Range
from .steps import page, step_of, within


def levels(points: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Per series and step: points, least, greatest, sum and last value."""
    return points.groupBy(*keys, step_of(F.col("recorded_at"), step).alias("step_at")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("sum"), F.max_by("value", "recorded_at").alias("last")
    )


LOOK_BACK = 300_000_000_000  # how long before a range the point is looked for that its first one grew from


def increases(points: DataFrame, keys: list[str], step: int, cumulative: bool = True, r: Range | None = None) -> DataFrame:
    """Per series and step: increase and the time it took, in the step of the later point.

    The first point of a cumulative series only sets the base; a fall is a restart and counts from zero. In a range, the
    point before it, within LOOK_BACK, is the base of the first one.
    """
    if r:
        points = within(points, "recorded_at", Range(r.start - LOOK_BACK, r.end))
    w = Window.partitionBy(*keys).orderBy("recorded_at")
    before = F.lag("value").over(w)
    grown = F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value")) if cumulative else F.col("value")
    took = F.coalesce(F.col("recorded_at") - F.lag("recorded_at").over(w), F.lit(0))
    rows = points.select(*keys, "recorded_at", grown.alias("grown"), took.alias("took")).filter(F.col("grown").isNotNull())
    if r:
        rows = rows.filter(F.col("recorded_at") >= r.start)
    return rows.groupBy(*keys, step_of(F.col("recorded_at"), step).alias("step_at")).agg(F.sum("grown").alias("increase"), F.sum("took").alias("elapsed_ns"))


def rates(steps: DataFrame) -> DataFrame:
    """Increase a second; null where no time passed."""
    return steps.withColumn("rate", F.try_divide(F.col("increase").cast("double"), F.col("elapsed_ns") / F.lit(1e9)))


def ranking(steps: DataFrame, key: str, kind: str) -> DataFrame:
    """key, score: a gauge's and an updown's mean of step averages, a counter's mean over the steps that have a rate, a
    histogram's summed values."""
    score = {"counter": lambda: F.avg("rate"), "histogram": lambda: F.sum("sum")}.get(kind, lambda: F.avg(F.col("sum") / F.col("n")))()
    return (rates(steps) if kind == "counter" else steps).groupBy(key).agg(score.alias("score"))


def combined(steps: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """All series of a chart as one line: gauges average, updowns and rates add up; steps without a point are left out."""
    value = F.col("rate") if kind == "counter" else F.col("sum") / F.col("n")
    rows = rates(steps) if kind == "counter" else steps
    return rows.groupBy(*(by or []), "step_at").agg((F.avg(value) if kind == "gauge" else F.sum(value)).alias("value"))


def aligned(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """The rows of first with `column` of second at the same step, 0 where it has none."""
    return first.join(second.select("step_at", column), "step_at", "left").withColumn(column, F.coalesce(column, F.lit(0)))


def metric_names(points: DataFrame, name: str) -> DataFrame:
    """Per metric: series, least and greatest value."""
    return points.groupBy(F.col(name).alias("name")).agg(F.count_distinct("series").alias("n_series"), F.min("value").alias("low"), F.max("value").alias("high"))


def metric_list(series: DataFrame, points: DataFrame, r: Range, limit: int) -> DataFrame:
    """Series with a point in the range, in order of name and series, and whether there are more."""
    live = within(points, "recorded_at", r).select("series").distinct()
    return page(series.join(live, "series", "left_semi"), [F.asc("name"), F.asc("series")], limit)


def grouped_levels(steps: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Series of a group in each step: a gauge averages averages and lasts, an updown adds up, also least and greatest."""
    if kind == "gauge":
        return steps.groupBy(*by, "step_at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.avg(F.col("sum") / F.col("n")).alias("avg"), F.avg("last").alias("last"))
    return steps.groupBy(*by, "step_at").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum(F.col("sum") / F.col("n")).alias("avg"), F.sum("last").alias("last"))


def top_and_rest(steps: DataFrame, key: str, rank: DataFrame, limit: int, value: str) -> DataFrame:
    """The steps of the first `limit` groups of `rank` (key, score), all others added up as one group, `other`."""
    order = rank.orderBy(F.desc("score"), F.asc_nulls_first(key)).limit(limit).select(F.col(key).alias("__key"), F.lit(True).alias("__kept"))
    named = steps.join(F.broadcast(order), F.col(key).eqNullSafe(F.col("__key")), "left")
    group = F.when(F.col("__kept"), F.col(key)).otherwise("other")
    return named.groupBy(group.alias("__group"), F.coalesce("__kept", F.lit(False)), "step_at").agg(F.sum(value).alias(value), F.count_distinct(key).alias("series_count")).select(F.col("__group").alias(key), "step_at", value, "series_count")


def histogram_points(points: DataFrame, keys: list[str], bounds: list[float], step: int) -> DataFrame:
    """Explicit delta histograms of the values of each series and step: count, sum, bucket counts."""
    place = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        place = F.when(F.col("value") <= bounds[k], k).otherwise(place)
    cells = [F.count_if(place == k) for k in range(len(bounds) + 1)]
    return points.groupBy(*keys, step_of(F.col("recorded_at"), step).alias("step_at")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.array(*cells).alias("counts"))


def add_counts(steps: DataFrame, by: list[str], cells: int) -> DataFrame:
    """Merge histograms of the same bounds: bucket by bucket, as plain sums that combine before the shuffle."""
    return steps.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.array(*[F.sum(F.col("counts")[k]) for k in range(cells)]).alias("counts"))


def percentile(counts: Column, bounds: list[float], q: float) -> Column:
    """Linear interpolation within the bucket that passes q; the lowest starts at the lesser of its bound and 0, the open one ends at its start."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    target = total * F.lit(q)
    lower = F.array(*[F.lit(float(x)) for x in [min(bounds[0], 0.0), *bounds]])
    upper = F.array(*[F.lit(float(x)) for x in [*bounds, bounds[-1]]])
    seen = F.transform(counts, lambda _, k: F.aggregate(F.slice(counts, 1, k + 1), F.lit(0).cast("long"), lambda s, x: s + x))
    at = F.array_position(F.transform(seen, lambda s: s >= target), F.lit(True)).cast("int") - 1
    before, here = F.get(seen, at) - F.get(counts, at), F.get(counts, at)
    part = F.coalesce(F.try_divide(target - before, here), F.lit(0.0))
    return F.when(total > 0, F.get(lower, at) + (F.get(upper, at) - F.get(lower, at)) * part)


def with_previous(points: DataFrame, keys: list[str], point: Column, block: int) -> DataFrame:
    """points with `previous`: that column at the point before in its series, null at the first; instants are distinct.

    A series is cut into blocks of time, which are read in order each on its own; what a block starts from is the last
    point of the block before, so only one row of each block meets in the order of a whole series.
    """
    at = step_of(F.col("recorded_at"), block)
    rows = points.withColumns({"__block": at, "__point": point})
    lasts = rows.groupBy(*keys, "__block").agg(F.max_by("__point", "recorded_at").alias("__last"))
    carried = lasts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__at"), F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block")).alias("__carried"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__block") == F.col("__at")]
    within_block = F.lag("__point").over(Window.partitionBy(*keys, "__block").orderBy("recorded_at"))
    joined = rows.withColumn("__before", within_block).join(carried, same)
    return joined.withColumn("previous", F.coalesce("__before", "__carried")).drop("__block", "__point", "__before", "__at", "__carried", *[f"__{k}" for k in keys])


def fold_histograms(points: DataFrame, keys: list[str], cumulative: bool, block: int = 3_600_000_000_000) -> DataFrame:
    """Explicit histograms of each series and step in order of time, where bounds may change: the newer bounds replace all.

    Points: recorded_at, step_at, bounds, counts, sum, low, high. Cumulative points add their increase, a fall or other
    bounds count whole; least and greatest survive only among delta points that all have them. As what a step holds is
    what came after its last change of bounds, a step is a sum over the points from that instant on: parts of it combine
    before the shuffle, and no series is gathered.
    """
    whole = with_previous(points, keys, F.struct("bounds", "counts", "sum"), block)
    before = F.col("previous")
    changed = before.isNull() | (before["bounds"] != F.col("bounds"))
    if cumulative:
        less = F.when(~changed, subtract_counts(F.col("counts"), before["counts"]))
        grown = {"counts": F.coalesce(less, F.col("counts")), "sum": F.when(less.isNotNull(), F.col("sum") - before["sum"]).otherwise(F.col("sum")), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}
        whole = whole.withColumn("__changed", changed).filter(before.isNotNull()).withColumns(grown)
    else:
        whole = whole.withColumn("__changed", changed)
    by = [*keys, "step_at"]
    since = whole.groupBy(*by).agg(F.max(F.when(F.col("__changed"), F.col("recorded_at"))).alias("__since"))
    kept = whole.join(since, by).filter(F.coalesce(F.col("recorded_at") >= F.col("__since"), F.lit(True)))
    all_have = lambda c, agg: F.when(F.count(c) == F.count(F.lit(1)), agg(c)).alias(c)
    told = kept.groupBy(*by).agg(F.max("bounds").alias("bounds"), F.sum("sum").alias("sum"), all_have("low", F.min), all_have("high", F.max))
    cells = kept.select(*by, F.posexplode("counts").alias("place", "n")).groupBy(*by, "place").agg(F.sum("n").alias("n"))
    counts = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda c: c["n"]).alias("counts"))
    return told.join(counts, by).select(*by, "bounds", "counts", "sum", "low", "high")


MOST_BUCKETS = 4_096  # buckets that the counts of one sign may span
SIGNS = ("positive", "negative")


def joined_buckets(buckets: Column, halvings: Column) -> Column:
    """Buckets (offset, counts) at a scale that is lower by `halvings`: of 2 ** halvings neighbours each the sum."""
    offset, counts = buckets["offset"], buckets["counts"]
    down = lambda x: F.call_function("shiftright", x, halvings)
    last = offset + F.size(counts) - 1
    per = F.call_function("shiftleft", F.lit(1), halvings)
    part = lambda j: F.slice(counts, F.greatest(j * per, offset) - offset + 1, F.least((j + 1) * per - 1, last) - F.greatest(j * per, offset) + 1)
    added = F.transform(F.sequence(down(offset), down(last)), lambda j: F.aggregate(part(j), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.when(F.size(counts) == 0, buckets).otherwise(F.struct(down(offset).alias("offset"), added.alias("counts")))


def subtract_buckets(newer: Column, older: Column) -> Column:
    """Bucket by bucket at one scale; null if any is negative or the buckets span too many."""
    start, end = F.least(newer["offset"], older["offset"]), F.greatest(newer["offset"] + F.size(newer["counts"]), older["offset"] + F.size(older["counts"])) - 1
    at = lambda b, j: F.coalesce(F.get(b["counts"], j - b["offset"]), F.lit(0).cast("long"))
    less = F.transform(F.sequence(start, end), lambda j: at(newer, j) - at(older, j))
    fits = (end - start < MOST_BUCKETS) & ~F.exists(less, lambda x: x < 0)
    return F.when(F.size(older["counts"]) == 0, newer).otherwise(F.when(F.size(newer["counts"]) > 0, F.when(fits, F.struct(start.alias("offset"), less.alias("counts")))).when(~F.exists(older["counts"], lambda x: x > 0), newer))


def fold_exponential(points: DataFrame, keys: list[str], cumulative: bool, block: int = 3_600_000_000_000) -> DataFrame:
    """Exponential histograms of each series and step as cells: keys, step_at, scale, sign, index, n; index 0 of `zero` counts zeros.

    Points: recorded_at, step_at, scale, zeros, positive and negative (offset, counts). Cumulative points add what they
    have more than the point before, both at the lesser scale; where any bucket fell, they count whole. A step's points
    are added at the least scale among them; cells are summed, so no series and no step is gathered. Points of which one
    sign spans more than 4,096 buckets are left out.
    """
    fits = (F.size("positive.counts") <= MOST_BUCKETS) & (F.size("negative.counts") <= MOST_BUCKETS)
    rows = points.filter(fits)
    if cumulative:
        rows = with_previous(rows, keys, F.struct("scale", "zeros", *SIGNS), block).filter("previous IS NOT NULL")
        before = F.col("previous")
        scale = F.least(F.col("scale"), before["scale"])
        less = {s: subtract_buckets(joined_buckets(F.col(s), F.col("scale") - scale), joined_buckets(before[s], before["scale"] - scale)) for s in SIGNS}
        rows = rows.withColumns({f"__{s}": c for s, c in less.items()} | {"__zeros": F.col("zeros") - before["zeros"], "__scale": scale})
        good = (F.col("__zeros") >= 0) & F.col("__positive").isNotNull() & F.col("__negative").isNotNull()
        rows = rows.withColumns({c: F.when(good, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("zeros", "scale", *SIGNS)})
    one = lambda s: F.transform(F.col(f"{s}.counts"), lambda n, k: F.struct(F.lit(s).alias("sign"), (F.col(f"{s}.offset") + k).alias("index"), n.alias("n")))
    zero = F.array(F.struct(F.lit("zero").alias("sign"), F.lit(0).alias("index"), F.col("zeros").cast("long").alias("n")))
    by = [*keys, "step_at"]
    cells = rows.select(*by, "scale", F.explode(F.filter(F.concat(one("positive"), one("negative"), zero), lambda c: c["n"] > 0)).alias("c")).select(*by, "scale", "c.*")
    cells = cells.groupBy(*by, "scale", "sign", "index").agg(F.sum("n").alias("n"))
    least = rows.groupBy(*by).agg(F.min("scale").alias("__least"))
    index = F.call_function("shiftright", F.col("index"), F.col("scale") - F.col("__least"))
    return cells.join(least, by).groupBy(*by, F.col("__least").alias("scale"), "sign", index.alias("index")).agg(F.sum("n").alias("n"))


def exponential_index(value: Column, scale: int) -> Column:
    """Bucket index of a positive value at a scale: the smallest i with value <= 2 ** ((i + 1) / 2 ** scale).

    The logarithm may be off by its last bit at a border, so its neighbours' borders are looked at.
    """
    upper = lambda i: F.pow(F.lit(2.0), (i + 1) / float(2**scale))
    near = F.ceil(F.log2(value) * (2**scale)) - 1
    return F.when(value <= upper(near - 1), near - 1).when(value > upper(near), near + 1).otherwise(near).cast("int")


def to_least_scale(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Exponential buckets (scale, index, n) of several scales added at the least scale of their group."""
    least = cells.groupBy(*keys).agg(F.min("scale").alias("__scale"))
    joined = cells.join(least, keys)
    index = F.floor(F.col("index") / F.pow(F.lit(2.0), F.col("scale") - F.col("__scale"))).cast("int")
    return joined.groupBy(*keys, F.col("__scale").alias("scale"), index.alias("index")).agg(F.sum("n").alias("n"))


def subtract_counts(newer: Column, older: Column) -> Column:
    """Bucket by bucket; null if any is negative (a restart) or the arrays differ in length."""
    less = F.zip_with(newer, older, lambda a, b: a - b)
    return F.when((F.size(newer) == F.size(older)) & ~F.exists(less, lambda x: x < 0), less)


def explicit_bounds(offset: Column, counts: Column, scale: Column, most: int = 64) -> Column:
    """Exponential buckets as (bounds, counts) of explicit ones: neighbours are joined until there are at most `most`."""
    last = offset + F.size(counts) - 1
    width = lambda k: F.shiftright(last, k) - F.shiftright(offset, k) + 1
    halvings = F.lit(31)
    for k in range(30, -1, -1):
        halvings = F.when(width(k) <= most, k).otherwise(halvings)
    first, per = F.floor(offset / F.pow(F.lit(2.0), halvings)).cast("int"), F.pow(F.lit(2.0), halvings)
    cells = (F.floor(last / per).cast("int")) - first
    places = F.sequence(F.lit(0), F.greatest(cells, F.lit(0)))
    joined = F.transform(places, lambda j: F.aggregate(F.transform(counts, lambda c, i: F.when(F.floor((offset + i) / per) == first + j, c).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x))
    bounds = F.transform(places, lambda j: F.pow(F.lit(2.0), (first + j + 1) * per / F.pow(F.lit(2.0), scale)))
    empty = F.size(counts) == 0
    return F.struct(F.when(empty, F.array().cast("array<double>")).otherwise(bounds).alias("bounds"), F.when(empty, F.array().cast("array<long>")).otherwise(joined).alias("counts"))


def lower_scale(cells: DataFrame, keys: list[str], halvings: int) -> DataFrame:
    """Join exponential buckets (index, n) to a scale that is lower by `halvings`."""
    return cells.groupBy(*keys, F.shiftright("index", halvings).alias("index")).agg(F.sum("n").alias("n"))
