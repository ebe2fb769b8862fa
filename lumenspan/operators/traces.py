"""Trace trees of any size: parents are followed and rows counted by pointer jumping, a join for each doubling of the way."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame) -> DataFrame:
    """A table that cuts the lineage between rounds, in the shared folder; what was shuffled for it is let go."""
    spark, path = df.sparkSession, stored.shared(df.sparkSession, "jumps")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _gone(*tables: DataFrame) -> None:
    """Removes tables of `_written` that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            stored.remove(table.sparkSession, unquote(folder))


def _named(spans: DataFrame) -> DataFrame:
    """Spans that name a parent, with `up`: the number of the parent, the first of its ID; null where there is none or it is the span itself.

    `rank` is the place among those of the same parent. `on`: whether the parent names one, too.
    """
    first = spans.groupBy(F.col("trace_id").alias("__trace"), F.col("span_id").alias("__span")).agg(F.min(F.struct("started_at", "row_id", "id", F.col("parent_span_id").isNotNull().alias("on"))).alias("__first"))
    joined = spans.filter("parent_span_id IS NOT NULL").join(first, (F.col("trace_id") == F.col("__trace")) & (F.col("parent_span_id") == F.col("__span")), "left")
    up = F.col("__first.id")
    told = joined.withColumns({"up": F.when(up != F.col("id"), up), "on": F.coalesce("__first.on", F.lit(False))})
    siblings = Window.partitionBy("trace_id", "parent_span_id", F.col("up").isNull()).orderBy("started_at", "row_id")
    return told.select("trace_id", "span_id", "started_at", "row_id", "id", "up", F.row_number().over(siblings).alias("rank"), "on", F.col("up").alias("named"))


def _roots(spans: DataFrame, named: DataFrame) -> DataFrame:
    """Roots, `rank` among those of the trace, and `start` of the trace; `up` is a number below 0 that stands for the trace.

    Spans whose parent is missing come with those that name none, the first spans of cycles after these.
    """
    roots = spans.filter("parent_span_id IS NULL").withColumn("named", F.lit(None).cast("long")).unionByName(named.filter("up IS NULL"), allowMissingColumns=True)
    traces = spans.groupBy(F.col("trace_id").alias("__trace")).agg(F.min("started_at").alias("start"), (-1 - F.min("id")).alias("__up"))
    order = Window.partitionBy("trace_id").orderBy(F.col("named").isNotNull(), "started_at", "row_id")
    found = roots.join(traces, F.col("trace_id") == F.col("__trace"))
    return found.select("trace_id", "span_id", "started_at", "id", F.col("__up").alias("up"), F.row_number().over(order).alias("rank"), "start")


def _inner(roots: DataFrame, named: DataFrame) -> DataFrame:
    """The rows that others name, with `children`, the number of these, and `below`, that of those that hang below them."""
    counts = named.filter("named IS NOT NULL").groupBy(F.col("named").alias("__id")).agg(F.count(F.lit(1)).alias("children"), F.count("up").alias("below"))
    rows = named.filter("up IS NOT NULL").select("id", "up", "rank", "on").unionByName(roots.select("id", "up", "rank", "start"), allowMissingColumns=True)
    return rows.join(counts, F.col("id") == F.col("__id")).drop("__id").withColumn("deep", F.lit(False))


def _jumps(inner: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """id, at: the inner rows whose way up has 1, 2, 4 and so on steps, with where these lead; then those whose way never ends.

    Rows whose way has ended are in no later table, so what is joined shrinks. If none ended in a round, none of those left
    will: of a way that ends, some row has fewer steps than the round asks for.
    """
    first = inner.filter("up >= 0")
    now, going = first.select("id", F.col("up").alias("at")), first.filter("on").select("id", F.col("up").alias("at"))
    found, before, left = [now], now.count(), going.count()
    while left:
        there = now.select(F.col("id").alias("__id"), F.col("at").alias("__at"))
        now = going = _written(going.join(there, F.col("at") == F.col("__id")).select("id", F.col("__at").alias("at")))
        left = now.count()
        if left == before:
            return found, now
        found.append(now)
        before = left
    return found, None


def _without_cycles(named: DataFrame, endless: DataFrame) -> DataFrame:
    """`named` with `up` null for each row that is a root only since it is the first of a cycle, or above none before it.

    Of rows whose way up never ends, those with no earlier row on their way are roots; the others hang below them.
    """
    rows = named.join(endless.select(F.col("id").alias("__id")), F.col("up") == F.col("__id"), "left_semi")
    now = _written(rows.select("id", F.col("up").alias("at"), F.struct("started_at", "row_id", "id").alias("low"), F.lit(True).alias("fell")))
    while not now.filter("fell").isEmpty():
        there, last = now.select(F.col("id").alias("__id"), F.col("at").alias("__at"), F.col("low").alias("__low")), now
        low = F.least("low", "__low")
        now = _written(now.join(there, F.col("at") == F.col("__id")).select("id", F.col("__at").alias("at"), low.alias("low"), (low < F.col("low")).alias("fell")))
        _gone(last)
    late = now.filter("low.id = id").select(F.col("id").alias("__late"))
    left = named.join(late, F.col("id") == F.col("__late"), "left_semi").select(F.col("named").alias("__named"))  # rows below which one is gone
    told = named.join(left, F.col("named") == F.col("__named"), "left_semi").join(late, F.col("id") == F.col("__late"), "left").withColumn("up", F.when(F.col("__late").isNull(), F.col("up")))
    siblings = Window.partitionBy("named", F.col("up").isNull()).orderBy("rank")
    told = told.withColumn("rank", F.row_number().over(siblings)).drop("__late")
    found = _written(named.join(left, F.col("named") == F.col("__named"), "left_anti").unionByName(told))
    _gone(now)
    return found


def _below(jumps: list[DataFrame], inner: DataFrame) -> DataFrame:
    """`inner` with all rows below each row; `deep` tells whether others than its own children are.

    What was counted below a row until then is counted 1, 2, 4 and so on steps above it, too.
    """
    found = inner.drop("on")
    for k, now in enumerate(jumps):
        counted = found.select("id", F.col("up").alias("at"), "below").filter("at >= 0") if k == 0 else now.join(found.select(F.col("id").alias("__id"), "below"), F.col("id") == F.col("__id"))
        above = counted.select(F.col("at").alias("id"), "below", F.lit(True).alias("deep"))
        kept = [F.max(c).alias(c) for c in ("up", "rank", "start", "children", "deep")]
        last, found = found, _written(found.unionByName(above, allowMissingColumns=True).groupBy("id").agg(F.sum("below").alias("below"), *kept))
        _gone(last)
    return found


def _tops(inner: DataFrame) -> DataFrame:
    """id, place, depth and start of the inner rows: sums along the way up, over twice as many steps in each round."""
    siblings = Window.partitionBy("up").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    child = (F.col("up") >= 0).cast("long")
    place = F.col("rank") - 1 + F.coalesce(F.sum("below").over(siblings), F.lit(0)) + child
    now = inner.select("id", F.when(child == 1, F.col("up")).alias("at"), place.alias("place"), child.alias("depth"), "start", "deep")
    done = []
    while True:
        now = _written(now)
        done.append(now.filter("at IS NULL").drop("at"))
        left = now.filter("at IS NOT NULL")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done).drop("deep")
        there = left.unionByName(reduce(DataFrame.unionByName, done), allowMissingColumns=True).filter("deep")
        there = there.select(*[F.col(c).alias(f"__{c}") for c in ("id", "at", "place", "depth", "start")])
        now = left.join(there, F.col("at") == F.col("__id")).select("id", F.col("__at").alias("at"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in ("place", "depth")], F.col("__start").alias("start"), "deep")


def large_trace_trees(spans: DataFrame) -> DataFrame:
    """Rows of each trace's tree in depth-first order: place, depth, children, offset; see `spans.trace_trees`.

    A row's place is that of its parent, one more, and the rows below its earlier siblings and these. Every step is a join,
    an aggregate or a window on a span's ID or on the number that each row gets, so a trace is spread over all tasks. Only
    rows that others hang below are in the rounds, whose number grows with the logarithm of the deepest way; what the
    others need is found with their siblings. Texts are shuffled thrice, and what was shuffled or written for a step goes
    with it. Row IDs are distinct within a trace.
    """
    rows = _written(spans.select("trace_id", "row_id", "span_id", "parent_span_id", "started_at", F.monotonically_increasing_id().alias("id")))
    named = _written(_named(rows))
    roots = _written(_roots(rows, named))
    inner = _written(_inner(roots, named))
    jumps, endless = _jumps(inner)
    if endless is not None:
        last = [named, roots, inner, endless, *jumps[1:]]
        named = _without_cycles(named, endless)
        roots = _written(_roots(rows, named))
        inner = _written(_inner(roots, named))
        _gone(*last)
        jumps, _ = _jumps(inner)
    _gone(rows)
    inner = _below(jumps, inner)
    _gone(*jumps[1:])
    above = _tops(inner).select(F.col("id").alias("up"), F.lit(0).alias("rank"), "place", "depth", "start")
    texts = ["up", "rank", "trace_id", "span_id", "started_at"]
    told = named.filter("up IS NOT NULL").select(texts).unionByName(roots.select(*texts, "start"), allowMissingColumns=True).withColumn("span", F.lit(True))
    for more in (inner.select("up", "rank", "children", "below"), above):
        told = told.unionByName(more, allowMissingColumns=True)
    siblings = Window.partitionBy("up").orderBy("rank")
    parent = lambda c: F.max(c).over(siblings.rangeBetween(Window.unboundedPreceding, 0))
    own = F.max("children").over(siblings.rangeBetween(0, 0))
    before = F.coalesce(F.sum("below").over(siblings.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = told.select("span", "trace_id", "span_id", "started_at", "rank", own.alias("children"), before.alias("before"), *[parent(c).alias(c) for c in ("place", "depth", "start")]).filter("span")
    place, depth = F.coalesce(F.col("place") + 1, F.lit(0)) + F.col("rank") - 1 + F.col("before"), F.coalesce(F.col("depth") + 1, F.lit(0))
    return found.select("trace_id", "span_id", place.cast("int").alias("place"), depth.cast("int").alias("depth"), F.coalesce("children", F.lit(0)).cast("int").alias("children"), (F.col("started_at") - F.col("start")).alias("offset_ns"))
