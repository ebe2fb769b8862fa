"""Mixing overlapping sources to target weights by min-cost flow, then choosing documents by seed.

Documents are aggregated by membership pattern, the set of sources that they belong to. A flow network leads from each
pattern, through arcs for its first, second and third use that cost more each time (a convex cost of repetition), to
the sources of the pattern and on to the sources' quotas. The cheapest maximal flow says how many words of each pattern
are used. Within a pattern, all documents are used as often as they all fit, and once more those that fit in the order of
a seeded hash, up to the pattern's words: a document that doesn't fit is passed over, until none is left that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Hash ranges within a pattern; the choice is exact within the one range that the quota cuts.
RANGES = 1024
#: A pattern whose room shrank by less than this share in a pass goes on with its largest documents, which at least halve it.
STALLED = 1 / 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above most times its size; the excess goes to the others by weight."""
    total, full = float(sum(sizes)), set()
    while True:
        left = total - sum(most * sizes[k] for k in full)
        open_weight = sum(w for k, w in enumerate(weights) if k not in full)
        share = [most * sizes[k] if k in full else left * w / open_weight for k, w in enumerate(weights)]
        over = {k for k in range(len(sizes)) if k not in full and share[k] > most * sizes[k]}
        if not over:
            return share
        full |= over


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], uses: int) -> list[list[int]]:
    """Words of each pattern for each of its sources: cheapest among the largest flows, by successive cheapest paths.

    The k-th use of a word costs k * k. Patterns and sources are aggregates, so the network is small.
    """
    patterns, sources = len(supply), len(quota)
    # Arcs [to, capacity, cost, back]; node 0 feeds, 1.. are patterns, then sources, then the sink.
    graph: list[list[list]] = [[] for _ in range(patterns + sources + 2)]
    sink = patterns + sources + 1

    def arc(u: int, v: int, capacity: int, cost: int) -> list:
        forth, back = [v, capacity, cost, None], [u, 0, -cost, None]
        forth[3], back[3] = back, forth
        graph[u].append(forth)
        graph[v].append(back)
        return forth

    routed = []
    for p, size in enumerate(supply):
        for k in range(uses):
            arc(0, 1 + p, size, k * k)
        routed.append([arc(1 + p, 1 + patterns + s, uses * size, 0) for s in members[p]])
    for s, q in enumerate(quota):
        arc(1 + patterns + s, sink, q, 0)
    while True:
        cost, into, queue = {0: 0}, {}, [0]
        while queue:
            ahead = []
            for u in queue:
                for a in graph[u]:
                    if a[1] > 0 and cost[u] + a[2] < cost.get(a[0], 1 << 60):
                        cost[a[0]], into[a[0]] = cost[u] + a[2], (u, a)
                        ahead.append(a[0])
            queue = list(dict.fromkeys(ahead))
        if sink not in cost:
            return [[a[3][1] for a in arcs] for arcs in routed]
        path, v = [], sink
        while v:
            u, a = into[v]
            path.append(a)
            v = u
        push = min(a[1] for a in path)
        for a in path:
            a[1] -= push
            a[3][1] += push


def mix_sources(docs: DataFrame, members: Column, weights=None, id_col: str = "doc_id", text_col: str = "text", most_uses: int = 3, seed: int = 7) -> DataFrame:
    """One row per input row: id, key (hash of its text), members, size, source_size, target, taken (words, repeats counted).

    `members` is an array of source names (null is a source of its own; a null or empty array counts as [null]). Size is
    the number of words, 0 for null or empty text. source_size and target are sums over the row's sources. weights maps
    the sources, by code point and null last, to numbers; by default 1, 2, 3, repeating. Targets share all words by
    weight, none above most_uses times its source's size. A document is used whole, at most most_uses times, so a pattern
    gives nearly its flow: passes over the documents by hash go on until none fits in what lacks, and one more is added if
    that comes nearer. The choice depends on the seed, the id and the text, and not on partitions; rows that repeat both
    are chosen in any order. Other columns are not read. No rows give no rows.

    The driver gets a few rows for each pattern and pass, and broadcasts as many; the rows of a range are ordered only where
    a quota cuts it, so a source of a third of all rows is RANGES small groups. Each pass reads only what may still fit.
    """
    spark = docs.sparkSession
    given = F.array_sort(F.array_distinct(F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string")))))
    base = docs.select(F.col(id_col).alias("id"), given.alias("members"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), words(F.col(text_col)).alias("size"))
    rank = F.xxhash64(F.lit(seed), "id", "key")
    sized = cut(base.withColumns({"rank": rank, "range": F.pmod(rank, F.lit(RANGES)), "row": F.monotonically_increasing_id()}), "sized")
    patterns = [(tuple(r["members"]), r["size"]) for r in sized.groupBy("members").agg(F.sum("size").alias("size")).collect()]
    names = sorted({s for m, _ in patterns for s in m}, key=lambda s: (s is None, s or ""))
    if not names:
        return sized.select(F.col("id").alias(id_col), "key", "members", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
    number = {s: k for k, s in enumerate(names)}
    sizes = [0] * len(names)
    for m, n in patterns:
        for s in m:
            sizes[number[s]] += n
    total = sum(n for _, n in patterns)
    share = capped_shares(sizes, [k % 3 + 1 for k in range(len(names))] if weights is None else list(weights), most_uses) if total else [0.0] * len(names)
    # Sources that overlap count shared words each; the targets then share the words that there are.
    target = [x * total / sum(sizes) for x in share] if total and sum(sizes) != total else share
    flow = min_cost_flow([n for _, n in patterns], [[number[s] for s in m] for m, _ in patterns], [round(x) for x in target], most_uses)
    plan = spark.createDataFrame(
        [(list(m), float(sum(target[number[s]] for s in m)), sum(sizes[number[s]] for s in m), sum(f) // n if n else 0, sum(f) % n if n else 0) for (m, n), f in zip(patterns, flow, strict=True)],
        "members array<string>, target double, source_size long, passes long, rest long",
    )
    rows = sized.join(F.broadcast(plan.select("members", "target", "source_size", "passes")), "members")
    lacking = {tuple(r["members"]): r["rest"] for r in plan.select("members", "rest").collect()}
    fields, narrow = "members array<string>, room long, stalled boolean", ["members", "size", "rank", "id", "key", "row", "range"]
    free, slow, added = sized.filter("size > 0").select(*narrow), set(), []
    while any(n > 0 for n in lacking.values()):
        gaps = F.broadcast(spark.createDataFrame([(list(m), n, m in slow) for m, n in lacking.items() if n > 0], fields))
        seen = cut(_pass(free.join(gaps, "members").filter("size <= room")).select(*narrow, "more"), "pass")
        used = {tuple(r["members"]): r["used"] for r in seen.filter("more = 1").groupBy("members").agg(F.sum("size").alias("used")).collect()}
        if not used:
            break
        added.append(seen.filter("more = 1").select("row"))
        slow |= {m for m, n in used.items() if n < STALLED * lacking[m]}
        lacking = {m: lacking[m] - n for m, n in used.items()} | {m: n for m, n in lacking.items() if m not in used}
        free = seen.filter("more = 0").select(*narrow)
    # Nothing fits any more: the smallest document that is left, if the quota is missed by less with it.
    chosen = added[0] if added else sized.select("row").limit(0)
    for x in added[1:]:
        chosen = chosen.unionByName(x)
    taken = cut(rows.join(chosen.withColumn("more", F.lit(1)), "row", "left").fillna(0, ["more"]).drop("range"), "taken")
    gaps = F.broadcast(spark.createDataFrame([(list(m), n, False) for m, n in lacking.items() if n > 0], fields))
    left = taken.filter(f"more = 0 and passes < {most_uses} and size > 0").join(gaps, "members").filter("size < 2 * room")
    last = left.groupBy("members").agg(F.min(F.struct("size", "rank", "id", "key", "row")).alias("top")).select(F.col("top.row").alias("row"), F.lit(1).alias("last"))
    final = taken.join(F.broadcast(last), "row", "left")
    uses = F.least(F.lit(most_uses), F.col("passes") + F.greatest("more", F.coalesce("last", F.lit(0))))
    return final.select(F.col("id").alias(id_col), "key", "members", "size", "source_size", "target", (uses * F.col("size")).alias("taken"))


def _pass(placed: DataFrame) -> DataFrame:
    """The rows with `more`: 1 for those that fit in their pattern's room before the first that doesn't, else 0."""
    placed = placed.withColumn("range", F.when(F.col("stalled"), -F.col("size")).otherwise(F.col("range")))
    before = Window.partitionBy("members").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("members", "range").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    placed = placed.join(cut(ranges, "ranges"), ["members", "range"])
    room = F.col("room") - F.col("before")
    whole = room >= F.col("words")
    inner = Window.partitionBy("members", "range").orderBy("rank", "id", "key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossed = placed.filter(~whole & (room > 0)).withColumn("more", (F.sum("size").over(inner) <= room).cast("int"))
    return placed.filter(whole | (room <= 0)).withColumn("more", whole.cast("int")).unionByName(crossed)
