"""Exact n-gram Jaccard self-join by signature trees.

1. Every text becomes the set of its distinct word shingles, a bitmap of them and their number. Equal sets are one class.
2. Two sets that are linked share a token among the first n - ceil(need * n / 100) + 1 of each, in any order of tokens
   that all sets follow. The order here puts frequent tokens last. Tasks deal (token, set) entries to buckets, packed
   in arrays; a bucket gives the lists of sets that share a token, each distinct list once.
3. A signature tree over each list's bitmaps is joined with itself by dual traversal. What the bounds leave are edges,
   and the components of the edges are families. No link crosses families.
4. The texts of a family are brought together, many small families to a task, large families as pairs of blocks. There
   a signature tree over each block's full sets is joined with another, or with itself, and what the bounds leave is
   compared exactly, unless it is in one class already.
5. Components of the links, over classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, text_of
from .graph import components, forest
from .shingles import digest, mix, shingle_sets
from .signature_tree import bitmap, link, may_link, width_for

#: Tokens gathered before a task counts or deals them.
CHUNK = 1 << 21
#: A token is counted where so many sets of a chunk have it.
LOCAL = 16
#: Most tokens that the order puts last; an order that misses some is as exact.
FREQUENT = 1_000_000
BATCH = 256


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH):
            yield batch.slice(k, BATCH)


def _describe(width: int, schema: pa.Schema):
    """A row for each text, and one for each token that many texts of a chunk have (with `token` set, d1 the token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n >= LOCAL].astype(np.int64), n[n >= LOCAL]
            held.clear()
            none = pa.nulls(len(n), schema.field("id").type)
            return pa.RecordBatch.from_arrays([none, pa.array(np.zeros(len(n), np.int64)), pa.array(n), pa.array(token), pa.array(token), pa.nulls(len(n), pa.binary()), pa.array(np.ones(len(n), bool))], schema=schema)

        for part in _texts(batches):
            sets = shingle_sets(part["body"].to_pylist(), width)
            d1, d2 = zip(*map(digest, sets), strict=True)
            yield pa.RecordBatch.from_arrays([part["id"], part["rid"], pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([bitmap(s, width_for(len(s))).tobytes() for s in sets], pa.binary()), pa.array([False] * len(sets))], schema=schema)
            held += sets
            if sum(map(len, held)) >= CHUNK:
                yield counted()
        if held:
            yield counted()

    return run


def _deal(width: int, need: int, buckets: int, split: int, frequent, counts):
    """Entries of each set's first tokens, as arrays by bucket: tokens (32 bits that the bucket doesn't tell) and sets.

    Sets of a token of more than `split` sets are parted, and an entry goes to every pair of parts that has its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = frequent.value, counts.value
        tokens: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()

        def dealt() -> pa.RecordBatch:
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            tokens.clear(), owners.clear(), seen.clear()
            home = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[order], np.arange(buckets + 1))
            low, owner = (token >> np.uint64(32)).astype(np.uint32)[order], owner[order]
            rows = [(k, low[x:y].tobytes(), owner[x:y].tobytes()) for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x]
            fields = (pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], ["bucket", "x", "y"])

        size = 0
        for part in _texts(batches):
            for s in shingle_sets(part["body"].to_pylist(), width):
                d = digest(s)
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                k = len(s) - -(-need * len(s) // 100) + 1
                weight = np.zeros(0, np.int64)
                if len(often):
                    at = np.searchsorted(often, s)
                    at[at == len(often)] = 0
                    weight = np.where(often[at] == s, rank[at], 0)
                if weight.any():
                    first = np.lexsort((s, weight))[:k]
                    s, weight = s[first], weight[first]
                    hot = weight > split
                    for token, n in zip(s[hot], weight[hot].tolist(), strict=True):
                        parts = n // split + 1
                        own = d[0] % parts
                        pairs = np.array([min(own, c) * parts + max(own, c) for c in range(parts)], np.uint64)
                        tokens.append(mix(token + pairs * np.uint64(0x9E3779B97F4A7C15)))
                        owners.append(np.full(parts, d[0], np.int64))
                        size += parts
                    s = s[~hot]
                else:
                    s = s[:k]
                tokens.append(s)
                owners.append(np.full(len(s), d[0], np.int64))
                size += len(s)
            if size >= CHUNK:
                yield dealt()
                size = 0
        if size:
            yield dealt()

    return run


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """The lists of two or more sets that share a token of this bucket, each distinct list once."""
    token = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["x"]])
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in rows["y"]])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))  # a set may come from two tasks
    token, owner = token[fresh], owner[fresh]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    length = np.diff(np.append(start, len(token)))
    name = np.add.reduceat(mix(owner.astype(np.uint64)), start)  # the list's name: a sum over its sets
    name = mix(name + length.astype(np.uint64)).astype(np.int64)
    _, one = np.unique(name, return_index=True)
    one = one[length[one] > 1]
    take = np.repeat(start[one], length[one]) + np.arange(length[one].sum()) - np.repeat(np.cumsum(length[one]) - length[one], length[one])
    return pd.DataFrame({"list": np.repeat(name[one], length[one]), "d1": owner[take]})


def _sift(need: int):
    """Edges between the sets of a list whose bitmaps leave room for a link."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["list", "node"]).drop_duplicates(["list", "node"])
        name, node, size = rows["list"].to_numpy(), rows["node"].to_numpy(), rows["n"].to_numpy()
        maps = [np.frombuffer(x, np.uint64) for x in rows["bits"]]
        start = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        a, b = [], []
        for x, y in zip(start.tolist(), np.append(start[1:], len(name)).tolist(), strict=True):
            if y - x > 1 and 100 * size[x:y].max() >= need * size[x:y].min():
                label = may_link(maps[x:y], size[x:y], need)
                moved = label != np.arange(y - x)
                a.append(node[x:y][moved])
                b.append(node[x:y][label[moved]])
        x, y = forest(np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])
        return pd.DataFrame({"a": x, "b": y})

    return run


def _join(width: int, need: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, family in rows.groupby("fam", sort=False):
            sets = shingle_sets(family["body"].tolist(), width)
            node, block = family["node"].to_numpy(), family["block"].to_numpy()
            # One row of each class, and none of a text that another row only shares its key with.
            own = {int(n): k for k, (n, d, s) in enumerate(zip(node, family["d1"], sets, strict=True)) if digest(s)[0] == d}
            at = np.array(sorted(own.values()), np.int64)
            if len(at) < 2:
                continue
            sets, node, block = [sets[k] for k in at], node[at], block[at]
            one = family["i"].iloc[0] == family["j"].iloc[0]
            label = link(sets, need, None if one else block == family["j"].iloc[0])
            moved = label != np.arange(len(label))
            out.append(pd.DataFrame({"a": node[moved], "b": node[label[moved]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype=np.int64), "b": pd.Series(dtype=np.int64)})

    return run


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, need: int = 75, task_shingles: int = 2_000_000) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id that links reach, its own included), text_key
    (a hash of the text) and stays (whether id and text are those of the component's first document).

    Words are runs of anything but ASCII white space, A-Z lowered; a set holds a text's distinct shingles of `width`
    words, or its whole sequence if it has fewer. Texts are linked when 100 * intersection >= need * union. A null,
    empty or blank text has an empty set and is linked with nothing. Rows with equal sets are linked; a row with a null
    id counts as a text like others; null comes after all ids, and the component of null ids alone is null. Ids may repeat. Other columns are not
    read, whatever their names. No rows give no rows. Whole texts are used, whatever their length.

    Memory: a bucket holds about task_shingles entries and a list at most about task_shingles / 4 sets, as the sets of a
    more frequent token are parted; a joining task gets about task_shingles shingles, or two blocks of a larger family.
    Broadcast: at most FREQUENT tokens.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("rid"), text_of(text_col).alias("body"))
    fields = plain.select("id", "rid", F.lit(0).cast("long").alias("n"), F.col("rid").alias("d1"), F.col("rid").alias("d2"), F.lit(b"").alias("bits"), F.lit(True).alias("token")).schema
    for f in fields:
        f.nullable = True
    described = cut(plain.mapInArrow(_describe(width, to_arrow_schema(fields)), fields), "sets")
    sets = described.filter("not token")
    # A class of equal sets. Its node is a row number of this written table; low and rid tell one of its rows.
    classes = cut(
        sets.filter("n > 0").groupBy("d1", "d2").agg(F.max("n").alias("n"), F.first("bits").alias("bits"), F.min("id").alias("low"), F.coalesce(F.min_by("rid", "id"), F.min("rid")).alias("rid")).select("*", F.monotonically_increasing_id().alias("node")),
        "classes",
    )
    total = classes.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    least = max(4 * LOCAL, total["sets"] // 2_000)
    often = described.filter("token").groupBy("d1").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).limit(FREQUENT).toPandas().sort_values("d1")
    token = often["d1"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(token)
    frequent, counts = spark.sparkContext.broadcast(token[order]), spark.sparkContext.broadcast(often["n"].to_numpy(np.int64)[order])

    buckets = max(1, -(-int(total["n"]) * (100 - need) // 100 // task_shingles), int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = plain.select("body").mapInArrow(_deal(width, need, buckets, max(1, task_shingles // 8), frequent, counts), "bucket int, x binary, y binary")
    met = entries.groupBy("bucket").applyInPandas(_meet, "list long, d1 long")
    lists = cut(met.dropDuplicates(["list", "d1"]), "lists")
    tasks = max(1, -(-lists.count() // max(1, task_shingles // 32)))
    # Merge joins at every size: what a small table would broadcast grows with the corpus.
    sifted = lists.join(classes.select("d1", "node", "n", "bits").hint("merge"), "d1").withColumn("task", F.pmod(F.xxhash64("list"), F.lit(tasks)).cast("int"))
    edges = sifted.select("task", "list", "node", "n", "bits").groupBy("task").applyInPandas(_sift(need), "a long, b long")
    family = components(edges)

    fam = family.unionByName(family.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "fam")
    members = cut(classes.join(fam, "node").select("node", "d1", "low", "rid", "n", "fam"), "members")
    sizes = members.groupBy("fam").agg(F.sum("n").alias("all"))
    small = max(1, -(-int(members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // task_shingles))
    blocks = F.ceil(F.col("all") / (task_shingles // 2)).cast("int")
    placed = members.join(sizes, "fam").withColumn("blocks", F.when(F.col("all") > task_shingles, blocks).otherwise(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    with_text = plain.join(placed.drop("n", "all").withColumnRenamed("rid", "rid_").hint("merge"), (F.col("rid") == F.col("rid_")) & F.col("id").eqNullSafe(F.col("low")))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("fam"), F.lit(small))).otherwise(F.col("fam"))
    dealt = with_text.withColumn("p", pair).select("fam", "node", "d1", "block", "body", "blocks", "p.i", "p.j").withColumn("task", task)
    links = dealt.groupBy("task", F.col("blocks").alias("of"), "i", "j").applyInPandas(_join(width, need), "a long, b long")

    roots = components(links)
    own = classes.join(roots, "node", "left").select("d1", "d2", "low", "rid", F.coalesce("root", "node").alias("root"))
    lowest = own.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "rid")).alias("top"))
    found = own.join(lowest, "root").select("d1", "d2", "top", F.lit(True).alias("known"))
    same = F.col("id").eqNullSafe(F.col("top.low")) & (F.col("rid") == F.col("top.rid"))
    return sets.join(found, ["d1", "d2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("top.low")).otherwise(F.col("id")).alias("component_id"),
        F.col("rid").alias("text_key"), F.when(F.col("known"), same).otherwise(True).alias("stays"),
    )
