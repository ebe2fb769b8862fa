"""Connected components of a table of edges, and of arrays of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges in arrays: every node that isn't the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of the component, for every node that isn't its own root. edges: a, b, both long.

    Alternating large stars and small stars, each an aggregate that is combined before its shuffle and an equi-join that
    adaptive execution can split at a hot node. Each round is written to the shared folder. Loops and repeats do no
    harm; no edges give no rows.
    """

    def seal(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = cut(e, "edges")
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**31 - 1)))).first())

    e, mark = seal(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m"))))
        small = large.join(low, "a").select(pairs.alias("p")).select("p.a", F.col("p.m").alias("b")).filter("a <> b").distinct()
        e, now = seal(small)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
