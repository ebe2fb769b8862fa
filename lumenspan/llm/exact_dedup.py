"""Exact duplicates by distributed most-significant-digit radix partitioning.

A digit is a block of successive bytes. Round by round, the documents of each open group are split by their next block;
a group of one is settled as unique, a group whose texts have ended is settled as copies, the others go on with what
is left of their texts. Two texts share a group exactly while all their bytes so far agree, so no digest decides
anything. Blocks grow by a constant factor, so the number of rounds is logarithmic in the longest shared prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of


HOT, SALTS = 1000, 64


def _join_counts(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with what groups (a written table) says of their keys, or nulls: by the same sort-merge join at every size."""
    groups = groups.hint("merge")
    hot = [r[0] for r in groups.filter(F.col("n") > max(SALTS, total / HOT)).select(F.xxhash64(*keys)).collect()]
    if not hot:
        return rows.join(groups, keys, "left")
    is_hot = F.xxhash64(*keys).isin(hot)
    salted = groups.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).otherwise(0)).join(salted.hint("merge"), [*keys, "salt"], "left").drop("salt")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_block: int = 32, growth: int = 4) -> DataFrame:
    """One row per input row: id, keep_id (largest id among the equal texts), group_size, kept, text_sha256.

    A null text counts as empty, so null and empty texts are one group. A null id is below every other id. Of rows that
    repeat id and text, one is kept. Other columns are not read, whatever their names. An empty table gives no rows.
    The counts of a group are combined before they are shuffled. In the equi-joins that bring them back to the rows, the
    rows of a hot group (over 1 / HOT of all) are dealt to SALTS parts and its counts are repeated for each of them. There
    are fewer than HOT such groups, so the driver gets at most so many hashes; they only deal rows, and the keys decide.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("body"))
    base = base.withColumns({"head": F.substring("body", 1, first_block), "rid": F.monotonically_increasing_id()})
    shared = cut(base.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "heads")
    state = cut(
        _join_counts(base, shared, ["head"], base.count()).select("id", F.sha2("body", 256).alias("sha"), "rid", F.lit(0).cast("long").alias("gid"), F.when(F.col("n") > 1, F.col("body")).alias("rest")), "radix"
    )
    settled = [state.filter("rest is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha")]
    state, block = state.filter("rest is not null"), first_block * growth
    while not state.isEmpty():
        keyed = state.withColumns({"block": F.substring("rest", 1, block), "ended": F.length("rest") <= block})
        groups = keyed.groupBy("gid", "block", "ended").agg(
            F.count(F.lit(1)).alias("n"), F.max("id").alias("top"), F.coalesce(F.max_by("rid", "id"), F.max("rid")).alias("top_rid"), F.max("rid").alias("next_gid")
        )
        known = cut(
            _join_counts(keyed, cut(groups.filter("n > 1"), "groups"), ["gid", "block", "ended"], state.count()).select(
                "id", "sha", "rid", F.col("next_gid").alias("gid"), F.when(~F.col("ended") & F.col("n").isNotNull(), F.substring("rest", block + 1, 2**31 - 1)).alias("rest"),
                F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"), (F.coalesce("top_rid", "rid") == F.col("rid")).alias("kept"),
            ), "radix",
        )
        settled.append(known.filter("rest is null").select("id", "keep_id", "n", "kept", "sha"))
        state, block = known.filter("rest is not null").select("id", "sha", "rid", "gid", "rest"), block * growth
    return reduce(DataFrame.unionByName, settled).select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
