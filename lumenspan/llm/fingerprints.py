"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of paragraph pieces: its lines, cut at sentence ends and, where a sentence runs on, every PIECE
characters. Each piece is hashed to a wide vector whose components are the bits of SEEDS 64-bit hashes, and the
vectors of a text are summed component by component modulo 2^31. So the order of the pieces doesn't matter, inserting
a piece adds its vector and deleting it subtracts it, and equal multisets have equal sums. Two components are kept
in one long (31 bits each), which is a sum modulo powers of two in each half: a string of under 2^31 pieces can't carry
from one into the other. A bit is +1 or -1 with even odds, so products of centred sums estimate how much two multisets
share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

SEEDS = 3  # 64-bit hashes per piece
PIECE = 120  # characters after which a run without a sentence end is cut
HALF = 31  # bits of a component
PIECES = rf"[^\n.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"


def pieces(text: Column) -> Column:
    """The paragraph pieces of a text; none if it has only line breaks."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def _modulo(lane: Column) -> Column:
    """Both components of a lane modulo 2^31, for a sum of so few that the lower one didn't carry."""
    return lane.bitwiseAND(F.lit((1 << 2 * HALF) - 1))


def lane_sums(piece: Column) -> list[Column]:
    """Aggregates: the summed vector of a group's pieces (a null piece adds nothing), and how many there are."""
    mask = (1 << HALF) | 1
    hashes = [F.xxhash64(F.lit(seed), piece) for seed in range(SEEDS)]
    lanes = [_modulo(F.sum(F.when(piece.isNotNull(), F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask))).otherwise(F.lit(0)))) for h in hashes for j in range(HALF)]
    return [F.array(*lanes).alias("lanes"), F.count(piece).alias("pieces")]


def _each(x: Column, y: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Both components of two lanes, modulo 2^31 each."""
    most = F.lit((1 << HALF) - 1)
    low, high = of(x.bitwiseAND(most), y.bitwiseAND(most)), of(F.shiftright(x, HALF), F.shiftright(y, HALF))
    return F.shiftleft(high.bitwiseAND(most), HALF).bitwiseOR(low.bitwiseAND(most))


def add(a: Column, b: Column) -> Column:
    """The fingerprint vector of both multisets together."""
    return F.zip_with(a, b, lambda x, y: _each(x, y, lambda u, v: u + v))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint vector of a after deleting the pieces of b, which a holds."""
    return F.zip_with(a, b, lambda x, y: _each(x, y, lambda u, v: u - v))


def spell(lanes: Column, n: Column) -> Column:
    """The vector as text."""
    return F.concat_ws("-", F.hex(n), F.transform(lanes, lambda x: F.lower(F.hex(x))))


def centred(lanes: Column, n: Column) -> Column:
    """Each component as (ones - zeros)."""
    low, high = lambda x: x.bitwiseAND(F.lit((1 << HALF) - 1)), lambda x: F.shiftright(x, HALF)
    return F.flatten(F.transform(lanes, lambda x: F.array(2.0 * low(x) - n, 2.0 * high(x) - n)))


def likeness(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """0 to 1: the estimate of 2 <A, B> / (<A, A> + <B, B>) over two multisets; two empty ones are alike."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    ca, cb = centred(a, na), centred(b, nb)
    both = square(ca) + square(cb)
    apart = square(F.zip_with(ca, cb, lambda x, y: x - y))
    return F.when(both == 0, F.when(na == nb, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - apart / both)))


def range_edges(keys: DataFrame, count: int) -> list:
    """Ascending keys of the table, at most count - 1, that part it into ranges of about as many rows each."""
    if count <= 1:
        return []
    found = keys.agg(F.percentile_approx("key", [i / count for i in range(1, count)], max(10_000, 4 * count)).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(key: Column, edges: list, width: int = 256) -> Column:
    """How many edges are below the key, found in two steps of at most `width` comparisons each (for up to width**2)."""
    if not edges:
        return F.lit(0)
    below = lambda array: F.size(F.filter(array, lambda e: e < key))
    rows = _in_rows(edges, width)
    row = below(F.lit([r[-1] for r in rows]))
    return F.when(row < len(rows), row * width + below(F.get(_array(rows), row))).otherwise(len(edges))


def edge_at(place: Column, edges: list, width: int = 256) -> Column:
    """The edge of that number, null beyond the last."""
    return F.get(F.get(_array(_in_rows(edges, width)), F.floor(place / width).cast("int")), place % width) if edges else F.lit(None)


def _in_rows(edges: list, width: int) -> list[list]:
    return [edges[i : i + width] for i in range(0, len(edges), width)]


def _array(rows: list[list]) -> Column:
    return F.array(*[F.lit(r) for r in rows])


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2_000, most_ranges: int = 65_536) -> DataFrame:
    """Fingerprint every text and its edited text, and compare each with its edited text and with the next document.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is
    the one with the next smaller id (a number); after the smallest comes the largest, so a lone document is its own
    next. The edited text has its last third (rounded down, in code points) replaced by as many first code points of
    the next text, or all of it. Null texts count as empty; an empty text has no pieces and the fingerprint of nothing.
    Null ids come after all others; rows that repeat an id are ordered by text. Other columns are not read, whatever
    their names. No rows give no rows.

    The texts are shuffled once, to ranges of ids of about as many rows each. The first document of each range is also
    dealt to the range before it, so that "next" never needs all ids in one task. The driver holds the range edges, at
    most most_ranges ids, and nothing else.
    """
    span = docs.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).cast("long").alias("low"), F.max(id_col).cast("long").alias("top"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
    absent = 0 if span["low"] is None else max(span["low"] - 1, -(2**63))
    top = absent if span["top"] is None else span["top"]
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(absent)).alias("key"), text_of(text_col).alias("body"))
    edges = range_edges(base.select("key"), min(most_ranges, -(-span["n"] // rows_per_range)))
    base = base.withColumn("range", range_of(F.col("key"), edges))
    part, is_edge = F.col("range"), F.coalesce(edge_at(F.col("range"), edges) == F.col("key"), F.lit(False))
    # A range ends, in descending order, before the edge below it: that edge's document follows its last one.
    places = F.array_compact(F.array(
        F.struct(part.alias("part"), F.lit(0).alias("again")),
        F.when(is_edge, F.struct((part + 1).alias("part"), F.lit(1).alias("again"))),
        F.when(F.col("key") == F.lit(top), F.struct(F.lit(0).alias("part"), F.lit(2).alias("again"))),
    ))
    dealt = base.select("id", "key", "body", F.explode(places).alias("place")).select("id", "key", "body", "place.part", "place.again")
    order = Window.partitionBy("part").orderBy(F.col("again") == 2, F.col("key").desc(), "body")
    n = F.length("body")
    texts = dealt.select("part", "again", "id", "body", F.row_number().over(order).alias("place"), F.lead("body").over(order).alias("after")).select(
        "part", "again", "id", "place", n.alias("n_chars"), "body", F.when(F.col("again") == 0, F.concat(F.expr("substring(body, 1, length(body) - length(body) div 3)"), F.expr("substring(after, 1, length(body) div 3)"))).alias("edited")
    )
    kinds = texts.select("part", "again", "id", "place", "n_chars", F.sha2("edited", 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("body").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("k"))
    units = kinds.filter("k.t is not null").select("part", "again", "id", "place", "n_chars", "sha", "k.kind", F.explode_outer(pieces(F.col("k.t"))).alias("piece"))
    sums = units.groupBy("part", "again", "id", "place", "n_chars", "sha", "kind").agg(*lane_sums(F.col("piece")))
    by_place = Window.partitionBy("part").orderBy("place", "kind")
    ahead = lambda c, k: F.lead(c, k).over(by_place)
    rows = sums.select("*", ahead("lanes", 1).alias("e"), ahead("pieces", 1).alias("ne"), ahead("lanes", 2).alias("x"), ahead("pieces", 2).alias("nx")).filter("kind = 0 and again = 0")
    own, count = F.col("lanes"), F.col("pieces")
    return rows.select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), spell(own, count).alias("fingerprint"), spell(F.col("e"), F.col("ne")).alias("edited_fingerprint"),
        likeness(own, count, F.col("e"), F.col("ne")).alias("near_edited"), likeness(own, count, F.col("x"), F.col("nx")).alias("near_next"),
    )
