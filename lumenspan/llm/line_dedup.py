"""Repeated passages: overlapping windows of three consecutive lines, of which later occurrences are removed.

A line ends at a line break and at a sentence end, unless one of the three words before it ends a sentence or line, too: texts
whose words all have marks are no rows of short lines. Runs of words without such ends are cut at winnowing minima: of every RUN
consecutive words in a run, the one with the smallest hash (of equal ones the last) ends a line, words that repeat the
one before them left out; where one word goes on and on, lines end by count. So no line is longer than RUN words, a passage is cut alike wherever it stands (but for its first three words), and 51 words hold three whole lines,
whatever is around them.
Windows whose hashes occur again anywhere are looked at with their places; every place but the first covers its lines,
covered lines are merged and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from xxhash import xxh3_128_intdigest

from .common import cut, forget, text_of

RUN = 12  # words of a line at most
NEAR = 3  # words after an end of which none ends a sentence
WINDOW = 3  # lines of a window
CHUNK = 4_000_000  # bytes that are cut into lines at once (whole texts)
LONG = 64  # bytes of a word that have powers of their own
FILTER_BITS = (16, 30)  # size of the filter that is sent to the tasks, as powers of two of bits: 128 MB at most
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Multipliers of the polynomials: that of the order has 32 bits, so that SQL can follow it in 128.
ORDER, SPREAD = 0x85EBCA6B, 0x27220A95FE4A7C15
_SPREAD = np.uint64(SPREAD)
_BYTES = [np.array([pow(p, k, 2**64) for k in range(LONG)], np.uint64) for p in (ORDER, 0xC2B2AE3D27D4EB4F)]
_NONE = np.int64(2**32)  # beyond any order
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(RUN)], np.uint64)


def _code(word: bytes) -> tuple[int, int]:
    h = xxh3_128_intdigest(word)
    return h & (2**64 - 1), h >> 64


class Lines:
    """The lines and windows of some texts, given as one buffer of UTF-8 and where each of them starts and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word doesn't go on in the next text
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.at, ends = np.flatnonzero(first), np.flatnonzero(last) + 1  # bytes of each word
        words = np.searchsorted(self.at, offsets)
        sizes, self.text_ends = np.diff(words), words[1:]
        self.offsets, self.words = offsets, len(self.at)
        order, codes = self._codes(data[solid], ends - self.at)
        marks = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        breaks = np.zeros(self.words, bool)
        breaks[:-1] = lines[self.at[1:]] > lines[ends[:-1]]
        if self.words:
            breaks[self.text_ends[sizes > 0] - 1] = True
        inside = np.arange(self.words) - np.repeat(words[:-1], sizes)  # place of a word in its text
        stop, stops = breaks | marks, marks.copy()
        for k in range(1, NEAR + 1):
            stops[k:] &= ~(stop[:-k] & (inside[k:] >= k))
        stops |= breaks
        again = np.zeros(self.words, bool)
        again[1:] = (codes[0][1:] == codes[0][:-1]) & (codes[1][1:] == codes[1][:-1]) & (inside[1:] >= 1)
        stops |= _minima(np.where(again, _NONE, order), stops)
        ends = np.flatnonzero(stops)
        place = np.arange(self.words) - np.repeat(np.concatenate([[0], ends + 1])[: len(ends)], np.diff(ends, prepend=-1))
        stops |= place % RUN == RUN - 1
        self.stops = np.flatnonzero(stops) + 1
        self.starts = np.concatenate([[0], self.stops])[: len(self.stops)].astype(np.int64)  # first word of each line
        #: Lines of each text, and the number of its first one.
        self.first = np.searchsorted(self.starts, words[:-1])
        self.n = np.searchsorted(self.starts, self.text_ends) - self.first
        self._hash(codes)

    @staticmethod
    def of(texts: list[str]) -> Lines:
        coded = [t.encode() for t in texts]
        return Lines(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))

    @staticmethod
    def _codes(solid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The order that the minima go by, and two hashes of each word: polynomials of its bytes."""
        if not len(sizes):
            return np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * 2
        start = np.cumsum(sizes) - sizes
        place = np.minimum(np.arange(len(solid), dtype=np.int32) - np.repeat(start.astype(np.int32), sizes), LONG - 1)
        values = solid.astype(np.uint64)
        with np.errstate(over="ignore"):
            sums = [np.add.reduceat(values * powers[place], start) for powers in _BYTES]
            order = ((sums[0] * _SPREAD) >> np.uint64(32)).astype(np.int64)
            codes = [_mixed(x + sizes.astype(np.uint64)) for x in sums]
        for k in np.flatnonzero(sizes > LONG):  # the places beyond LONG share a power, which is enough for an order alone
            codes[0][k], codes[1][k] = _code(solid[start[k] : start[k] + sizes[k]].tobytes())
        return order, codes

    def _hash(self, words: list[np.ndarray]) -> None:
        """Windows: number of the text, first line within it, two hashes of the words in their lines."""
        if not len(self.starts):
            self.text = self.line = np.zeros(0, np.int64)
            self.h1 = self.h2 = np.zeros(0, np.int64)
            return
        place = np.arange(self.words) - np.repeat(self.starts, self.stops - self.starts)
        with np.errstate(over="ignore"):
            lines = [_mixed(np.add.reduceat(words[k] * _POWERS[place], self.starts) + (self.stops - self.starts).astype(np.uint64)) for k in (0, 1)]
            count = np.where(self.n > 0, np.maximum(self.n - WINDOW + 1, 1), 0)
            self.text = np.repeat(np.arange(len(count)), count)
            self.line = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            here, more = self.first[self.text] + self.line, self.n[self.text] - self.line
            found = []
            for h in lines:
                own = h[here]
                for k in range(1, WINDOW):  # a text of fewer lines is one window
                    own = _mixed(own * _ODD + np.where(more > k, h[np.minimum(here + k, len(h) - 1)], np.uint64(k)))
                found.append(own.astype(np.int64))
            self.h1, self.h2 = found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def _minima(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a word is the last smallest one of some RUN words in a row, none of which but the last may end a run."""
    cuts = np.zeros(len(hashes), bool)
    stops = np.flatnonzero(last)
    until = np.repeat(stops, np.diff(stops, prepend=-1))  # the last word of each word's run
    starts = np.flatnonzero(until - np.arange(len(hashes)) >= RUN - 1)
    best, where = hashes[starts], starts.copy()
    for k in range(1, RUN):
        other = hashes[starts + k]
        less = other <= best
        best[less], where[less] = other[less], starts[less] + k
    cuts[where[best != _NONE]] = True
    return cuts


def _chunks(column: pa.Array) -> Iterator[tuple[int, Lines]]:
    """The number of the first text and the lines of about CHUNK bytes of texts, read from Arrow's own buffers."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK)))
        b = min(b, len(column))
        yield a, Lines(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        a = b


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x in _chunks(batch.column("body")):
            yield pa.RecordBatch.from_arrays([pa.array(x.h1)], names=["h1"])


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _places(sent, bits: int):
    """A row for each text, and instead one for each window that the filter doesn't tell to be unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for a, x in _chunks(batch.column("body")):
                place = _bit(x.h1, bits)
                hit = np.flatnonzero((filled[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                none = np.setdiff1d(np.arange(len(x.n)), x.text[hit])
                text = np.concatenate([x.text[hit], none])
                gap = np.arange(len(text)) >= len(hit)
                own = lambda v: pa.array(np.concatenate([v[hit], np.zeros(len(none), v.dtype)]), mask=gap)  # noqa: E731, B023
                columns = [batch.column(c).take(pa.array(text + a)) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(x.n[text].astype(np.int32)), own(x.line.astype(np.int32)), own(x.h1), own(x.h2)], names=["id", "key", "n_lines", "at", "h1", "h2"])

    return run


def _filter(again: DataFrame, bits: int) -> bytes:
    """A bit for the leading bits of each hash, put together in slices of 2 ** 20 bits."""
    width = min(bits, 20)

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = np.unique(_bit(frame["h1"].to_numpy(np.int64), bits))
            for k in np.unique(place >> width).tolist():
                own = np.zeros(1 << width, bool)
                own[place[place >> width == k] - (k << width)] = True
                yield pd.DataFrame({"slice": [k], "filled": [np.packbits(own).tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    spread = again.repartitionByRange("h1")  # few slices in each task
    for row in spread.mapInPandas(slices, "slice long, filled binary").toLocalIterator():
        out[row["slice"] << (width - 3) : (row["slice"] + 1) << (width - 3)] |= np.frombuffer(row["filled"], np.uint8)
    return out.tobytes()


def _kept(x: Lines, text: int, data: bytes, starts) -> tuple[str, int]:
    """A text without the windows that start at those lines, and how many lines went. White space before the first word
    goes with the first line."""
    begin, end = int(x.offsets[text]), int(x.offsets[text + 1])
    first, n = int(x.first[text]), int(x.n[text])
    gone = sorted({k for s in starts for k in range(s, min(s + WINDOW, n))})
    own = [int(v) for v in x.at[x.starts[first : first + n]]] + [end]  # where each line starts
    own[0] = begin
    kept, at = [], begin
    for k in gone:
        kept.append(data[at : own[k]])
        at = own[k + 1]
    return b"".join([*kept, data[at:end]]).decode(), len(gone)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("n_removed", IntegerType())]))
def _rebuild(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
    out: list[tuple[str | None, int]] = [(None, 0)] * len(texts)
    rows = [k for k, s in enumerate(starts) if s is not None]
    while rows:
        size = np.cumsum([len(texts.iloc[k]) for k in rows])
        now, rows = rows[: max(1, int(np.searchsorted(size, CHUNK)))], rows[max(1, int(np.searchsorted(size, CHUNK))) :]
        coded = [texts.iloc[k].encode() for k in now]
        data = b"".join(coded)
        x = Lines(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, coded)]))
        for place, k in enumerate(now):
            out[k] = _kept(x, place, data, starts.iloc[k])
    return pd.DataFrame(out, columns=["text", "n_removed"])


#: So that a filter on the result isn't moved below it, which would rebuild every text once more.
_rebuilt = _rebuild.asNondeterministic()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, key (hash of the text it had), text (what stays), n_lines, n_removed.

    Two windows are equal if their three lines have the same words. The first occurrence is the one with the least (id,
    text hash, line); null ids come first. A text of fewer than three lines is one window, so of equal short texts the
    first keeps its words; there is no least length. Texts without repeats stay as they are to the byte; an empty or
    null text and one of white space stays as it is, with no lines. Rows that repeat id and text are one document and get
    the same result. Of other columns those named in `carry` come along as the fields of a struct `carried`, whatever
    their names; the rest is not read.

    A first pass shuffles nothing but the windows' hashes, counted with combining. Those that occur again fill a filter of
    at most 128 MB, by which a second pass leaves out most unique windows; what it lets through (all, on a corpus beyond
    its size) is decided by both hashes. The joins are equi-joins, which adaptive execution can split at a hot window. No
    group is gathered but the covered lines of one document.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("body"), F.col(text_col).isNull().alias("absent"), F.struct(*[F.col(c) for c in carry] or [F.lit(0)]).alias("carried"))
    texts = base.select("id", "key", "body")
    again = cut(texts.select("body").mapInArrow(_hashes, "h1 long").groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"), "repeated")
    bits = min(max((16 * again.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    sent = spark.sparkContext.broadcast(_filter(again, bits))
    fields = StructType([StructField("id", base.schema["id"].dataType), StructField("key", LongType()), StructField("n_lines", IntegerType()), StructField("at", IntegerType()), StructField("h1", LongType()), StructField("h2", LongType())])
    found = cut(texts.mapInArrow(_places(sent, bits), fields), "places")
    forget(spark, again)
    sent.destroy()
    places = found.filter("at IS NOT NULL").select("id", "key", "at", "h1", "h2")
    place = F.struct("id", "key", "at")
    # Written, so that the join has an exchange of its own on both sides, which is split at a hot window.
    first = cut(places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first")
    later = places.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    covered = later.select("id", "key", "at", F.lit(None).cast("int").alias("n_lines")).unionByName(found.select("id", "key", F.lit(None).cast("int").alias("at"), "n_lines"))
    told = covered.groupBy("id", "key").agg(F.collect_set("at").alias("starts"), F.max("n_lines").alias("n_lines"))
    same = base["id"].eqNullSafe(told["id"]) & (base["key"] == told["key"])
    joined = base.join(told, same).select(base["id"], base["key"], "body", "absent", F.when(F.size("starts") > 0, F.col("starts")).alias("starts"), "n_lines", "carried")
    made = joined.withColumn("made", _rebuilt(F.when(F.col("starts").isNotNull(), F.col("body")), "starts"))
    text = F.when(F.col("starts").isNotNull(), F.col("made.text")).when(~F.col("absent"), F.col("body"))
    return made.select(F.col("id").alias(id_col), "key", *(["carried"] if carry else []), text.alias("text"), "n_lines", F.col("made.n_removed").alias("n_removed"))
