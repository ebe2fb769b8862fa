r"""Collocations: a sketch bounds the counts of all phrases, automata count those that may be frequent enough.

Texts become lines of guarded words (` w1 w2 ` with a blank on both sides of each word and ` \n ` between pieces). A
counting sketch over all words and phrases, built in slices, gives upper bounds; phrases whose own bound and whose parts'
bounds reach the threshold are candidates. A task compiles the candidates of each chunk of its lines into Aho-Corasick
automata, over letters that stand for words and a guard between pieces, and scans the chunk with these, counting overlapping
matches; the counts are summed, in the task first. So the lines are scanned once, however many candidates there are. Thresholds apply to the
exact counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, forget, text_of

LEAST = 10  # occurrences of a candidate
INSIDE = 50  # per cent of a phrase's occurrences that within a longer candidate make the phrase go
CHUNK = 2_000_000  # characters of lines that are hashed at once
PART = 600_000  # phrases of an automaton (about 90 MB)
HELD = 1_500_000  # counted phrases of a task's chunks that are summed before they are shuffled
HELD_CELLS = 6_000_000  # cells of the sketch likewise
WORDS_OF_PART = 4_000_000  # words of the corpus for each part that its phrases are dealt to by hash
LEAST_PARTS = 64
SLICE_BITS = 20  # cells of a slice of the sketch, as a power of two
CELL_BITS = (SLICE_BITS, 30)  # the sketch has at least a cell for each word of the corpus, between these powers of two; its bits are broadcast (128 MB at most)
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def guarded(text: str) -> str:
    """The text's words, a blank on both sides of each, pieces apart; empty if it has no words."""
    pieces = (b" ".join(w for w in p.split(b" ") if w) for p in text.encode().translate(FOLD).split(b"\n"))
    body = b" \n ".join(p for p in pieces if p)
    return f" {body.decode()} " if body else ""


@F.pandas_udf(StringType())
def _guarded(texts: pd.Series) -> pd.Series:
    return pd.Series([guarded(t) for t in texts], dtype=object)


#: So that the filter on the lines isn't moved below it, which would make every line twice.
_guarded_once = _guarded.asNondeterministic()


def encoded(lines: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The different words of the lines, the break between pieces among them, and the lines as numbers of these."""
    words = pc.list_flatten(pc.split_pattern(pa.array([" \n ".join(lines)], pa.large_string()), " "))
    found = words.filter(pc.not_equal(words, "")).dictionary_encode()
    return found.dictionary.cast(pa.string()), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Hashes:
    """Words of lines of one language as numbers, and hashes of its words and phrases; phrases don't cross pieces."""

    def __init__(self, lang: str, lines: list[str]):
        self.words, self.ids = encoded(lines)
        self.n, seed = len(self.words), zlib.crc32(lang.encode())
        own = self.words.to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in own), np.uint64, self.n)
        h, word = hashes[self.ids], self.ids != (own.index("\n") if "\n" in own else -1)
        with np.errstate(over="ignore"):
            two = (h[:-1] * _A + h[1:]) * _B
            three = (two[:-1] * _A + h[2:]) * _B
        #: By number of words less one: where a word or phrase starts, and what it hashes to there.
        self.at = [np.flatnonzero(x) for x in (word, word[:-1] & word[1:], word[:-2] & word[1:-1] & word[2:])]
        self.of = [h, two, three]

    def cells(self, k: int, at: np.ndarray, bits: int) -> np.ndarray:
        return (self.of[k][at] >> np.uint64(64 - bits)).astype(np.int64)

    def parts(self, k: int, at: np.ndarray, parts: int) -> np.ndarray:
        return (self.of[k][at] % np.uint64(parts)).astype(np.int64)

    def firsts(self, pairs: np.ndarray, triples: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Number of words and where each of the different phrases that start at these places stands first."""
        first = self.ids[:-1] * self.n + self.ids[1:]
        _, two = np.unique(first[pairs], return_index=True)
        _, dense = np.unique(first[triples], return_inverse=True)
        _, three = np.unique(dense * self.n + self.ids[triples + 2], return_index=True)
        return [(2, pairs[two]), (3, triples[three])]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """Lines of one language, together at most about CHUNK bytes; longer lines are cut between pieces."""
    langs = batch.column("lang").dictionary_encode()
    order = np.argsort(langs.indices.to_numpy(zero_copy_only=False), kind="stable")
    bounds = np.cumsum([0, *np.bincount(langs.indices.to_numpy(zero_copy_only=False), minlength=len(langs.dictionary))])
    for lang, low, high in zip(langs.dictionary.to_pylist(), bounds, bounds[1:], strict=False):
        own = batch.column("line").take(pa.array(order[low:high]))
        size = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(size, CHUNK + (size[a - 1] if a else 0))))
            lines = own[a:b].to_pylist()
            a = b
            if len(lines) == 1 and len(lines[0]) > CHUNK:
                pieces, n, first = lines[0].split(" \n "), 0, 0
                for k, piece in enumerate(pieces):
                    n += len(piece)
                    if n >= CHUNK or k + 1 == len(pieces):
                        yield lang, pieces[first : k + 1]
                        n, first = 0, k + 1
            else:
                yield lang, lines


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n: the number of words of each line; breaks between pieces are none."""
    for batch in batches:
        blanks, breaks = (pc.count_substring(batch.column("line"), x) for x in (" ", "\n"))
        n = pc.subtract(pc.subtract(blanks, breaks), 1).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("lang").cast(pa.string()), n], names=["lang", "n"])


def _packed(cells: np.ndarray) -> bytes:
    """Ascending numbers by their distances in bytes: 255 carries on, anything less ends a number; compressed, as most distances are alike."""
    more, rest = np.divmod(np.diff(cells, prepend=0), 255)
    out = np.full(int(more.sum()) + len(cells), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return zlib.compress(out.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of sorted runs, in order, and the sums of their counts."""
    cells, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.minimum(np.add.reduceat(counts, first, dtype=np.int64), 255).astype(np.uint8)  # a count of 255 reaches any threshold below it


def _slices(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cells, counts = _summed(held)
    own, starts = np.unique(cells >> SLICE_BITS, return_index=True)
    bounds = list(zip(own.tolist(), starts, [*starts[1:], len(cells)], strict=True))
    packed = [[_packed(cells[a:b].astype(np.int64) - (k << SLICE_BITS)) for k, a, b in bounds], [zlib.compress(counts[a:b].tobytes(), 1) for _, a, b in bounds]]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *(pa.array(x, pa.binary()) for x in packed)], names=["slice", "cells", "counts"])


def _sketch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for lang, lines in _chunks(batch):
                h = Hashes(lang, lines)
                cells, counts = np.unique(np.concatenate([h.cells(k, h.at[k], bits) for k in range(3)]), return_counts=True)
                held.append((cells.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)))
                if sum(len(x) for x, _ in held) >= HELD_CELLS:
                    yield _slices(held)
                    held = []
        if held:
            yield _slices(held)

    return run


def _merge(least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by slice: the sums of its cells, of which a bit tells whether they reach the threshold."""
        now, sums = None, None
        for frame in frames:
            for k, cells, counts in frame[["slice", "cells", "counts"]].itertuples(index=False, name=None):
                if k != now:
                    if now is not None:
                        yield pd.DataFrame({"slice": [now], "bits": [np.packbits(sums >= least).tobytes()]})
                    now, sums = k, np.zeros(1 << SLICE_BITS, np.int64)
                sums[_unpacked(cells)] += np.frombuffer(zlib.decompress(counts), np.uint8)
        if now is not None:
            yield pd.DataFrame({"slice": [now], "bits": [np.packbits(sums >= least).tobytes()]})

    return run


class Automaton:
    """Phrases, each given by where it stands first among the words. Each word is written in letters of a number system whose
    places have alphabets of their own, so that matches start and end at words; words that no phrase has, and what is between
    pieces, are a guard that is no letter, so that no match crosses them."""

    def __init__(self, ids: np.ndarray, n: int, firsts: list[tuple[int, np.ndarray]]):
        had = np.zeros(n, bool)
        for k, at in firsts:
            had[ids[at[:, None] + np.arange(k)]] = True
        number = np.arange(int(had.sum()))
        wide = max(1, len(number).bit_length())
        self.places = -(-wide // LETTER_BITS)
        bits = -(-wide // self.places)
        self.letters = np.full((n, self.places), ord(GUARD), "<u4")
        for j in range(self.places):
            self.letters[had, j] = 0x100 + (j << bits) + (number >> bits * j & (1 << bits) - 1)
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.size = 0
        for k, at in firsts:
            width, written = k * self.places, self.written(ids[at[:, None] + np.arange(k)])
            for place in range(0, len(written), width):
                self.search.add_word(written[place : place + width], self.size)
                self.size += 1
        self.search.make_automaton()

    def written(self, ids: np.ndarray) -> str:
        return self.letters[ids].tobytes().decode("utf-32-le")

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """By phrase: the places among these words where it stands, overlapping ones too."""
        if not self.size:
            return np.zeros(0, np.int64)
        return np.bincount(np.fromiter((k for _, k in self.search.iter(self.written(ids))), np.int64), minlength=self.size)


GUARD = "\n"
LETTER_BITS = 7  # of an alphabet: a state's next letters are searched one by one


def _count(bitmap, bits: int, per_part: int, parts: int):
    """part, lang, phrases, counts: the candidates of a task's chunks, summed and packed by the part that their hash tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held, size = np.frombuffer(bitmap.value, np.uint8), {}, 0
        for batch in batches:
            for lang, lines in _chunks(batch):
                h, own = Hashes(lang, lines), held.setdefault(lang, [])
                on = np.zeros((3, len(h.ids) + 1), bool)
                for k in range(3):
                    at = h.at[k]
                    if k:  # both parts that lack a word reach the threshold, too
                        at = at[on[k - 1][at] & on[k - 1][at + 1]]
                    cells = h.cells(k, at, bits)
                    on[k][at[(frequent[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1]] = True
                at = np.flatnonzero(on[0])
                at = at[np.unique(h.ids[at], return_index=True)[1]]
                own.append((h.parts(0, at, parts), h.words.take(pa.array(h.ids[at])), np.bincount(h.ids, minlength=h.n)[h.ids[at]]))
                size += len(at)
                for k, firsts in h.firsts(np.flatnonzero(on[1]), np.flatnonzero(on[2])):
                    for low in range(0, len(firsts), per_part):
                        at = firsts[low : low + per_part]
                        counts = Automaton(h.ids, h.n, [(k, at)]).counts(h.ids)
                        words = [h.words.take(pa.array(h.ids[at + j])) for j in range(k)]
                        own.append((h.parts(k - 1, at, parts), pc.binary_join_element_wise(*words, " "), counts))
                    size += len(firsts)
                if size >= HELD:
                    yield from (_by_part(x, rows) for x, rows in held.items())
                    held, size = {}, 0
        yield from (_by_part(x, rows) for x, rows in held.items())

    return run


def _by_part(lang: str, held: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """A row for each part: its different phrases in order, one a line (no word has a line break), and the sums of their counts."""
    part, f = (np.concatenate([x[j] for x in held]) for j in (0, 2))
    phrase = pa.concat_arrays([x[1] for x in held])
    order = pc.sort_indices(pa.table({"part": part, "phrase": phrase}), sort_keys=[("part", "ascending"), ("phrase", "ascending")])
    phrase, order = phrase.take(order), order.to_numpy()
    part, f = part[order], f[order]
    first = np.ones(len(part), bool)
    first[1:] = (part[1:] != part[:-1]) | pc.not_equal(phrase[1:], phrase[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(first)
    phrase, part, f = phrase.take(pa.array(first)), part[first], np.add.reduceat(f, first) if len(first) else f
    own, starts = np.unique(part, return_index=True)
    bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=False)) if len(part) else []
    phrases = [zlib.compress("\n".join(phrase[a:b].to_pylist()).encode()) for a, b in bounds]
    counts = [zlib.compress(np.ascontiguousarray(f[a:b].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()) for a, b in bounds]
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array([lang] * len(own), pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())], names=["part", "lang", "phrases", "counts"])


def _sums(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part and lang: the phrases whose counts together reach the threshold."""

        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("part", "lang", "phrases", "counts")), strict=True)

        for (_, lang), own in groupby(rows(), key=lambda r: r[:2]):
            phrases, counts = [], []
            for *_, p, n in own:
                phrases.append(pc.list_flatten(pc.split_pattern(pa.array([zlib.decompress(p).decode()], pa.large_string()), "\n")).cast(pa.string()))
                counts.append(np.ascontiguousarray(np.frombuffer(zlib.decompress(n), np.uint8).reshape(8, -1).T).view("<i8").ravel())
            table = pa.table({"phrase": pa.chunked_array(phrases), "f": np.concatenate(counts)}).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
            table = table.filter(pc.greater_equal(table["f_sum"], least))
            for b in table.to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), b.column("phrase"), b.column("f_sum")], names=["lang", "phrase", "f"])

    return run


def guarded_lines(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang (null: `und`), line: the guarded words of each text that has any."""
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), _guarded_once(text_of(text_col)).alias("line")).filter("line <> ''")


def candidate_phrases(lines: DataFrame, n_words: int, least: int = LEAST, per_part: int = PART) -> DataFrame:
    """lang, phrase, f: the words and the phrases of two or three words with at least `least` occurrences within pieces,
    overlapping ones included. Those whose bounds reach it are counted, so none is missing.

    Two languages or phrases may share a cell, which only raises a bound. A slice of the sketch is summed in one task; its
    size is fixed and their number grows with the corpus. Candidates are counted chunk by chunk of the lines, by automata of
    at most per_part of the phrases that the chunk has; what a task counts is summed there and shuffled by parts, whose number
    grows with the corpus.
    """
    spark = lines.sparkSession
    bits = min(max(n_words.bit_length(), CELL_BITS[0]), CELL_BITS[1])
    slices = lines.mapInArrow(_sketch(bits), "slice long, cells binary, counts binary").repartition("slice").sortWithinPartitions("slice")
    bitmap = bytearray(1 << (bits - 3))
    width = 1 << (SLICE_BITS - 3)
    for row in slices.mapInPandas(_merge(min(least, 255)), "slice long, bits binary").toLocalIterator():  # 2^bits bits in all
        bitmap[row["slice"] * width : (row["slice"] + 1) * width] = row["bits"]
    sent = spark.sparkContext.broadcast(bytes(bitmap))
    parts = max(LEAST_PARTS, n_words // WORDS_OF_PART)
    counted = lines.mapInArrow(_count(sent, bits, per_part, parts), "part long, lang string, phrases binary, counts binary")
    return counted.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(_sums(least), "lang string, phrase string, f long")


def _scored(counted: DataFrame, words: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """lang, phrase, a, l, r, score of kept (all counted ones) by the lowest-scoring cut; counted and words hold all parts of the phrases."""
    number = lambda c: F.col(c).cast("decimal(38,0)")
    split = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(split) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(split, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(split, k + 1, F.size(split) - k), " ").alias("rest")))
    cuts = (counted if kept is None else kept).select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    f = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(counted.select("lang", F.col("phrase").alias("part"), "f"))
    left, right = f.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), f.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({"square": number("a") * number("a") * 1_000_000, "product": number("l") * number("r")})
    lowest = F.min(F.struct(F.expr("square div product").alias("score"), "k", "l", "r")).alias("low")
    return both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, inside: int = INSIDE, most: int = 2000, per_part: int = PART) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language (null: `und`) the phrases of two or three words that score highest.

    n counts all words of the language, a, l and r the phrase and the two parts of its lowest-scoring cut (ties: the
    shorter first part); score is floor(1,000,000 a a / (l r)), computed exactly. Phrases with fewer than `least`
    occurrences aren't candidates; those of which at least `inside` per cent stand in one longer candidate are left out.
    Ties of the score go by a descending, then by the phrase's bytes. Null and empty texts have no words; repeated rows
    count each; other columns aren't read; an empty table gives an empty result.

    The texts are read once, as guarded lines in the shared folder; the sketch is summed in slices, phrases are counted in one
    pass over the lines. No language or phrase is gathered in a task: what is grouped was summed in the tasks before.
    """
    spark = docs.sparkSession
    lines = cut(guarded_lines(docs, text_col, lang_col), "lines")
    sizes = cut(lines.mapInArrow(_count_words, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = cut(candidate_phrases(lines, total, least, per_part), "frequent")
    forget(spark, lines)
    words = frequent.filter(F.instr("phrase", " ") == 0).select("lang", F.col("phrase").alias("word"), F.col("f").alias("n"))
    counted = frequent.filter(F.instr("phrase", " ") > 0)
    longer = counted.filter(F.size(F.split("phrase", " ")) == 3)
    parts = F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))).alias("phrase")
    holds = longer.select("lang", parts, "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = counted.join(holds, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < inside * F.col("f"), F.lit(True)))
    scored = _scored(counted, words, kept)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
