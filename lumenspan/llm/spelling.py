"""Spelling variants: words of a corpus that one edit tells apart, and the form that each of them stands for.

A positional q-gram index finds the pairs. Words within one edit share all but q of their q-grams, at places that differ
by at most one, so both have the rarest gram that the edit leaves among their q + 1 rarest. Words meet in the groups of these
grams; in a group, those that are the same up to the gram, or from it on, are indexed by the grams of their rest. The
postings of two of a word's grams are merged by a heap under the limits on length and position, words that share enough
grams are verified, and a pair is kept in the group of its rarest such gram alone.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, groupby
from operator import eq, ne

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, text_of

Q = 3
LETTERS = "[A-Za-zÀ-ÿ]"
PER_GROUP = 20_000  # words of a gram's group that are compared in one go; larger ones are compared as pairs of blocks
MODULUS = 31  # one of so many occurrences (by hash) loses a letter in `corpus_words`


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the two apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    p = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        p += 1
    return a[p:] == b[p + 1 :]


def grams(word: str) -> list[str]:
    return [word[k : k + Q] for k in range(len(word) - Q + 1)]


def shared_around(gram: str, a: str, b: str) -> bool:
    """Whether the words are the same up to the gram's first place, or from its last place on; both have the gram."""
    return b.startswith(a[: a.index(gram) + Q]) or b.endswith(a[a.rindex(gram) :])


class Index:
    """Postings of q-grams by place over words in order of their lengths: the numbers of the words. All start with the same `alike` letters."""

    def __init__(self, words: list[str], alike: int = 0):
        self.alike, self.words, self.grams = alike, words, [grams(w) for w in words]
        self.postings: dict[tuple[str, int], list[int]] = defaultdict(list)
        for k, own in enumerate(self.grams):
            for place in zip(own, count()):  # noqa: B905
                self.postings[place].append(k)
        self.lengths = [len(w) for w in words]

    def near(self, word: str, below: int | None = None) -> Iterator[int]:
        """Numbers of the words one edit away, only those below a number if one is given.

        One edit touches at most Q grams, which follow one another, so of two grams with no letter in common one is left, at its
        place or moved by the difference of the lengths. The lists of two such grams, rare ones here, are merged by a heap under
        the limits on length and place, and what they bring is counted on in the other grams. A word too short to have
        two such grams is compared with all words of about its length.
        """
        n, own = len(word), grams(word)
        lengths, words = self.lengths, self.words
        end = bisect_left(lengths, n + 2) if below is None else below
        low = bisect_left(lengths, n - 1, 0, end)
        if low == end:
            return
        same = bisect_left(lengths, n, low, end)
        lists = self._lists(own, low, same, bisect_left(lengths, n + 1, low, end), end) if len(own) > Q else [range(low, end)]
        half, less = (n - self.alike) // 2, (n - self.alike - 1) // 2  # letters that the edit leaves at one of the ends
        ends, ends_of_shorter = (word[: self.alike + half], word[n - half :]), (word[: self.alike + less], word[n - less :])
        last = -1
        for k in heapq.merge(*lists) if len(lists) > 1 else chain(*lists):
            if k != last:
                last, other = k, words[k]
                head, tail = ends if k >= same else ends_of_shorter
                if other.startswith(head) or other.endswith(tail):
                    least = max(n, lengths[k]) - Q + 1 - Q  # grams that one edit leaves; one is there
                    if (least < 2 or self._shared(own, self.grams[k]) >= least) and one_edit(word, other):
                        yield k

    def _lists(self, own: list[str], low: int, same: int, longer: int, end: int) -> list[list[int]]:
        """The postings of two grams within the limits."""
        sizes = [len(self.postings.get(place, ())) for place in zip(own, count())]  # noqa: B905
        first = sizes.index(min(sizes))
        rest = [p for p in range(len(own)) if abs(p - first) >= Q]
        if not rest:
            first, rest = 0, range(Q, len(own))
        lists = []
        for p in (first, min(rest, key=sizes.__getitem__)):
            for shift, lo, hi in ((0, low, end), (-1, low, same), (1, longer, end)):
                if lo < hi and (found := self.postings.get((own[p], p + shift))):
                    at = found[bisect_left(found, lo) : bisect_left(found, hi)]
                    if at:
                        lists.append(at)
        return lists

    @staticmethod
    def _shared(own: list[str], other: list[str]) -> int:
        """How many grams are at their places, or moved by the difference of the lengths."""
        hits = sum(map(eq, own, other))
        if len(own) == len(other):
            return hits
        return hits + sum(map(eq, own[1:], other) if len(own) > len(other) else map(eq, own, other[1:]))


def _pairs(rows: list[tuple[str, int, list[str], int]], gram: str, across: bool) -> Iterator[tuple[str, int, str, int]]:
    """word, n, word, n of the pairs that this gram stands for; rows: word, n, its rarest grams, side.

    If a gram isn't touched by the edit, the words are the same up to its first place or from its last place on, so
    words with the same head, or the same tail, are looked at together; tails are read backwards.
    """
    for tail in (False, True):
        alike = defaultdict(list)
        for r in rows:
            alike[r[0][r[0].rindex(gram) :] if tail else r[0][: r[0].index(gram) + Q]].append(r)
        for shared, own in alike.items():
            if len(own) > 1:
                yield from _pairs_alike(sorted(own, key=lambda r: (len(r[0]), r[0])), gram, len(shared), across, tail)


def _pairs_alike(rows: list[tuple[str, int, list[str], int]], gram: str, shared: int, across: bool, tail: bool) -> Iterator[tuple[str, int, str, int]]:
    """The pairs of words that share so many letters of their heads (or tails): an edit of the rest is one of the word."""
    left = [r for r in rows if r[3] == 0] if across else rows
    right = [r for r in rows if r[3] == 1] if across else rows
    if not left or not right:
        return
    kept = shared - Q + 1  # letters that all grams but those of the rest have
    rest = (lambda w: w[: len(w) - kept][::-1]) if tail else (lambda w: w[kept:])
    index = Index([rest(r[0]) for r in left], Q - 1)
    for place, (word, n, own, _) in enumerate(right):
        for k in index.near(rest(word), None if across else place):
            other, m, theirs, _ = left[k]
            if tail and other.startswith(word[: word.index(gram) + Q]):
                continue  # found by their heads
            # The pair comes up in the groups of all grams that it shares in this way: the rarest of them keeps it.
            if next(g for g in own if g == gram or g in theirs and shared_around(g, word, other)) == gram:
                yield word, n, other, m


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (gram, low, high): each group once all its rows are there."""
    columns = ["word", "n", "near", "near_n"]

    def rows():
        for f in frames:
            yield from f[["gram", "low", "high", "word", "n", "rarest", "side"]].itertuples(index=False, name=None)

    def found():
        for (gram, low, high), group in groupby(rows(), key=lambda r: r[:3]):
            for a, n, b, m in _pairs([(w, n, list(rarest), side) for *_, w, n, rarest, side in group], gram, low != high):
                yield a, n, b, m
                yield b, m, a, n

    out: list[tuple] = []
    for row in found():
        out.append(row)
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=columns, dtype=object)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns, dtype=object)


def _in_groups(words: DataFrame, per_group: int) -> DataFrame:
    """word, n, rarest, gram, low, high, side: a row for each group in which a word is compared."""
    places = F.sequence(F.lit(1), F.length("word") - (Q - 1))
    own = words.select("word", "n", F.explode(F.array_distinct(F.transform(places, lambda p: F.substring(F.col("word"), p, F.lit(Q))))).alias("gram"))
    counts = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n_words"))
    ranked = own.join(counts, "gram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("n_words", "gram"))).alias("by_rarity"))
    rarest = cut(ranked.select("word", "n", F.slice(F.transform("by_rarity", lambda g: g["gram"]), 1, Q + 1).alias("rarest")), "rarest")
    groups = rarest.select("word", "n", "rarest", F.explode("rarest").alias("gram"))
    blocks = groups.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / per_group).alias("blocks"))
    block = F.pmod(F.xxhash64("word"), F.col("blocks"))
    dealt = groups.join(blocks, "gram").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select("word", "n", "rarest", "gram", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def near_words(words: DataFrame, per_group: int = PER_GROUP) -> DataFrame:
    """word, n, near, near_n: both directions of each pair of words (of at least seven code points) one edit apart.

    words: word, n, each word once. A gram's group of more than per_group words is cut into blocks by the words' hashes and
    compared as pairs of blocks, so a task holds at most two blocks; no pair is lost.
    """
    grouped = _in_groups(words, per_group)
    dealt = grouped.repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high")
    return dealt.mapInPandas(_compare, "word string, n long, near string, near_n long")


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2) -> DataFrame:
    """word, n of the words of at least least_length code points and least_n occurrences.

    Words are the runs of letters in whole texts, A-Z folded. A run whose crc32 of `<id>:<run>` (a null id counts as empty)
    is a multiple of 31 loses one letter: the place is the crc32 modulo the run's length.
    """
    runs = F.regexp_extract_all(text_of(text_col), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    folded = found.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = folded.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % MODULUS == 0, F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word on the way along the forms. A form has ten times the occurrences, so the way ends.

    Each round doubles the steps that are taken, so some five rounds are enough for any counts.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        last, now = now, cut(now.join(further, now["root"] == further["__at"], "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        if "moved" in last.columns:
            forget(last.sparkSession, last)
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root", "moved")


def group_variants(words: DataFrame, times: int = 10, per_group: int = PER_GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of words (word, n; each word once, of at least seven code points).

    n_near counts the words one edit away. form is the one of them with the largest n (ties: the first in code-point
    order) if that is at least `times` the word's own, else null; root is the end of the way along the forms, the word
    itself without one. An empty table gives an empty result; words without near ones stay with n_near 0.
    """
    words = cut(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words, per_group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    large = -F.col("best.minus") >= times * F.col("n")
    told = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n")), "forms")
    roots = _roots(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
