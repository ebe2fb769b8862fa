"""Licence notices in texts, with a few edits: exact seeds locate candidates, bounded-error matching verifies them.

A notice that stands in a text with at most k edits has, cut into k + 1 pieces, at least one piece there unchanged
(pigeonhole). All pieces of all notices are looked for at once; around each one found, the regex library matches the
notice with bounded errors between word ends. So the costly matching sees only short windows, and no place is missed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import text_of


@dataclass(frozen=True)
class Notice:
    """A notice in words of lower case with single blanks: `fixed` stands unchanged, the rest with at most `edits` edits."""

    label: str
    fixed: str
    rest: str
    edits: int
    base: bool = False

    def __post_init__(self):
        if len(self.rest) <= 4 * self.edits + 2 or self.fixed and not self.fixed.endswith(" "):
            raise ValueError(f"too short for its edits, or fixed words without a blank behind: {self}")

    @property
    def text(self) -> str:
        return self.fixed + self.rest

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def seeds(self) -> list[tuple[str, int]]:
        """The pieces of the rest, of which at least one is unchanged, and where each ends in the notice."""
        cuts = [len(self.rest) * p // (self.edits + 1) for p in range(self.edits + 2)]
        return [(self.rest[a:b], len(self.fixed) + b) for a, b in zip(cuts, cuts[1:], strict=False)]


# Short notices and the label of each.
NOTICES = (
    Notice("mit", "mit ", "license", 1, True),
    Notice("apache", "apache ", "license", 1, True),
    Notice("gpl", "", "general public license", 2, True),
    Notice("cc", "", "licensed under cc by", 1),
    Notice("cc", "", "creative commons", 1),
    Notice("mpl", "", "mozilla public license", 2),
    Notice("bsd", "", "redistribution and use in source and binary forms", 4),
    Notice("mit", "", "permission is hereby granted free of charge", 4),
)

#: A-Z becomes a-z; what stands between words becomes a blank. Bytes beyond ASCII belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PLACE = StructType([StructField(n, t) for n, t in (("label", StringType()), ("notice", IntegerType()), ("edits", IntegerType()), ("first_word", LongType()), ("n_words", IntegerType()), ("start", LongType()), ("end", LongType()), ("likeness", DoubleType()))])
SCANNED = StructType([StructField("n_words", LongType()), StructField("places", ArrayType(PLACE))])


class Scanner:
    """Finds the notices in a text."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        self.matchers = [regex.compile(rf"(?b)(?<= ){regex.escape(n.fixed, literal_spaces=True)}(?:{regex.escape(n.rest, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in notices]
        seeds = defaultdict(list)
        for k, n in enumerate(notices):
            for piece, end in n.seeds:
                seeds[piece].append((k, end))
        self.seeds = ahocorasick.Automaton()
        for piece, ends in seeds.items():
            self.seeds.add_word(piece, ends)
        self.seeds.make_automaton()

    def matches(self, line: str) -> list[tuple[int, int, int, int]]:
        """edits, start, end, notice in a line of words with a blank on both sides of each; of overlapping ones the best."""
        found, seen = set(), set()
        for last, ends in self.seeds.iter(line):
            for k, end in ends:
                at = last + 1 - end  # where the notice starts if nothing before the piece is edited
                if (k, at) in seen:
                    continue
                seen.add((k, at))
                n = self.notices[k]
                low = max(0, at - n.edits - 1)
                window = line[low : max(0, at) + len(n.text) + n.edits + 1]
                if n.fixed and f" {n.fixed}" not in window:
                    continue
                m = self.matchers[k].search(window)
                if m:
                    found.add((sum(m.fuzzy_counts), low + m.start(), low + m.end(), k))
        kept: list[tuple[int, int, int, int]] = []
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of each notice, apart and in order
        for x in sorted(found):
            own = ends[x[3]]
            p = bisect_right(own, (x[1], x[2]))
            if (p == 0 or own[p - 1][1] <= x[1]) and (p == len(own) or own[p][0] >= x[2]):
                own.insert(p, (x[1], x[2]))
                kept.append(x)
        return sorted(kept, key=lambda x: (x[1], x[2], x[3]))

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        words = text.encode().translate(_FOLD).split()
        line = f" {b' '.join(words).decode()} "
        matches = self.matches(line)
        if not matches:
            return len(words), []
        starts, at = [], 1
        for w in words:
            starts.append(at)
            at += len(w.decode()) + 1
        spans = [m.span() for m in _WORD.finditer(text)]
        places = []
        for edits, start, end, k in matches:
            first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
            n = self.notices[k]
            places.append((n.label, k, edits, first, last - first + 1, spans[first][0], spans[last][1], 1 - edits / len(n.text)))
        return len(words), places


def scan_notices(docs: DataFrame, text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """docs with n_words and places: label, number of the notice, edits, first_word, n_words, start and end in the text
    (code points), likeness (1 less the edits for each character of the notice), in the order of the text.

    Places of different notices may overlap; of overlapping ones of one notice the one with the fewest edits counts, then
    the first. A null or empty text has no words and no places; repeated rows are scanned alike. Each text is scanned
    whole and alone, in linear time but for the places, so no rows meet and long texts or hot groups need no care. Columns
    of docs named n_words or places are replaced.
    """
    scanner: list[Scanner] = []  # made once in each worker: automata aren't sent

    @F.pandas_udf(SCANNED)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not scanner:
            scanner.append(Scanner(notices))
        return pd.DataFrame([scanner[0].scan(t) for t in texts], columns=["n_words", "places"])

    made = docs.withColumn("__scan", scan(text_of(text_col)))
    return made.withColumns({"n_words": F.col("__scan.n_words"), "places": F.col("__scan.places")}).drop("__scan")
