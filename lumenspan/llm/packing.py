"""Packing of tokenised documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). A piece goes
to the open sequence that can take it under every constraint and whose residual vector, after taking it, has the
smallest weighted norm (or, with rule="dot", whose residual has the largest weighted dot product with the piece). The
pieces are dealt evenly to groups that are packed independently; a group wastes at most about one sequence.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import cut

#: Entries that each of a tokenising worker's memories holds, in each of two generations.
REMEMBER = 500_000
_CHUNK = re.compile(r"[^\x09-\x0D\x20]+")
_PLAIN = re.compile(r"[\x09-\x0D\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^\\sa-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")


class Memory:
    """A bounded memory of a function from strings: when the young generation is full it becomes the old one."""

    def __init__(self, of):
        self.of, self.young, self.old = of, {}, {}

    def get(self, key: str) -> bytes:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.of(key)
            if len(self.young) >= REMEMBER:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got

    def all(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.young.get, keys))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self.get(keys[at])
        return found


class WordIds:
    """Token ids of texts, with chunks between white space and pieces of words remembered.

    The tokenizer drops white space and never merges over it or over the borders of its word pieces, so a text's ids are
    those of its pieces in order. Texts and chunks of printable ASCII and Latin-1 letters are cut here, by the tokenizer's own
    pattern, and their pieces go to the model; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))}
        self.pieces, self.chunks = Memory(self._piece), Memory(self._chunk)

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.spelled))
        return array("I", [t.id for t in found]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.pieces.get(chunk.lower())
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(self.pieces.all(_PIECE.findall(chunk.lower())))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return np.frombuffer(b"".join(self.pieces.all(_PIECE.findall(text.lower()))), "<u4")
        return np.frombuffer(b"".join(self.chunks.all(_CHUNK.findall(text))), "<u4")


_tokenizers: dict[str, WordIds] = {}


def tokenizer(path: str) -> WordIds:
    """One per worker and file, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of every document's token ids (with end_id last): id, piece, start, length, ids_crc32; null text is empty.

    Only documents of more than `capacity` ids are cut, into pieces of `capacity` of which the last may be shorter.
    """
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL("piece int, start long, length long, ids_crc32 long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            for k, text in enumerate(batch["body"].to_pylist()):
                ids = np.append(words.ids(text or ""), np.uint32(end_id)).astype("<u4")
                rows += [(k, p, s, len(part := ids[s : s + capacity]), zlib.crc32(part.tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
            at, *columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at)), *(pa.array(c).cast(f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int, most_docs: int, most_cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths must come longest first. Each alone must fit."""
    caps = np.array([capacity, most_docs, most_cost], float)
    w = np.array(weights, float)
    left, used, number = np.empty((64, 3)), np.empty(64, np.int64), np.empty(64, np.int64)
    open_bins = made = 0
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    floor = int(lengths[-1]) if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        fits = np.flatnonzero((left[:open_bins] >= need).all(axis=1))
        if len(fits):
            rest = left[fits]
            if rule == "dot":
                b = fits[np.argmax((rest / caps * (need / caps)) @ w)]
            else:
                b = fits[np.argmin((((rest - need) / caps) ** 2) @ w)]
        else:
            if open_bins == len(left):
                left, used, number = np.resize(left, (2 * open_bins, 3)), np.resize(used, 2 * open_bins), np.resize(number, 2 * open_bins)
            b, open_bins = open_bins, open_bins + 1
            left[b], used[b], number[b] = caps, 0, made
            made += 1
        at[i], offset[i] = number[b], used[b]
        used[b] += n
        left[b] -= need
        if left[b, 0] < floor or left[b, 1] < 1 or left[b, 2] < float(floor) * floor:  # nothing more can fit
            open_bins -= 1
            left[b], used[b], number[b] = left[open_bins], used[open_bins], number[open_bins]
    return at, offset


def pack(pieces: DataFrame, capacity: int = 4096, most_docs: int | None = None, most_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), group: int = 20_000) -> DataFrame:
    """Add sequence_id and offset (gapless from 0) to pieces.

    most_docs defaults to capacity and most_cost to capacity squared, the most that sequences of `capacity` tokens can
    reach, so that only tokens bind; a piece that alone exceeds a limit is an error. Rows that repeat are packed as
    often as they occur. `group` pieces are packed together; `pieces` is a written table, and dealing by its row numbers
    keeps the groups even whatever the ids are.
    """
    most_docs, most_cost = most_docs or capacity, most_cost or capacity**2
    groups = max(1, round(pieces.count() / group))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        n = rows["length"].to_numpy()
        if len(n) and (n[0] > capacity or float(n[0]) ** 2 > most_cost):
            raise ValueError("a piece is larger than a sequence may be")
        at, offset = best_fit(n, capacity, most_docs, most_cost, rule, weights)
        return rows.assign(sequence_id=(int(rows["deal"].iloc[0]) << 32) + at, offset=offset).drop(columns="deal")

    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    fields = ", ".join(f"`{k}` {t}" for k, t in pieces.dtypes)
    return dealt.groupBy("deal").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, **options) -> DataFrame:
    """Tokenise, cut and pack: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty, and an empty document is its end id alone. Null ids stay null. Other columns are not read,
    whatever their names. An empty table gives no rows. Rows that repeat are packed each.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    return pack(pieces, capacity, **options).withColumnRenamed("id", id_col)
