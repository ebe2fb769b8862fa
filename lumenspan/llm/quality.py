"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The random features approximate a Gaussian kernel. Each partition sums its share of the normal equations; the sums are
added and solved once. The ridge score is calibrated on a fold of its own by pooling adjacent violators.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of

STATISTICS = 24  # numbers that describe a text
FEATURES = 256  # random Fourier features
RIDGE = 1e-3  # penalty, for each labelled row
SAMPLE = 40_000  # labelled rows that a model is fitted on, at most (about)
PARTS = 8  # partitions that sum normal equations
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"([^\w\s])\1+")


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; all 0 for an empty one but the last, which says so."""
    words = _WORD.findall(text)
    if not words:
        return [0.0] * (STATISTICS - 1) + [1.0]
    n, chars = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    spaces = sum(map(str.isspace, text))
    marks = chars - letters - digits - spaces
    lengths = np.fromiter(map(len, words), float, n)
    runs = _RUN.findall(text)
    plain = sum(text.count(c) for c in ".,;:?'\"()-")
    ends = text.count(".") + text.count("!") + text.count("?")
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(chars), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        letters / chars, upper / max(1, letters), digits / chars, spaces / chars, marks / chars, (marks - plain) / chars,
        len(runs) / n, text.count("!") / n, text.count("|") / n, ends / n,
        len(counts) / n ** 0.8, max(counts.values()) / n, pairs / max(1, n - 1),
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(w.isdigit() for w in words) / n, sum(c in text for c in ("http", "@", "=", "{", "<")) / 5, 0.0,
    ]


@dataclass
class QualityModel:
    """All that a score needs: a few arrays of a size that doesn't depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # ridge scores, ascending
    levels: np.ndarray  # calibrated scores at the steps

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phase)) * np.cos((np.clip((x - self.mean) / self.scale, -6, 6)) @ self.waves + self.phase)

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([statistics(t or "") for t in texts], float).reshape(-1, len(self.mean))
        return self.calibrated(self.raw(x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights[:-1] + self.weights[-1]

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.steps, self.levels)

    def column(self) -> Callable[[Column], Column]:
        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series(self.score(texts.tolist()))

        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and means, which rise; a prior row of each label keeps them inside 0 and 1."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + t, blocks[-1][2] + n]
    centre = np.array([s / n for s, _, n in blocks])
    level = np.array([(t + 0.5 * 0.01) / (n + 0.01) for _, t, n in blocks])
    return centre, np.maximum.accumulate(level)


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0, calibration_fold: int = 1, sample: int = SAMPLE, seed: int = 11) -> QualityModel:
    """Learn from labelled rows whose fold (crc32 of the id as text, modulo folds) isn't held_fold.

    At most about `sample` labelled rows are used, chosen by a hash of the id; their ids are broadcast, which this bounds.
    A null id or label isn't learned from; of several labels of an id the greatest holds. With rows of one label, or
    none, the model gives that label (or 0.5) to every text. The rows of calibration_fold only calibrate.
    """
    known = labels.filter(F.col(label_col).isNotNull() & (fold_of(id_col, folds) != held_fold)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    fold = fold_of("id", folds)
    describe = F.pandas_udf(lambda texts: pd.Series([statistics(t or "") for t in texts]), "array<double>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).join(F.broadcast(known), "id").select(describe("body").alias("x"), "y", (fold == calibration_fold).alias("calibrates"))
    rows = cut(rows, "labelled").coalesce(PARTS)
    moments = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[a for k in range(STATISTICS) for a in (F.avg(F.col("x")[k]), F.stddev_pop(F.col("x")[k]))]).first()
    if not moments["n"] or moments["y"] in (0.0, 1.0):
        level = 0.5 if not moments["n"] else moments["y"]
        flat = np.zeros(STATISTICS)
        return QualityModel(flat, flat + 1, np.zeros((STATISTICS, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.array([level]))
    mean, spread = np.array(moments[2::2], float), np.array(moments[3::2], float)
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = np.column_stack((model.features(np.stack(batch["x"].to_list())), np.ones(len(batch)))) if len(batch) else np.zeros((0, FEATURES + 1))
            a += z.T @ z
            b += z.T @ batch["y"].to_numpy(float)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    parts = rows.filter(~F.col("calibrates")).mapInPandas(sums, "a binary, b binary").toPandas()
    a = sum(np.frombuffer(p, float).reshape(FEATURES + 1, -1) for p in parts["a"])
    b = sum(np.frombuffer(p, float) for p in parts["b"])
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.diag([1.0] * FEATURES + [0.0]) / FEATURES + 1e-9 * np.eye(FEATURES + 1), b)
    check = rows.filter("calibrates").toPandas()
    if len(check):
        model.steps, model.levels = isotonic(model.raw(np.stack(check["x"].to_list())), check["y"].to_numpy(float))
    else:  # nothing to calibrate on: the ridge score itself, cut to 0 and 1
        model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score (0 to 1), predicted (1 from threshold on) of every row, from its whole text alone.

    Null and empty texts get the score of an empty text. Rows that repeat get equal scores. No rows give no rows.
    """
    scored = docs.select(F.col(id_col).alias("id"), model.column()(F.col(text_col).cast("string")).alias("score"))
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
