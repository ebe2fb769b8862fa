"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of labelled texts, with the text's language
as the label of every byte. A text is read whole, in segments; every position gets label probabilities from both
directions, and a document's probabilities are their mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of

HIDDEN = 8  # units in each direction
SEGMENT = 128  # bytes over which a state runs
TOGETHER = 4096  # segments read at a time
DOCS = 400  # texts of each language to learn from, at most
WINDOWS = 4  # windows of each of these texts
EPOCHS, BATCH, RATE = 10, 64, 0.01


def _gru(p: np.ndarray, u: np.ndarray, steps: range, keep: list | None = None) -> np.ndarray:
    """States at every step, for inputs p (steps x sequences x 3 * hidden): gates update and reset, then candidate."""
    n, h = p.shape[1], u.shape[0]
    state, out = np.zeros((n, h), np.float32), np.empty((p.shape[0], n, h), np.float32)
    for t in steps:
        g = np.tanh(0.5 * (p[t, :, : 2 * h] + state @ u[:, : 2 * h])) * 0.5 + 0.5
        z, r = g[:, :h], g[:, h:]
        c = np.tanh(p[t, :, 2 * h :] + (r * state) @ u[:, 2 * h :])
        if keep is not None:
            keep.append((t, state, z, r, c))
        state = state + z * (c - state)
        out[t] = state
    return out


@dataclass
class LanguageModel:
    labels: list[str]
    params: dict[str, np.ndarray]

    def _states(self, segments: np.ndarray, tape: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        steps, w = segments.shape[1], self.params
        both = []
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            keep = None if tape is None else tape.setdefault(side, [])
            both.append(_gru(w["in_" + side][segments.T], w["u_" + side], order, keep))
        return both[0], both[1]

    def probabilities(self, segments: np.ndarray) -> np.ndarray:
        """Label probabilities of every position: segments x steps x labels."""
        f, b = self._states(segments)
        x = np.concatenate((f, b), axis=2) @ self.params["out"] + self.params["bias"]
        x = np.exp(x - x.max(axis=2, keepdims=True))
        return (x / x.sum(axis=2, keepdims=True)).transpose(1, 0, 2)

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean label probabilities over all bytes of each text; a text without bytes gets zeros."""
        total = np.zeros((len(texts), len(self.labels)))
        size = np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def read() -> None:
            segments = np.concatenate([s for _, s in held])
            owner = np.concatenate([np.full(len(s), k) for k, s in held])
            for at in range(0, len(segments), TOGETHER):
                part = segments[at : at + TOGETHER]
                p = (self.probabilities(part) * (part != 0)[:, :, None]).sum(axis=1)
                np.add.at(total, owner[at : at + TOGETHER], p)
            held.clear()

        rows = 0
        for k, text in enumerate(texts):
            data = np.frombuffer((text or "").replace("\0", " ").encode(), np.uint8)
            size[k] = len(data)
            for at in range(0, len(data), SEGMENT * TOGETHER):
                part = data[at : at + SEGMENT * TOGETHER]
                held.append((k, np.pad(part, (0, -len(part) % SEGMENT)).reshape(-1, SEGMENT)))
                rows += len(held[-1][1])
                if rows >= TOGETHER:
                    read()
                    rows = 0
        if held:
            read()
        return total / np.maximum(size, 1)[:, None]

    def column(self, unknown: str) -> Callable[[Column], Column]:
        @F.pandas_udf("lang string, score double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                text = [t or "" for t in texts]
                readable = np.array([any(map(str.isalpha, t)) for t in text], bool)
                p = self.documents(text) if len(text) and self.labels else np.zeros((len(text), 1))
                best = p.argmax(axis=1)
                names = np.array([*self.labels, unknown], object)
                known = readable & (len(self.labels) > 0)
                yield pd.DataFrame({"lang": names[np.where(known, best, len(self.labels))], "score": np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)})

        return predict


def train(segments: np.ndarray, target: np.ndarray, labels: list[str], seed: int = 3, epochs: int = EPOCHS) -> LanguageModel:
    """Backpropagation through time over windows of bytes (0 pads), each with one label; Adam."""
    rng, h, k = np.random.default_rng(seed), HIDDEN, len(labels)
    w = {}
    for side in "fb":
        w["in_" + side] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        w["u_" + side] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
    w["out"], w["bias"] = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32), np.zeros(k, np.float32)
    model = LanguageModel(labels, w)
    m, v, step = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(segments))
        for at in range(0, len(order), BATCH):
            x, y = segments[order[at : at + BATCH]], target[order[at : at + BATCH]]
            tape: dict = {}
            f, b = model._states(x, tape)
            s = np.concatenate((f, b), axis=2)
            logit = s @ w["out"] + w["bias"]
            p = np.exp(logit - logit.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            p[:, np.arange(len(y)), y] -= 1
            d = p * ((x.T != 0)[:, :, None] / max(1, np.count_nonzero(x))).astype(np.float32)
            g = {n: np.zeros_like(a) for n, a in w.items()}
            g["out"], g["bias"] = np.einsum("tni,tnk->ik", s, d), d.sum(axis=(0, 1))
            ds = d @ w["out"].T
            for side, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
                u, back = w["u_" + side], np.zeros((len(y), h), np.float32)
                for t, before, z, r, c in reversed(tape[side]):
                    dh = part[t] + back
                    dz, dc = dh * (c - before) * z * (1 - z), dh * z * (1 - c * c)
                    dr_in = dc @ u[:, 2 * h :].T
                    dr = dr_in * before * r * (1 - r)
                    gates = np.concatenate((dz, dr), axis=1)
                    g["u_" + side][:, : 2 * h] += before.T @ gates
                    g["u_" + side][:, 2 * h :] += (r * before).T @ dc
                    np.add.at(g["in_" + side], x[:, t], np.concatenate((gates, dc), axis=1))
                    back = dh * (1 - z) + gates @ u[:, : 2 * h].T + dr_in * r
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for n in w:
                grad = g[n] * min(1.0, 1.0 / max(norm, 1e-9))
                m[n], v[n] = 0.9 * m[n] + 0.1 * grad, 0.999 * v[n] + 0.001 * grad * grad
                w[n] -= (RATE * (0.9**epoch) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit_language(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1, docs_per_label: int = DOCS, seed: int = 5) -> LanguageModel:
    """Learn from rows with a label whose fold (crc32 of the id as text, modulo folds) isn't held_fold.

    Of each label at most docs_per_label texts are used, those with the least seeded hash, and of each text WINDOWS
    windows of SEGMENT bytes spread over the whole of it: this bound, by the number of labels, is what the driver
    gets, and a count for each label. Rows with a null id, label or text, or a blank text, aren't learned from. Without any, nothing is known.
    """
    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("body"), F.xxhash64(F.lit(seed), id_col, text_col).alias("rank"), fold_of(id_col, folds).alias("fold"))
    rows = rows.filter(F.col("label").isNotNull() & (F.col("fold") != held_fold) & (F.trim("body") != ""))
    # Twice as many rows as are wanted come below these ranks, so what meets in a label's task doesn't grow with the table.
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {})
    most = [F.lit(x) for label, n in sizes.items() for x in (label, min(2**63 - 1, -(2**63) + 2**64 * (2 * docs_per_label + 50) // n))]
    rows = rows.filter(F.col("rank") <= F.try_element_at(F.create_map(*most), F.col("label")))
    data, n = F.col("body").cast("binary"), F.octet_length("body")
    starts = [(F.greatest(n - SEGMENT, F.lit(0)) * k / (WINDOWS - 1)).cast("int") + 1 for k in range(WINDOWS)]
    windows = rows.select("label", "rank", F.array(*[F.substring(data, s, F.lit(SEGMENT)) for s in starts]).alias("windows"))
    top = windows.withColumn("row", F.row_number().over(Window.partitionBy("label").orderBy("rank"))).filter(F.col("row") <= docs_per_label).drop("row").toPandas()
    top = top.sort_values(["label", "rank"])
    labels = sorted(set(top["label"]))
    segments, target = [], []
    for label, parts in zip(top["label"], top["windows"], strict=True):
        for part in {bytes(x): None for x in parts}:
            segments.append(np.frombuffer(part.replace(b"\0", b" ").ljust(SEGMENT, b"\0"), np.uint8))
            target.append(labels.index(label))
    if not segments:
        return LanguageModel([], {})
    return train(np.stack(segments), np.array(target), labels)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """id, lang_pred, score of every row from its whole text alone.

    A null text, or one without a letter, is `unknown` with score 0, as is every text if nothing was learned. The score
    is the predicted label's mean probability over the text's bytes. Rows that repeat get equal results; no rows give
    no rows. Other columns are not read.
    """
    found = docs.select(F.col(id_col).alias("id"), model.column(unknown)(F.col(text_col).cast("string")).alias("p"))
    return found.select(F.col("id").alias(id_col), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
