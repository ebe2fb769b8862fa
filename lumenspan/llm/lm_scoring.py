"""Masked pseudo-likelihood by a bidirectional window network over the tokens of a public tokenizer.

The network predicts every token from the tokens on both sides: the vectors of the SPAN tokens before and after, each
scaled by its place, are added and squashed, and a two-step softmax (class, then token of the class) gives the masked
token's probability. Every token of the vocabulary has a class, a vector and a probability of its own. Tokens are ranked
by how often the corpus has them, and a class that starts at a token of probability p has 1 / sqrt(p) tokens, which
makes the two steps short. A document's score is the sum of the log-probabilities of all its tokens.

It is trained in numpy, on every position of every text, in ROUNDS rounds. A hash of id and text deals each document to a
round and to one of the round's shards, whose number grows with the corpus; so shards don't depend on how the input is
split. In a round, every shard starts from the same parameters and learns from its own positions. What the shards changed
is averaged row by row, weighted by how often a shard met the row, so that rare tokens learn from all that met them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import cut
from .packing import tokenizer

SPAN = 2  # tokens on each side
SIDES = (*range(-SPAN, 0), *range(1, SPAN + 1))
HIDDEN = 16
BLOCK, TOGETHER = 64, 256  # positions of a block, blocks of a step
ROUNDS = 4  # each document takes part in one of them
SHARD = 1_000_000  # tokens that a shard of a round has, on average
RATE = 0.1
LARGEST = 3.0  # of any weight, and 8 times that of any bias: keeps all logits in the range of single precision
SLICE = 256  # rows of parameters that are averaged together
FAN_IN = 32  # shards whose slice a task averages
KINDS = ("ins", "side", "bias", "cw", "cb", "ww", "wb")


def class_edges(p: np.ndarray) -> np.ndarray:
    """Where classes start, for tokens with probabilities p, largest first."""
    edges = [0]
    while edges[-1] < len(p):
        edges.append(min(len(p), edges[-1] + max(1, round(1 / np.sqrt(p[edges[-1]])))))
    return np.array(edges)


@dataclass
class WindowModel:
    rank: np.ndarray  # of every token of the vocabulary; those that the corpus doesn't have come last
    edges: np.ndarray  # of the classes, over ranks; the last class is that of the tokens it doesn't have
    params: dict[str, np.ndarray]
    learned: int = 0  # positions that it was trained on

    def __post_init__(self) -> None:
        self.known = len(self.params["ww"])
        self.wall = len(self.rank)  # the rank of what is beyond an end
        self.of_class = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))

    def blocks(self, docs: list[np.ndarray]) -> np.ndarray:
        """The ranks of all documents as overlapping rows: BLOCK positions with SPAN neighbours on both sides."""
        wall = np.full(SPAN, self.wall)
        line = np.concatenate([wall, *(x for t in docs for x in (self.rank[t], wall))]).astype(np.uint16 if self.wall < 1 << 16 else np.uint32)
        line = np.concatenate([line, np.full(-(len(line) - 2 * SPAN) % BLOCK, self.wall, line.dtype)])
        return np.lib.stride_tricks.sliding_window_view(line, BLOCK + 2 * SPAN)[::BLOCK]

    def _rows(self, blocks: np.ndarray) -> np.ndarray:
        """Rows of the input vectors: those of known tokens, and a last one for all else."""
        return np.minimum(blocks, blocks.dtype.type(self.known) + (blocks == self.wall)) if self.known + 1 < self.wall else blocks

    def _hidden(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors, the squashed sum x / sqrt(1 + x * x) of every position, and that root; a row for each block."""
        inner = self.params["ins"].take(rows, axis=0).reshape(len(rows), -1)
        x = inner[:, _near(-SPAN)] * np.tile(self.params["side"][0], BLOCK)
        root = np.empty_like(x)
        for k, d in enumerate(SIDES[1:], 1):
            x += np.multiply(inner[:, _near(d)], np.tile(self.params["side"][k], BLOCK), out=root)
        x += np.tile(self.params["bias"], BLOCK)
        np.multiply(x, x, out=root)
        root += 1
        np.sqrt(root, out=root)
        x /= root
        return inner, x, root

    def _targets(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the positions in order of rank, and their places; walls are none."""
        t = blocks[:, SPAN : SPAN + BLOCK].ravel()
        order = np.argsort(t, kind="stable")
        t = t[order]
        n = int(np.searchsorted(t, self.wall))
        return t[:n].astype(np.int64), order[:n]

    def _words(self, t: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Of each class with more than one token that t, in order, has: its ranks and its rows."""
        cuts = np.searchsorted(t, self.edges)
        for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(self.edges) > 1)).tolist():
            yield self.edges[k], self.edges[k + 1], cuts[k], cuts[k + 1]

    def log_probabilities(self, blocks: np.ndarray) -> np.ndarray:
        """Of every position of the blocks; 0 at walls."""
        p = self.params
        _, hidden, _ = self._hidden(self._rows(blocks))
        t, order = self._targets(blocks)
        h = hidden.reshape(-1, HIDDEN).take(order, axis=0)
        found = _log_softmax(h @ p["cw"].T + p["cb"], self.of_class[t])
        for lo, hi, a, z in self._words(t):
            if hi > self.known:  # never seen: all the same
                found[a:z] -= np.log(hi - lo)
            else:
                found[a:z] += _log_softmax(h[a:z] @ p["ww"][lo:hi].T + p["wb"][lo:hi], t[a:z] - lo)
        out = np.zeros(len(blocks) * BLOCK, np.float32)
        out[order] = found
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The summed log-probabilities of each document's tokens."""
        blocks = self.blocks(docs)
        each = np.concatenate([np.zeros(0, np.float32), *(self.log_probabilities(blocks[k : k + TOGETHER]) for k in range(0, len(blocks), TOGETHER))]).astype(np.float64)
        sums = np.concatenate([[0.0], np.cumsum(each)])
        sizes = np.array([len(t) for t in docs], np.int64)
        ends = np.cumsum(sizes + SPAN) - SPAN
        return sums[ends] - sums[ends - sizes]


def _near(d: int) -> slice:
    """Of a block's input vectors in one row, those at distance d of its positions."""
    return slice((SPAN + d) * HIDDEN, (SPAN + d + BLOCK) * HIDDEN)


def _log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = x[np.arange(len(at)), at]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], np.float32))


def _less_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The softmax less 1 at the right places: the slope of the negative log-probability."""
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
    x[np.arange(len(at)), at] -= 1
    return x


class Learner:
    """A model's own copy and how much each row of it was moved (adaptive steps)."""

    def __init__(self, model: WindowModel):
        self.model = WindowModel(model.rank, model.edges, {k: v.copy() for k, v in model.params.items()})
        self.moved = {k: np.zeros(v.shape[:1] if k in ("ins", "side", "cw", "ww") else v.shape, np.float32) for k, v in model.params.items()}

    def slopes(self, blocks: np.ndarray) -> list[tuple[str, object, np.ndarray]]:
        """(parameter, rows, slope of the summed negative log-probability) of the blocks."""
        model, p = self.model, self.model.params
        rows = model._rows(blocks)
        inner, hidden, root = model._hidden(rows)
        t, order = model._targets(blocks)
        h = hidden.reshape(-1, HIDDEN).take(order, axis=0)
        one, every = np.ones(len(t), np.float32), slice(None)
        e = _less_softmax(h @ p["cw"].T + p["cb"], model.of_class[t])
        dh = e @ p["cw"]
        found = [("cw", every, e.T @ h), ("cb", every, one @ e)]
        last = next((hi for lo, hi, _, _ in reversed(list(model._words(t))) if hi <= model.known), 0)
        dw, db = np.zeros((last, HIDDEN), np.float32), np.zeros(last, np.float32)
        for lo, hi, a, z in model._words(t):
            if hi <= model.known:
                own = h[a:z]
                e = _less_softmax(own @ p["ww"][lo:hi].T + p["wb"][lo:hi], t[a:z] - lo)
                dh[a:z] += e @ p["ww"][lo:hi]
                np.matmul(e.T, own, out=dw[lo:hi])
                np.matmul(one[: z - a], e, out=db[lo:hi])
        found += [("ww", slice(0, last), dw), ("wb", slice(0, last), db)]
        dx = np.zeros_like(hidden)
        flat = dx.reshape(-1, HIDDEN)
        flat[order] = dh
        np.multiply(root, root, out=hidden)
        hidden *= root
        dx /= hidden
        found.append(("bias", every, dx.sum(axis=0).reshape(BLOCK, HIDDEN).sum(axis=0)))
        back, by_side = np.zeros_like(inner), np.empty_like(p["side"])
        for k, d in enumerate(SIDES):
            back[:, _near(d)] += np.multiply(dx, np.tile(p["side"][k], BLOCK), out=root)
            by_side[k] = np.multiply(dx, inner[:, _near(d)], out=root).sum(axis=0).reshape(BLOCK, HIDDEN).sum(axis=0)
        found.append(("side", every, by_side))
        v = rows.ravel()
        order = np.argsort(v, kind="stable")
        v = v[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        found.append(("ins", v[first], np.add.reduceat(back.reshape(-1, HIDDEN).take(order, axis=0), first)))
        return found

    def step(self, blocks: np.ndarray, rate: float) -> None:
        for name, at, slope in self.slopes(blocks):
            moved, param = self.moved[name], self.model.params[name]
            if moved.ndim == param.ndim:
                moved[at] += slope * slope
                param[at] = np.clip(param[at] - rate * slope / np.sqrt(moved[at] + 1e-6), -8 * LARGEST, 8 * LARGEST)
            else:
                moved[at] += (slope * slope).mean(axis=1)
                param[at] = np.clip(param[at] - slope * (rate / np.sqrt(moved[at] + 1e-6))[:, None], -LARGEST, LARGEST)

    def learn(self, docs: list[np.ndarray], rate: float, seed: int) -> None:
        """From every position once, in blocks in an order by seed."""
        blocks = self.model.blocks(docs)
        order = np.random.default_rng(seed).permutation(len(blocks))
        for at in range(0, len(order), TOGETHER):
            self.step(blocks[order[at : at + TOGETHER]], rate)


def fresh(counts: np.ndarray, seed: int = 1) -> WindowModel:
    """A network that knows how frequent each token of the vocabulary is, and nothing of its neighbours."""
    order = np.argsort(-counts, kind="stable")
    known = int(np.count_nonzero(counts))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = counts[order[:known]].astype(float)
    edges = class_edges(n / max(n.sum(), 1))
    mass = np.append(np.add.reduceat(n, edges[:-1]) if known else [], [1.0] if known < len(order) else [])
    within = n / np.repeat(mass[: len(edges) - 1], np.diff(edges))
    if known < len(order):
        edges = np.append(edges, len(order))
    rng = np.random.default_rng(seed)
    shapes = {"ins": (known + 2, HIDDEN), "side": (2 * SPAN, HIDDEN), "cw": (len(edges) - 1, HIDDEN), "ww": (known, HIDDEN)}
    params = {k: rng.normal(0, {"ins": 0.3, "side": 1.0}.get(k, 0.1), s).astype(np.float32) for k, s in shapes.items()}
    params |= {"bias": np.zeros(HIDDEN, np.float32), "cb": np.log(mass / mass.sum()).astype(np.float32), "wb": np.log(within).astype(np.float32)}
    return WindowModel(rank, edges, {k: params[k] for k in KINDS})


def _table(params: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters as rows of equal length."""
    parts = {k: v if v.ndim == 2 else np.pad(v, (0, -len(v) % HIDDEN)).reshape(-1, HIDDEN) for k, v in params.items()}
    return np.concatenate([parts[k] for k in KINDS])


def _from_table(table: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in KINDS:
        n = len(like[k]) if like[k].ndim == 2 else -(-len(like[k]) // HIDDEN)
        part = table[at : at + n]
        out[k] = part.copy() if like[k].ndim == 2 else part.ravel()[: len(like[k])].copy()
        at += n
    return out


def _met(model: WindowModel, docs: list[np.ndarray]) -> np.ndarray:
    """How often the documents' positions meet each row of the table."""
    ranks = np.bincount(model.rank[np.concatenate(docs)], minlength=len(model.rank)) if docs else np.zeros(len(model.rank))
    total, known = float(ranks.sum()), ranks[: model.known]
    by_class = np.add.reduceat(ranks, model.edges[:-1])
    ins = np.concatenate([known, [total, total]])
    ww = by_class[model.of_class[: model.known]]
    wb = np.pad(ww, (0, -len(ww) % HIDDEN)).reshape(-1, HIDDEN).max(axis=1)
    rest = {"side": 2 * SPAN, "bias": 1, "cw": len(by_class), "cb": -(-len(by_class) // HIDDEN)}
    return np.concatenate([{"ins": ins, "ww": ww, "wb": wb}.get(k, np.full(rest.get(k, 0), total)) for k in KINDS]).astype(np.float64)


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, deal (hash of id and text), n_tokens, ids (little-endian binary) of every row's whole text, written."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL("deal long, n_tokens long, ids binary")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        narrow = "<u2" if words.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            ids = [words.ids(t or "").astype(narrow) for t in batch["body"].to_pylist()]
            columns = [batch["id"], batch["deal"], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    body = F.col(text_col).cast("string")
    return cut(docs.select(F.col(id_col).alias("id"), body.alias("body"), F.xxhash64(F.col(id_col), body).alias("deal")).mapInArrow(run, schema), "tokens")


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def count_tokens(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often the table has each token: one row for each token and task is shuffled, one for each token gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data, n in zip(batch["ids"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
                counts += np.bincount(_ids(data, n), minlength=vocabulary)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["token", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in tokens.filter("n_tokens > 0").select("ids", "n_tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    return counts


def train(tokens: DataFrame, vocabulary: int, shard: int = SHARD) -> WindowModel:
    """Learn from all rows of a table of tokens, each position once. Without a token anywhere, the model is the fresh one.

    The driver holds one set of parameters, whose size the vocabulary bounds.
    """
    spark = tokens.sparkSession
    counts = count_tokens(tokens, vocabulary)
    model, total = fresh(counts), int(counts.sum())
    if not total:
        return model
    shards = -(-total // (ROUNDS * shard))
    dealt = tokens.filter("n_tokens > 0").select(F.pmod("deal", F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftrightunsigned("deal", ROUNDS.bit_length()), F.lit(shards)).alias("shard"), "deal", "n_tokens", "ids")
    for k in range(ROUNDS):
        learnt = dealt.filter(F.col("round") == k).repartition(2 * shards, "shard").groupBy("shard").applyInPandas(_learn(spark.sparkContext.broadcast(model), k), _CHANGE)
        changes = cut(learnt, "changes")
        model.learned += changes.groupBy("part").agg(F.max("learned").alias("n")).agg(F.sum("n")).first()[0] or 0
        table = _table(model.params)
        for r in _averaged(changes, shards).collect():
            at = np.frombuffer(r["at"], "<i4")
            table[at] += np.frombuffer(r["change"], np.float16).reshape(-1, HIDDEN).astype(np.float32)
        model.params = _from_table(table, model.params)
    return model


def _learn(given: Broadcast, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a shard of round k changes in the parameters, in slices of rows, with how often it met each row."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        docs = [_ids(x, n) for _, x, n in sorted(zip(rows["deal"], rows["ids"], rows["n_tokens"], strict=True))]
        part, learner = int(rows["shard"].iloc[0]), Learner(given.value)
        learner.learn(docs, RATE / (1 + k), part)
        change = (_table(learner.model.params) - _table(given.value.params)).astype(np.float16)
        met, out = _met(given.value, docs), []
        for s in range(0, len(met), SLICE):
            at = s + np.flatnonzero(met[s : s + SLICE])
            if len(at):
                out.append((s // SLICE, part, sum(map(len, docs)), at.astype("<i4").tobytes(), met[at].astype("<f8").tobytes(), change[at].tobytes()))
        return pd.DataFrame(out, columns=["slice", "part", "learned", "at", "met", "change"])

    return learn


_CHANGE = "slice int, part long, learned long, at binary, met binary, change binary"


def _averaged(changes: DataFrame, shards: int) -> DataFrame:
    """One row for each slice: the mean change of each of its rows, by how often it was met. FAN_IN shards at a time."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total, change = np.zeros(SLICE), np.zeros((SLICE, HIDDEN))
        number = int(rows["slice"].iloc[0])
        for r in rows.sort_values("part").itertuples():
            at, met = np.frombuffer(r.at, "<i4") - number * SLICE, np.frombuffer(r.met, "<f8")
            total[at] += met
            change[at] += met[:, None] * np.frombuffer(r.change, np.float16).reshape(-1, HIDDEN)
        at = np.flatnonzero(total)
        mean = (change[at] / total[at, None]).astype(np.float16)
        made = (number, int(rows["part"].iloc[0]) // FAN_IN, 0, (at + number * SLICE).astype("<i4").tobytes(), total[at].tobytes(), mean.tobytes())
        return pd.DataFrame([made], columns=["slice", "part", "learned", "at", "met", "change"])

    while True:
        changes = cut(changes.groupBy("slice", F.floor(F.col("part") / FAN_IN)).applyInPandas(mean, _CHANGE), "mean")
        shards = -(-shards // FAN_IN)
        if shards == 1:
            return changes


def score_tokens(tokens: DataFrame, model: WindowModel, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, log_prob (sum over all tokens), mean_log_prob of every row of a table of tokens."""
    given = tokens.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField(id_col, tokens.schema["id"].dataType), *StructType.fromDDL("n_tokens long, log_prob double, mean_log_prob double")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [_ids(x, n) for x, n in zip(batch["ids"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True)]
            n, total, at = np.array([len(t) for t in docs], np.int64), np.zeros(len(docs)), 0
            while at < len(docs):  # as many documents at once as have about a shard's tokens
                end = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), SHARD)))
                total[at:end] = given.value.score(docs[at:end])
                at = end
            mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n), pa.array(total), mean], schema=arrow)

    return tokens.select("id", "n_tokens", "ids").mapInArrow(run, schema)


def score_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_prob, mean_log_prob of every row's whole text, by a network trained on all of them.

    A text without tokens (null, empty, blank) has 0 tokens, log_prob 0 and a null mean. Equal texts score equally up to the
    rounding of single precision (about 1e-6 of the score), and so do runs over other partitions of the same rows. Rows that
    repeat are each learned from and scored. Other columns are not read, whatever their names; no rows give no rows.
    Texts are tokenised once; the table of their tokens (about 2 bytes a token) is shuffled once and read again in each round.
    """
    from tokenizers import Tokenizer

    tokens = token_table(docs, tokenizer_path, id_col, text_col)
    return score_tokens(tokens, train(tokens, Tokenizer.from_file(tokenizer_path).get_vocab_size()), id_col)
