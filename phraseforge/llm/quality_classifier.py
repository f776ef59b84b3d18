"""Quality classifier (operator 4): random-indexing word vectors pooled per
document, a two-layer network, temperature-calibrated probabilities.

Tokens are runs of word characters (letters, digits, all non-ASCII) or of
punctuation, hashed into ``SLOTS``.  Random indexing over all documents: a
slot's vector is the sum of the sparse random index vectors of its neighbours
within ``REACH`` tokens, scaled to length one.  A document is the mean and
spread of its tokens' vectors, the mean step between neighbouring tokens, and
its length.  The network learns from at most ``MAX_ROWS`` labelled rows (the
first in the order of a hash of the id), a fifth of which only set the
temperature.

Defined results: null and empty texts have the features of a text without
tokens and are scored like any other; labels that are null are no labels, of
several labels of one doc_id the largest counts; without labelled rows of both
classes every score is the share of label 1 among them (1 without any);
repeated rows get equal scores; extra columns are ignored by :func:`score` and
kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.vectors import held_out, index_vectors, softmax, table_sum, temperature

SLOTS, WIDTH, ONES, REACH = 1 << 13, 24, 4, 2
MAX_ROWS = 8000
THRESHOLD = 0.3
BLOCK_BYTES = 3 << 18  # text of one block: its tokens' vectors are held at once

_KIND = np.zeros(256, np.uint8)  # 0 separator, 1 word character, 2 punctuation
_KIND[0x21:0x80] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every token, first token of every text with one more entry than texts)."""
    data, offsets = A.utf8(column)
    kind = _KIND[data]
    parts = [A.runs(kind == k, offsets)[:2] for k in (1, 2)]
    start, end = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    slot = (A.byte_hashes(A.HASH_A, data, start, end) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    return slot, np.searchsorted(start, offsets)


def _add_contexts(batch: pa.RecordBatch, total: np.ndarray) -> None:
    """Random indexing: add each token's neighbours' index vectors to its slot's row."""
    index = index_vectors(SLOTS, WIDTH, ONES)
    rows = total.reshape(SLOTS, WIDTH)
    for block in A.blocks(iter([batch]), "text", BLOCK_BYTES):
        slot, first = _tokens(block.column("text"))
        if not len(slot):
            continue
        near = np.zeros((len(slot), WIDTH), np.float32)
        vec = index[slot]
        text = np.repeat(np.arange(block.num_rows), np.diff(first))
        for d in range(1, REACH + 1):
            same = (text[d:] == text[:-d])[:, None]
            near[d:] += vec[:-d] * same
            near[:-d] += vec[d:] * same
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        held, at = np.unique(slot[order], return_index=True)
        rows[held] += np.add.reduceat(near[order], at, axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """SLOTS x WIDTH vectors of length one (zero where no token fell), from all texts."""
    total = table_sum(docs.select("text"), _add_contexts, SLOTS * WIDTH).reshape(SLOTS, WIDTH)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def _pooled(column, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean, spread, mean step, log length."""
    slot, first = _tokens(column)
    n = np.diff(first)
    out = np.zeros((len(n), 3 * WIDTH + 1))
    out[:, -1] = np.log1p(n)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    at, n = first[full], n[full][:, None]
    v = vectors[slot]
    mean = np.add.reduceat(v, at, axis=0, dtype=np.float64) / n
    square = np.add.reduceat(v * v, at, axis=0, dtype=np.float64) / n
    step = np.zeros_like(v)
    step[1:] = np.abs(v[1:] - v[:-1])
    step[at] = 0
    out[full, :WIDTH] = mean
    out[full, WIDTH:2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[full, 2 * WIDTH:3 * WIDTH] = np.add.reduceat(step, at, axis=0, dtype=np.float64) / np.maximum(n - 1, 1)
    return out


class QualityModel:
    """Word vectors and a network of one hidden layer over pooled features."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.prior: float | None = 1.0  # the score of every text while nothing is learned

    def learn(self, x: np.ndarray, y: np.ndarray, spared: np.ndarray, hidden: int = 32, epochs: int = 60,
              batch: int = 64, rate: float = 0.003, decay: float = 1e-4, seed: int = 7) -> None:
        """Adam on the rows that are not spared, then the temperature on those that are."""
        if not len(y) or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 1.0
            return
        self.prior = None
        rng = np.random.default_rng(seed)
        xt, yt = x[~spared], y[~spared]
        self.mean, self.scale = xt.mean(axis=0), xt.std(axis=0) + 1e-6
        xt = self._scaled(xt)
        p = self.weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden),
                            rng.normal(0, (1 / hidden) ** 0.5, (hidden, 2)), np.zeros(2)]
        m, s, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(yt))
            for i in range(0, len(order), batch):
                rows = order[i:i + batch]
                a = np.maximum(xt[rows] @ p[0] + p[1], 0)
                d = softmax(a @ p[2] + p[3])
                d[np.arange(len(rows)), yt[rows]] -= 1
                d /= len(rows)
                da = (d @ p[2].T) * (a > 0)
                grads = [xt[rows].T @ da + decay * p[0], da.sum(0), a.T @ d + decay * p[2], d.sum(0)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
        self.heat = 1.0
        self.heat = temperature(self._logits(x[spared]), y[spared])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        a = np.maximum(self._scaled(x) @ self.weights[0] + self.weights[1], 0)
        return a @ self.weights[2] + self.weights[3]

    def scores(self, column) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(column), self.prior)
        return softmax(self._logits(_pooled(column, self.vectors)) / self.heat)[:, 1]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Word vectors from all texts; the network from labelled rows outside the held-out fold."""
    model = QualityModel(word_vectors(docs))
    marked = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("y"))
              .join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi"))
    # max_rows rows of two numbers: small by its parameter, so it goes to every task and no text is shuffled
    chosen = marked.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), "id").limit(max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, "text", BLOCK_BYTES):
            x = _pooled(block.column("text"), shared.value).astype(np.float32)
            yield pa.record_batch([block.column("id"), block.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    # rows that repeat an id: one of them stands for all, whatever their number
    sample = sample.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sample.mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary").collect()
    if len(rows) > max_rows:
        raise AssertionError(f"{len(rows)} rows drawn, {max_rows} at most")
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(len(rows), 3 * WIDTH + 1)
    model.learn(x, np.array([r["y"] for r in rows], np.int64), np.arange(len(rows)) % 5 == 0)
    return model


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def with_score(docs: DataFrame, model: QualityModel, output: str) -> DataFrame:
    """``docs`` with the score of each text in a new last column ``output``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, "text", BLOCK_BYTES):
            yield pa.record_batch([*block.columns, pa.array(shared.value.scores(block.column("text")))], [*block.schema.names, output])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{output}` double")


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = with_score(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns."""
    name = _unused("score", docs.columns)
    return with_score(docs, fit(docs, labels), name).filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
