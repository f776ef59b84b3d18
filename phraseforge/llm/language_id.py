"""Language ID (operator 5): sparse multinomial logistic regression on TF-IDF
character n-grams, trained with FTRL and elastic-net penalties, then calibrated.

A text is lower-cased, everything but letters becomes a space, and its 1- to
3-grams are hashed into ``FEATURES`` columns.  A column's value is its share of
the text's n-grams times its idf, counted over all learnable documents.  The
regression learns from at most ``ROWS_PER_LANGUAGE`` documents of each language
(the first in the order of a hash of the id), ``MAX_ROWS`` in all; a fifth of
these only set the temperature.  Scoring adds one table row per n-gram and needs no per-document
table.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without learnable rows every text is ``und``; rows whose lang is null, and the
held-out fold, are never learned from; ties go to the language first in code
point order; repeated rows get equal predictions; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.vectors import held_out, softmax, table_sum, temperature

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
ROWS_PER_LANGUAGE, MAX_ROWS, SHARES = 400, 8000, 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 16)
_SCALE = 64.0  # brings shares of n-grams to the size FTRL's step expects


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case form of every letter, 32 for every other code point."""
    def one(c: int) -> int:
        ch = chr(c)
        if unicodedata.category(ch)[0] != "L":
            return 32
        low = ch.lower()
        return ord(low) if len(low) == 1 else c

    return np.fromiter((one(c) for c in range(0x110000)), np.uint32, 0x110000)


def _columns(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (feature of every n-gram, positions that are none, offsets of the texts)."""
    _, cp, offsets = A.code_points(column)
    c = _letters()[cp].astype(np.uint64)
    yield c, np.zeros(0, np.int64), offsets  # the letters themselves, for callers that look for any
    key = np.zeros(len(c), np.uint64)
    for k, order in enumerate(ORDERS):
        key[:len(c) - k] |= c[k:] << np.uint64(21 * k)
        # the last places of a text hold no whole n-gram; an empty text has no places
        tail = offsets[1:, None] - 1 - np.arange(k)[None, :]
        tail = tail[tail >= offsets[:-1, None]]
        yield ((key + np.uint64(order)) * _SPREAD >> _SHIFT).astype(np.int64), tail, offsets


def _ngram_total(offsets: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    return sum(np.maximum(n - order + 1, 0) for order in ORDERS)


def _add_document_counts(batch: pa.RecordBatch, total: np.ndarray) -> None:
    """Add to ``total[f]`` the documents that hold feature f; its last cell counts documents."""
    for block in A.blocks(iter([batch]), "text"):
        parts = _columns(block.column("text"))
        next(parts)
        seen = [(f, set(tail.tolist()), offsets) for f, tail, offsets in parts]
        mark = np.zeros(FEATURES + 1, bool)
        for d in range(block.num_rows):
            for f, tail, offsets in seen:
                a, b = int(offsets[d]), int(offsets[d + 1])
                while b > a and b - 1 in tail:
                    b -= 1
                mark[f[a:b]] = True
            mark[FEATURES] = True
            total += mark
            mark[:] = False


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, features, counts) of the sampled documents."""
    for block in A.blocks(batches, "text"):
        parts = _columns(block.column("text"))
        next(parts)
        features, rows = [], []
        for f, tail, offsets in parts:
            real = np.ones(len(f), bool)
            real[tail] = False
            features.append(f[real])
            rows.append(np.repeat(np.arange(block.num_rows), np.diff(offsets))[real])
        key, n = np.unique(np.concatenate(rows) * FEATURES + np.concatenate(features), return_counts=True)
        cuts = np.searchsorted(key, np.arange(block.num_rows + 1) * FEATURES).astype(np.int32)
        yield pa.record_batch([block.column("lang"), block.column("turn"),
                               pa.ListArray.from_arrays(pa.array(cuts), pa.array((key % FEATURES).astype(np.int32))),
                               pa.ListArray.from_arrays(pa.array(cuts), pa.array(n.astype(np.int32)))],
                              ["lang", "turn", "features", "counts"])


class FTRL:
    """Multinomial logistic regression by follow-the-regularised-leader, one document at a time.

    Weights are a function of the accumulators: zero inside the l1 ball, shrunk
    by l2 outside; each coordinate has its own step size."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax((x @ w)[None])[0]
        error[label] -= 1
        g = x[:, None] * error[None]
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


class LanguageModel:
    """Languages, the table of what an n-gram adds to each, and the temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, heat: float):
        self.languages, self.table, self.heat = languages, table.astype(np.float32), heat

    def logits(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each text and language, does the text hold a letter)."""
        parts = _columns(column)
        letters, _, offsets = next(parts)
        filled = np.flatnonzero(np.diff(offsets))
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        has = np.zeros(len(offsets) - 1, bool)
        if not len(filled):
            return out, has
        has[filled] = np.logical_or.reduceat(letters != 32, offsets[filled])
        for f, tail, _ in parts:
            for k in range(0, len(self.languages), 8):
                rows = self.table[f, k:k + 8]
                rows[tail] = 0
                out[filled, k:k + 8] += np.add.reduceat(rows, offsets[filled], axis=0, dtype=np.float64)
        return out / np.maximum(_ngram_total(offsets), 1)[:, None], has


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_rows: int = MAX_ROWS, epochs: int = 6) -> LanguageModel:
    """Learn from rows outside the held-out fold whose lang is known.

    Document frequencies cover all of them; the regression the bounded sample."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    df = table_sum(known.select("text"), _add_document_counts, FEATURES + 1)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # the first rows of each language by hash: first within shares of a language, then among the shares' first
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    ids = known.select("doc_id", "lang").distinct().select("doc_id", "lang", draw.alias("draw")).withColumn("share", F.pmod(F.xxhash64("draw"), F.lit(SHARES)))
    first = ids.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "share").orderBy("draw", "doc_id")))
    first = first.filter(F.col("turn") <= rows_per_language)
    chosen = first.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id")))
    chosen = chosen.filter(F.col("turn") <= rows_per_language).select("doc_id", "lang", "turn")
    # max_rows rows of two columns: small by its parameter, so it goes to every task and no text is shuffled
    chosen = chosen.orderBy("turn", "lang", "doc_id").limit(max_rows)
    sample = known.join(F.broadcast(chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), "turn")),
                        (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l"))).select("lang", "turn", "text")
    # rows that repeat an id and language: one of them stands for all, whatever their number
    sample = sample.groupBy("lang", "turn").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sample.mapInArrow(_sparse, "lang string, turn int, features array<int>, counts array<int>").collect()
    if len(rows) > max_rows:
        raise AssertionError(f"{len(rows)} rows drawn, {max_rows} at most")
    languages = sorted({r["lang"] for r in rows})
    model = FTRL(FEATURES, max(1, len(languages)))
    examples = []
    for r in sorted(rows, key=lambda r: (r["turn"], r["lang"])):
        at, n = np.array(r["features"], np.int64), np.array(r["counts"], np.float64)
        if len(at):
            examples.append((at, _SCALE * n / n.sum() * idf[at], languages.index(r["lang"]), r["turn"] % 5 == 0))
    for _ in range(epochs):
        for at, x, label, spared in examples:
            if not spared:
                model.learn(at, x, label)
    weights = model.weights()
    spared = [e for e in examples if e[3]]
    logits = np.array([x @ weights[at] for at, x, _, _ in spared]).reshape(len(spared), weights.shape[1])
    heat = temperature(logits, np.array([e[2] for e in spared], np.int64))
    return LanguageModel(languages, _SCALE * idf[:, None] * weights, heat)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for block in A.blocks(batches, "text"):
            if m.languages:
                logits, has = m.logits(block.column("text"))
                p = softmax(logits / m.heat)
                best = np.where(has, p.argmax(axis=1), len(m.languages))
                score = np.where(has, p.max(axis=1), 0.0)
            else:
                best, score = np.zeros(block.num_rows, np.int64), np.zeros(block.num_rows)
            yield pa.record_batch([block.column("doc_id"), block.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                                  ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
