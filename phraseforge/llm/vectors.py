"""Sums of fixed-size vectors over a whole table, and calibration of probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.llm.arrays import mix64

#: Cells of one piece of a vector, and tasks whose pieces are first added among themselves.
PIECE, FAN_IN = 1 << 14, 64
_PARTS = "piece int, part long, data binary"


def _added(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(d, np.float64) for d in parts.column("data").to_pylist())
    return pa.table({"piece": [key[0].as_py()], "part": [key[1].as_py()], "data": [total.tobytes()]},
                    schema=pa.schema([("piece", pa.int32()), ("part", pa.int64()), ("data", pa.binary())]))


def table_sum(df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """Sum over all rows of what ``add(batch, total)`` adds to a float64 vector.

    ``size`` is a parameter of the caller's model, never of the data, so what
    reaches the driver is bounded.  Tasks send one vector each, in pieces;
    pieces are added in groups of ``FAN_IN`` tasks, level by level, so that no
    task adds up more than a bounded number of them."""
    n_parts = max(1, df.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size), False
        for batch in batches:
            any_rows = any_rows or batch.num_rows > 0
            add(batch, total)
        if any_rows:
            part = TaskContext.get().partitionId()
            for i in range(0, size, PIECE):
                yield pa.record_batch([pa.array([i // PIECE], pa.int32()), pa.array([part], pa.int64()),
                                       pa.array([total[i:i + PIECE].tobytes()], pa.binary())], ["piece", "part", "data"])

    parts = df.mapInArrow(run, _PARTS)
    while n_parts > 1:
        n_parts = -(-n_parts // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("piece", "part").applyInArrow(_added, _PARTS)
    out = np.zeros(size)
    for row in parts.collect():
        cells = np.frombuffer(row["data"], np.float64)
        out[row["piece"] * PIECE:row["piece"] * PIECE + len(cells)] += cells
    return out


def index_vectors(slots: int, width: int, ones: int) -> np.ndarray:
    """Sparse random +-1 vectors, one per slot, drawn by hash (the same on every machine)."""
    out = np.zeros((slots, width), np.float32)
    for k in range(ones):
        h = mix64(np.arange(slots, dtype=np.uint64) * np.uint64(ones) + np.uint64(k + 1))
        out[np.arange(slots), (h % np.uint64(width)).astype(np.int64)] += np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1)
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature that makes ``softmax(logits / T)`` likeliest for the true
    classes, by golden-section search over log T; 1 without rows."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(column: str = "doc_id"):
    """True for the fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
