"""Substring dedup (operator 3): fixed-block anchors, probes, maximal exact repeats.

1. Every text is cut into reference blocks of ``BLOCK`` words that do not
   overlap; every rolling window of ``BLOCK`` words is a probe.  A repeat of
   ``WINDOW`` = 2 * BLOCK words holds a whole reference block of either copy, so
   at least one probe of each copy hits a block of the other.  Probes travel to
   the bucket of their hash as packed arrays (four bytes of hash and a small
   step each): less than the text itself.  A probe at a block's own place *is*
   the block, so blocks need no rows of their own.
2. A hit is extended by comparing the whole ``WINDOW``-word windows around it by
   hash (61 bits and 32 of a second one), against all other windows around hits.  A window whose words
   also start earlier (smaller doc_id, or earlier in the same document) is
   repeated; runs of overlapping repeated windows are the maximal repeats, and
   their words go.  Of the windows that repeat inside one block of documents
   only the earliest is compared with other blocks, so a passage that a third
   of all documents share meets as one row a block, and no pairs of documents
   are ever made.

A text that stands as a whole under a smaller doc_id too is settled before
step 1: all its windows start earlier there, so all its words go (if they fill
a window), and the smaller one stands for both in the search.

Hashes of 32 bits in step 1 can only add candidates; step 2 decides on 93 bits.

Defined results: null, empty and short texts have nothing removed; a null
doc_id sorts before all others; rows that share a doc_id count as one document
(a window at the same place in two of them is not earlier in either), and their
texts are judged one by one; texts of any length are processed whole; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.common import partitions

BLOCK = 10
WINDOW = 2 * BLOCK
#: Words whose probes are packed together before they are dealt to buckets.
PACK = 500_000

_NULL_ID = -(1 << 63)
_PACKED = "bucket int, n int, docs binary, starts binary, steps binary, hashes binary, n_docs int"


def _zip(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unzip(raw: bytes, dtype, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(raw, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _window_hashes(family: A.RollingHash, word_hashes: np.ndarray, head: np.ndarray, size: int) -> np.ndarray:
    return family.slices(family.sums(word_hashes), head, head + size)


def _deal(at: np.ndarray, hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket with the probes whose hash belongs there, in text order."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    low = hashes.astype(np.uint32)
    ids, heads = _zip(np.diff(docs, prepend=0)), _zip(np.diff(starts, prepend=0).astype(np.int32))
    full = np.flatnonzero(np.diff(cuts))
    parts = [order[cuts[b]:cuts[b + 1]] for b in full]
    return pa.record_batch({
        "bucket": pa.array(full, pa.int32()),
        "n": pa.array([len(p) for p in parts], pa.int32()),
        "docs": pa.array([ids] * len(full), pa.binary()),
        "starts": pa.array([heads] * len(full), pa.binary()),
        "steps": pa.array([_zip(np.diff(at[p], prepend=0).astype(np.uint32)) for p in parts], pa.binary()),
        "hashes": pa.array([low[p].tobytes() for p in parts], pa.binary()),
        "n_docs": pa.array([len(docs)] * len(full), pa.int32()),
    })


def _probes(block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush():
            return _deal(*(np.concatenate(x) for x in zip(*held)), buckets)

        for rows in A.blocks(batches, "text"):
            data, offsets = A.utf8(rows.column(1))
            start, end, first = A.words(data, offsets)
            count = np.maximum(np.diff(first) - block + 1, 0)
            head = A.spread(first[:-1], count)
            h = _window_hashes(A.HASH_B, A.byte_hashes(A.HASH_A, data, start, end), head, block)
            ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((head + n, h, ids, first[:-1] + n))
            n += len(start)
            if n >= PACK:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _hits(block: int):
    def run(key: tuple[pa.Scalar, ...], packed: pa.Table) -> pa.Table:
        """(doc, places): probes of this bucket that hit a reference block other than their own."""
        hashes, docs, places = [], [], []
        for r in packed.to_pylist():
            at = np.cumsum(_unzip(r["steps"], np.uint32, r["n"]), dtype=np.int64)
            starts = np.cumsum(_unzip(r["starts"], np.int32, r["n_docs"]), dtype=np.int64)
            own = np.searchsorted(starts, at, side="right") - 1
            hashes.append(np.frombuffer(r["hashes"], np.uint32))
            docs.append(np.cumsum(_unzip(r["docs"], np.int64, r["n_docs"]))[own])
            places.append((at - starts[own]).astype(np.int32))
        h, doc, place = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
        is_block = place % block == 0
        index, times = np.unique(h[is_block], return_counts=True)
        if not len(index):
            index, times = np.zeros(1, np.uint32), np.zeros(1, np.int64)
        j = np.minimum(np.searchsorted(index, h), len(index) - 1)
        hit = np.flatnonzero((index[j] == h) & (times[j] > is_block))
        hit = hit[np.argsort(doc[hit], kind="stable")]
        found, at = np.unique(doc[hit], return_index=True)
        pieces = np.split(place[hit], at[1:]) if len(found) else []
        return pa.table({"doc": pa.array(found, pa.int64()), "places": pa.array([p.tobytes() for p in pieces], pa.binary())})

    return run


def _cover(heads: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` that starts at one of ``heads``."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, heads, 1)
    np.add.at(marks, np.minimum(heads + size, n), -1)
    return np.cumsum(marks[:n]) > 0


def _candidates(block: int, window: int):
    names = ["a", "b", "doc", "pos", "tag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows around hits, with their two hashes; ``tag`` is twice the
        row's key, plus one if the window is settled.

        Settled: the same words start earlier in this very block.  Such a
        window is dealt by its document instead of its words, so
        that it meets nothing from elsewhere and many of them add no skew."""
        for rows in A.blocks(batches, "text"):
            data, offsets = A.utf8(rows.column(2))
            start, end, first = A.words(data, offsets)
            near = np.zeros(len(start) + 1, np.int64)
            for d, places in enumerate(rows.column(3).to_pylist()):
                p = np.frombuffer(b"".join(places), np.int32).astype(np.int64) + first[d]
                # another row with this doc_id may be longer: its places are not ours
                p = p[p <= first[d + 1] - block]
                np.add.at(near, np.maximum(p - (window - block), first[d]), 1)
                np.add.at(near, p + 1, -1)
            count = np.maximum(np.diff(first) - window + 1, 0)
            head = A.spread(first[:-1], count)
            head = head[(np.cumsum(near[:-1]) > 0)[head]] if len(head) else head
            own = np.searchsorted(first, head, side="right") - 1
            a = _window_hashes(A.HASH_A, A.byte_hashes(A.HASH_A, data, start, end), head, window)
            b = _window_hashes(A.HASH_B, A.byte_hashes(A.HASH_B, data, start, end), head, window).astype(np.uint32)
            doc, key = (rows.column(i).to_numpy(zero_copy_only=False)[own] for i in (0, 1))
            pos = head - first[own]
            order = np.lexsort((pos, doc, b, a))
            new = np.ones(len(order), bool)
            new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            lowest = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            later = np.zeros(len(order), bool)
            later[order] = (doc[order] != doc[lowest]) | (pos[order] != pos[lowest])
            a[later], b[later] = A.mix64(doc[later].view(np.uint64)), 0
            tag = key.astype(np.int64) * 2 + later
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int32)), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(tag)], names)

    return run


def _kept(window: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words left of every text, and the maximal repeats that went."""
        for rows in A.blocks(batches, "text"):
            ids, keys = (rows.column(i).to_pylist() for i in (0, 1))
            found = rows.column(4)
            ends = np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_numpy(zero_copy_only=False)))
            packed = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            f_key, f_pos = packed >> 32, packed & 0xFFFFFFFF
            n_words, n_removed, kept, spans = [], [], [], []
            for d, (text, key, copy) in enumerate(zip(rows.column(2).to_pylist(), keys, rows.column(3).to_pylist())):
                words = (text or "").encode().split()
                heads = f_pos[ends[d]:ends[d + 1]][f_key[ends[d]:ends[d + 1]] == key].astype(np.int64)
                if copy:
                    heads = np.arange(max(len(words) - window + 1, 0))
                gone = _cover(heads, window, len(words))
                left = [w for w, g in zip(words, gone.tolist()) if not g] if len(heads) else words
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist() if len(heads) else []
                spans.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.record_batch([pa.array([None if d == _NULL_ID else d for d in ids], pa.int64()), pa.array(n_words, pa.int64()),
                                   pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)],
                                  ["doc_id", "n_words", "n_removed", "kept_text", "repeats"])

    return run


def _standing(rows: DataFrame) -> DataFrame:
    """(doc, keys, n): keys of the rows whose whole text also stands under a smaller
    doc_id, and the rows of a doc, where there are any such keys or several rows."""
    texts = rows.select("doc", "key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    first = texts.groupBy("sha").agg(F.min("doc").alias("first"))
    found = texts.join(first, "sha").groupBy("doc").agg(
        F.collect_set(F.when(F.col("doc") > F.col("first"), F.col("key"))).alias("keys"), F.count(F.lit(1)).alias("n"))
    return found.filter((F.size("keys") > 0) | (F.col("n") > 1))


def remove_repeats(docs: DataFrame, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and repeats (word ranges that went)
    of every row, for repeats of ``2 * block`` words or more."""
    window = 2 * block
    parts = partitions(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.hash("text").alias("key"), "text")
    # texts are shuffled once, by document; all steps below read that one exchange
    standing = _standing(rows).hint("shuffle_hash")
    texts = (rows.repartition(parts, "doc").join(standing, "doc", "left")
             .select("doc", F.when(F.col("n") > 1, F.col("key")).otherwise(0).alias("key"), "text",
                     F.coalesce(F.array_contains("keys", F.col("key")), F.lit(False)).alias("copy")))
    own = texts.filter(~F.col("copy")).select("doc", "text", "key")
    packed = own.mapInArrow(_probes(block, buckets or parts), _PACKED)
    hits = packed.groupBy("bucket").applyInArrow(_hits(block), "doc long, places binary")
    hits = hits.groupBy("doc").agg(F.collect_list("places").alias("places")).hint("shuffle_hash")
    near = own.join(hits, "doc").select("doc", "key", "text", "places")
    windows = near.mapInArrow(_candidates(block, window), "a long, b int, doc long, pos int, tag long")
    by_place = Window.partitionBy("a", "b").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windows = windows.withColumn("e_doc", F.first("doc").over(by_place)).withColumn("e_pos", F.first("pos").over(by_place))
    settled = F.col("tag").bitwiseAND(F.lit(1)) != 0
    repeated = windows.filter(settled | (F.col("doc") > F.col("e_doc")) | (F.col("pos") > F.col("e_pos")))
    found = F.shiftleft(F.shiftright("tag", 1), 32) + F.col("pos")
    repeated = repeated.groupBy("doc").agg(F.collect_list(found).alias("found")).hint("shuffle_hash")
    return (texts.join(repeated, "doc", "left").select("doc", "key", "text", "copy", "found")
            .mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_text string, "
                                       "repeats array<struct<start:int,end:int>>"))
