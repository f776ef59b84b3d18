"""Suffix-array dedup (operator 7): a sparse suffix array over minimisers.

1. Of every ``SPAN`` neighbouring ``GRAM``-word grams the one with the smallest
   hash is a minimiser; only the suffixes that start at minimisers are kept,
   about two of ``SPAN + 1``.  The choice depends on the words alone, so a
   passage of ``LENGTH`` words has the same minimiser in all its copies, within
   its first ``SPAN`` words, and the suffixes there agree in ``LENGTH - SPAN + 1``
   words or more.
2. The suffixes are range-sorted over all tasks: by the letters their first word
   starts with, by a hash of the words that are sure to agree, and by place, so
   that equal suffixes are neighbours and a popular passage spreads over tasks.
   A suffix with an equal neighbour is a match; the first and the last suffix of
   a task may have theirs in the next task and are taken along.
3. Matches are extended to the left and right: every ``LENGTH``-word window around
   one is compared, by a hash of 93 bits, with the windows around all others.  A
   window that also starts earlier (smaller doc_id, or earlier in the document)
   is a repeat.  Its source is the earliest place of its words; or, if it also
   starts at most ``LENGTH`` words before in the same row (a period), the last
   such place.  Repeats whose sources move along with them and whose words touch
   are one passage: it ends where the words differ or an earlier source begins.

Windows of a block of documents that have the same words travel as one row, and
the earliest place is a minimum that is summed up before it is joined back, so a
passage that a third of all documents share meets as one row a block and no
pairs are made.  All choices are by place: the result does not depend on how the
rows are dealt.

Defined results: null, empty and short texts have no passages; a null doc_id
sorts before all others; a text that stands as a whole under a smaller doc_id
too is one passage from there; rows that share a doc_id count as one document (a
window at the same place in two of them is not earlier in either), and identical
rows are reported once; very long texts are processed whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.common import partitions, word_count

LENGTH, SPAN, GRAM = 50, 16, 10

_NULL_ID = -(1 << 63)


def _slices(family: A.RollingHash, word_hashes: np.ndarray, head: np.ndarray, size: int) -> np.ndarray:
    return family.slices(family.sums(word_hashes), head, head + size)


def _minimisers(grams: np.ndarray, first: np.ndarray, n: np.ndarray, span: int) -> np.ndarray:
    """Indexes of the grams that are the smallest of some ``span`` neighbours of their
    text (all of a text's grams, if it has fewer); ties go to the left.

    ``first`` and ``n`` give each text's grams in the array."""
    picked = []
    low = np.arange(len(grams))  # index of the smallest of the next 1, 2, 4, ... grams
    size = 1
    while 2 * size <= span:
        other = low[np.minimum(np.arange(len(grams)) + size, len(grams) - 1)]
        low = np.where(grams[other] < grams[low], other, low)
        size *= 2
    full = np.maximum(n - span + 1, 0)
    at = A.spread(first, full)
    if len(at):
        a, b = low[at], low[at + span - size]
        picked.append(np.where(grams[b] < grams[a], b, a))
    for f, m in zip(first[(n > 0) & (full == 0)].tolist(), n[(n > 0) & (full == 0)].tolist()):
        picked.append(np.array([f + int(np.argmin(grams[f:f + m]))]))
    return np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)


def _head(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of each slice as a signed number that sorts as they do."""
    at = start[:, None] + np.arange(8)
    raw = np.where(at < end[:, None], data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros((0, 8), np.uint8)
    number = np.ascontiguousarray(raw.astype(np.uint8)).view(">u8").astype(np.uint64).ravel()
    return (number ^ np.uint64(1 << 63)).view(np.int64)


def _suffixes(length: int, span: int, gram: int):
    sure = length - span + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(head, h, doc, pos): the suffixes at minimisers, with what they are sorted by."""
        for rows in A.blocks(batches, "text"):
            data, offsets = A.utf8(rows.column(1))
            start, end, first = A.words(data, offsets)
            words = A.byte_hashes(A.HASH_A, data, start, end)
            n = np.maximum(np.diff(first) - gram + 1, 0)
            head = A.spread(first[:-1], n)
            chosen = head[_minimisers(_slices(A.HASH_B, words, head, gram), np.cumsum(n) - n, n, span)]
            own = np.searchsorted(first, chosen, side="right") - 1
            fits = chosen + sure <= first[own + 1]
            chosen, own = chosen[fits], own[fits]
            h = _slices(A.HASH_A, words, chosen, sure)
            doc = rows.column(0).to_numpy(zero_copy_only=False)[own]
            yield pa.record_batch([pa.array(_head(data, start[chosen], end[chosen])), pa.array(h.view(np.int64)), pa.array(doc),
                                   pa.array((chosen - first[own]).astype(np.int32))], ["head", "h", "doc", "pos"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, pos) of the sorted suffixes that equal the one before or after them, and of
    the first and the last of the task."""
    held = None
    for rows in batches:
        if not rows.num_rows:
            continue
        if held is not None:
            rows = pa.Table.from_batches([held[0], rows]).combine_chunks().to_batches()[0]
        head, h = (rows.column(i).to_numpy() for i in (0, 1))
        same = (head[1:] == head[:-1]) & (h[1:] == h[:-1])
        match = np.zeros(len(h), bool)
        match[1:] |= same
        match[:-1] |= same
        match[0] |= held is None or held[1]  # a task's first, or one that equalled the last of an earlier batch
        last = bool(match[-1])
        held = rows.slice(len(h) - 1), last
        match[-1] = False  # decided with the next batch
        yield rows.select(["doc", "pos"]).filter(pa.array(match))
    if held is not None:
        yield held[0].select(["doc", "pos"])


_PLACES = pa.list_(pa.struct([("doc", pa.int64()), ("pos", pa.int32()), ("key", pa.int32())]))


def _windows(length: int, span: int):
    sure = length - span + 1
    names = ["a", "b", "doc", "pos", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows around matches, one row for those of a block with the same words:
        the earliest place and all places.  A window that overlaps one with the same
        words before it in its row has its source there: hashes null, places are
        itself and, as ``doc`` and ``pos``, the source."""
        for rows in A.blocks(batches, "text"):
            data, offsets = A.utf8(rows.column(2))
            start, end, first = A.words(data, offsets)
            near = np.zeros(len(start) + 1, np.int64)
            for d, places in enumerate(rows.column(3).to_pylist()):
                p = np.array(places, np.int64) + first[d]
                p = p[p <= first[d + 1] - sure]  # another row with this doc_id may be longer
                np.add.at(near, np.maximum(p - span + 1, first[d]), 1)
                np.add.at(near, p + 1, -1)
            head = A.spread(first[:-1], np.maximum(np.diff(first) - length + 1, 0))
            head = head[(np.cumsum(near[:-1]) > 0)[head]] if len(head) else head
            if not len(head):
                continue
            own = np.searchsorted(first, head, side="right") - 1
            a = _slices(A.HASH_A, A.byte_hashes(A.HASH_A, data, start, end), head, length)
            b = _slices(A.HASH_B, A.byte_hashes(A.HASH_B, data, start, end), head, length).astype(np.uint32)
            doc, key = (rows.column(i).to_numpy(zero_copy_only=False)[own] for i in (0, 1))
            pos = (head - first[own]).astype(np.int32)
            # periods: the same words at most ``length`` words before in the same row
            order = np.lexsort((pos, own, b, a))
            same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
            same &= pos[order[1:]] - pos[order[:-1]] <= length
            mine, before = order[1:][same], order[:-1][same]
            others = np.ones(len(head), bool)
            others[mine] = False
            # the others: together by words, the earliest place first
            rest = np.flatnonzero(others)
            rest = rest[np.lexsort((pos[rest], doc[rest], b[rest], a[rest]))]
            new = np.ones(len(rest), bool)
            new[1:] = (a[rest[1:]] != a[rest[:-1]]) | (b[rest[1:]] != b[rest[:-1]])
            groups = np.flatnonzero(new)
            every = np.concatenate([rest, mine])
            ends = np.concatenate([groups, len(rest) + np.arange(len(mine) + 1)]).astype(np.int32)
            listed = pa.StructArray.from_arrays([pa.array(doc[every]), pa.array(pos[every]), pa.array(key[every])], fields=list(_PLACES.value_type))
            low = np.concatenate([rest[groups], before])
            unknown = np.arange(len(low)) >= len(groups)
            yield pa.record_batch([pa.array(a[low].view(np.int64), mask=unknown), pa.array(b[low].view(np.int32), mask=unknown), pa.array(doc[low]),
                                   pa.array(pos[low]), pa.ListArray.from_arrays(pa.array(ends), listed)], names)

    return run


def _passages(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated windows of a document whose sources move along with them, and whose words touch."""
        for rows in batches:
            n = pc.list_value_length(rows.column(1)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(rows.num_rows), n)
            key, pos, src, src_pos = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in rows.column(1).flatten().flatten())
            shift = pos - src_pos
            order = np.lexsort((pos, shift, src, key, row))
            cols = [c[order] for c in (row, key, src, shift)]
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0) | (np.diff(pos[order]) > length)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(order))[:len(first)] - 1
            begin, size = pos[order][first], pos[order][last] - pos[order][first] + length
            doc = rows.column(0).to_numpy(zero_copy_only=False)[cols[0][first]]
            source = cols[2][first]
            yield pa.record_batch([pa.array(doc, mask=doc == _NULL_ID), pa.array(begin), pa.array(size),
                                   pa.array(source, mask=source == _NULL_ID), pa.array(begin - cols[3][first])],
                                  ["doc_id", "start", "n_words", "source_doc_id", "source_start"])

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per passage of ``length`` words or more that also stands earlier:
    doc_id, start (word), n_words, source_doc_id, source_start."""
    if span + gram - 1 > length or gram > length - span + 1:
        raise ValueError("a passage must hold span + gram - 1 words, and a gram the words that are sure to agree")
    parts = partitions(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.hash("text").alias("key"), "text")
    # a text that also stands as a whole under a smaller doc_id is one passage; the smaller one stands for both below
    whole = rows.select("doc", "key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), word_count().alias("n"))
    first = whole.groupBy("sha").agg(F.min("doc").alias("first"))
    whole = whole.join(first, "sha").filter("doc > first")
    copies = whole.groupBy("doc").agg(F.collect_set("key").alias("keys")).hint("shuffle_hash")
    # texts are shuffled once, by document; both steps below read that one exchange
    own = (rows.repartition(parts, "doc").join(copies, "doc", "left")
           .filter(~F.coalesce(F.array_contains("keys", F.col("key")), F.lit(False))).select("doc", "text", "key"))
    order = ["head", "h", "doc", "pos"]
    suffixes = own.mapInArrow(_suffixes(length, span, gram), "head long, h long, doc long, pos int")
    suffixes = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    matches = suffixes.mapInArrow(_neighbours, "doc long, pos int").groupBy("doc").agg(F.collect_list("pos").alias("places"))
    near = own.join(matches.hint("shuffle_hash"), "doc").select("doc", "key", "text", "places")
    windows = near.mapInArrow(_windows(length, span), "a long, b int, doc long, pos int, places array<struct<doc:long,pos:int,key:int>>")
    # the earliest place of every window: summed up first, then joined back to the blocks' rows
    place = F.struct("doc", "pos")
    first = windows.filter("a IS NOT NULL").groupBy("a", "b").agg(F.min(place).alias("e"), F.count(F.lit(1)).alias("rows"))
    met = windows.filter("a IS NOT NULL").join(first, ["a", "b"]).filter((F.col("rows") > 1) | (F.size("places") > 1)).select("e", "places")
    periods = windows.filter("a IS NULL").select(place.alias("e"), "places")
    found = met.union(periods).select("e", F.explode("places").alias("w")).filter(F.struct("w.doc", "w.pos") > F.col("e"))
    found = found.groupBy(F.col("w.doc").alias("doc")).agg(F.collect_list(
        F.struct("w.key", "w.pos", F.col("e.doc").alias("src"), F.col("e.pos").alias("src_pos"))).alias("found"))
    passages = found.mapInArrow(_passages(length), "doc_id long, start long, n_words long, source_doc_id long, source_start long")
    zero = F.lit(0).cast("long")
    return passages.union(whole.filter(F.col("n") >= length).select(
        "doc", zero, "n", F.when(F.col("first") != _NULL_ID, F.col("first")), zero).distinct())
