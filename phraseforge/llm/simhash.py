"""SimHash near-dedup (operator 6) by multi-index hashing.

A document's fingerprint is the bitwise majority of the hashes of its word
shingles.  Two fingerprints that differ in at most ``max_bits`` bits agree, in
at least one of ``segments`` parts, up to ``max_bits // segments`` bits.  So
every fingerprint is filed under each of its parts, looks up the small Hamming
ball around each of its parts, and the whole distance of what it finds is
verified.

Equal fingerprints are one node before any search.  A bucket that holds more
than ``HOT`` different fingerprints is not paired out as rows: its look-ups are
dealt in bounded shares, each compared with the bucket's fingerprints as arrays,
and only links that connect something new leave the task.  A bucket of more than
``HUGE`` is not even compared: the fingerprints that meet there are connected
exactly through midpoints.  Two fingerprints differ in at most 4 bits if and
only if some value lies within 2 bits of both, so each of them lists all values
within ``max_bits / 2`` bits and is linked to the smallest fingerprint that
lists the same value: a constant number of rows per fingerprint, whatever the
size of the group.

Defined results: null, empty and word-free texts have fingerprint zero and link
like any other; texts with fewer words than a shingle are one shingle; a null
doc_id is linked but never names a component (null if a component has no other);
repeated rows give repeated result rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.common import text_or_empty
from phraseforge.llm.components import components
from phraseforge.session import materialize

SEED = 42
HOT, HUGE, SHARE = 64, 1 << 14, 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit majority of consecutive groups of hashes; an empty group gives 0."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    counts = counts[full]
    # Bits as bytes, eight bytes to a 64-bit lane: up to 255 rows add up without a carry between bytes.
    lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view("<u8")
    pieces = -(-counts // 255)
    first = np.cumsum(counts) - counts
    piece = np.repeat(first, pieces) + 255 * A.spread(np.zeros(len(pieces), np.int64), pieces)
    partial = np.add.reduceat(lanes, piece, axis=0).view(np.uint8).astype(np.int64)
    ones = np.add.reduceat(partial, np.cumsum(pieces) - pieces, axis=0)
    out[full] = np.packbits((2 * ones > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _block_fingerprints(column, shingle: int) -> np.ndarray:
    raw, offsets = A.utf8(column)
    data = _LOWER[raw]
    start, end, first = A.words(data, offsets)
    if not len(start):
        return np.zeros(len(offsets) - 1, np.uint64)
    # all words, each followed by one space
    size = end - start + 1
    at = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 0x20, np.uint8)
    joined[A.spread(at, size - 1)] = data[A.spread(start, size - 1)]
    blob = joined.tobytes()
    n_words = np.diff(first)
    n = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    head = A.spread(first[:-1], n)
    last = np.minimum(head + shingle, np.repeat(first[1:], n)) - 1
    stop = at[last] + size[last] - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(blob[a:b], SEED) for a, b in zip(at[head].tolist(), stop.tolist())), np.uint64, len(head))
    return _majority(h, n)


def _text_key():
    """Digest that tells a row's text from others under the same doc_id."""
    return F.sha2(text_or_empty(), 256).alias("key")


def _with_fingerprint(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with the fingerprint fp in place of their last column, text."""
    fields = rows.schema.fields[:-1]
    names = [*(f.name for f in fields), "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, "text"):
            fp = _block_fingerprints(block.column("text"), shingle)
            yield pa.record_batch([*block.columns[:-1], pa.array(fp.view(np.int64))], names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", fp long")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits in a long."""
    return _with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text"), shingle)


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flipped(masks: list[int], value, tag):
    """All values at the given flips of ``value``, each filed under ``tag``."""
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(value) + tag)


def _midpoint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links that connect exactly the fingerprints within ``max_bits`` of each
    other: a midpoint lies within half of that of one and the rest of the other."""
    near, far = max_bits // 2, max_bits - max_bits // 2
    masks = F.array(*[F.lit(_signed(m)) for m in _ball(64, near)])
    listed = fps.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
    if far == near:
        low = listed.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("mid", "b")
        return listed.join(low, "mid").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    # an odd distance: one side lists the nearer values, the other the farther ones; both hang on the value
    masks = F.array(*[F.lit(_signed(m)) for m in _ball(64, far)])
    wide = fps.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
    low = listed.groupBy("mid").agg(F.min("fp").alias("b"))
    return wide.join(low, "mid").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _bucket_links(max_bits: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Links that connect what a bucket's fingerprints and one share of its look-ups hold within max_bits."""
        fp = rows.column("fp").to_numpy().view(np.uint64)
        filed = rows.column("filed").to_numpy().astype(bool)
        held, seek = np.sort(fp[filed]), np.sort(fp[~filed])
        owner = np.full(len(seek), -1, np.int64)  # the first held fingerprint that each look-up met
        group = list(range(len(held)))

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        a, b = [], []
        for m, value in enumerate(held):
            met = np.flatnonzero(np.bitwise_count(seek ^ value) <= max_bits)
            for o in np.unique(owner[met[owner[met] >= 0]]).tolist():
                if root(o) != root(m):
                    group[root(o)] = root(m)
                    a.append(held[[o]])
                    b.append(held[[m]])
            new = met[owner[met] < 0]
            owner[new] = m
            a.append(seek[new])
            b.append(np.full(len(new), value))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
        real = a != b
        return pa.table({"a": pa.array(a[real].view(np.int64)), "b": pa.array(b[real].view(np.int64))})

    return run


def _crowded_links(table: DataFrame, met: DataFrame, max_bits: int) -> DataFrame:
    """Links through crowded buckets; ``met`` holds the (key, fp) look-ups that reach them."""
    shares = met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    seek = met.join(shares, "key").select("key", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int").alias("share"), "fp", F.lit(False).alias("filed"))
    held = table.join(shares, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "fp", F.lit(True).alias("filed"))
    return seek.union(held).groupBy("key", "share").applyInArrow(_bucket_links(max_bits), "a long, b long")


def fingerprint_links(fps: DataFrame, max_bits: int = 4, segments: int = 3, hot: int = HOT, huge: int = HUGE) -> DataFrame:
    """(a, b): links between different fingerprints whose components are those of
    all pairs within ``max_bits``; ``fps`` has distinct values in column fp.

    Outside hot buckets every such pair is a link."""
    cuts = [64 * s // segments for s in range(segments + 1)]
    filed, looked, balls = [], [], []
    for s in range(segments):
        width = cuts[s + 1] - cuts[s]
        part = F.shiftrightunsigned(F.col("fp"), cuts[s]).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(s).cast("long") * F.lit(1 << 58)
        balls.append(_ball(width, max_bits // segments))
        filed.append(part + tag)
        looked.append(_flipped(balls[-1], part, tag))
    table = fps.select("fp", F.explode(F.array(*filed)).alias("key"))
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*looked)).alias("key"))
    crowded = materialize(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
    calm = table.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("b"))
    links = (probes.join(calm, "key")
             .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
             .select("a", "b"))
    # kinds of buckets that do not occur are left out of the plan
    largest = crowded.agg(F.max("n")).first()[0] or 0
    if largest > hot:
        # a crowded bucket is looked up by whatever is filed within the ball around it
        masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in ball]) for ball in balls])
        own = F.element_at(masks, (F.shiftrightunsigned(F.col("key"), 58) + 1).cast("int"))
        around = crowded.select("key", "n", F.explode(F.transform(own, lambda m: m.bitwiseXOR(F.col("key")))).alias("near"))
        met = table.withColumnRenamed("key", "near").join(around, "near").select("key", "n", "fp")
        links = links.union(_crowded_links(table, met.filter(F.col("n") <= huge).select("key", "fp"), max_bits))
    if largest > huge:
        links = links.union(_midpoint_links(met.filter(F.col("n") > huge).select("fp").distinct(), max_bits))
    return links.distinct()


def _named(own: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(fp, label, component_id) of every fingerprint; the label, itself a
    fingerprint, is never null."""
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(fingerprint_links(nodes.select("fp"), max_bits, segments))
    # fingerprints without a link are their own label, as is the smallest of a component
    labelled = nodes.join(found, nodes.fp == found.id, "left").select("fp", "node", F.coalesce("label", "fp").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("node").alias("component_id"))
    return labelled.join(lowest, "label").select("fp", "label", "component_id")


def near_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest
    doc_id reachable over links, itself included."""
    own = materialize(fingerprints(docs, shingle))
    return own.join(_named(own, max_bits, segments), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def drop_near_copies(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the row with
    the smallest doc_id (one row, if several carry it, or if all its ids are null)."""
    own = materialize(_with_fingerprint(docs.select(F.col("doc_id").cast("long"), _text_key(), "text"), shingle))
    stay = own.join(_named(own, max_bits, segments), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("stay"), F.col("key").alias("stay_key"), "label").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _text_key())
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay")) & (F.col("key") == F.col("stay_key")))
    order = [F.col(f"row.`{c}`").cast("string") for c in docs.columns if c != "doc_id"]
    first = Window.partitionBy("label").orderBy(*order, F.lit(0))
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*")
