"""Quality rules (operator 10): per-document counts and cross-document line frequency.

Base counts come from one pass over each text.  Lines are normalised (lower
case, single spaces), hashed, and counted per host over distinct documents;
copies of a text count once, so that a page's copies do not turn its own lines
into boilerplate.  Lines on more documents of their host than the limit are
removed, and a document left with too few of its words is rejected.

Defined results: null and empty texts have zero words and fail the base rule;
a null host is a host of its own; repeated rows are judged alike, each on its
own row; a line exactly at the limit stays; texts and lines of any length are
processed whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.common import WORD, row_key, text_or_empty
from phraseforge.operators.frequent import BROADCAST_BYTES
from phraseforge.session import materialize

#: A line is removed when more than MIN_DOCS and more than SHARE of its host's documents carry it.
MIN_DOCS, SHARE = 10, 0.1
#: A document is rejected when less than KEEP of its words are left.
KEEP = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is this key found twice or more in its group, is it not the first there)."""
    order = np.lexsort((keys, group))
    k, g = keys[order], group[order]
    same = np.zeros(len(keys), bool)
    same[1:] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same  # lexsort is stable: the first of equal keys is the earliest
    twice = same.copy()
    twice[:-1] |= same[1:]
    any_[order] = twice
    return any_, later


def _block_counts(column, window: int) -> list[np.ndarray]:
    data, offsets = A.utf8(column)
    docs = len(offsets) - 1
    start, end, first = A.words(data, offsets)
    n_words = np.diff(first)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    word_chars = A.sums_by(chars[end] - chars[start], first)
    symbols = A.sums_by(_SYMBOL[data].astype(np.int64), offsets)
    # lines: runs of anything but \n; those with a word are compared as they stand
    ls, le, lfirst = A.runs(data != 0x0A, offsets)
    has_word = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ldoc = np.repeat(np.arange(docs), np.diff(lfirst))[has_word]
    later = _repeated(A.byte_hashes(A.HASH_A, data, ls[has_word], le[has_word]), ldoc)[1]
    dup_lines = np.bincount(ldoc[later], minlength=docs)
    # windows of consecutive words: mark every word that a repeated window covers
    n = np.maximum(n_words - window + 1, 0)
    head = A.spread(first[:-1], n)
    hashes = A.byte_hashes(A.HASH_A, data, start, end)
    seen = _repeated(A.HASH_B.slices(A.HASH_B.sums(hashes), head, head + window), np.repeat(np.arange(docs), n))[0]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, head[seen], 1)
    np.add.at(cover, head[seen] + window, -1)
    repeat = A.sums_by((np.cumsum(cover[:-1]) > 0).astype(np.int64), first)
    return [n_words, word_chars, symbols, dup_lines, repeat]


def base_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, key (see ``common.row_key``) and the counts of every row."""
    names = ["doc_id", "key", *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, "text"):
            counts = [pa.array(c.astype(np.int64)) for c in _block_counts(block.column(2), window)]
            yield pa.record_batch([block.column(0), block.column(1), *counts], names)

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, " + ", ".join(f"{c} long" for c in _COUNTS))


def common_lines(lines: DataFrame, hosts: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, line) above the limit, from (host, line, key) rows and documents per host."""
    per_line = (lines.select("host", "line", "key").distinct()
                .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs))
    l, h = per_line.alias("l"), hosts.alias("h")
    return (l.join(h, F.col("l.host").eqNullSafe(F.col("h.host")))
            .filter(F.col("n_docs") > F.col("host_docs") * share).select("l.host", "l.line"))


def removed_words(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(doc_id, key, removed): words in lines above the limit, for rows that have such lines."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col(host).cast("string").alias("host"), text_or_empty().alias("text"))
    hosts = own.select("host", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    line = own.select("doc_id", "key", "host", F.explode(F.split("text", "\n")).alias("raw"))
    plain = F.lower(F.trim(F.regexp_replace("raw", r"[\x20\x09-\x0D]+", " ")))
    line = line.select("doc_id", "key", "host", F.regexp_count("raw", F.lit(WORD)).alias("n"), F.xxhash64(plain).alias("line")).filter("n > 0")
    limit = materialize(common_lines(line, hosts, min_docs, share))
    if (limit.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 24)).first()[0] or 0) <= BROADCAST_BYTES:
        # measured to be small: only the lines above the limit are shuffled
        limit = F.broadcast(limit)
    else:
        # one row per line of a document: repeats are added up before anything is shuffled
        line = line.groupBy("host", "line", "doc_id", "key").agg(F.sum("n").alias("n"))
    limit, line = limit.alias("c"), line.alias("l")
    hit = line.join(limit, F.col("l.host").eqNullSafe(F.col("c.host")) & (F.col("l.line") == F.col("c.line")))
    # identical rows (same doc_id and text) have their lines summed together: divide by their number
    copies = own.groupBy("doc_id", "key", "host").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    removed = hit.groupBy("l.doc_id", "l.key", "l.host").agg(F.sum("l.n").alias("removed"))
    r, c = removed.alias("r"), copies.alias("k")
    same = F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.key") == F.col("k.key")) & F.col("r.host").eqNullSafe(F.col("k.host"))
    return r.join(c, same, "left").groupBy("r.doc_id", "r.key").agg(
        F.max(F.col("r.removed") / F.coalesce("k.copies", F.lit(1))).cast("long").alias("removed"))


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """doc_id, the counts, base_failed, n_removed_words and kept for every row."""
    b = base_counts(docs).alias("b")
    r = removed_words(docs, host, min_docs, share).alias("r")
    rows = b.join(r, F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("b.key") == F.col("r.key")), "left")
    removed = F.coalesce(F.col("r.removed"), F.lit(0).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - removed
    rows = rows.select("b.doc_id", *[f"b.{c}" for c in _COUNTS], removed.alias("n_removed_words"), failed.alias("base_failed"),
                       (~failed & (left >= F.col("n_words") * keep)).alias("kept"))
    return rows
