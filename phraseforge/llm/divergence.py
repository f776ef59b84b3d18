"""Source divergence audit (operator 11): chunk factorisation.

1. Every document's white-space chunks are counted; a block of documents passes
   on one row per (language, source, chunk) with its documents and occurrences,
   and these are added up.
2. Dealt and sorted by chunk, each globally distinct chunk is cut into terms
   once; its terms are joined back to the chunk's groups, which gives the
   occurrences of a term in every group of documents.
3. A language keeps the terms on enough of its documents.  The documents of a
   term lie between the largest and the sum of its chunks' documents; only where
   the limit lies between the two are its documents looked up: a second pass
   takes those chunks' documents (a filter of fixed size first, an exact join
   after it), and they are counted as distinct.  Such a chunk stands in fewer
   documents than the limit, so no key of that join is frequent.
4. Smoothed shares of the kept terms are compared, in whole numbers: all sources
   of a language with each other (blocks of terms by all sources, as arrays),
   and each source with its whole language.

A term holds no white space, so no term lies across two chunks.

Defined results: null text, language and source count as ''; every row is a
document of its own, repeated rows too; a group without terms, or a language
that keeps none, still has its pairs; ties are ranked by item; texts of any
length are processed whole; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.common import partitions
from phraseforge.session import materialize

MIN_DOCS, TOP = 10, 10
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Bits of the filter in front of the second pass; (term, source) entries of a block of terms; cells of an array in it.
FILTER_BITS, ENTRIES, CELLS = 1 << 24, 100_000, 1 << 20
BLOCK_BYTES = 1 << 21
#: Counted rows that a task holds to add up before it passes them on.
HELD = 800_000

_COUNTED = ["lang", "source", "chunk", "docs", "n"]
#: Bytes of a term (all bytes of characters beyond ASCII are above 0x7F), and A-Z lower-cased.
_IN_TERM = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_LOWERED = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _chunks(column) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, index of the chunk) of every chunk of a block's texts, and the different chunks."""
    data, offsets = A.utf8(column)
    start, end, first = A.words(data, offsets)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    letters = data[~A.SEPARATORS[data]]
    all_ = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), all_.indices.to_numpy().astype(np.int64), all_.dictionary


def _per_document(row: np.ndarray, chunk: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, chunk, times) of every chunk of every document."""
    both, times = np.unique(row * max(size, 1) + chunk, return_counts=True)
    return both // max(size, 1), both % max(size, 1), times


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, chunk, docs, n) of the documents of a task, added up over its blocks."""
    held: list[pa.RecordBatch] = []
    for rows in A.blocks(batches, "text", BLOCK_BYTES):
        code, langs, sources = _codes(rows)
        row, chunk, distinct = _chunks(rows.column("text"))
        row, chunk, times = _per_document(row, chunk, len(distinct))
        both, at, docs = np.unique(code[row] * max(len(distinct), 1) + chunk, return_inverse=True, return_counts=True)
        n = np.bincount(at, weights=times, minlength=len(both)).astype(np.int64)
        of, which = pa.array(both // max(len(distinct), 1)), pa.array(both % max(len(distinct), 1))
        held.append(pa.record_batch([langs.take(of), sources.take(of), distinct.take(which).cast(pa.string()), pa.array(docs.astype(np.int64)), pa.array(n)],
                                    _COUNTED))
        if sum(x.num_rows for x in held) > HELD:
            yield _together(held)
            held = []
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each chunk and group of some counted rows."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()
    if not rows:
        return held[0]
    chunk, group, docs, n, chunks, langs, sources = _added_up(rows[0])
    return pa.record_batch([langs.take(pa.array(group)), sources.take(pa.array(group)), chunks.take(pa.array(chunk)), pa.array(docs), pa.array(n)], _COUNTED)


def _codes(rows: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of each row's (lang, source), and the language and source of each number."""
    lang, source = (rows.column(c).dictionary_encode() for c in ("lang", "source"))
    wide = max(len(source.dictionary), 1)
    both, code = np.unique(lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy(), return_inverse=True)
    return code.astype(np.int64), lang.dictionary.take(pa.array(both // wide)), source.dictionary.take(pa.array(both % wide))


def _added_up(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(chunk, group, docs, n) of each chunk in each group, sorted; the chunks, and the
    language and source of each group."""
    chunk = rows.column("chunk").dictionary_encode()
    code, langs, sources = _codes(rows)
    both, at = np.unique(chunk.indices.to_numpy().astype(np.int64) * max(len(langs), 1) + code, return_inverse=True)
    docs, n = (np.zeros(len(both), np.int64) for _ in range(2))
    np.add.at(docs, at, rows.column("docs").to_numpy())
    np.add.at(n, at, rows.column("n").to_numpy())
    return both // max(len(langs), 1), both % max(len(langs), 1), docs, n, chunk.dictionary, langs, sources


def _cut_chunks(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of whole chunks to (lang, source, chunk, term, docs, docs of the chunk in the language, n)."""
    chunk, group, docs, n, chunks, langs, sources = _added_up(rows)
    lang = langs.dictionary_encode()
    of_lang = chunk * max(len(lang.dictionary), 1) + lang.indices.to_numpy()[group]
    seen, at = np.unique(of_lang, return_inverse=True)
    together = np.zeros(len(seen), np.int64)
    np.add.at(together, at, docs)
    # terms of each distinct chunk: runs of letters and bytes beyond ASCII, with A-Z lower-cased
    data, offsets = A.utf8(chunks)
    start, end, first = A.runs(_IN_TERM[data], offsets)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    lower = _LOWERED[data[_IN_TERM[data]]]
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(lower)).dictionary_encode()
    owner, term, times = _per_document(np.repeat(np.arange(len(chunks)), np.diff(first)), found.indices.to_numpy().astype(np.int64), len(found.dictionary))
    # joined back: every term of a chunk with every group of the chunk
    begin = np.searchsorted(chunk, np.arange(len(chunks) + 1))
    width = np.diff(begin)[owner]
    entry, pair = A.spread(begin[owner], width), np.repeat(np.arange(len(owner)), width)
    of = pa.array(group[entry])
    return pa.record_batch([langs.take(of), sources.take(of), chunks.take(pa.array(owner[pair])), found.dictionary.take(pa.array(term[pair])).cast(pa.string()),
                            pa.array(docs[entry]), pa.array(together[at][entry]), pa.array(n[entry] * times[pair])],
                           ["lang", "source", "chunk", "term", "docs", "of_chunk", "n"])


def _chunk_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_cut_chunks`, from rows sorted by chunk: a chunk's rows are added
    up until its last one has come, however many batches they fill."""
    held = None
    for rows in batches:
        if held is not None:
            rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
        if not rows.num_rows:
            continue
        same = pc.equal(rows.column("chunk"), rows.column("chunk")[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield _cut_chunks(rows.slice(0, cut))
        held = _together([rows.slice(cut)])
    if held is not None:
        yield _cut_chunks(held)


def _slots(lang: pa.Array, chunk: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each (language, chunk) in the filter."""
    def hashes(column):
        data, offsets = A.utf8(column)
        return A.byte_hashes(A.HASH_A, data, offsets[:-1], offsets[1:])

    h = A.mix64(hashes(lang) + np.uint64(1)) ^ hashes(chunk)
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter(chunks: DataFrame) -> np.ndarray:
    """Bits set for every (lang, chunk), as bytes: the driver sees FILTER_BITS / 8 bytes at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            slots = np.unique(np.concatenate(_slots(rows.column(0), rows.column(1))))
            word, first = np.unique(slots >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), first) if len(word) else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    words = chunks.select("lang", "chunk").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _documents_of(docs: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(lang, chunk, row): the documents of ``chunks``, each of which stands in fewer
    than ``limit`` documents of its language (and of some other chunks)."""
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter(chunks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(flags.value).view(bool)
        for rows in A.blocks(batches, "text", BLOCK_BYTES):
            lang = rows.column("lang").dictionary_encode()
            row, chunk, distinct = _chunks(rows.column("text"))
            row, chunk, _ = _per_document(row, chunk, len(distinct))
            both, at, n = np.unique(lang.indices.to_numpy()[row].astype(np.int64) * max(len(distinct), 1) + chunk, return_inverse=True, return_counts=True)
            l, c = lang.dictionary.take(pa.array(both // max(len(distinct), 1))), distinct.take(pa.array(both % max(len(distinct), 1)))
            one, two = _slots(l, c)
            take = (wanted[one] & wanted[two] & (n < limit))[at]
            at = pa.array(at[take])
            yield pa.record_batch([l.take(at), c.take(at).cast(pa.string()), rows.column("row").take(pa.array(row[take]))], ["lang", "chunk", "row"])

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "lang string, chunk string, row long")


def chunk_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, chunk, term, docs, of_chunk, n): documents and occurrences of each
    chunk in each group, documents of the chunk in the language, once per term of it."""
    counts = docs.mapInArrow(_count_chunks, "lang string, source string, chunk string, docs long, n long")
    counts = counts.repartition(partitions(docs), "chunk").sortWithinPartitions("chunk")
    return counts.mapInArrow(_chunk_terms, "lang string, source string, chunk string, term string, docs long, of_chunk long, n long")


def kept_terms(docs: DataFrame, parts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of terms on ``min_docs`` documents of the language or more, as (lang, source, term, n)."""
    whole = Window.partitionBy("lang", "term")
    parts = parts.withColumn("least", F.max("of_chunk").over(whole)).withColumn("most", F.sum("docs").over(whole))
    parts = materialize(parts.filter(F.col("most") >= min_docs))
    unclear = parts.filter(F.col("least") < min_docs).select("lang", "term", "chunk").distinct()
    rows = _documents_of(docs, unclear.select("lang", "chunk").distinct(), min_docs)
    looked_up = (unclear.join(rows, ["lang", "chunk"]).groupBy("lang", "term").agg(F.countDistinct("row").alias("found"))
                 .filter(F.col("found") >= min_docs).select("lang", "term"))
    sure = parts.filter(F.col("least") >= min_docs).select("lang", "source", "term", "n")
    more = parts.filter(F.col("least") < min_docs).join(looked_up, ["lang", "term"]).select("lang", "source", "term", "n")
    return materialize(sure.union(more).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))


def _shares(count, size):
    """1 + floor(SCALE * (count + 2) / size), exactly: beyond 64 bits in Python's whole numbers."""
    if np.max(count, initial=0) >= (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + 2) // int(s) for c, s in np.broadcast(count, size)], np.int64)
    return 1 + SCALE * (count + 2) // size


def _compare(min_rank: int):
    names = ["lang", "part", "source", "item", "value"]

    def run(key: tuple[pa.Scalar, ...], entries: pa.Table, groups: pa.Table) -> pa.Table:
        """A block of terms of one language: the sum of distances of all sources a < b
        (part ``pair``), and each source's most over-used terms (part ``term``)."""
        sources = groups.column("source").to_pylist()
        order = np.array(sorted(range(len(sources)), key=sources.__getitem__), np.int64)
        sources = groups.column("source").combine_chunks().take(pa.array(order))
        total, kept = (groups.column(c).to_numpy()[order] for c in ("total", "kept"))
        size = total + 2 * kept
        number = {s: i for i, s in enumerate(sources.to_pylist())}
        own = entries.column("source").combine_chunks().dictionary_encode()
        at = np.array([number[s] for s in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()]
        term = entries.column("term").combine_chunks().dictionary_encode()
        which, n = term.indices.to_numpy().astype(np.int64), entries.column("n").to_numpy()
        by_term = np.lexsort((at, which))
        at, which, n = at[by_term], which[by_term], n[by_term]
        p, none = _shares(n, size[at]), _shares(np.zeros(len(size), np.int64), size)
        step, sums = max(1, CELLS // max(len(sources), 1)), np.zeros((len(sources), len(sources)), np.int64)
        for begin in range(0, len(term.dictionary), step):
            some = slice(*np.searchsorted(which, [begin, begin + step]))
            cells = np.repeat(none[:, None], min(step, len(term.dictionary) - begin), axis=1)
            cells[at[some], which[some] - begin] = p[some]
            for a in range(len(sources) - 1):
                d, s = cells[a + 1:] - cells[a], cells[a + 1:] + cells[a]
                d *= d
                d //= s
                sums[a, a + 1:] += d.sum(axis=1)
        a, b = np.triu_indices(len(sources), 1)
        whole = np.zeros(len(term.dictionary), np.int64)
        np.add.at(whole, which, n)
        q = _shares(whole, groups.column("whole").to_numpy()[0] + 2 * kept[0])[which]
        over = p > q
        at, which, f = at[over], which[over], (p[over] - q[over]) ** 2 // (p[over] + q[over])
        place = np.empty(len(term.dictionary), np.int64)  # of each term among the others, by its code points
        place[sorted(range(len(place)), key=term.dictionary.to_pylist().__getitem__)] = np.arange(len(place))
        best = np.lexsort((place[which], -f, at))
        rank = np.arange(len(best)) - np.searchsorted(at[best], at[best])
        best = best[rank < min_rank]  # no other term of the block can be among the first
        count = len(a) + len(best)
        return pa.table([pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(count, np.int64))),
                         pa.array(["pair", "term"]).take(pa.array((np.arange(count) >= len(a)).astype(np.int64))),
                         sources.take(pa.array(np.concatenate([a, at[best]]))),
                         pa.concat_arrays([sources.take(pa.array(b)), term.dictionary.take(pa.array(which[best]))]),
                         pa.array(np.concatenate([sums[a, b], f[best]]))], names)

    return run


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if top is None else rows.filter(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every source against each other source of
    its language (part ``pair``), and its ``top`` most over-used terms (part ``term``)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = kept_terms(docs, chunk_terms(docs), min_docs)
    size = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"))
    groups = (docs.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(size, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "entries", "kept")]))
    groups = materialize(groups.withColumn("whole", F.sum("total").over(Window.partitionBy("lang"))))

    # blocks of a language's terms, each compared as one array
    langs = groups.groupBy("lang").agg(F.ceil(F.sum("entries") / ENTRIES).cast("int").alias("blocks"))
    entries = counts.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "source", "n")
    beside = (groups.join(langs.filter("blocks > 0"), "lang")
              .select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "kept", "whole")
              .toDF("lang", "block", "source", "total", "kept", "whole"))  # columns of its own: both sides come from the same groups
    compared = materialize(entries.groupBy("lang", "block").cogroup(beside.groupBy("lang", "block"))
                           .applyInArrow(_compare(top), "lang string, part string, source string, item string, value long"))
    sums = compared.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "value", sides.alias("s")).select("lang", "s.source", "s.item", "value")
    # a language that keeps no term: all its pairs are at 0
    bare = groups.filter("kept = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    terms = compared.filter("part = 'term'").select("lang", "source", "item", "value")
    out = [_ranked(rows, n).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
           for part, rows, n in (("pair", pairs.union(bare), None), ("term", terms, top))]
    return out[0].union(out[1])
