"""Documents as rows of words, worked on in blocks of arrays.

A document is one row ``(doc_id, at, words, kind)`` (:func:`~phraseforge.operators.tokens.token_rows`):
its words in order, a number per word (0: no content word, 1: content word, 2: one
tagged JJ), and the words' positions where they are not 0, 1, 2, ...: several texts
under one id are one document whose tokens are merged by position.  What belongs to
one document -- runs, phrases, counts, scores, the best k -- is computed for a whole
block of documents in numpy, so no token is a row of its own, is sorted or shuffled.

A block holds about ``BLOCK_TOKENS`` words; a longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the documents that are worked on together.
BLOCK_TOKENS = 200_000


# Bytes of text of the documents that are one group (:func:`dealt`).
BLOCK_BYTES = 1 << 20


def map_blocks(rows: DataFrame, fn: Callable, schema: str, wrap: Callable | None = None) -> DataFrame:
    """``fn`` over the blocks of rows whose third column is the list of words; a block is a
    ``Block`` of (doc_id, at, words, kind, ...) rows unless ``wrap`` says otherwise."""

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + BLOCK_TOKENS, side="right")))
                yield fn((wrap or Block)(batch.slice(at, to - at)))
                at = to

    return rows.mapInArrow(run, schema)


def dealt(docs: DataFrame, size: Column, *columns: str, blocks: int | None = None) -> DataFrame:
    """(block, *columns): documents dealt to blocks of about ``BLOCK_BYTES`` of ``size`` (or to so many
    ``blocks``) by a hash of their id, so that all rows of an id share a block; the driver sees the
    number of blocks."""
    if blocks is None:
        blocks = docs.agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int")).first()[0]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), *columns).repartition(tasks, "block").sortWithinPartitions("block")


def sorted_names(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words in order, place of every word among them): the same for every order of the rows."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def one_batch(rows: pa.Table, *columns: str) -> pa.RecordBatch:
    rows = rows.select(list(columns)).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns], names=list(columns))


def by_id(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct ids, a null one included, number of every row's id)."""
    coded = ids.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Lists:
    """Lists of words by id: ``words``, ``doc`` (into ``ids``), ``pos``; rows of one id are one document."""

    def __init__(self, ids: pa.Array, lists: pa.ListArray):
        self.words, lengths = flat(lists)
        self.ids, of = by_id(ids)
        self.several = len(self.ids) < len(ids)
        self.doc = np.repeat(of, lengths)
        self.pos = np.arange(len(self.doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def in_order(self, which: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places ``which`` by document, position and number of the word."""
        if not self.several:
            return which
        return which[np.lexsort((word[which], self.pos[which], self.doc[which]))]


def rewrite_words(rows: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(block, doc_id, terms): the words of (block, doc_id, toks) rows replaced and dropped as ``rewrite``
    says for the distinct words of every block: it gets (block, slot, word, n), n the
    occurrences there, and returns (block, slot, term) for the words that stay.  A word
    has at most as many rows as there are blocks.  Documents without a term are left out."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, place = sorted_names(flat(one_batch(table, "toks").column(0))[0])
        return pa.table({"block": pa.array(np.full(len(names), key[0].as_py(), np.int32)), "slot": pa.array(np.arange(len(names)), pa.int32()),
                         "word": names, "n": pa.array(np.bincount(place, minlength=len(names)), pa.int64())})

    def replace(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        table, found = one_batch(table, "doc_id", "toks"), one_batch(found, "slot", "term")
        lists = Lists(table.column(0), table.column(1))
        names, place = sorted_names(lists.words)
        terms, term = sorted_names(found.column(1))
        of = np.full(len(names), -1)
        of[found.column(0).to_numpy(zero_copy_only=False)] = term
        word = of[place]
        at = lists.in_order(np.flatnonzero(word >= 0), word)
        doc, first = lists.doc[at], np.flatnonzero(np.diff(lists.doc[at], prepend=-1))
        out = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), terms.take(pa.array(word[at])))
        return pa.table({"block": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "doc_id": lists.ids.take(pa.array(doc[first])), "terms": out})

    words = rows.select("block", "toks").groupBy("block").applyInArrow(count, "block int, slot int, word string, n long")
    back = rewrite(words).select(F.col("block").alias("of"), "slot", "term")
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(replace, f"block int, doc_id {kind}, terms array<string>")


def grams(words: pa.Array, doc: np.ndarray, n_min: int, n_max: int):
    """(n, place of the first word, number) of all n-grams within a document; equal n-grams
    share a number, and numbers are those of the sorted n-grams."""
    names, code = sorted_names(words)
    at, number = np.arange(len(code)), code
    for n in range(1, n_max + 1):
        if n > 1:
            fits = at + n - 1 < len(code)
            at, number = at[fits], number[fits]
            same = doc[at + n - 1] == doc[at]
            at, number = at[same], number[same]
            number = np.unique(number * max(1, len(names)) + code[at + n - 1], return_inverse=True)[1]
        if n >= n_min:
            yield n, at, number


def gram_texts(words: pa.Array, at: np.ndarray, n: int) -> pa.Array:
    if n == 1:
        return words.take(pa.array(at))
    parts = words.take(pa.array((at[:, None] + np.arange(n)).ravel()))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * n, pa.int32()), parts), " ")


def flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(values of all lists, length of each list); a null list is empty."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def place_in_group(group: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))


class Block:
    """Some documents: ``doc``, ``pos``, ``kind`` and ``code`` (into ``names``) of every word."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows, self.ids, self.n = rows, rows.column(0), rows.num_rows
        self.words, self.lengths = flat(rows.column(2))
        self.doc = np.repeat(np.arange(self.n), self.lengths)
        self.kind = rows.column(3).flatten().to_numpy(zero_copy_only=False)
        self.pos = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        own = rows.column(1).is_valid().to_numpy(zero_copy_only=False)
        self.merged = bool(own.any())
        if self.merged:
            self.pos[np.repeat(own, self.lengths)] = rows.column(1).flatten().to_numpy(zero_copy_only=False)

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        """The block of a group's (doc_id, at, words, kind) rows; rows of one id are one document,
        merged by position."""
        block = cls(one_batch(rows, "doc_id", "at", "words", "kind"))
        ids, of = by_id(block.ids)
        if len(ids) < block.n:
            doc = of[block.doc]
            order = np.lexsort((block.kind, sorted_names(block.words)[1], block.pos, doc))
            block.ids, block.n, block.merged = ids, len(ids), True
            block.doc, block.pos, block.kind, block.words = doc[order], block.pos[order], block.kind[order], block.words.take(pa.array(order))
        return block

    def null_ids(self) -> np.ndarray:
        return self.ids.is_null().to_numpy(zero_copy_only=False)

    def encode(self, more: pa.Array | None = None) -> None:
        """``code`` of every word (those of ``more`` after the own ones), and the
        documents' word types: ``types`` (document * n_names + code, sorted), ``of``
        (the type of every own word), ``first`` (a type's first word)."""
        words = self.words if more is None else pa.concat_arrays([self.words, more])
        coded = words.dictionary_encode()
        self.code, self.names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.n_names = max(1, len(self.names))
        self.types, self.first, self.of = np.unique(self.doc * self.n_names + self.code[:len(self.words)], return_index=True, return_inverse=True)

    def type_names(self, types: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(self.types[types] % self.n_names))

    def runs(self, member: np.ndarray) -> Runs:
        """The maximal runs of member words at adjacent positions."""
        at = np.flatnonzero(member)
        doc = self.doc[at]
        island = self.pos[at] - place_in_group(doc)
        if self.merged:  # a run is what shares an island, wherever it stands
            order = np.lexsort((island, doc))
            at, doc, island = at[order], doc[order], island[order]
        first = np.ones(len(at), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (island[1:] != island[:-1])
        return Runs(self, at, np.flatnonzero(first))

    def candidates(self) -> Runs:
        """W1 + F3: runs of content words; one whose last tag is JJ is dropped whole."""
        runs = self.runs(self.kind > 0)
        return runs.keep(self.kind[runs.at[runs.ends() - 1]] != 2)


class Runs:
    """Runs of words: ``at`` are the words' places, ``starts`` where in ``at`` a run begins."""

    def __init__(self, block: Block, at: np.ndarray, starts: np.ndarray):
        self.block, self.at, self.starts = block, at, starts
        self.doc = block.doc[at[starts]]

    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], len(self.at))[:len(self.starts)]

    def keep(self, which: np.ndarray) -> Runs:
        sizes = self.ends() - self.starts
        at = self.at[np.repeat(which, sizes)]
        sizes = sizes[which]
        return Runs(self.block, at, np.cumsum(sizes) - sizes)

    def phrases(self) -> pa.Array:
        offsets = pa.array(np.append(self.starts, len(self.at)), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.block.words.take(pa.array(self.at))), " ")


class Phrases:
    """The distinct phrases of each document: ``doc``, ``code`` (into ``names``), ``first``
    (the number of a run), ``count``, and every run's phrase (``inverse``)."""

    def __init__(self, runs: Runs):
        coded = runs.phrases().dictionary_encode()
        self.names = coded.dictionary
        key = runs.doc * max(1, len(self.names)) + coded.indices.to_numpy(zero_copy_only=False)
        key, self.first, self.inverse, self.count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        self.doc, self.code = np.divmod(key, max(1, len(self.names)))
        # byte order of UTF-8, Spark's order of strings
        self.order = np.empty(len(self.names), np.int64)
        self.order[pc.sort_indices(self.names).to_numpy()] = np.arange(len(self.names))

    def best(self, k: int | None, *descending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """O1: (places of each document's ``k`` best phrases by the given numbers, ties
        by phrase; their ranks from 1).  ``None``: all."""
        order = np.lexsort((self.order[self.code], *[-x for x in reversed(descending)], self.doc))
        rank = place_in_group(self.doc[order]) + 1
        if k is not None:
            order, rank = order[rank <= k], rank[rank <= k]
        return order, rank

    def texts(self, places: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(self.code[places]))


def units(x: np.ndarray) -> np.ndarray:
    """Scores in units of 1e-9, half away from zero, as Spark's ``round(x, 9)`` gives them."""
    y = np.abs(x) * 1e9
    out = np.floor(y + 0.5)
    # as close to a half as the product's error: decided on the number's decimals
    unsure = np.flatnonzero((np.abs(y - np.floor(y) - 0.5) <= np.maximum(1e-4, y * 1e-15)) | (y >= 2.0 ** 50))
    out = out.astype(np.int64)
    for i in unsure:
        out[i] = int(abs(Decimal(repr(float(x[i])))).scaleb(9).quantize(Decimal(1), "ROUND_HALF_UP"))
    return np.where(x < 0, -out, out)


class Sums:
    """Exact sums of 64-bit numbers over runs, as two halves."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        high, low = (np.add.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64) for x in (values >> 32, values & 0xFFFFFFFF))
        self.high, self.low = high + (low >> 32), low & 0xFFFFFFFF

    def decimals(self, places: np.ndarray, kind: pa.DataType) -> pa.Array:
        """The sums at ``places`` as decimals of 9 places."""
        return pa.array([Decimal((h << 32) + lo).scaleb(-9) for h, lo in zip(self.high[places].tolist(), self.low[places].tolist())], kind)


SCORE = "decimal(30,9)"


def best_phrases(block: Block, word_units: np.ndarray, k: int) -> pa.RecordBatch:
    """A10 + O1: (doc_id, rank, phrase, score) of each document's ``k`` best candidate
    phrases, scored by the exact sum of ``word_units`` of their words."""
    runs = block.candidates()
    sums = Sums(word_units[runs.at], runs.starts)
    phrases = Phrases(runs)
    # every run of a phrase in a document has the same sum
    order, rank = phrases.best(k, sums.high[phrases.first], sums.low[phrases.first])
    return pa.record_batch([block.ids.take(pa.array(phrases.doc[order])), pa.array(rank.astype(np.int32)), phrases.texts(order),
                            sums.decimals(phrases.first[order], pa.decimal128(30, 9))], ["doc_id", "rank", "phrase", "score"])


def candidate_counts(rows: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, phrase, n) -- occurrences of each candidate phrase, of the ``k`` most
    frequent ones of a document if ``k`` is given (ties by phrase)."""

    def run(block: Block) -> pa.RecordBatch:
        phrases = Phrases(block.candidates())
        order, _ = phrases.best(k, phrases.count)
        return pa.record_batch([block.ids.take(pa.array(phrases.doc[order])), phrases.texts(order), pa.array(phrases.count[order])],
                               ["doc_id", "phrase", "n"])

    return map_blocks(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, phrase string, n long")


def candidate_lists(rows: DataFrame) -> DataFrame:
    """(doc_id, phrases): the distinct candidate phrases of each document that has one,
    most frequent first (ties by phrase)."""

    def run(block: Block) -> pa.RecordBatch:
        phrases = Phrases(block.candidates())
        order, rank = phrases.best(None, phrases.count)
        first = np.flatnonzero(rank == 1)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), phrases.texts(order))
        return pa.record_batch([block.ids.take(pa.array(phrases.doc[order][first])), lists], ["doc_id", "phrases"])

    return map_blocks(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, phrases array<string>")
