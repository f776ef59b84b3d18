"""Token counts (operator 2): byte-level BPE by rank-synchronous array merging.

A block's texts are cut into pre-tokens by array comparisons on character
classes; different pre-tokens a worker has not met yet are laid out as one
ragged array of symbols.  Each round finds the lowest-ranked pair of every
sequence, merges all its occurrences in all sequences at once, and retires the
sequences that have no pair left; the symbols that survive are the tokens.
Since every merge makes a token that only later-ranked merges use, merging all
occurrences of the lowest pair together equals merging them one by one.

The vocabulary is a ``tokenizers`` JSON file (byte-level BPE, no normalizer, no
prefix space); its added tokens are matched in the text first, as that library
does by default.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
and ties do not matter; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.lookup import KeyTable, Memo

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Characters with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in a contraction, in the order they are tried.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_NO_RANK = np.int32(1 << 30)


def character_classes() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space, other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters stand for themselves, the other bytes take the
    characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Arrays of one vocabulary, and the memo of pre-tokens its worker has counted."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normalizer and prefix space")
        vocab = model["vocab"]
        self.first = np.zeros(256, np.int32)  # symbol of each byte
        for char, byte in byte_symbols().items():
            self.first[byte] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if len(np.unique(self.merged)) != len(pairs):
            raise ValueError("two merges make the same token")
        self.ranks = KeyTable(left << np.uint64(32) | right, np.arange(len(pairs), dtype=np.int32))
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._classes = None
        self.memo = Memo()

    @property
    def classes(self) -> np.ndarray:
        if self._classes is None:
            self._classes = character_classes()
        return self._classes

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.ranks.get(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        return np.where(rank < 0, _NO_RANK, rank)


def pre_tokens(cp: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every pre-token, in no particular order.

    A run of letters, of numbers or of other characters takes one space before
    it along; white space before it otherwise stays together, but for its last
    character; a lone apostrophe takes the letters of a contraction."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes[np.minimum(cp, 0x10FFFF)]
    new = np.empty(len(cp), bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    text_start = np.zeros(len(cp) + 1, bool)
    text_start[offsets] = True
    new |= text_start[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(cp))
    run = kind[start]
    begins_text, ends_text = text_start[start], text_start[end]

    # a run that is not white space: one space before it belongs to it
    space_before = np.zeros(len(start), bool)
    space_before[1:] = (run[:-1] == SPACE) & (cp[start[1:] - 1] == 0x20) & ~begins_text[1:]
    solid = run != SPACE
    head = start - (solid & space_before)
    tail = end.copy()

    # contractions: a run of one apostrophe, no space before it, letters after it in the same text
    quote = np.flatnonzero(solid & (end - start == 1) & (cp[start] == 0x27) & ~space_before & ~ends_text)
    quote = quote[run[np.minimum(quote + 1, len(run) - 1)] == LETTER]
    open_ = np.ones(len(quote), bool)
    for letters in CONTRACTIONS:
        at, fits = end[quote], open_ & (end[quote + 1] - end[quote] >= len(letters)) if len(quote) else open_
        for i, c in enumerate(letters):
            fits = fits & (cp[np.minimum(at + i, len(cp) - 1)] == ord(c))
        tail[quote[fits]] += len(letters)
        head[quote[fits] + 1] += len(letters)
        open_ &= ~fits

    blank = ~solid
    keep_last = blank & ~ends_text  # the last white space goes with what follows, or stands alone
    lone = keep_last & (cp[end - 1] != 0x20)
    tail = np.where(keep_last, end - 1, tail)
    s, e = np.concatenate([head, end[lone] - 1]), np.concatenate([tail, end[lone]])
    real = e > s
    return s[real], e[real]


def merge_counts(model: ByteBPE, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens left of each sequence of a ragged symbol array after all merges (lengths >= 1)."""
    out = lengths.astype(np.int64)
    alive = np.arange(len(lengths))
    sym, n = symbols.astype(np.int32), lengths.astype(np.int64)
    while len(alive):
        first = np.cumsum(n) - n
        rank = np.full(len(sym), _NO_RANK, np.int32)
        rank[:-1] = model.pair_ranks(sym[:-1], sym[1:])
        rank[first + n - 1] = _NO_RANK  # no pair across sequences
        low = np.minimum.reduceat(rank, first)
        going = low < _NO_RANK
        out[alive[~going]] = n[~going]
        inside = np.repeat(going, n)
        sym, rank, low = sym[inside], rank[inside], np.repeat(low[going], n[going])
        alive, n = alive[going], n[going]
        if not len(alive):
            break
        hit = rank == low
        # overlapping occurrences (a a a): every second one of a row of hits, from its left end
        at = np.arange(len(hit))
        begin = hit.copy()
        begin[1:] &= ~hit[:-1]
        since = at - np.maximum.accumulate(np.where(begin, at, 0))
        hit &= since % 2 == 0
        sym[hit] = model.merged[rank[hit]]
        gone = np.zeros(len(hit), bool)
        gone[1:] = hit[:-1]
        n = n - A.sums_by(gone.astype(np.int64), np.append(np.cumsum(n) - n, len(hit)))
        sym = sym[~gone]
    return out


def count_block(model: ByteBPE, values: list[str]) -> np.ndarray:
    """Tokens of each text."""
    extra = np.zeros(len(values), np.int64)
    parts, owner = values, np.arange(len(values))
    if model.added is not None and any(model.added.search(v) for v in values):
        cut = [model.added.split(v) for v in values]
        extra = np.array([len(c) - 1 for c in cut], np.int64)
        parts, owner = [p for c in cut for p in c], np.repeat(owner, extra + 1)
    text, cp, offsets = A.code_points(pa.array(parts, pa.large_string()))
    start, end = pre_tokens(cp, offsets, model.classes)
    if not len(start):
        return extra
    keys = A.HASH_A.slices(A.HASH_A.sums(A.mix64(cp.astype(np.uint64) + np.uint64(1))), start, end)
    distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
    new = model.memo.missing(distinct)
    if len(new):
        raw = [text[a:b].encode() for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())]
        symbols = model.first[np.frombuffer(b"".join(raw), np.uint8)]
        counts = merge_counts(model, symbols, np.array([len(r) for r in raw], np.int64))
        model.memo.add(distinct[new], np.ones(len(new), np.int64), counts.astype(np.int32))
    n = model.memo.values(*model.memo.take(distinct))[which]
    text_of = np.searchsorted(offsets, start, side="right") - 1
    return extra + np.bincount(owner[text_of], weights=n, minlength=len(values)).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(ByteBPE(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in A.blocks(batches, "text"):
            n = count_block(model.value, A.texts(rows.column(1)).to_pylist())
            yield pa.record_batch([rows.column(0), rows.column(2), pa.array(n), pa.array(n > limit)],
                                  ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
