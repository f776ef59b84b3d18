"""Array look-up tables for the tokenizer operators: fixed tables and a growing memo."""

from __future__ import annotations

import numpy as np

from phraseforge.llm.arrays import mix64, spread

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class KeyTable:
    """Fixed map from 64-bit keys to int32 values; whole arrays are looked up at once
    (open addressing at a quarter full, so most keys are found at the first slot)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, _EMPTY, np.uint64)
        self._values = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self._keys[slot[todo]] == _EMPTY
            self._keys[slot[todo[free]]] = keys[todo[free]]  # of several keys for one slot, the last stays
            placed = self._keys[slot[todo]] == keys[todo]
            self._values[slot[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 if it is not in the table."""
        slot = self._slot(keys)
        held = self._keys[slot]
        out = np.where(held == keys, self._values[slot], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != _EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self._mask
            held = self._keys[slot]
            out[todo[held == keys[todo]]] = self._values[slot[held == keys[todo]]]
            more = (held != keys[todo]) & (held != _EMPTY)
            todo, slot = todo[more], slot[more]
        return out


class Memo:
    """Ragged int32 results by 64-bit key, kept by a worker between blocks.

    Bounded: when more than ``limit`` keys are held it starts afresh.  Keys are
    hashes modulo a 61-bit prime: of a million keys held, a new one meets a
    wrong entry with a probability of 2^-41."""

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._start = np.zeros(0, np.int64)
        self._count = np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.int32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of the (sorted, distinct) keys that are not held."""
        if len(self._keys) > self.limit:
            self._clear()
        if not len(self._keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.flatnonzero(self._keys[at] != keys)

    def add(self, keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> None:
        start = np.cumsum(counts) - counts + len(self._pool)
        self._pool = np.concatenate([self._pool, values])
        at = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, at, keys)
        self._start = np.insert(self._start, at, start)
        self._count = np.insert(self._count, at, counts)

    def take(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first index in :meth:`values`, count) of each held key."""
        at = np.searchsorted(self._keys, keys)
        return self._start[at], self._count[at]

    def values(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self._pool[spread(start, count)]
