"""Array kernels shared by the operators of this subpackage.

A block is a run of consecutive rows of one Arrow batch whose texts together
stay near ``BLOCK_BYTES``; a single longer text is a block of its own, never
cut.  Inside a block all work is numpy over the UTF-8 bytes (or code points) of
the texts laid end to end, with ``offsets`` marking where each text begins.

Nulls: a null text is an empty text here; callers that must tell them apart
look at the column's validity themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: The separators of a word ``[^\x20\x09-\x0D]+``: space and the five ASCII controls 9-13.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (splitmix finaliser); a bijection, so it adds no collisions."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


#: The prime 2^61 - 1: reducing by it takes shifts and sums only.
_P = np.uint64((1 << 61) - 1)
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_S32, _S29, _S61, _S3 = np.uint64(32), np.uint64(29), np.uint64(61), np.uint64(3)


#: Long arrays are multiplied in parts that stay in a processor's cache.
_PART = 1 << 14


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime but for one possible prime too many: at most 2^61 + 6, for any 64-bit x."""
    high = x >> _S61
    x = x & _P
    x += high
    return x


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, folded, for folded a and b; from products of 32-bit halves."""
    a1, a0, b1, b0 = a >> _S32, a & _LOW32, b >> _S32, b & _LOW32
    middle = a1 * b0
    middle += a0 * b1  # at most 2^62
    a1 *= b1
    a0 *= b0
    # 2^64 is 8 and 2^61 is 1 modulo the prime
    a1 <<= _S3
    a1 += middle >> _S29
    middle &= _LOW29
    middle <<= _S32
    a1 += middle
    a1 += _fold(a0)
    return _fold(a1)


class RollingHash:
    """Polynomial hashes of any slice of a sequence from one running sum.

    ``sum(v[k] * base^k)`` is accumulated modulo the prime 2^61 - 1; a slice's
    hash is the difference of two sums shifted back by the inverse power of its
    start, so equal slices hash alike wherever they stand.  Two different slices
    of n values collide for at most n of the 2^61 bases (modulo a power of two,
    long regular texts would collide for every base)."""

    def __init__(self, base: int):
        self._base = base % int(_P)
        self._inv = pow(self._base, -1, int(_P))
        self._pow = np.ones(1, dtype=np.uint64)
        self._ipow = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, have: np.ndarray, n: int) -> np.ndarray:
        out = np.empty(n, dtype=np.uint64)
        out[: len(have)] = have
        k = len(have)
        while k < n:  # doubling: base^(k+i) = base^k * base^i
            m = min(k, n - k)
            out[k:k + m] = mul61(out[:m], np.array([pow(base, k, int(_P))], np.uint64))
            k += m
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums modulo the prime (folded), one more than values."""
        n = len(values) + 1
        if len(self._pow) < n:
            size = max(n, 1 << 16)
            self._pow = self._powers(self._base, self._pow, size)
            self._ipow = self._powers(self._inv, self._ipow, size)
        out = np.zeros(n, dtype=np.uint64)
        for at in range(0, n - 1, _PART):
            to = min(at + _PART, n - 1)
            terms = mul61(_fold(values[at:to]), self._pow[at:to])
            # halves are summed apart, so that no sum leaves 64 bits
            high = _fold(np.cumsum(terms >> _S32, dtype=np.uint64))
            part = np.cumsum(terms & _LOW32, dtype=np.uint64)
            part += high >> _S29
            part += (high & _LOW29) << _S32
            part += out[at]
            out[at + 1:to + 1] = _fold(part)
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hash of every slice [start, end); the length takes part."""
        out = np.empty(len(start), dtype=np.uint64)
        for at in range(0, len(start), _PART):
            s, e = start[at:at + _PART], end[at:at + _PART]
            h = mul61(_fold(sums[e] + (_P + _P - sums[s])), self._ipow[s])
            h[h >= _P] -= _P
            out[at:at + _PART] = mix64(h + (e - s).astype(np.uint64) * _M1)
        return out


#: Two independent families; their pair is a hash of 122 bits.
HASH_A, HASH_B = RollingHash(0x9E3779B97F4A7C13), RollingHash(0xC2B2AE3D27D4EB4B)
_BYTES_A = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTES_B = mix64(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
BYTE_VALUES = {id(HASH_A): _BYTES_A, id(HASH_B): _BYTES_B}


def byte_hashes(family: RollingHash, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte slice of ``data``."""
    return family.slices(family.sums(BYTE_VALUES[id(family)][data]), start, end)


def texts(column) -> pa.Array:
    """One Arrow string array with 64-bit offsets and without nulls (null -> empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts laid end to end, int64 offsets with one more entry than texts)."""
    arr = texts(column)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into blocks of about ``size`` text bytes (whole rows only)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true cells that never cross a text's end.

    Returns (start, end, first): ``first[d]`` is the index of text d's first run,
    with one more entry than texts."""
    n = len(inside)
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        start[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slices ``[^\\x20\\x09-\\x0D]+`` of a block (see :func:`runs`)."""
    return runs(~SEPARATORS[data], offsets)


def code_points(column) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts as one str, its code points, offsets counted in code points)."""
    parts = texts(column).to_pylist()
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    joined = "".join(parts)
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), off


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes first[i], first[i]+1, ..., counts[i] of them for each i, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(first - (ends - counts), counts)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each group of consecutive values; ``first`` has one more entry than groups."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
