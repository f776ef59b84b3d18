"""SentencePiece encoding and decoding (operator 1) by streaming Viterbi.

Every position of a text has one best path to it: its last piece, and through
that piece's start the path before it.  Only the last ``longest piece``
positions can still be extended, so only their backpointers are kept; as soon
as all their paths run through one boundary, the ids up to it are final.

The vocabulary is a BPE model, whose library applies merges by rank instead of
adding scores.  The path to a position is therefore chosen by the rule that
makes the result the library's: a text's merges leave pieces p1 ... pn exactly
if each neighbouring pair, taken alone, is left as it is by the merges; so the
last piece at a position is the one that fits the path it continues, and there
is exactly one.  Whether two pieces fit is found by undoing their merges in
reverse order and asking whether a merge across their border would have come
first.

No piece of such a model holds a space marker after another character, so all
paths meet before every word; pieces of a word are found once per worker and
different words of a block are stepped through together, as arrays.  Words
longer than ``LONG`` are streamed on their own.

Characters without a piece become their UTF-8 byte pieces.  Decoding joins the
pieces, turns markers into spaces and drops the one that encoding puts first.

Defined results: null and empty texts have no ids and decode to the empty text;
a text that holds the marker character itself (U+2581) decodes to a space
there, as in the library; byte pieces that are no valid UTF-8 decode to U+FFFD;
an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.llm import arrays as A
from phraseforge.llm.lookup import KeyTable, Memo

MARK = "▁"
LONG = 48
#: Text of one block, and ids decoded at a time; words a worker remembers.
BLOCK_BYTES, BLOCK_IDS, REMEMBERED = 3 << 19, 1 << 18, 400_000
_START, _OPEN = -1, -2
_CHAR = 1 << 21  # values from here on stand for a character without a piece


def _keys(text: str, cuts: list[tuple[int, int]]) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.array(cuts, np.int64).reshape(-1, 2)
    return A.HASH_B.slices(_sums(cp), at[:, 0], at[:, 1])


def _sums(cp: np.ndarray) -> np.ndarray:
    return A.HASH_B.sums(A.mix64(cp.astype(np.uint64) + np.uint64(1)))


class PieceModel:
    """Arrays of a BPE piece model, and the memo of words its worker has encoded."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.strings = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.strings[i][1:-1], 16)] = i
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = {self.strings[i]: -sp.get_score(i) for i in plain}  # merges with the higher score come first
        ids = {self.strings[i]: i for i in plain}
        self.unknown = next(i for i in range(n) if sp.is_unknown(i))
        self.raw = [self._raw(sp, i) for i in range(n)]
        if any(MARK in s.lstrip(MARK) for s in ids):
            raise ValueError("pieces with a space marker inside are not supported")
        # how each piece comes about when it is encoded alone, and which pieces never do
        left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        order = np.full(n, -1, np.int64)  # when a piece comes about: single characters before all merges
        whole = set()
        for s, i in ids.items():
            split = _last_merge(s, rank)
            if split is not None:
                whole.add(s)
                if len(s) > 1:
                    left[i], right[i], order[i] = ids[split[0]], ids[split[1]], int(rank[s])
        self.left, self.right, self.order = left, right, order
        self.length = np.array([len(s) for s in self.strings], np.int64)
        pairs = [(ids[s[:k]], ids[s[k:]], int(rank[s])) for s in ids for k in range(1, len(s)) if s[:k] in whole and s[k:] in whole]
        a, b, r = (np.array(x, np.int64) for x in zip(*pairs))
        self.merges = KeyTable(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), r.astype(np.int32))
        found = sorted(whole)
        cuts = np.cumsum([0] + [len(s) for s in found]).tolist()
        self.pieces = KeyTable(_keys("".join(found), list(zip(cuts, cuts[1:]))), np.array([ids[s] for s in found], np.int32))
        self.by_string = {s: ids[s] for s in found}
        self.longest = max(map(len, found))
        self._fits: dict[tuple[int, int], bool] = {}
        self.memo = Memo(REMEMBERED)

    def _raw(self, sp, i: int) -> bytes:
        if sp.is_byte(i):
            return bytes([int(self.strings[i][1:-1], 16)])
        if sp.is_control(i):
            return b""
        return " ⁇ ".encode() if sp.is_unknown(i) else self.strings[i].replace(MARK, " ").encode()

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Are pieces a, b next to each other left as they are by the merges?

        x and y are the symbols at the border at some time, tx and ty the rank of
        the merge that uses each of them up; going back in time, the one that
        came about later is undone.  A merge of x and y that outranks both of
        these (on a tie the left one is done first) would have come before."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        never = np.int64(1) << 40
        tx, ty = np.full(len(a), never), np.full(len(a), never)
        while len(live):
            m = self.merges.get(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)).astype(np.int64)
            m[m < 0] = 2 * never
            bad = (m < tx) & (m <= ty)
            ox, oy = self.order[x], self.order[y]
            ok[live[bad]] = False
            more = ~bad & ((ox >= 0) | (oy >= 0))
            live, x, y, tx, ty, ox, oy = (v[more] for v in (live, x, y, tx, ty, ox, oy))
            undo = ox > oy  # of two that came about at one rank, the left one came first
            tx, ty = np.where(undo, ox, tx), np.where(undo, ty, oy)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def fits(self, a: int, b: int) -> bool:
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            got = self._fits[a, b] = bool(self.fit(np.array([a]), np.array([b]))[0])
        return got


def _last_merge(s: str, rank: dict[str, float]) -> tuple[str, str] | None:
    """Merge the characters of ``s`` by rank; the last two symbols if all of it
    becomes one, itself twice for one character, None if it does not."""
    parts, last = list(s), (s, s)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], float("inf")))
        if parts[best] + parts[best + 1] not in rank:
            return None
        last = (parts[best], parts[best + 1])
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return last


class StreamingViterbi:
    """Encode one character stream with bounded state.

    ``feed`` takes characters and returns the ids that became final, ``close``
    the rest.  Kept are the characters and backpointers after the last final
    boundary; with a window of ``longest`` positions that can still be
    extended, these stay a few windows long on ordinary text."""

    def __init__(self, model: PieceModel):
        self.m = model
        self._chars = ""  # characters after the final boundary
        self._path: list[int] = [_START]  # last piece of the path to each position after it

    def _step(self, c: str) -> None:
        self._chars += c
        i = len(self._chars)
        for k in range(min(i, self.m.longest), 0, -1):
            before = self._path[i - k]
            piece = self.m.by_string.get(self._chars[i - k:i], _OPEN)
            if piece >= 0 and (before < 0 or before >= _CHAR or self.m.fits(before, piece)):
                self._path.append(piece)
                return
        self._path.append(_CHAR + ord(c))

    def _back(self, i: int) -> int:
        return i - (1 if self._path[i] >= _CHAR else int(self.m.length[self._path[i]]))

    def _commit(self, to: int) -> list[int]:
        out, i = [], to
        while i > 0:
            out.append(self._path[i])
            i = self._back(i)
        self._chars, self._path = self._chars[to:], self._path[to:]
        return out[::-1]

    def _meeting(self) -> int:
        """The last boundary that the paths of all open positions run through."""
        n = len(self._chars)
        open_ = set(range(max(0, n - self.m.longest + 1), n + 1))
        while len(open_) > 1:
            last = max(open_)
            open_.remove(last)
            open_.add(self._back(last))
        return open_.pop()

    def feed(self, text: str) -> list[int]:
        out = []
        for c in text:
            self._step(c)
            if len(self._chars) % (4 * self.m.longest) == 0:
                out += self._commit(self._meeting())
        return out

    def close(self) -> list[int]:
        out = self._commit(len(self._chars))
        self._path = [_START]
        return out


def _encode_words(m: PieceModel, cp: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, pieces) of many words at once: the same steps as StreamingViterbi, position by position."""
    by_length = np.argsort(-length, kind="stable")
    first, size = start[by_length], length[by_length]
    sums = _sums(cp)
    last = np.full((len(first), int(size[0]) + 1), _OPEN, np.int32)
    last[:, 0] = _START
    for i in range(1, int(size[0]) + 1):
        open_ = np.arange(np.searchsorted(-size, -i, side="right"))  # words of i characters or more
        for k in range(min(i, m.longest), 0, -1):
            if not len(open_):
                break
            at = first[open_] + i
            piece = m.pieces.get(A.HASH_B.slices(sums, at - k, at))
            known = np.flatnonzero(piece >= 0)
            row, piece = open_[known], piece[known]
            before = last[row, i - k]
            free = (before < 0) | (before >= _CHAR)
            pair, which = np.unique(before[~free].astype(np.int64) << 32 | piece[~free], return_inverse=True)
            good = free.copy()
            good[~free] = m.fit(pair >> 32, pair & 0xFFFFFFFF)[which]
            last[row[good], i] = piece[good]
            keep = np.ones(len(open_), bool)
            keep[known[good]] = False
            open_ = open_[keep]
        last[open_, i] = (_CHAR + cp[first[open_] + i - 1].astype(np.int64)).astype(np.int32)
    # follow the backpointers of all words together, from their ends
    steps, row, at = [], np.arange(len(first)), size.copy()
    while len(row):
        piece = last[row, at]
        steps.append((row, piece))
        at = at - np.where(piece >= _CHAR, 1, m.length[np.minimum(piece, len(m.length) - 1)])
        row, at = row[at > 0], at[at > 0]
    count = np.bincount(np.concatenate([r for r, _ in steps]), minlength=len(first))
    out = np.zeros(int(count.sum()), np.int32)
    stop = np.cumsum(count)
    for k, (r, piece) in enumerate(steps):
        out[stop[r] - 1 - k] = piece
    # back to the order asked for
    back = np.argsort(by_length, kind="stable")
    return count[back], out[A.spread((stop - count)[back], count[back])]


def _to_ids(m: PieceModel, count: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by the ids of their UTF-8 bytes."""
    odd = np.flatnonzero(pieces >= _CHAR)
    if not len(odd):
        return count, pieces
    char, which = np.unique(pieces[odd] - _CHAR, return_inverse=True)
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in char.tolist()]
    width = np.ones(len(pieces), np.int64)
    width[odd] = np.array([len(r) for r in raw])[which]
    out = np.repeat(pieces, width)
    size = np.array([len(r) for r in raw])
    pool = m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    at = np.cumsum(width) - width
    out[A.spread(at[odd], width[odd])] = pool[A.spread((np.cumsum(size) - size)[which], size[which])]
    ends = np.append(0, np.cumsum(count))
    return A.sums_by(width, ends), out


def encode_block(m: PieceModel, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts, as of a ragged array."""
    marked = [MARK + v.replace(" ", MARK) if v else "" for v in values]
    text, cp, offsets = A.code_points(pa.array(marked, pa.large_string()))
    if not len(cp):
        return np.zeros(len(values) + 1, np.int64), np.zeros(0, np.int32)
    mark = cp == ord(MARK)
    new = mark.copy()
    new[1:] &= ~mark[:-1]
    new[offsets[:-1][offsets[:-1] < len(cp)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(cp))
    keys = A.HASH_A.slices(A.HASH_A.sums(A.mix64(cp.astype(np.uint64) + np.uint64(1))), start, end)
    distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
    new = m.memo.missing(distinct)
    if len(new):
        s, size = start[sample[new]], (end - start)[sample[new]]
        short = size <= LONG
        count, parts = np.zeros(len(new), np.int64), []
        c, p = _encode_words(m, cp, s[short], size[short]) if short.any() else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        count[short] = c
        streamed = {}
        for k in np.flatnonzero(~short).tolist():
            stream = StreamingViterbi(m)
            streamed[k] = stream.feed(text[s[k]:s[k] + size[k]]) + stream.close()
            count[k] = len(streamed[k])
        pieces = np.zeros(int(count.sum()), np.int32)
        first = np.cumsum(count) - count
        pieces[A.spread(first[short], count[short])] = p
        for k, ids in streamed.items():
            pieces[first[k]:first[k] + len(ids)] = ids
        m.memo.add(distinct[new], *_to_ids(m, count, pieces))
    at, n = m.memo.take(distinct)
    ids = m.memo.values(at[which], n[which])
    out = np.zeros(len(values) + 1, np.int64)
    out[1:] = np.cumsum(A.sums_by(n[which], np.searchsorted(start, offsets)))
    return out, ids


def _grown(schema, name: str, kind: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != name] + [f"{name} {kind}"])


def _encoded(m: PieceModel, column) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    offsets, ids = encode_block(m, A.texts(column).to_pylist())
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32())), offsets, ids


def encode(docs: DataFrame, path: str, output: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in a new last column (one of that name is replaced)."""
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(path))
    kept = [c for c in docs.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in A.blocks(batches, "text", BLOCK_BYTES):
            yield pa.record_batch([*rows.columns, _encoded(model.value, rows.column("text"))[0]], [*rows.schema.names, output])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, _grown(docs.schema, output, "array<int>"))


def decode_block(m: PieceModel, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
    """Texts of a ragged array of ids."""
    size = np.array([len(r) for r in m.raw], np.int64)
    pool = np.frombuffer(b"".join(m.raw), np.uint8)
    first, out, at = np.cumsum(size) - size, [], 0
    while at < len(offsets) - 1:  # whole texts, about BLOCK_IDS ids at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_IDS, side="right")) - 1)
        part = ids[offsets[at]:offsets[to]]
        n = size[part]
        data = pool[A.spread(first[part], n)].tobytes()
        ends = np.append(0, np.cumsum(n))[offsets[at:to + 1] - offsets[at]].tolist()
        out += [data[a + 1 if data[a:a + 1] == b" " else a:b].decode("utf-8", "replace") if b > a else "" for a, b in zip(ends, ends[1:])]
        at = to
    return out


def decode(df: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids in a new last column (null ids: empty text)."""
    model = df.sparkSession.sparkContext.broadcast(PieceModel(path))
    kept = [c for c in df.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column(ids)
            n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = decode_block(model.value, np.append(0, np.cumsum(n)), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.record_batch([*rows.columns, pa.array(text, pa.string())], [*rows.schema.names, output])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, _grown(df.schema, output, "string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and whether the ids decode to the text again, in one pass over the texts."""
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in A.blocks(batches, "text", BLOCK_BYTES):
            column, offsets, ids = _encoded(model.value, rows.column("text"))
            same = pc.equal(A.texts(rows.column("text")), pa.array(decode_block(model.value, offsets, ids), pa.large_string()))
            yield pa.record_batch([rows.column("doc_id"), column, same], ["doc_id", "ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, round_trip boolean")
