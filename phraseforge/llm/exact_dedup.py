"""Exact dedup (operator 8): a cuckoo-filter index of live text digests.

Digests are spread over index buckets by their first bits; each bucket is one
group on one executor and holds a cuckoo filter (short fingerprints, insert and
delete) beside the digests themselves.  A digest the filter has not seen is new
for sure; a filter hit is looked up in the stored content of its cuckoo bucket
before it counts.  When an insertion finds no free slot the filter doubles and
is refilled from the stored digests.

A text shared by very many rows reaches the index as at most ``SALT`` rows: its
rows are summed per (digest, salt) before the shuffle.

Defined results: a null text equals the empty text; of rows with equal text the
largest doc_id stays (a null doc_id only if all are null), and of rows that
also share the doc_id exactly one; an empty table gives an empty result; extra
columns are ignored by :func:`decisions` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.llm.common import partitions, text_or_empty
from phraseforge.session import materialize

SALT = 8
INDEX_SCHEMA = "bucket int, digest string, keep_id long, group_size long"


class CuckooIndex:
    """Live digests of one bucket: a cuckoo filter in front of the stored entries.

    An entry is ``[digest, keep_id, group_size]``; it lives in the list of the
    first of its two cuckoo buckets."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self._reset(buckets)
        self.size = 0

    def _reset(self, buckets: int) -> None:
        self._mask = buckets - 1
        self._slots: list[list[int]] = [[] for _ in range(buckets)]
        self._content: dict[int, list[list]] = {}

    def _place(self, digest: str) -> tuple[int, int, int]:
        """(fingerprint, first bucket, second bucket)."""
        h = int(digest[16:32], 16)
        print_ = (h >> 44) | 1
        first = h & self._mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ ((print_ * 0x5BD1E995) & self._mask)

    def may_hold(self, digest: str) -> bool:
        p, a, b = self._place(digest)
        return p in self._slots[a] or p in self._slots[b]

    def find(self, digest: str) -> list | None:
        """The live entry of a digest: filter first, then the stored content."""
        p, a, b = self._place(digest)
        if p in self._slots[a] or p in self._slots[b]:
            for entry in self._content.get(a, ()):
                if entry[0] == digest:
                    return entry
        return None

    def _seat(self, digest: str) -> bool:
        p, a, b = self._place(digest)
        for at in (a, b):
            if len(self._slots[at]) < self.SLOTS:
                self._slots[at].append(p)
                return True
        at = b
        for k in range(self.KICKS):
            seats = self._slots[at]
            p, seats[k % self.SLOTS] = seats[k % self.SLOTS], p
            at = self._other(at, p)
            if len(self._slots[at]) < self.SLOTS:
                self._slots[at].append(p)
                return True
        return False

    def _grow(self) -> None:
        entries = list(self.entries())
        buckets = 2 * (self._mask + 1)
        while True:
            self._reset(buckets)
            for e in entries:
                self._content.setdefault(self._place(e[0])[1], []).append(e)
            if all(self._seat(e[0]) for e in entries):
                return
            buckets *= 2

    def insert(self, digest: str, keep_id: int | None, count: int) -> bool:
        """Add rows of a digest; true if the digest was not live before."""
        entry = self.find(digest)
        if entry is not None:
            if keep_id is not None and (entry[1] is None or keep_id > entry[1]):
                entry[1] = keep_id
            entry[2] += count
            return False
        self._content.setdefault(self._place(digest)[1], []).append([digest, keep_id, count])
        self.size += 1
        if not self._seat(digest):
            self._grow()
        return True

    def delete(self, digest: str) -> bool:
        """Retire a digest; only one that is verified live frees a slot."""
        entry = self.find(digest)
        if entry is None:
            return False
        p, a, b = self._place(digest)
        self._slots[a if p in self._slots[a] else b].remove(p)
        self._content[a].remove(entry)
        self.size -= 1
        return True

    def entries(self) -> Iterator[list]:
        for held in self._content.values():
            yield from held


def _index_table(bucket: int | None, index: CuckooIndex) -> pa.Table:
    held = list(index.entries())
    return pa.table({"bucket": pa.array([bucket] * len(held), pa.int32()),
                     "digest": pa.array([e[0] for e in held], pa.string()),
                     "keep_id": pa.array([e[1] for e in held], pa.int64()),
                     "group_size": pa.array([e[2] for e in held], pa.int64())})


def _apply(changes: pa.Table, index: CuckooIndex) -> None:
    for op, digest, doc, n in zip(*(changes.column(c).to_pylist() for c in ("op", "digest", "doc_id", "n"))):
        if op == "delete":
            index.delete(digest)
        else:
            index.insert(digest, doc, n)


def _fresh(key: tuple[pa.Scalar, ...], changes: pa.Table) -> pa.Table:
    index = CuckooIndex()
    _apply(changes, index)
    return _index_table(key[0].as_py(), index)


def _updated(key: tuple[pa.Scalar, ...], held: pa.Table, changes: pa.Table) -> pa.Table:
    index = CuckooIndex()
    for digest, keep, n in zip(*(held.column(c).to_pylist() for c in ("digest", "keep_id", "group_size"))):
        index.insert(digest, keep, n)
    # deletions first: a digest deleted and inserted in one step ends up live with the new rows only
    _apply(changes.sort_by([("op", "ascending")]), index)
    return _index_table(key[0].as_py(), index)


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, rows): one row per distinct text and doc_id."""
    return (docs.select(F.sha2(text_or_empty(), 256).alias("digest"), "doc_id")
            .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("rows")))


def insertions(found: DataFrame, buckets: int) -> DataFrame:
    """Changes (bucket, op, digest, doc_id, n) that insert what :func:`digests` found."""
    salt = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(SALT))
    summed = found.groupBy("digest", salt.alias("salt")).agg(F.max("doc_id").alias("doc_id"), F.sum("rows").alias("n"))
    return summed.select(bucket_of(buckets).alias("bucket"), F.lit("insert").alias("op"), "digest", "doc_id", "n")


def bucket_of(buckets: int):
    return F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def build_index(changes: DataFrame) -> DataFrame:
    """A new index table (INDEX_SCHEMA) from changes."""
    return changes.groupBy("bucket").applyInArrow(_fresh, INDEX_SCHEMA)


def update_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after inserting and deleting digests; both sides use the same bucket count."""
    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInArrow(_updated, INDEX_SCHEMA)


def decisions(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    found = materialize(digests(docs))
    index = build_index(insertions(found, buckets or partitions(docs)))
    rows = found.join(index.select("digest", "keep_id", "group_size"), "digest")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    stay = decisions(docs, buckets).filter("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.sha2(text_or_empty(), 256).alias("sha"))
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha")), "left_semi")
    rest = [F.col(f"row.`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", "sha").orderBy(*rest, F.lit(0))
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*")
