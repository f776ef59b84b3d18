"""Joining rows with a table of words by their frequency.

A plain join deals the rows by word, so the task of a word that makes up a third
of a corpus gets a third of all rows, and every row moves.  Here the table is
written and measured first.  If all of it is small it goes to every task; if
not, its most frequent words do, as many as the bound allows, and only rows of
other words are dealt by word: none of them is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.session import materialize

#: Bytes of keys (and 16 for the rest of a row) that are sent to every task at most.
BROADCAST_BYTES = 64 << 20


def frequent_rows(table: DataFrame, key: str, frequency: str, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the most frequent keys within the bound, the others or None if there
    are none).  The driver sees one size per power of two of the frequency."""
    power = F.floor(F.log2(F.greatest(F.col(frequency).cast("double"), F.lit(1.0))))
    sizes = {r["power"]: r["size"] for r in table.groupBy(power.alias("power")).agg(F.sum(F.octet_length(key) + 16).alias("size")).collect()}
    used, least = 0, None
    for p in sorted(sizes, reverse=True):
        used += sizes[p]
        if used > max_bytes:
            least = p + 1
            break
    if least is None:
        return table, None
    return table.where(power >= least), table.where(power < least)


def frequent_join(rows: DataFrame, table: DataFrame, key: str, frequency: str, how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows.join(table, key, how)`` for ``inner``, ``left`` and ``left_semi``; ``table`` has one
    row per key, ``frequency`` is one of its columns and says how many rows a key has,
    about."""
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("inner, left or left_semi")
    frequent, others = frequent_rows(materialize(table), key, frequency, max_bytes)
    if others is None:
        return rows.join(F.broadcast(frequent), key, how)
    rows = materialize(rows)  # read twice below
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    first = rows.join(F.broadcast(frequent), key, "inner" if how == "left" else how)
    return first.unionByName(rest.join(others, key, how))
