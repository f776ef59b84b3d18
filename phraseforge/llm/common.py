"""Column expressions shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Number of words of a text, 0 for null or empty."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def row_key(col: str = "text") -> Column:
    """Tells rows apart that carry the same doc_id: a hash of the text (identical rows share it)."""
    return F.xxhash64(text_or_empty(col))


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions: set in proportion to the input, as every job here expects."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
