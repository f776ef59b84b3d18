"""Dense numbers for records (S2, S8): 0, 1, 2, ... in file order or by a key.

Every part of the input counts its own rows; the counts, one per part, are
added up in order, and a row's number is its part's offset plus its place in
the part.  No row moves for it in file order, and no task sees all rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseforge.session import materialize

_PART, _PLACE = "__part", "__place"


def _with_offsets(rows: DataFrame, part: str, order, name: str) -> DataFrame:
    """``rows`` with a number; ``part`` tells parts apart, ``order`` sorts their counts.

    The driver sees one count per part, as many as there are tasks or file splits."""
    counts = sorted(rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(_PLACE).alias("first")).collect(), key=lambda r: order(r[part]))
    offsets = accumulate((r["n"] for r in counts), initial=0)
    table = [(r[part], at - r["first"]) for r, at in zip(counts, offsets)]
    parts = rows.sparkSession.createDataFrame(table, rows.select(F.col(part).alias("of"), F.lit(0).cast("long").alias("shift")).schema)
    # one row per part: small by construction
    numbered = rows.join(F.broadcast(parts), F.col(part) == F.col("of"))
    return numbered.withColumn(name, F.col(_PLACE) + F.col("shift")).drop(_PART, _PLACE, "of", "shift")


def number_lines(spark: SparkSession, path: str, keep=None, name: str = "ordinal") -> DataFrame:
    """(value, ordinal): lines of text files, files by path, lines as they stand;
    ``keep``: a condition on ``value``, only lines that meet it are numbered.

    A file split is read by one task from its begin to its end, so its rows'
    places follow each other; splits are put in order by file and offset."""
    lines = spark.read.text(path)
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.select("value", split.alias(_PART))
    if keep is not None:
        lines = lines.where(keep)
    return _with_offsets(lines.withColumn(_PLACE, F.monotonically_increasing_id()), _PART, lambda p: (p["file"], p["start"]), name)


def number_rows(rows: DataFrame, by: list[str], name: str = "ordinal") -> DataFrame:
    """``rows`` with a number in the order of the columns ``by`` (which should tell rows
    apart): range-sorted, then as for lines."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = materialize(rows.withColumn(_PART, F.spark_partition_id()).withColumn(_PLACE, F.monotonically_increasing_id()))
    return _with_offsets(rows, _PART, lambda p: p, name)


def pair_by_position(left: DataFrame, right: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """S3's pairing: the n-th row of one list with the n-th of the other."""
    return left.join(right, ordinal)
