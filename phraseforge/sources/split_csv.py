"""CSV whose records may span lines, read by many tasks a file.

A task that starts in the middle of a file does not know whether it is inside a
quoted field.  So every file split is read under both assumptions: it reports
how many records start in it and how it ends, for each.  The splits of a file
are put together in order, one pair of numbers per split, and in a second pass
each line knows whether it starts a record, and which.  Records of one line are
parsed where they are; only lines of longer records are grouped.

A quote opens a field at its begin only, two quotes inside are one, and what
follows a closing quote belongs to the field up to the next comma, as in Spark's
own reader.  Blank lines between records are skipped, a carriage return before
a line's end is not part of it, an unclosed quote takes the rest of its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTES = {"quote": '"', "escape": '"'}
_COLUMNS = ["file", "start", "place", "value"]


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, if one is (not) before it."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at) + 1
            if not at:
                return True
            if line.startswith('"', at):
                at += 1
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with, for a split that starts outside and inside a field: the
    records that have started in the split with this line, whether this line
    starts one, and whether a field is open after it."""
    split, states, counts = None, [False, True], [0, 0]
    for rows in batches:
        columns = [[] for _ in range(6)]
        for file, start, value in zip(*(rows.column(c).to_pylist() for c in ("file", "start", "value"))):
            if (file, start) != split:
                split, states, counts = (file, start), [False, True], [0, 0]
            for k in (0, 1):
                begins = not states[k]
                counts[k] += begins
                if '"' in value:
                    states[k] = inside_after(value, states[k])
                for c, x in zip(columns[3 * k:], (counts[k], begins, states[k])):
                    c.append(x)
        kinds = [pa.int64(), pa.bool_(), pa.bool_()] * 2
        yield pa.record_batch([*rows.columns, *[pa.array(c, t) for c, t in zip(columns, kinds)]], [*_COLUMNS, *_MARKS])


_MARKS = ["n0", "begins0", "open0", "n1", "begins1", "open1"]


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 0 in each."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.withColumn("place", F.monotonically_increasing_id()).select(*_COLUMNS)
    lines = lines.mapInArrow(_marked, "file string, start long, place long, value string, n0 long, begins0 boolean, open0 boolean, n1 long, begins1 boolean, open1 boolean")
    # one row per split; the last line says what the whole split does
    last = F.max_by(F.struct(*_MARKS), "place")
    ends = sorted(lines.groupBy("file", "start").agg(last.alias("m")).collect(), key=lambda r: (r["file"], r["start"]))
    table, before, inside, n = [], None, False, 0
    for r in ends:
        if r["file"] != before:
            before, inside, n = r["file"], False, 0
        table.append((r["file"], r["start"], inside, n))
        n, inside = n + r["m"]["n1" if inside else "n0"], r["m"]["open1" if inside else "open0"]
    splits = spark.createDataFrame(table, "file string, start long, inside boolean, shift long")

    def given(name: str):
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    lines = lines.join(F.broadcast(splits), ["file", "start"])
    lines = lines.select("file", "start", "place", "value", (F.col("shift") + given("n") - 1).alias("record"), given("begins").alias("begins"), given("open").alias("open"))
    alone = F.col("begins") & ~F.col("open")
    whole = lines.where(alone).select("file", "record", F.col("value").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("start", "place", "value")))
    longer = lines.where(~alone).groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"))
    text = F.regexp_replace("text", "\r$", "")
    return whole.unionByName(longer).select("file", "record", text.alias("text"))


def read(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """The columns of CSV files; ``header``: each file's first record is none."""
    found = records(spark, path)
    if header:
        found = found.where("record > 0")
    return found.where("text <> ''").select(F.from_csv("text", schema, QUOTES).alias("r")).select("r.*")
