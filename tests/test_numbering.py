"""Dense numbers over several files, splits and tasks."""

import json

from pyspark.sql import functions as F

from phraseforge.sources import numbering as NB
from phraseforge.sources import readers as RD


def write(tmp_path, sizes):
    want = []
    for i, n in enumerate(sizes):
        lines = [f"file {i} line {k} " + "x" * (k % 50) for k in range(n)]
        (tmp_path / f"part-{i}.txt").write_text("".join(line + "\n" for line in lines))
        want += lines
    return want


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    want = write(tmp_path, [700, 3, 0, 1500, 1])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "1m"):  # many splits of a file, and several files to a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r["ordinal"], r["value"]) for r in NB.number_lines(spark, str(tmp_path)).collect())
            assert got == list(enumerate(want))
            odd = NB.number_lines(spark, str(tmp_path), F.col("value").contains("5")).collect()
            assert sorted((r["ordinal"], r["value"]) for r in odd) == list(enumerate(w for w in want if "5" in w))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rows_are_numbered_by_a_key(spark):
    rows = spark.range(0, 5000, 7).select((F.col("id") * 37 % 5003).alias("k"))
    got = NB.number_rows(rows, ["k"]).collect()
    assert sorted((r["ordinal"], r["k"]) for r in got) == list(enumerate(sorted(r["k"] for r in got)))
    assert NB.number_rows(rows.limit(0), ["k"]).count() == 0


def test_readers_number_and_pair_by_position(spark, tmp_path):
    (tmp_path / "docs.txt").write_text("a\n\nc\n")
    (tmp_path / "gold.txt").write_text("a.key\n.key\nc.key\n")
    docs, gold = (RD.document_list(spark, f"{tmp_path}/{n}.txt").withColumnRenamed("name", n) for n in ("docs", "gold"))
    assert sorted(map(tuple, NB.pair_by_position(docs, gold).collect())) == [(0, "a", "a.key"), (1, "", ".key"), (2, "c", "c.key")]
    lines = [json.dumps({"title": f"t{i}", **({"abstract": f"a{i}"} if i % 3 else {})}) for i in range(20)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = sorted((r["id"], r["title"]) for r in RD.abstracts_json(spark, f"{tmp_path}/a.json").collect())
    assert got == list(enumerate(f"t{i}" for i in range(20) if i % 3))
