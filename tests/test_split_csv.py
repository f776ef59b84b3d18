"""Records over several lines, read by many tasks, against Spark's one-task reader."""

import random

import pytest

from phraseforge.sources import readers as RD
from phraseforge.sources import split_csv


def field(r):
    plain = "".join(r.choices(["word ", "x", "it's ", '5" disk ', "é"], k=r.randrange(1, 6))).strip()
    quoted = "".join(r.choices(["line", "\n", ", ", '""', " ", "\n\n", "end."], k=r.randrange(1, 12)))
    return plain if r.random() < 0.6 and not plain.startswith('"') else f'"{quoted}"'


def write(folder, r, files=3, n=200, end="\n"):
    for i in range(files):
        with open(folder / f"f{i}.csv", "w", newline="") as f:
            f.write("".join(f"{i}-{k},{field(r)}{end}" + (end if k % 17 == 0 else "") for k in range(n)))


@pytest.mark.parametrize("size", ["300b", "4k", "10m"])
def test_rows_equal_the_one_task_reader(spark, tmp_path, size):
    write(tmp_path, random.Random(9))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = split_csv.read(spark, str(tmp_path), RD.TWO_COLUMN_SCHEMA)
        if size == "300b":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted(map(tuple, got.collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = sorted(map(tuple, spark.read.csv(str(tmp_path), schema=RD.TWO_COLUMN_SCHEMA, multiLine=True, **split_csv.QUOTES).collect()))
    assert len(got) == 600 and got == want


def test_header_and_line_ends(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes(b'id,text\r\n1,"a\r\nb"\r\n\r\n2,c\r\n3,"open')
    got = {r["id"]: r["text"] for r in split_csv.read(spark, str(tmp_path), RD.TWO_COLUMN_SCHEMA, header=True).collect()}
    assert set(got) == {"1", "2", "3"} and got["2"] == "c" and got["1"].replace("\r", "") == "a\nb"


def test_open_fields():
    cases = {"a,b": False, 'a,"b': True, 'a,"b""': True, 'a,"b"': False, 'a 5" disk': False, '"x"y,"z': True, '"': True, "": False}
    assert {k: split_csv.inside_after(k, False) for k in cases} == cases
    assert split_csv.inside_after("still", True) and not split_csv.inside_after('end",x', True) and split_csv.inside_after('end","x', True)
