import os

import duckdb
import pytest
from tests.llm.fixtures import edge_rows, table, words

from phraseforge.llm import mixing, quality_rules
from phraseforge.llm.oracle import oracles
from phraseforge.llm.queries import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(oracles()[name])
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted((tuple(plain(v) for v in r) for r in want.select(*columns).fetchall()), key=str)


def test_sql_of_edge_rows(spark):
    """The same SQL over nulls, empty texts, ties and long texts (one row per doc_id, as the SQL groups by it)."""
    rows = [r for r in edge_rows() if r[0] not in (None, 8)] + [(30 + i, f"shared line\nown {i} a b c d e f g h\n shared  LINE", "en", "z") for i in range(25)]
    docs = table(spark, rows, "key,size,line,host")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    for name, got in (("op9_mixing", mixing.plan(docs).drop("source")), ("op10_quality_rules", quality_rules.judge(docs))):
        want = con.sql(oracles()[name])
        columns = sorted(want.columns)
        have = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
        assert sorted(have, key=str) == sorted((tuple(plain(v) for v in r) for r in want.select(*columns).fetchall()), key=str), name


def test_sources_reach_their_budget_in_many_ranges(spark):
    rows = [(i, "w " * (1 + i * 7 % 30), "en", f"s{i % 3}" if i % 2 else "s0") for i in range(400)]
    docs = table(spark, rows)
    plans = [{r["doc_id"]: tuple(r) for r in mixing.plan(docs, rows_per_range=n).collect()} for n in (1000, 7)]
    assert plans[0] == plans[1]
    by = {}
    for r in mixing.plan(docs, rows_per_range=7).collect():
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(x[0]["target"] for x in by.values()) - 1.5 * sum(r["size"] for x in by.values() for r in x)) < 1e-6
    for x in by.values():
        assert sum(r["size"] for r in x) == x[0]["source_size"]
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 0.5


def test_mix_gives_the_planned_words(spark):
    rows = edge_rows() + [(40 + i, f"a b\n c  d{i} ", "en", "a") for i in range(30)]
    docs = table(spark, rows, "size,taken,copy,row,due")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    want, got = {}, {}
    for r in mixing.plan(docs).collect():
        want[r["source"], r["doc_id"]] = want.get((r["source"], r["doc_id"]), 0) + r["taken"]
    original = {(r[3], r[0], r[1]) for r in rows}
    cut = set()
    for r in mixed.collect():
        got[r["source"], r["doc_id"]] = got.get((r["source"], r["doc_id"]), 0) + len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        if (r["source"], r["doc_id"], r["text"]) not in original:
            cut.add(r["source"])
            assert any(t.startswith(r["text"]) for s, d, t in original if (s, d) == (r["source"], r["doc_id"]))
    assert got == {k: v for k, v in want.items() if v}
    assert len(cut) <= 4
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.plan(docs.limit(0)).count() == 0


def test_rules_reject_depleted_documents(spark):
    shared = "This site uses the same long footer on every single page of the host"
    body = "one two three four five six seven eight nine ten eleven {} {}"
    rows = [(i, f"{body.format(i, i + 1)} and {' '.join(f'own{i}x{j}' for j in range(12))}\n{shared}", "en", "h") for i in range(30)]
    rows += [(100 + i, f"{shared}\n{shared.upper()}  \nw{i} x y z", "en", "h") for i in range(3)]  # nothing else on them
    rows += [(200 + i, rows[0][1], "en", "other") for i in range(40)]  # copies of one text are one document
    got = {r["doc_id"]: r for r in quality_rules.judge(table(spark, rows)).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 14 for i in range(30))
    assert all(not got[100 + i]["kept"] and not got[100 + i]["base_failed"] and got[100 + i]["n_removed_words"] == 28 for i in range(3)) or \
        all(got[100 + i]["base_failed"] for i in range(3))
    assert all(got[200 + i]["kept"] and got[200 + i]["n_removed_words"] == 0 for i in range(40))


def test_rules_on_repeated_rows(spark):
    rows = edge_rows()
    got = quality_rules.judge(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r["n_words"] for r in got) == sorted(len(words(r[1])) for r in rows)
    assert quality_rules.judge(table(spark, rows).limit(0)).count() == 0
    empty = [r for r in got if r["n_words"] == 0]
    assert empty and all(r["base_failed"] and not r["kept"] for r in empty)


def test_testdata_is_there():
    assert os.path.exists(f"{SF}/documents.parquet")


def test_few_removed_lines_go_to_the_documents(spark):
    """Only lines above the limit are shuffled with their documents."""
    rows = [(i, f"common line of words\nown line number {i} with several words", "s") for i in range(30)]
    got = quality_rules.removed_words(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["removed"] for r in got.collect()} == {4} and got.count() == 30
    assert "strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()
