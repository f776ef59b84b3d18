"""The sentence rule, and abbreviations that the corpus teaches."""

import duckdb

from phraseforge.operators import sentences as SE
from phraseforge.plans.oracle import sentences_sql


def test_abbreviations_and_ends(spark):
    rows = [(1, 'Dr. Smith met Dr. Jones. He said "go!" Then he left'), (2, "Use a cat, e.g. Tom. Is it? yes. No!"), (3, None), (4, " \n"),
            (5, "Dr. A. Dr. B. Dr. C. The doctor.")] + [(10 + i, f"We saw e.g. Cats and the end. Of the end {i}.") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["abbreviation"] for r in SE.abbreviations(docs).collect()} == {"dr", "e.g"}
    got = {}
    for r in sorted(SE.split_sentences(docs).collect()):
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    assert got[1] == ["Dr. Smith met Dr. Jones.", 'He said "go!"', "Then he left"]
    assert got[2] == ["Use a cat, e.g. Tom.", "Is it? yes.", "No!"]
    assert got[5] == ["Dr. A.", "Dr. B.", "Dr. C.", "The doctor."] and 3 not in got and 4 not in got
    assert got[10] == ["We saw e.g. Cats and the end.", "Of the end 0."]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {}
    for d, _, s in sorted(con.sql(sentences_sql()).select("doc_id", "nth", "sentence").fetchall()):
        want.setdefault(d, []).append(s)
    assert got == want
