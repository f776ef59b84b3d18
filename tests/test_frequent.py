"""Joins by frequency: the same rows whatever the bound, and no shuffle of the rows when the table is small."""

import pytest
from pyspark.sql import functions as F

from phraseforge.operators import frequent as FR
from phraseforge.operators import ngrams as N
from phraseforge.operators import tfidf as T
from phraseforge.operators import tokens as K


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_equals_a_plain_join_for_every_bound(spark, how):
    rows = spark.range(3000).select("id", F.concat(F.lit("w"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)).alias("word"))
    rows = rows.union(spark.createDataFrame([(9000, None), (9001, "unknown")], "id long, word string"))
    table = rows.where("word <> 'unknown'").groupBy("word").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(table, "word", how).select("id", "word").collect()), key=str)
    for bound in (0, 100, 700, 1 << 20):
        got = FR.frequent_join(rows, table, "word", "n", how, bound)
        assert got.columns == rows.join(table, "word", how).columns
        assert sorted(map(tuple, got.select("id", "word").collect()), key=str) == want


def test_frequent_words_go_first(spark):
    table = spark.createDataFrame([("a", 1000), ("b", 900), ("c", 3), ("d", 1)], "word string, n long")
    few, others = FR.frequent_rows(table, "word", "n", max_bytes=40)
    assert {r["word"] for r in few.collect()} == {"a", "b"} and {r["word"] for r in others.collect()} == {"c", "d"}
    assert FR.frequent_rows(table, "word", "n")[1] is None


def test_rankers_do_not_depend_on_the_bound(spark, monkeypatch):
    texts = [(i, " ".join(f"{'alpha beta'.split()[i % 2]} gamma{i % 4} the delta{k % 5}s" for k in range(6))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    def both():
        t = K.tokens_from_text(docs)
        return (sorted(map(tuple, T.tfidf_phrases(t, T.n_docs(docs), 3).collect())),
                sorted(map(tuple, N.boosted_top_terms(docs, 1, 3, 5).select("doc_id", "rank", "term").collect())))

    want = both()
    assert all(want)
    monkeypatch.setattr(FR.frequent_join, "__defaults__", ("inner", 60))
    assert both() == want
