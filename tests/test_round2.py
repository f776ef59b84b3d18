"""Ids of any type end to end, number formats, odd separators, LDA without cuts, blocks of vectors."""

import os

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from phraseforge.operators import dictionary as D
from phraseforge.operators import evaluate as V
from phraseforge.operators import graph as G
from phraseforge.operators import ngrams as N
from phraseforge.operators import similarity as S
from phraseforge.operators import tfidf as T
from phraseforge.operators import tokens as K
from phraseforge.operators import topics as TP
from phraseforge.sources import readers as RD

TEXTS = {
    "a.txt": "graph_NN theory_NN of_IN large_JJ graphs_NNS and_CC graph_NN theory_NN",
    "b.txt": "neural_JJ networks_NNS learn_VB graph_NN theory_NN from_IN data_NNS",
    "c.txt": "large_JJ data_NNS networks_NNS need_VB graph_NN partition_NN",
}


def corpus(spark, tmp_path):
    os.makedirs(f"{tmp_path}/docs")
    for name, text in TEXTS.items():
        with open(f"{tmp_path}/docs/{name}", "w") as f:
            f.write(text)
    return RD.tagged_corpus(spark, f"{tmp_path}/docs", suffix=".txt")


def test_files_through_every_ranker_to_the_scores(spark, tmp_path):
    tokens = corpus(spark, tmp_path)
    n = tokens.agg(F.count_distinct("doc_id")).scalar()
    nb = S.similar_documents(T.tfidf_words(tokens, n), 2)
    assert {r["doc_id"] for r in nb.collect()} == {"a", "b", "c"}
    gold = spark.createDataFrame([("a", "graph theory"), ("b", "neural network"), ("c", "graph partition")], "doc_id string, phrase string")
    for phrases in (T.tfidf_phrases(tokens, n, 5), G.singlerank_phrases(tokens, 2, 5, "grouped"), G.singlerank_phrases(tokens, 2, 5, "joins"),
                    G.textrank_phrases(tokens, 2, 1.0, "grouped"), G.expandrank_phrases(tokens, nb, 2, 5, "grouped")):
        m = V.micro_scores(phrases, gold).first()
        assert {r["doc_id"] for r in phrases.collect()} == {"a", "b", "c"} and m["matched"] >= 1


def test_string_ids_in_gold_lines(spark):
    lines = spark.createDataFrame([("C-41 : a b,c+d",), ("no keys here",)], "line string")
    assert rows(V.parse_stemmed_gold(lines), "doc_id", "key_pos", "alt_pos", "phrase") == [
        ("C-41", 0, 0, "a b"), ("C-41", 1, 0, "c"), ("C-41", 1, 1, "d")]


def test_small_numbers_have_no_exponent(spark):
    df = spark.createDataFrame([(0.0009, 0.00044), (0.5, 1.0), (12.34567, 100.0), (0.0, 0.00004)], "z double, x double")
    got = [(r[0], r[1]) for r in df.select(N.plain_number(F.col("z")), N.plain_number(F.col("x"))).collect()]
    assert got == [("0.0009", "0.0004"), ("0.5", "1.0"), ("12.3457", "100.0"), ("0.0", "0.0")]
    top = df.withColumn("doc_id", F.lit("a\\b")).withColumn("rank", F.lit(1)).withColumn("term", F.lit("t"))
    assert rows(N.scored_term_lines(top), "file_id", "line")[0] == ("a_b", "t,0.0,0.0")


def test_words_with_unicode_line_ends_stay_whole(spark):
    df = spark.createDataFrame([(1, "x\u0085y_JJ a _b_NN c ")], "doc_id long, text string")
    assert rows(K.parse_tagged(df), "pos", "word", "tag") == [(0, "x\u0085y", "JJ"), (1, "a _b", "NN"), (2, "c ", "c ")]


def test_topics_see_every_term_and_document(spark):
    texts = ["graph theory graph nodes", "neural networks", "rare", "once only words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = TP.fit_topics(docs.select("text"), k=2, max_iter=2)
    assert set(model.stages[0].vocabulary) == set(" ".join(texts).split())
    assert model.stages[1].getSubsamplingRate() == 1.0
    gold = spark.createDataFrame([(0, "graph theory"), (1, "neural")], "doc_id long, phrase string")
    out = TP.lda_keywords(docs, docs, gold, k=2, top_n=1)
    assert {r["doc_id"] for r in out.collect()} == {0, 1, 2, 3}  # also documents without gold


def test_saved_topics_give_the_same_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b c"), (1, "c d")], "doc_id long, text string")
    model = TP.fit_topics(docs.select("text"), k=2, max_iter=1)
    TP.save_model(model, f"{tmp_path}/model")
    first, again = (sorted(map(str, TP.topic_vectors(m, docs, "doc_id", "text").collect())) for m in (model, TP.load_model(f"{tmp_path}/model")))
    assert first == again


def test_nearest_vectors_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    d, k = rng.normal(size=(60, 5)), rng.normal(size=(25, 5))
    big = 1 << 60  # ids beyond what a float holds
    docs = spark.createDataFrame([(big + i, v.tolist()) for i, v in enumerate(d)] + [(big + 99, [0.0] * 5)], "doc_id long, vec array<double>")
    kw = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(k)], "keyword string, vec array<double>")
    sim = (d / np.linalg.norm(d, axis=1, keepdims=True)) @ (k / np.linalg.norm(k, axis=1, keepdims=True)).T
    want = sorted((big + i, r + 1, f"k{j:02d}") for i in range(60) for r, j in enumerate(np.argsort(-sim[i])[:4]))
    for per_block in (1000, 7):
        assert rows(S.nearest_keywords(docs, kw, 4, per_block=per_block), "doc_id", "rank", "keyword") == want


def test_single_words_count_in_chunks_only_as_whole_phrases(spark):
    p = spark.createDataFrame([(1, x) for x in ("graph", "graph theory", "large graph theory", "theory of graph theory kinds today", "kinds")],
                              "doc_id long, phrase string")
    assert rows(D.redundant_phrases(p), "phrase") == [("graph",), ("graph theory",), ("kinds",)]
    assert rows(D.in_chunk(p), "phrase") == [("graph theory",)]
    assert rows(D.redundancy_filter(p), "phrase") == [("large graph theory",), ("theory of graph theory kinds today",)]


def test_corpus_union_repeats_a_corpus(spark):
    a, b = (spark.createDataFrame([(i,)], "id long") for i in (1, 2))
    assert rows(V.corpus_union([a, b], repeat={1: 2}), "id") == [(1,), (2,), (2,)]


def test_tagged_text_with_odd_ends_and_markup(spark):
    """only texts that may hold markup are filtered token by token; nothing else is read as a lambda."""
    texts = [(1, "  a_NN\tB_c_JJ \r\n"), (2, "<p> x_<_y <a_T _ __ b>_NN >_c"), (3, None), (4, " \t\n"), (5, ""), (6, "one"), (7, "\u0085_x a\u0085_b")]
    t = spark.createDataFrame(texts, "doc_id long, text string")
    got = K.parse_tagged(t)
    rows = sorted((r["doc_id"], r["pos"], r["word"], r["tag"]) for r in got.collect())
    assert rows == [(1, 0, "a", "NN"), (1, 1, "b_c", "JJ"), (2, 0, "x_<", "y"), (2, 1, "", ""), (2, 2, "_", ""), (2, 3, ">", "c"),
                    (6, 0, "one", "one"), (7, 0, "\u0085", "x"), (7, 1, "a\u0085", "b")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("split(") == 1
