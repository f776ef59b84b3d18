"""Documents as rows of words: the same results as from rows of tokens, and no row per token."""

import os
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from phraseforge.operators import blocks as B
from phraseforge.operators import dictionary as D
from phraseforge.operators import graph as G
from phraseforge.operators import ngrams as N
from phraseforge.operators import tfidf as T
from phraseforge.operators import tokens as K
from phraseforge.operators import topics as TP
from phraseforge.session import checkpoint_dir

WORDS = "graph theory of large networks and quickly trained neural models, the musical scale is big. bus buss busss"


def texts(n=9):
    w = WORDS.split()
    return [(i, " ".join(w[(i * 5 + j * (1 + i % 3)) % len(w)] for j in range(30))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(3, texts()[3][1]), (20, None), (21, ""), (None, "lonely graph theory of graph theory")]
    return spark.createDataFrame(texts() + odd, "doc_id long, text string").cache()


def same(a, b, *cols):
    got, want = (sorted((tuple(r) for r in x.select(*cols).collect()), key=str) for x in (a, b))
    assert got and got == want


def test_rows_of_words_give_what_rows_of_tokens_give(docs):
    t, d = K.tokens_from_text(docs), K.texts_by_document(docs)
    rows = K.token_rows(d)
    same(B.candidate_counts(rows), K.candidate_phrases(t), "doc_id", "phrase", "n")
    same(G.edge_rows(rows, 2, "cnt"), G.cooccurrence_pairs(t, 2), "doc_id", "src", "dst", "cnt")
    same(G.edge_count_rows(rows, 2), G.edge_count(G.cooccurrence_pairs(t, 2)), "doc_id", "n_edges")
    score = F.round("score", 6).alias("s")
    for method in ("rows", "grouped"):
        same(G.singlerank_phrases(d, 2, 3), G.singlerank_phrases(t, 2, 3, method), "doc_id", "rank", "phrase", score)
        same(G.textrank_phrases(d, 2, 0.5), G.textrank_phrases(t, 2, 0.5, method), "doc_id", "rank", "phrase")
    same(T.tfidf_phrases(docs, T.n_docs(docs), 4), T.tfidf_phrases(t, T.n_docs(docs), 4), "doc_id", "rank", "phrase", "score")
    same(K.parse_tagged(K.tagged_texts(docs), dealt=True), K.parse_tagged(K.tagged_text(t)), "doc_id", "pos", "word", "tag")


def written(spark):
    root = checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(a, f)) for a, _, files in os.walk(root) for f in files)


def test_rankers_and_redundancy_write_no_tokens(spark, docs):
    d, before = K.texts_by_document(docs), written(spark)
    lists = B.candidate_lists(K.token_rows(d))
    for out in (G.singlerank_phrases(d, 2, 3), G.textrank_phrases(d, 2, 0.5), T.tfidf_phrases(docs, T.n_docs(docs), 3),
                D.redundancy_filter(lists), D.in_chunk(lists)):
        out.collect()
    assert written(spark) == before


def test_results_do_not_depend_on_the_blocks(spark, docs, monkeypatch):
    entries = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    dictionary = spark.createDataFrame([("graph theory",), ("scale is big",)], "phrase string")

    def all_of_them():
        r6 = lambda c: F.round(c, 6).alias(c)
        out = [T.tfidf_phrases(docs, T.n_docs(docs), 4), N.ngram_counts(N.term_tokens(docs), 1, 3),
               N.boosted_top_terms(docs, 1, 3, 5).select("doc_id", "rank", "term", r6("z"), r6("x")),
               N.ngram_tfidf(docs, 1, 2).select("doc_id", "term", r6("x")), N.global_ngrams(docs).select("term", r6("g")),
               D.dictionary_matches(docs, dictionary), *(x.select(*[r6(c) if t == "double" else c for c, t in x.dtypes]) for x in TP.em_topics(entries, 3, 2))]
        return [sorted(map(tuple, x.collect()), key=str) for x in out]

    want = all_of_them()
    assert all(want)
    monkeypatch.setattr(B, "BLOCK_BYTES", 300)
    assert all_of_them() == want


def test_ngram_weights_from_blocks_equal_those_of_the_long_tables(docs):
    counts = N.ngram_counts(N.term_tokens(docs), 1, 3)
    n = docs.select(F.count("*")).scalar()
    x = F.round("x", 6).alias("x")
    same(N.ngram_tfidf(docs, 1, 3), N.local_tfidf(counts, n, 1, 3), "doc_id", "term", x)
    same(N.boosted_top_terms(docs, 1, 3, 5), N.top_terms(N.local_tfidf(counts, n, 1, 3), N.global_scores(counts), 5), "doc_id", "rank", "term", x)


def test_topics_of_counts_and_of_texts_agree(docs):
    entries = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    r = lambda c: F.round(c, 9).alias(c)
    (a, da), (b, db) = TP.em_topics(entries, 2, 2), TP.em_topics(TP.bag_of_words(entries), 2, 2)
    same(a, b, "term", r("p0"), r("p1"))
    same(da, db, "id", r("t0"), r("t1"))
    same(TP.fold_in(entries, a, 2), TP.fold_in(TP.bag_of_words(entries), a, 2), "id", F.transform("vec", lambda x: F.round(x, 6)))


def test_units_round_as_decimals_do():
    x = np.array([0.0, 0.5e-9, -0.5e-9, 1.0000000005, 2.4999999995, 123456.7891234565, -3.3, 9e8 + 0.1])
    want = [int((Decimal(repr(float(v))) * 10 ** 9).quantize(Decimal(1), "ROUND_HALF_UP")) for v in x]
    assert B.units(x).tolist() == want


def test_long_phrases_inside_longer_ones():
    w = [f"w{i}" for i in range(14)]
    phrases = [" ".join(w), " ".join(w[1:11]), " ".join(w[2:13]), " ".join(w[:9] + ["x"]), "w3 w4", "w4 w3", "w5"]
    assert D._contained(phrases) == [False, True, True, False, True, False, True]
