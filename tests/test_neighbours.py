"""Neighbours of documents (J4, O3, M3): packed blocks, read by every block's task (FINDINGS_r03 F13, F14)."""

import random

from pyspark.sql import functions as F

from phraseforge.operators import graph as G
from phraseforge.operators import similarity as S
from phraseforge.operators import tfidf as T
from phraseforge.operators import tokens as K
from tests.conftest import rows
from tests.test_eval_and_text import plain_neighbours


def texts(n=30):
    r = random.Random(3)
    words = [a + b for a in ("graf", "nod", "vektor", "pfad", "wort") for b in ("e", "al", "ly", "en", "um")] + ["the", "of"]
    return [(f"d{i:02d}", " ".join(r.choices(words, k=r.randint(1, 40)))) for i in range(n)] + [("same", "graf nod"), ("copy", "graf nod"), ("empty", "the of"), (None, "graf nod")]


def test_a_document_has_one_list_however_many_blocks_there_are(spark, monkeypatch):
    r = random.Random(1)
    vec = spark.createDataFrame([(f"d{i}", f"w{w}", float(r.randint(0, 3))) for i in range(24) for w in r.sample(range(12), 4)],
                                "doc_id string, word string, score double")
    monkeypatch.setattr(S, "DOCS_PER_BLOCK", 2)
    packed = S.pack_vectors(vec)
    assert packed.count() > 6
    near = S.blocked_neighbours(packed, 3)
    assert near.count() <= 24 * 3  # before: a list for every pair of blocks
    assert near.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 3
    assert rows(S.similar_documents(vec, 3), "doc_id", "rank", "nbr_id") == plain_neighbours(vec.collect(), 3)


def test_products_in_small_shares(spark, monkeypatch):
    """Terms met sparse and dense, a few rows and pairs at once: the same neighbours."""
    r = random.Random(2)
    vec = spark.createDataFrame([(i, f"w{w}", float(r.randint(1, 3))) for i in range(16) for w in {0, *r.choices(range(40), k=5)}],
                                "doc_id long, word string, score double")
    expected = plain_neighbours(vec.collect(), 4)
    assert rows(S.similar_documents(vec, 4), "doc_id", "rank", "nbr_id") == expected
    q = S._Queries(S._Vectors(S.pack_vectors(vec).first()), 4)
    monkeypatch.setattr(S, "CELLS", 50)
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 3)
    for row in S.pack_vectors(vec).collect():
        q.meet(S._Vectors(row))
    got = sorted(q.rows(), key=lambda x: (x[0], -round(x[2], 9), x[1]))
    own = set(q.v.ids)
    assert [(a, b) for a, b, s in got] == [(a, b) for a, _, b in expected if a in own]


def test_blocks_of_texts_are_the_vectors_of_tokens(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id string, text string")
    tokens = K.tokens_from_text(docs)
    n = T.n_docs(docs)
    expected = rows(S.similar_documents(T.tfidf_words(tokens, n), 3), "doc_id", "rank", "nbr_id")
    monkeypatch.setattr(S, "LEAST_BYTES", 300)
    for source in (docs, tokens):
        assert rows(S.similar_documents(S.tfidf_blocks(source, n), 3), "doc_id", "rank", "nbr_id") == expected


def test_expandrank_of_texts_and_of_tokens(spark):
    """Repeated ids are one document, of neighbours too."""
    docs = spark.createDataFrame([*texts(8), ("d01", "graf pfad wort")], "doc_id string, text string")
    nb = spark.createDataFrame([(f"d{i:02d}", f"d{j:02d}", 0.5) for i in range(8) for j in (0, 1)], "doc_id string, nbr_id string, sim double")
    cols = ("doc_id", "rank", "phrase", "score")
    named = docs.where("doc_id IS NOT NULL")
    assert rows(G.expandrank_phrases(K.texts_by_document(named), nb, 2, 5), *cols) == rows(G.expandrank_phrases(K.tokens_from_text(named), nb, 2, 5), *cols)


def test_expandrank_edges_of_blocks_are_those_of_pairs(spark, monkeypatch):
    """FINDINGS_r04 F4: no row per token or pair, and nothing is written to the checkpoint folder."""
    docs = spark.createDataFrame([*texts(12), texts(12)[1], ("one", "graf")], "doc_id string, text string")
    nb = spark.createDataFrame([(f"d{i:02d}", f"d{j:02d}", s) for i in range(12) for j, s in ((0, 0.5), (1, 0.25), (2, 0.0)) if i != j] + [("same", "copy", 1.0)],
                               "doc_id string, nbr_id string, sim double")
    w = F.round("w", 9).alias("w")
    expected = rows(G.expandrank_edges(K.tokens_from_text(docs), nb, 2).select("doc_id", "src", "dst", w), "doc_id", "src", "dst", "w")
    read = G.expandrank_rows(K.texts_by_document(docs), nb)
    assert rows(G.expandrank_edge_rows(read, 2).select("doc_id", "src", "dst", w), "doc_id", "src", "dst", "w") == expected and len(expected) > 100
    from phraseforge.plans import queries as Q
    monkeypatch.setattr(Q, "materialize", lambda df: 1 / 0)  # before: all tokens
    assert Q.q_expandrank_edges(spark, "/root/testdata/sf0.001").columns == ["doc_id", "src", "dst", "w"]


def test_nearest_vectors_leave_out_only_far_ones(monkeypatch):
    """FINDINGS_r04 F2: equal to comparing all, with equal vectors and ties by place; few are compared."""
    import numpy as np

    r = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for dim, nd, nm in ((2, 90, 200), (4, 300, 700), (4, 3, 2), (16, 70, 150)):
        x = r.random((nm, dim)) ** 3 + 1e-3
        x[nm // 2:nm // 2 + nm // 4] = x[0]
        m, d = unit(x), unit(r.random((nd, dim)) ** 3 + 1e-6)
        d[:nd // 3] = m[0]
        dist = np.round(1 - d @ m.T, 9)
        row, near, _ = S._nearest(d, m, 10)
        top = np.lexsort((np.broadcast_to(np.arange(nm), dist.shape), dist), axis=1)[:, :10]
        assert [near[row == i].tolist() for i in range(nd)] == top.tolist()
    m, d, seen = unit(r.random((4000, 3))), unit(r.random((500, 3))), []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kw: seen.append(a.size) or real(a, *args, **kw))
    S._nearest(d, m, 10)
    assert sum(seen) < 4000 * 500  # before: all pairs, sorted
