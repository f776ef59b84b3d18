"""Evaluation (T9-T11), text functions (T12), similarity (T14), dictionary, n-grams."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from phraseforge.functions import text as X
from phraseforge.operators import dictionary as D
from phraseforge.operators import evaluate as V
from phraseforge.operators import ngrams as N
from phraseforge.operators import similarity as S


def _pg(spark, pred, gold):
    p = spark.createDataFrame(pred, "doc_id long, phrase string")
    g = spark.createDataFrame(gold, "doc_id long, phrase string")
    return p, g


def test_t9_two_predictions_one_key(spark):
    p, g = _pg(spark, [(1, "cat"), (1, "cats")], [(1, "cat")])
    r = V.micro_scores(p, g).collect()[0]
    assert (r["matched"], r["predicted"], r["total_keys"]) == (2, 2, 1)
    assert r["recall"] == pytest.approx(200.0)


def test_micro_empty_denominator_is_null(spark):
    p, g = _pg(spark, [(1, "x")], [(2, "y")])
    r = V.micro_scores(p.where("false"), g).collect()[0]
    assert r["precision"] is None and r["f1"] is None


def test_t10_macro_precision_capped(spark):
    p, g = _pg(spark, [(1, "a")], [(1, "a"), (1, "a")])
    r = V.macro_scores(p, g).collect()[0]
    assert r["precision"] == pytest.approx(1.0) and r["recall"] == pytest.approx(1.0)


def test_t11_empty_gold_text_counts_one(spark):
    lines = spark.createDataFrame([(1, "")], "doc_id long, kw string")
    g = lines.select("doc_id", F.explode(F.split("kw", ",")).alias("phrase"))
    assert g.count() == 1  # ''.split(',') == [''], a list of length 1
    p, _ = _pg(spark, [(1, "x")], [(1, "x")])
    r = V.macro_scores(p, g).collect()[0]
    assert r["recall"] == 0.0


def test_gold_lines(spark):
    lines = spark.createDataFrame([(1, "  Web Service\t"), (1, "web service"), (1, ""), (2, "x")], "doc_id long, line string")
    assert rows(V.gold_from_lines(lines), "doc_id", "phrase") == [(1, "web service"), (2, "x")]


def test_t12_punctuation_and_symbols(spark):
    df = spark.createDataFrame([("web-service!",)], "s string")
    r = df.select(X.delete_punctuation("s").alias("a"), X.strip_symbols_digits("s").alias("b")).collect()[0]
    assert (r["a"], r["b"]) == ("webservice", "webservice")


def test_t14_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(S.cosine("a", "b").alias("c")).collect()[0]["c"] == 0.0


def test_stemmed_gold_lines(spark):
    lines = spark.createDataFrame([("C-41 : grid,web service+web servic",)], "line string")
    got = rows(V.parse_stemmed_gold(lines.withColumn("line", F.regexp_replace("line", "C-", ""))),
               "doc_id", "key_pos", "alt_pos", "phrase")
    assert got == [("41", 0, 0, "grid"), ("41", 1, 0, "web service"), ("41", 1, 1, "web servic")]


def plain_neighbours(entries, k):
    """(doc, rank, neighbour) pair by pair; documents without a positive partner take the smallest ids."""
    docs = sorted({r["doc_id"] for r in entries})
    norm = {d: math.sqrt(sum(r["score"] ** 2 for r in entries if r["doc_id"] == d)) for d in docs}
    sim = {(a, b): sum(x["score"] * y["score"] for x in entries for y in entries if (x["doc_id"], y["doc_id"]) == (a, b) and x["word"] == y["word"])
           / (norm[a] * norm[b]) for a in docs for b in docs if a != b}
    return [(a, i + 1, b) for a in docs for i, b in enumerate(sorted((b for b in docs if b != a), key=lambda b: (-round(sim[a, b], 9), b))[:k])]


def test_similarity_equals_a_plain_scan(spark):
    vec = spark.createDataFrame(
        [(d, f"w{(d * j) % 5}", float(1 + (d + j) % 3)) for d in range(1, 9) for j in range(4)] + [(9, "zz", 1.0)],
        "doc_id long, word string, score double")
    a = rows(S.similar_documents(vec, 3), "doc_id", "rank", "nbr_id")
    b = plain_neighbours(vec.collect(), 3)
    assert a == b
    # doc 9 shares nothing: sim-0 neighbours are the smallest ids
    assert [r[2] for r in a if r[0] == 9] == [1, 2, 3]


def test_nearest_keywords_order_and_zero(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "doc_id long, vec array<double>")
    kw = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "keyword string, vec array<double>")
    got = rows(S.nearest_keywords(docs, kw, 2), "doc_id", "rank", "keyword")
    assert got == [(1, 1, "a"), (1, 2, "b")]


def test_dictionary_and_redundancy(spark):
    lines = spark.createDataFrame([("Graph Theory",), ("the",), ("théory",)], "line string")
    sw = spark.createDataFrame([("the",)], "word string")
    d = D.dictionary_phrases(lines, sw)
    assert rows(d, "phrase") == [("graph theory",), ("thory",)]
    docs = spark.createDataFrame([(1, "The graph-theory of graph theory, thory!")], "doc_id long, text string")
    m = D.dictionary_matches(docs, d, sw)
    # terms: graphtheory of graph theory thory ("the" is a stopword)
    assert rows(m, "n", "pos", "phrase") == [(1, 4, "thory"), (2, 2, "graph theory")]
    ph = spark.createDataFrame([(1, "graph theory"), (1, "theory"), (1, "graph"), (1, "set theory"), (2, "theory")],
                               "doc_id long, phrase string")
    assert rows(D.redundancy_filter(ph), "doc_id", "phrase") == [(1, "graph theory"), (1, "set theory"), (2, "theory")]


def test_ngram_tfidf_against_hand_computation(spark):
    text = {1: "alpha beta alpha gamma", 2: "alpha beta delta", 3: "beta gamma gamma"}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    # stems seen more than 3 times: alpha (3) no, beta (3) no, gamma (3) no -> nothing survives
    assert N.ngram_tfidf(docs).count() == 0
    docs = spark.createDataFrame([(i, "alpha beta alpha beta " * (i % 2 + 1)) for i in range(1, 5)], "doc_id long, text string")
    x = {(r["doc_id"], r["term"]): r["x"] for r in N.ngram_tfidf(docs).collect()}
    # every doc has alpha and beta equally often -> each normalised weight is 1/sqrt(2)
    assert all(v == pytest.approx(1 / math.sqrt(2)) for v in x.values()) and len(x) == 8


def test_stemmer_pairs_and_vocabulary_job(spark):
    from phraseforge.functions.stem import stem_vocabulary
    from tests.plain_stemmer import stem_word

    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "filing": "file",
             "relational": "relat", "generously": "generous", "communication": "communic", "skies": "ski",
             "consignment": "consign", "the": "the", "having": "having", "ab": "ab", "Networks": "network"}
    assert {w: stem_word(w) for w in pairs} == pairs
    toks = spark.createDataFrame([(w,) for w in list(pairs) * 2], "token string")
    got = dict((r["token"], r["stem"]) for r in stem_vocabulary(toks).collect())
    assert got == pairs


def test_stem_rules_equal_the_word_by_word_stemmer_and_sql(spark):
    import random

    import duckdb
    from phraseforge.functions import stem as ST
    from phraseforge.plans.oracle_stem import stem_ctes
    from tests.plain_stemmer import stem_word

    r = random.Random(4)
    endings = [x for x, _ in ST.STEP2 + ST.STEP3] + list(ST.STEP4) + ["s", "ies", "ied", "sses", "us", "ed", "edly", "ingly", "eed", "y", "e", "ll", "'s", "'s'", "'"]
    words = {*ST.EXCEPTIONS, *ST.STOPWORDS, *ST.AFTER_1A, "yyy", "sayy", "boy", "by", "é", "éing", "'", "''s", "y", "HOPPING", "generally", "arsenal", ""}
    words |= {"".join(r.choices("aeiouybcdlmnstrzxw'", k=r.randint(0, 6))) + "".join(r.choices(endings, k=r.randint(0, 3))) for _ in range(6000)}
    want = {w: stem_word(w) for w in words}
    got = {x["token"]: x["stem"] for x in ST.stem_vocabulary(spark.createDataFrame([(w,) for w in words] + [(None,)], "token string")).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute("CREATE TABLE v (token VARCHAR)")
    con.execute("INSERT INTO v SELECT unnest(?)", [sorted(words)])
    assert dict(con.execute("WITH " + stem_ctes("v") + " SELECT token, stem FROM stems").fetchall()) == want


def test_stem_map_in_ngram_and_dictionary_pipelines(spark):
    from phraseforge.functions.stem import stem_vocabulary

    docs = spark.createDataFrame([(i, "Networks network networking networks") for i in range(1, 3)],
                                 "doc_id long, text string")
    toks = N.clean_tokens(docs).select(F.explode("toks").alias("token"))
    sm = stem_vocabulary(toks)
    f = {r["stem"]: r["n"] for r in N.corpus_frequency(docs, sm).collect()}
    assert f == {"network": 8}
    forms = N.surface_forms(docs, sm).collect()[0]
    assert list(forms["forms"]) == ["network", "networking", "networks"]
    # dictionary lines are stemmed twice, document terms once
    lines = spark.createDataFrame([("neural networks",)], "line string")
    lsm = stem_vocabulary(spark.createDataFrame([("neural",), ("networks",), ("network",), ("neural",)], "token string"))
    d = D.dictionary_phrases(lines, None, lsm)
    assert rows(d, "phrase") == [("neural network",)]
    docs2 = spark.createDataFrame([(1, "Neural networks!")], "doc_id long, text string")
    m = D.dictionary_matches(docs2, d, None, lsm)
    assert rows(m, "n", "pos", "phrase") == [(2, 0, "neural network")]
