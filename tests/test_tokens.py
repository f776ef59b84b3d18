"""Token reader, runs, n-grams and phrase positions (fixtures T1, T2, T13, T15)."""

from pyspark.sql import functions as F

from conftest import rows, tagged_docs
from phraseforge.functions.text import match_positions, ngrams
from phraseforge.operators import tokens as K


def test_t1_tagged_parse(spark):
    t = tagged_docs(spark, {1: "a_b_NN <p>_NN x JJ\nfoo_NN _NN"})
    assert rows(t, "pos", "word", "tag") == [
        (0, "a_b", "NN"),    # split at the last underscore
        (1, "x", "x"),       # no underscore: word = tag = token
        (2, "jj", "JJ"),     # word lower-cased, tag kept
        (3, "foo", "NN"),    # order runs across lines; <p> took no position
        (4, "", "NN"),
    ]


def test_markup_only_when_two_chars(spark):
    t = tagged_docs(spark, {1: "<_SYM <b_NN x>_NN ok_NN"})
    assert [r[0] for r in rows(t, "word")] == ["<", "ok"]


def test_t2_runs_drop_jj_tail(spark):
    t = tagged_docs(spark, {1: "fast_JJ graph_NN is_VB fast_JJ"})
    assert rows(K.candidate_phrases(t), "phrase", "n") == [("fast graph", 1)]


def test_runs_cross_lines_and_last_run_kept(spark):
    t = tagged_docs(spark, {1: "big_JJ\nhouse_NN of_IN red_JJ cars_NNS"})
    assert rows(K.candidate_phrases(t), "phrase") == [("big house",), ("red cars",)]


def test_word_positions_one_based(spark):
    t = tagged_docs(spark, {1: "cat_NN runs_VB cat_NN"})
    r = K.word_positions(t).collect()
    assert [(x["word"], x["tf"], list(x["positions"])) for x in r] == [("cat", 2, [1, 3])]


def test_t13_positions(spark):
    df = spark.createDataFrame([("a b a b a c", "a b a"), ("a b", "a b a"), ("a b", "")], "t string, p string")
    out = df.select(match_positions(F.split("t", " "), F.filter(F.split("p", " "), lambda x: x != "")).alias("m"))
    assert [list(r["m"]) for r in out.collect()] == [[0, 2], [], []]


def test_t15_ngrams_short_list(spark):
    df = spark.createDataFrame([(["x"],), (["a", "b", "c"],)], "t array<string>")
    out = [list(r["g"]) for r in df.select(ngrams("t", 1, 3).alias("g")).collect()]
    assert out[0] == ["x"]
    assert out[1] == ["a", "b", "c", "a b", "b c", "a b c"]


def test_tagged_text_round_trip(spark):
    docs = spark.createDataFrame([(1, "The cat_ sat."), (2, "Gut, sehr gut!")], "doc_id long, text string")
    toks = K.tokens_from_text(docs)
    back = K.parse_tagged(K.tagged_text(toks))
    assert rows(back, "doc_id", "pos", "word", "tag") == rows(toks, "doc_id", "pos", "word", "tag")
