"""Readers and sinks on small files written by the tests."""

import json
import os

from conftest import rows
from phraseforge.sources import readers as RD
from phraseforge.sources import sinks as SK


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_tagged_corpus_and_gold(spark, tmp_path):
    _write(f"{tmp_path}/docs/d1.txt", "graph_NN theory_NN\nis_VB <b>_SYM fun_JJ\n")
    _write(f"{tmp_path}/docs/d2.txt", "web-service_NN")
    t = RD.tagged_corpus(spark, f"{tmp_path}/docs", suffix=".txt")
    assert rows(t, "doc_id", "pos", "word") == [("d1", 0, "graph"), ("d1", 1, "theory"), ("d1", 2, "is"),
                                                 ("d1", 3, "fun"), ("d2", 0, "web-service")]
    _write(f"{tmp_path}/gold/d1.key", "Graph Theory\n\ngraph theory \nfun\n")
    g = RD.gold_keys(spark, f"{tmp_path}/gold", suffix=".key")
    assert rows(g, "doc_id", "phrase") == [("d1", "fun"), ("d1", "graph theory")]


def test_document_list_counts_blank_lines(spark, tmp_path):
    _write(f"{tmp_path}/list.txt", "d1.txt\n\nd2.txt\n")
    assert RD.document_list(spark, f"{tmp_path}/list.txt").count() == 3


def test_benchmark_csv(spark, tmp_path):
    _write(f"{tmp_path}/b.csv", 'id,title,abstract,controlled,uncontrolled\n'
                                '1," A title ","An abstract, with comma",,"grid,web service"\n')
    r = RD.benchmark_csv(spark, f"{tmp_path}/b.csv").collect()[0]
    assert (r["title"], r["abstract"], list(r["controlled"]), list(r["uncontrolled"])) == \
        ("A title", "An abstract, with comma", [""], ["grid", "web service"])


def test_plain_csvs_and_tsv(spark, tmp_path):
    _write(f"{tmp_path}/two.csv", "7, some text \n")
    assert rows(RD.two_column_csv(spark, f"{tmp_path}/two.csv"), "id", "text") == [("7", "some text")]
    _write(f"{tmp_path}/five.csv", "9, T , c1 , w1 , body \n")
    r = RD.textbook_csv(spark, f"{tmp_path}/five.csv").collect()[0]
    assert (r["title"], r["concepts"], r["wikipediafiles"], r["text"]) == ("T", "c1", "w1", "body")
    _write(f"{tmp_path}/d.tsv", "a1\tHello\tWorld\nno tab here\n")
    assert rows(RD.tsv_lines(spark, f"{tmp_path}/d.tsv"), "id", "text") == [("a1", "hello\tworld")]


def test_abstracts_json(spark, tmp_path):
    recs = [{"title": "x", "abstract": "first"}, {"title": "y"}, {"title": "z", "abstract": "second"}]
    _write(f"{tmp_path}/a.json", "\n".join(json.dumps(r) for r in recs) + "\n")
    df = RD.abstracts_json(spark, f"{tmp_path}/a.json")
    assert rows(df, "title", "abstract") == [("x", "first"), ("z", "second")]
    assert df.select("id").distinct().count() == 2


def test_stopwords_and_dictionary(spark, tmp_path):
    _write(f"{tmp_path}/stop.txt", "The\n the \nUntitled\n\n")
    sw = RD.stopwords(spark, f"{tmp_path}/stop.txt")
    assert rows(sw, "word") == [("",), ("the",), ("untitled",)]
    _write(f"{tmp_path}/dict.txt", "the\nMachine Learning\nab\n")
    assert rows(RD.phrase_dictionary(spark, f"{tmp_path}/dict.txt", sw), "phrase") == [("ab",), ("machine learning",)]


def test_stemmed_gold(spark, tmp_path):
    _write(f"{tmp_path}/gold.txt", "C-41 : grid,web servic+web-servic\nH-3 : a\n")
    got = rows(RD.stemmed_gold(spark, f"{tmp_path}/gold.txt"), "doc_id", "key_pos", "alt_pos", "phrase")
    assert got == [("C-41", 0, 0, "grid"), ("C-41", 1, 0, "web servic"), ("C-41", 1, 1, "web-servic"), ("H-3", 0, 0, "a")]


def test_sinks(spark, tmp_path):
    ph = spark.createDataFrame([(1, 1, "graph theory", 2.0), (1, 2, "graph", 1.0), (2, 1, "web", 3.0)],
                               "doc_id long, rank int, phrase string, score double")
    SK.write_phrases(ph, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    SK.export_phrase_files(ph, f"{tmp_path}/files")
    assert open(next(p for p in (os.path.join(dp, f) for dp, _, fs in os.walk(f"{tmp_path}/files/doc=1")
                                 for f in fs) if p.endswith(".txt"))).read().splitlines() == ["graph theory", "graph"]
    back = SK.save_artefact(ph, f"{tmp_path}/art")
    assert back.count() == 3
