import zlib

import numpy as np
import pytest
from tests.llm.fixtures import edge_rows, table

from phraseforge.llm import language_id, quality_classifier
from phraseforge.llm.queries import queries
from phraseforge.llm.vectors import softmax, table_sum, temperature

SF = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_table_sum_adds_over_all_tasks(spark):
    def add(batch, total):
        for v in batch.column(0).to_pylist():
            total[v % len(total)] += v

    df = spark.range(1000).selectExpr("id").repartition(70)
    got = table_sum(df, add, 40_000)
    want = np.zeros(40_000)
    want[:1000] = np.arange(1000)
    assert (got == want).all()
    assert not table_sum(df.limit(0), add, 10).any()


def test_temperature_softens_overconfident_scores():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 1, (4000, 2))
    truth = (rng.random(4000) < softmax(logits)[:, 1]).astype(int)
    assert abs(temperature(logits * 4, truth) - 4) < 1
    assert temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_quality_on_held_out_rows(spark):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries()["op4_quality_classifier"](spark, SF).collect()
    assert len(got) == 1000 and all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.93


def test_quality_of_edge_rows(spark):
    docs = table(spark, edge_rows(), "score,id,y,predicted")
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, *_) in enumerate(edge_rows())] + [(4, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r in quality_classifier.with_score(docs, model, "mark").collect():
        assert by_text.setdefault(r["text"] or "", r["mark"]) == r["mark"]
    good = quality_classifier.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() == sum(r["predicted"] for r in got)
    # nothing to learn from: every document passes
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {1.0}
    assert quality_classifier.score(docs.limit(0), none).count() == 0


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted(map(tuple, quality_classifier.score(docs, quality_classifier.fit(docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = queries()["op5_language_id"](spark, SF).collect()
    assert len(got) == 1000 and all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_of_edge_rows(spark):
    rows = edge_rows() + [(50 + i, "der die das und nicht " * 3, "de", "a") for i in range(12)] + [(70 + i, "the and of with this " * 3, "en", "a") for i in range(12)]
    docs = table(spark, rows, "score,lang_pred,turn,id")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, *_ in rows if d == r["doc_id"])
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in {"und", *model.languages}
        assert letters or r["score"] == 0
    assert {r["lang_pred"] for r in got if 50 <= (r["doc_id"] or 0) < 70} == {"de"}
    # nothing to learn from
    unknown = docs.withColumn("lang", docs["lang"].substr(0, 0)).where("false").union(docs.selectExpr(*[c if c != "lang" else "cast(null as string) lang" for c in docs.columns]))
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(unknown)).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_ngram_scores_equal_a_plain_count(spark):
    """The table look-up per position equals weights times counts over whole texts."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    model = language_id.LanguageModel(["x", "y"], rng.normal(size=(language_id.FEATURES, 2)), 1.0)
    texts = ["Ab c", "", "é1é", "a", "zz zz", "!"]
    got, has = model.logits(pa.array(texts))
    for t, g in zip(texts, got):
        low = [ord(c.lower()) if c.isalpha() else 32 for c in t]
        total, n = np.zeros(2), 0
        for k in language_id.ORDERS:
            for i in range(len(low) - k + 1):
                key = sum(c << (21 * j) for j, c in enumerate(low[i:i + k]))
                f = ((key + k) * 0x9E3779B97F4A7C15 % 2**64) >> 48
                total, n = total + model.table[f], n + 1
        assert g == pytest.approx(total / max(n, 1), abs=1e-6)
    assert has.tolist() == [True, False, True, True, True, False]


def test_ngram_scores_do_not_depend_on_empty_neighbours():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    model = language_id.LanguageModel(["x", "y"], rng.normal(size=(language_id.FEATURES, 2)), 1.0)
    texts = ["abcd", "", None, "efg", "", "hi", "", "j", ""]
    got, _ = model.logits(pa.array(texts))
    for t, g in zip(texts, got):
        assert g == pytest.approx(model.logits(pa.array([t], pa.string()))[0][0], abs=1e-6)


def test_samples_stay_bounded_when_rows_repeat(spark):
    """A third of all rows under one id, and every other row twice: the draw never holds more than its bound."""
    rows = [(1, f"the cat and the dog {i % 3}", "en", "a") for i in range(1000)]
    rows += [(i, text, lang, "a") for i in range(2, 60) for lang, text in (("en", "the cat sat on the mat"), ("de", "der hund und die katze")) for _ in range(2)]
    docs = table(spark, rows).repartition(5)
    once = table(spark, list(dict.fromkeys(rows)))
    model = language_id.fit(docs, rows_per_language=30, max_rows=40)  # raises beyond 40 rows
    assert model.languages == ["de", "en"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] * 3, "doc_id long, quality int")
    quality_classifier.fit(docs, labels, max_rows=45)
    got, want = (sorted(map(tuple, language_id.predict(once, language_id.fit(d, 30, 40)).collect()), key=str) for d in (docs, docs.repartition(2)))
    assert [r[:3] for r in got] == [r[:3] for r in want]
