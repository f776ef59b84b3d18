"""Token counts as arrays, and the stems of the counted tokens."""

import pytest
from pyspark.sql import functions as F

from phraseforge.operators import ngrams as N
from phraseforge.plans import queries


@pytest.mark.parametrize("name", ["corpus_frequency_stemmed", "surface_forms_stemmed"])
def test_stemmed_counts_read_the_texts_once(spark, monkeypatch, name):
    """the stems are those of the counted tokens."""
    t = spark.createDataFrame([(1, "Running runs run the runner"), (2, "run run"), (3, None)], "doc_id long, text string")
    reads = []
    monkeypatch.setattr(queries, "_docs", lambda *_: reads.append(1) or t)
    rows = {r["stem"]: r[1] for r in queries.registry()[name](spark, "").collect()}
    assert rows["run"] == (5 if name.startswith("corpus") else "run,running,runs") and len(reads) == 1


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_token_counts_are_those_of_the_clean_tokens(spark, monkeypatch, size):
    """counted as arrays, in slices of any size, without a row per token."""
    monkeypatch.setattr(N, "SLICE_BYTES", size)
    texts = ["", None, " a", "b", "A\x1cb\u0085c \u00e9cole na\u00efve_X", "x-y 12 3z\tz\x0bz", "end", "\u4f60 a\U0001f600b", "\n", "\u0130I\u212a k"] * 3
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = N.clean_tokens(t).select(F.explode("toks").alias("token")).groupBy("token").count()
    got = N.token_counts(t)
    assert {r["token"]: r["n"] for r in got.collect()} == {r["token"]: r["count"] for r in want.collect()}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
