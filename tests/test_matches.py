"""Positions of patterns against a plain scan, with anchors that are rare, common, first and last."""

import random

import pytest

from phraseforge.operators import dictionary as D


def plain(texts, patterns, same_key=False):
    return sorted((t, p, i) for t, toks, tk in texts for p, pat, pk in patterns if pat and (not same_key or tk == pk)
                  for i in range(len(toks) - len(pat) + 1) if toks[i:i + len(pat)] == pat)


def cases(seed):
    r = random.Random(seed)
    texts = [(i, r.choices("the a b c d".split(), weights=[8, 2, 1, 1, 1], k=r.randrange(60)), i % 3) for i in range(40)]
    patterns = [(i, r.choices("the a b c d".split(), weights=[8, 2, 1, 1, 1], k=r.randrange(9)), i % 3) for i in range(60)]
    patterns += [(100, "the the the the".split(), 0), (101, [], 1), (102, ["unknown"], 2), (103, "the the the the the b unknown".split(), 0), (104, texts[7][1], 1)]
    return texts, patterns


@pytest.mark.parametrize("key", [None, "k"])
def test_equals_a_plain_scan(spark, key):
    texts, patterns = cases(2)
    t = spark.createDataFrame(texts, "tid long, toks array<string>, k long")
    p = spark.createDataFrame(patterns, "pid long, ptoks array<string>, k long")
    got = D.contiguous_matches(t if key else t.drop("k"), p if key else p.drop("k"), key)
    assert sorted((r["tid"], r["pid"], r["pos"]) for r in got.collect()) == plain(texts, patterns, bool(key))


def test_the_rarest_gram_is_the_anchor(spark):
    t = spark.createDataFrame([(1, "the the the of the the the x y".split())], "tid long, toks array<string>")
    p = spark.createDataFrame([(7, "the the the x y z".split()), (8, "the the".split())], "pid long, ptoks array<string>")
    got = {r["pid"]: (r["offset"], r["gram"]) for r in D._anchors(t, p).collect()}
    assert got == {7: (3, "x y z"), 8: (0, "the the")}


@pytest.mark.parametrize("key", [None, "k"])
def test_many_patterns_equal_a_plain_scan(spark, key, monkeypatch):
    monkeypatch.setattr(D, "PATTERN_BYTES", -1)
    test_equals_a_plain_scan(spark, key)


def test_few_patterns_are_compared_where_the_texts_are(spark, monkeypatch):
    """No text and no candidate is shuffled: only what is found."""
    monkeypatch.setattr(D, "PLACES", 50)
    texts, patterns = cases(3)
    t = spark.createDataFrame([x[:2] for x in texts], "tid long, toks array<string>")
    got = D.contiguous_matches(t, spark.createDataFrame([x[:2] for x in patterns], "pid long, ptoks array<string>"))
    assert sorted((r["tid"], r["pid"], r["pos"]) for r in got.collect()) == plain(texts, patterns)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate explode(flatten" not in plan
