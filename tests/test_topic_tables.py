"""Topics as a table (M5) against the same expectation maximisation written as plain loops."""

import math
import random

import numpy as np
import pytest

from phraseforge.operators import topic_tables as TT

K = 3


def corpus(n=40):
    r = random.Random(1)
    themes = [["graph", "node", "edge", "path"], ["layer", "neural", "train", "loss"], ["cell", "gene", "protein", "tissue"]]
    return [(i, w) for i in range(n) for w in r.choices(themes[i % 3], k=20) + r.choices(["the", "of", "a"], k=6)]


def bow(spark, rows):
    return spark.createDataFrame(rows, "id long, term string").groupBy("id", "term").count().withColumnRenamed("count", "n")


def plain(rows, phi, rounds):
    """(likelihoods, shares of terms) of every round, one occurrence at a time."""
    ids, terms = sorted({d for d, _ in rows}), sorted({t for _, t in rows})
    a = 1 / K
    c = {t: phi[t] for t in terms}
    theta = {d: [1 / K] * K for d in ids}
    values = []
    for _ in range(rounds):
        z = [sum(c[t][j] + a for t in terms) for j in range(K)]
        p = {t: [(c[t][j] + a) / z[j] for j in range(K)] for t in terms}
        values.append(a * sum(math.log(x) for m in (theta, p) for v in m.values() for x in v))
        docs, c = {d: [a] * K for d in ids}, {t: [0.0] * K for t in terms}
        for d, t in rows:
            share = [theta[d][j] * p[t][j] for j in range(K)]
            values[-1] += math.log(sum(share))
            for j in range(K):
                docs[d][j] += share[j] / sum(share)
                c[t][j] += share[j] / sum(share)
        theta = {d: [x / sum(v) for x in v] for d, v in docs.items()}
    return values, c


@pytest.mark.parametrize("entries", [30, 100_000])
def test_equals_plain_loops(spark, entries):
    rows = corpus()
    start = {r["term"]: np.frombuffer(r["c"]).tolist() for r in TT._first_model(TT.pack(bow(spark, rows)), K, 7).collect()}
    topics = TT.fit(bow(spark, rows), K, tolerance=-1, max_rounds=6, entries=entries)
    values, c = plain(rows, start, 6)
    assert topics.likelihoods == pytest.approx(values, rel=1e-9)
    got = {r["term"]: np.frombuffer(r["c"]).tolist() for r in topics.terms.collect()}
    assert got.keys() == c.keys() and all(got[t] == pytest.approx(c[t], abs=1e-8) for t in c)
    assert np.array([r["p"] for r in topics.weights().collect()]).sum(axis=0) == pytest.approx([1.0] * K)


def test_likelihood_never_falls_and_themes_part(spark):
    topics = TT.fit(bow(spark, corpus()), K, tolerance=1e-6, max_rounds=60)
    steps = np.diff(topics.likelihoods)
    assert len(steps) < 59 and (steps > -1e-9 * abs(topics.likelihoods[-1])).all()
    vec = {r["id"]: int(np.argmax(r["vec"])) for r in TT.infer(bow(spark, corpus()), topics).collect()}
    assert all(vec[d] == vec[d % 3] for d in vec) and len({vec[0], vec[1], vec[2]}) == 3


def test_edges(spark):
    topics = TT.fit(bow(spark, corpus(6) + [(None, "graph"), (99, None)]), K, max_rounds=2)
    assert "graph" in {r["term"] for r in topics.terms.collect()}
    vec = {r["id"]: r["vec"] for r in TT.infer(bow(spark, [(1, "graph"), (1, "unseen"), (2, "unseen")]), topics).collect()}
    assert set(vec) == {1} and sum(vec[1]) == pytest.approx(1.0)
    none = TT.fit(bow(spark, corpus(6)).limit(0), K)
    assert none.terms.count() == 0 and TT.infer(bow(spark, [(1, "graph")]), none).count() == 0


def test_no_entry_or_term_is_broadcast_over_the_driver(spark):
    """Sizes of packed rows are estimated far too low: without a hint their joins are broadcasts (FINDINGS_r03 F11)."""
    packed = TT.materialize(TT.pack(bow(spark, corpus())))
    needs = TT.materialize(packed.selectExpr("block", "posexplode(terms) AS (slot, term)"))
    joined = TT._at_blocks(needs, TT.materialize(TT._first_model(packed, K, 7)))
    assert joined.count() == needs.count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fit_and_infer_hint_every_join(spark, monkeypatch):
    frame = type(spark.range(0))
    asked, join = [], frame.join

    def seen(self, other, *args, **kwargs):
        out = join(self, other, *args, **kwargs)
        asked.append(out._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(frame, "join", seen)
    b = bow(spark, corpus(12))
    TT.infer(b, TT.fit(b, K, max_rounds=2)).count()
    assert len(asked) == 5
    assert not [p for p in asked if "Broadcast" in p]


def test_a_round_leaves_its_terms_and_documents_only(spark, monkeypatch):
    """FINDINGS_r04 F6: the blocks' sums, a row for each term and block, stayed for another round."""
    import os

    from phraseforge.session import checkpoint_dir

    root, there, kept = checkpoint_dir(spark).removeprefix("file:"), set(os.listdir(checkpoint_dir(spark).removeprefix("file:"))), []
    real = TT._totals

    def seen(terms, *args):
        kept.append(sorted(os.path.join(r, x) for f in os.listdir(root) if f not in there and f.startswith("topics-")
                           for r in os.listdir(f"{root}/{f}") for x in os.listdir(f"{root}/{f}/{r}")))
        return real(terms, *args)

    monkeypatch.setattr(TT, "_totals", seen)
    topics = TT.fit(bow(spark, corpus(12)), K, tolerance=-1, max_rounds=3)
    assert kept[1:] == [[f"{r}/dealt", f"{r}/terms", f"{r}/theta"] for r in range(3)]  # before: those of the round before too
    left = [x for f in os.listdir(root) if f not in there and f.startswith("topics-") for r in os.listdir(f"{root}/{f}") for x in os.listdir(f"{root}/{f}/{r}")]
    assert sorted(left) == ["terms", "theta"] and topics.terms.count() > 0
