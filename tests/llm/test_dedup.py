import random

import numpy as np
import xxhash
from tests.llm.fixtures import edge_rows, table, words

from phraseforge.llm import exact_dedup, simhash, substring_dedup, suffix_dedup
from phraseforge.llm.components import components


# --- exact dedup ---------------------------------------------------------------

def digest(i):
    import hashlib

    return hashlib.sha256(str(i).encode()).hexdigest()


def test_cuckoo_index_against_a_dict():
    r, index, live = random.Random(1), exact_dedup.CuckooIndex(buckets=2), {}
    for _ in range(6000):
        d = digest(r.randrange(1500))
        if r.random() < 0.3:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            n = r.randrange(100)
            assert index.insert(d, n, 1) == (d not in live)
            keep, size = live.get(d, (n, 0))
            live[d] = (max(keep, n), size + 1)
    assert {e[0]: (e[1], e[2]) for e in index.entries()} == live
    assert index.size == len(live) and all(index.may_hold(d) for d in live)
    assert index.find(digest("never")) is None


def test_exact_decisions(spark):
    rows = edge_rows()
    got = exact_dedup.decisions(table(spark, rows, "digest,rows,nth"), buckets=3).collect()
    assert len(got) == len(rows)
    by_text = {}
    for d, t, *_ in rows:
        by_text.setdefault(t or "", []).append(d)
    import hashlib

    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by_text.items()}
    for r in got:
        ids = sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(by_text) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.decisions(table(spark, rows).limit(0)).count() == 0


def test_drop_copies_keeps_columns(spark):
    docs = table(spark, edge_rows(), "row,nth,stay_id,sha")
    left = exact_dedup.drop_copies(docs, buckets=2)
    assert left.columns == docs.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in edge_rows()})


def test_index_takes_insertions_and_deletions(spark):
    first = exact_dedup.build_index(exact_dedup.insertions(exact_dedup.digests(table(spark, [(1, "a"), (2, "b"), (3, "a")])), 2))
    more = exact_dedup.insertions(exact_dedup.digests(table(spark, [(9, "a"), (4, "c")])), 2)
    gone = more.filter("doc_id = 4").selectExpr("bucket", "'delete' AS op", "digest", "doc_id", "n")
    index = exact_dedup.update_index(exact_dedup.update_index(first, more), gone)
    assert sorted((r["keep_id"], r["group_size"]) for r in index.collect()) == [(2, 1), (9, 3)]


# --- components and SimHash ------------------------------------------------------

def closed(links):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in label}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in closed(links).items() if x != y}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, n=4):
    w = words(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).decode())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def near_copies(seed, n):
    r = random.Random(seed)
    base = [f"t{r.randrange(500)}" for _ in range(400)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = "Q"
        out.append(" ".join(t))
    return out


def test_simhash_groups_against_all_pairs(spark):
    texts = near_copies(1, 40) + near_copies(2, 3) + ["A b C", "a B c", None, "", "  ", "lonely words are here today"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = simhash.near_groups(table(spark, rows, "fp,node,label")).collect()
    assert len(got) == len(rows)
    want = {i: fingerprint(t) for i, t in rows}
    assert all(r["fp"] % 2**64 == want[r["doc_id"]] for r in got)
    ids = sorted(want)
    group = closed([(i, i) for i in ids] + [(i, j) for i in ids for j in ids if i < j and (want[i] ^ want[j]).bit_count() <= 4])
    assert {r["doc_id"]: r["component_id"] for r in got} == group
    assert simhash.near_groups(table(spark, rows).limit(0)).count() == 0


def test_crowded_buckets_connect_the_same(spark):
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(60)}
    for center in list(fps)[:3]:
        for _ in range(40):
            fps.add(center ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))))
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for bits in (3, 4):
        pairs = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= bits]
        plain = {(x["a"], x["b"]) for x in simhash.fingerprint_links(df, bits, hot=10**6).collect()}
        assert plain == set(pairs)
        for huge in (20, 10**6):  # through midpoints, and compared in the bucket
            hot = [(x["a"], x["b"]) for x in simhash.fingerprint_links(df, bits, hot=5, huge=huge).collect()]
            assert all(((a ^ b) % 2**64).bit_count() <= bits * 2 for a, b in hot)
            assert {k: v for k, v in closed(hot).items() if k != v} == {k: v for k, v in closed(pairs).items() if k != v}


def test_bucket_shares_give_spanning_links():
    import pyarrow as pa

    r = random.Random(9)
    held = [r.getrandbits(64)]
    held += [held[0] ^ sum(1 << b for b in r.sample(range(64), 3)) for _ in range(30)]
    seek = held + [h ^ 1 << r.randrange(64) for h in held for _ in range(3)]
    rows = pa.table({"fp": pa.array(np.array(held + seek, np.uint64).view(np.int64)), "filed": [True] * len(held) + [False] * len(seek)})
    out = simhash._bucket_links(4)((), rows).to_pylist()
    want = [(a, b) for a in held for b in seek if (a ^ b).bit_count() <= 4]
    signed = lambda x: x - 2**64 if x >> 63 else x
    want = [(signed(a), signed(b)) for a, b in want]
    assert {k: v for k, v in closed([(x["a"], x["b"]) for x in out]).items()} == {k: v for k, v in closed(want).items() if any(k in p and p[0] != p[1] for p in want)}
    assert len(out) < len(held) + len(seek)


def test_drop_near_copies_leaves_one_of_each_group(spark):
    rows = [(i + 5, t) for i, t in enumerate(near_copies(6, 8))] + [(2, "something else entirely, quite short"), (2, "something else entirely, quite short")]
    docs = table(spark, rows, "row,stay,nth")
    left = simhash.drop_near_copies(docs)
    groups = {r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(groups)


def test_drop_near_copies_keeps_every_group_without_ids(spark):
    """Groups whose ids are all null, and texts that share one doc_id, each leave a row."""
    apart = [" ".join(f"g{g}w{i}" for i in range(30)) for g in range(6)]
    rows = [(None, t) for t in apart[:3]] + [(None, apart[0]), (None, apart[3]), (7, apart[3]), (9, apart[4]), (9, apart[5]), (9, apart[5])]
    rows += [(None, None), (None, "")]
    docs = table(spark, rows, "row,stay,stay_key,key,label,nth")
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in left.collect())
    assert got == sorted([(0, apart[0]), (0, apart[1]), (0, apart[2]), (7, apart[3]), (9, apart[4]), (9, apart[5]), (0, "")])


# --- substring dedup -------------------------------------------------------------

def expected_repeats(rows, size):
    """Brute force: every window against the earliest place of its words."""
    first, texts = {}, {}
    key = lambda d: -(1 << 63) if d is None else d
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            k, at = tuple(w[i:i + size]), (key(d), i)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (key(d), i):
                gone[i:i + size] = True
        out.append((d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def passages(seed, n):
    r = random.Random(seed)
    pool = [" ".join(f"p{k}x{j}" for j in range(r.randrange(4, 40))) for k in range(6)]
    return [(i, " ".join(r.choice(pool) if r.random() < 0.5 else " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 15)))
                         for _ in range(r.randrange(0, 8)))) for i in range(n)]


def test_repeats_against_brute_force(spark):
    rows = passages(1, 60)
    rows += [(100, rows[5][1]), (101, "  " + (rows[5][1] or "").replace(" ", "\n")), (102, "z " * 70), (103, "z " * 19), (104, "z\t" * 20)]
    for block in (10, 3):
        got = substring_dedup.remove_repeats(table(spark, rows, "doc,key,pos"), block=block, buckets=5).drop("repeats").collect()
        assert sorted(map(tuple, got), key=str) == expected_repeats(rows, 2 * block)


def test_repeats_of_edge_rows(spark):
    rows = [r for r in edge_rows()] + [(20, " ".join(f"w{i}" for i in range(500, 560))), (None, " ".join(f"w{i}" for i in range(510, 550)))]
    got = substring_dedup.remove_repeats(table(spark, rows), block=10).collect()
    assert sorted([(r[0], r[1], r[2], r[3]) for r in got], key=str) == expected_repeats(rows, 20)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["repeats"]) == r["n_removed"]
    assert substring_dedup.remove_repeats(table(spark, rows).limit(0)).count() == 0


# --- suffix-array dedup ------------------------------------------------------------

def key(d):
    return -(1 << 63) if d is None else d


def expected_passages(rows, length):
    """Rows by definition: window by window, over all texts."""
    whole = {}
    for d, t, *_ in rows:
        whole[t or ""] = min(whole.get(t or "", key(d)), key(d))
    out = {(d, 0, len(words(t)), whole[t or ""], 0) for d, t, *_ in rows if whole[t or ""] < key(d) and len(words(t)) >= length}
    left = {(key(d), t or "") for d, t, *_ in rows if whole[t or ""] == key(d)}
    first = {}
    for d, t in left:
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            first[k] = min(first.get(k, (d, i)), (d, i))
    for d, t in left:
        w, before, runs = words(t), {}, {}
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            source = (d, before[k]) if k in before and i - before[k] <= length else first[k]
            before[k] = i
            if source < (d, i):
                runs.setdefault((source[0], i - source[1]), []).append(i)
        for (src, shift), places in runs.items():
            begin = None
            for i, after in zip(places, [*places[1:], None]):
                begin = i if begin is None else begin
                if after is None or after - i > length:
                    out.add((d, begin, i - begin + length, src, begin - shift))
                    begin = None
    plain = lambda x: None if x == -(1 << 63) else x
    return sorted(((plain(r[0]), r[1], r[2], plain(r[3]), r[4]) for r in out), key=str)


def found_passages(docs, **how):
    return sorted(map(tuple, suffix_dedup.repeated_passages(docs, **how).collect()), key=str)


def test_passages_against_brute_force(spark):
    rows = passages(2, 70) + [(100, passages(2, 70)[5][1]), (102, "z " * 90), (103, "z y " * 30)]
    for length, span, gram in ((12, 4, 3), (25, 9, 5)):
        want = expected_passages(rows, length)
        assert len(want) > 30 and found_passages(table(spark, rows, "h,doc,src,pos"), length=length, span=span, gram=gram) == want


def test_passages_do_not_depend_on_the_layout(spark):
    r = random.Random(8)
    one, two = (" ".join(f"{c}{i}" for i in range(70)) for c in "pq")
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(r.randrange(9))) + " " + one * (i % 3 > 0) + " " + (two if i % 2 else "") + f" t{i}") for i in range(40)]
    rows += [(50, one + " " + two), (51, two + " " + one)]
    want = expected_passages(rows, 50)
    for parts in (1, 3, 7, 64):
        assert found_passages(table(spark, rows).repartition(parts), length=50, span=16, gram=10) == want


def test_passages_of_edge_rows(spark):
    rows = edge_rows() + [(20, " ".join(f"w{i}" for i in range(500, 590))), (None, " ".join(f"w{i}" for i in range(510, 575))), (21, "a b " * 60)]
    assert found_passages(table(spark, rows), length=50, span=16, gram=10) == expected_passages(rows, 50)
    assert suffix_dedup.repeated_passages(table(spark, rows).limit(0)).count() == 0


def test_minimisers_depend_on_the_words_alone():
    r = np.random.default_rng(1)
    grams = r.integers(0, 50, 400).astype(np.uint64)
    first, n = np.array([0, 100, 103, 103]), np.array([100, 3, 0, 297])
    got = set(suffix_dedup._minimisers(grams, first, n, 16).tolist())
    want = set()
    for f, m in zip(first, n):
        for i in range(f, f + max(m - 16 + 1, min(m, 1))):
            part = grams[i:min(i + 16, f + m)]
            want.add(int(i + np.argmin(part)))
    assert got == want
