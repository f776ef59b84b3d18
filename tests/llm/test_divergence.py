import random
import re
from collections import Counter, defaultdict

from tests.llm.fixtures import edge_rows, table

from phraseforge.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, min_docs, top):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source in ((*r, None, None)[:4] for r in rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        size = {s: sum(counts[lang, s][t] for t in kept) + 2 * len(kept) for s in sources}
        share = lambda n, total: 1 + 10**9 * (n + 2) // total
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum(size.values()) - 2 * len(kept) * (len(sources) - 1)
        for s in sources:
            p = [share(counts[lang, s][t], size[s]) for t in kept]
            pairs = [(sum(map(f, p, [share(counts[lang, x][t], size[x]) for t in kept])), x) for x in sources if x != s]
            q = [share(sum(counts[lang, x][t] for x in sources), whole) for t in kept]
            terms = [(f(a, b), t) for t, a, b in zip(kept, p, q) if counts[lang, s][t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def result(docs, **how):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark):
    r = random.Random(6)
    words = ["the", "Cat,", "(cat)", "dog's", "été", "naïve-word", "12", "x1y", "中文", "😀", "THE", "rare", "a-b-a"] + [f"w{chr(97 + i)}!" for i in range(20)]
    # terms that only come near the limit through several rare chunks
    words += [f"{a}edge{b}" for a in "([{<*" for b in ").,;"]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(12))) + ("\n" if i % 3 else "\t") + "end", r.choice(["en", "de", None]), f"s{min(r.randrange(9), 5)}") for i in range(160)]
    rows += [(999, "lone", "fr", "s1"), (1000, None, "fr", "s2"), (1001, "", "xx", None)]
    for min_docs in (4, 10, 25):
        assert result(table(spark, rows, "term,chunk,n").repartition(3), min_docs=min_docs, top=5) == brute(rows, min_docs, 5)


def test_edge_rows(spark):
    rows = edge_rows()
    assert result(table(spark, rows), min_docs=2) == brute(rows, 2, 10)
    assert result(table(spark, rows), min_docs=50) == brute(rows, 50, 10)  # no language keeps a term
    assert divergence.audit(table(spark, rows).limit(0)).count() == 0


def test_small_blocks_give_the_same_rows(spark, monkeypatch):
    for name, value in (("ENTRIES", 7), ("CELLS", 3), ("HELD", 5), ("BLOCK_BYTES", 40), ("FILTER_BITS", 64)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(i, f"alpha beta{'xyz'[i % 3]} (gamma{'abc'[i % 3]}) gamma{'abc'[i % 3]}, w{'pq'[i % 2]}", "en", f"s{i % 4}") for i in range(30)]
    assert result(table(spark, rows).repartition(2), min_docs=8) == brute(rows, 8, 10)
