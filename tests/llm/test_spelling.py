import random
import re
import zlib
from collections import Counter

from tests.llm.fixtures import edge_rows, table

from phraseforge.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[i + 1:] == b[i + 1:] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1:])


def brute(rows):
    n = Counter()
    for d, text, *_ in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return out


def result(docs):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(docs).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_equals_brute_force(spark):
    r = random.Random(3)
    stems = ["".join(r.choices("abcéÿ", k=r.randint(4, 9))) for _ in range(60)] + ["aaaaaaa", "ababababab", "zzzzz", "ÀÀÀÀÀÀ"]
    words = list(stems)
    for w in stems * 6:
        i = r.randrange(len(w))
        words.append(r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abcx") + w[i:], w[:i] + r.choice("abcx") + w[i + 1:]]))
    rows = [(i if i % 9 else None, " ".join(w.upper() if r.random() < 0.2 else w for w in r.choices(words, weights=[1 + 400 / (k + 1) for k in range(len(words))], k=60)))
            for i in range(150)]
    want = brute(rows)
    assert sum(f is not None for _, f, *_ in want) > 50 and any(x[1] != x[2] for x in want if x[1])
    assert result(table(spark, rows)) == want


def test_edge_rows(spark):
    rows = edge_rows() + [(20 + i, "b" * 3000 + " " + "b" * 2999) for i in range(4)]
    assert result(table(spark, rows, "word,n,gram,form")) == brute(rows)
    assert spelling.variants(table(spark, rows).limit(0)).count() == 0
