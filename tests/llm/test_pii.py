import hashlib
import random
import re

import duckdb
from tests.llm.fixtures import edge_rows, table

from phraseforge.llm import pii
from phraseforge.llm.oracle import oracles


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "iban":
        x = m.replace(" ", "")
        return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    if kind == "ssn":
        return not re.search(r"^(000|666|9)|-00-|-0000$", m)
    return True


def brute(text):
    """All spans of a text by the plain patterns."""
    text, spans = text or "", []
    for kind, pattern in (pii.BASE | pii.ADDED).items():
        last, found = 0, list(re.finditer(pattern, text))
        for i, m in enumerate(found):
            tail = text[last:m.start()][-pii.BEFORE:].lower()
            head = text[m.end():found[i + 1].start() if i + 1 < len(found) else None][:pii.AFTER].lower()
            last = m.end()
            score = pii.SCORES[kind] + pii.CONTEXT * bool(re.search(pii.WORDS[kind], tail) or re.search(pii.WORDS[kind], head))
            score = round(min(1, max(0, score - pii.CONTEXT * bool(re.search(pii.AGAINST, tail)))), 3)
            if valid(kind, m.group()) and (kind in pii.BASE or score >= pii.THRESHOLD):
                spans.append((kind, m.start(), m.end(), score))
    base = [s for s in spans if s[0] in pii.BASE]
    return [s for s in spans if s[0] in pii.BASE or not any(b[1] < s[2] and s[1] < b[2] for b in base)]


PARTS = ["a.b@c.d", "x@y", "a@b.c_d@e.f", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.255.0", "4111 1111 1111 1111", "4111-1111-1111-1112",
         "378282246310005", "+1 (017) 555-7713", "+49 30 1234567", "+1", "+", "(017) 555-7713", "tel 555 123 4567", "call", "GB82 WEST 1234 5698 7654 32",
         "GB82WEST12345698765432", "DE89370400440532013000", "DE89370400440532013001", "iban", "078-05-1120", "ssn 078-05-1120", "SSN", "900-11-1111",
         "isbn", "ä", "😀", " ", " ", "\n", ".", "-", "7", "a", "word", ",", "%", "_"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, 25))) for _ in range(n)]


def test_spans_equal_brute_force(spark):
    texts = random_texts(1500, 1) + ["1" * 5000, "1." * 4000, "a.b@" + "c." * 5000 + "d", "a" * 2000, "0" * 2000, "+1" + "(" * 3000, "a@b.c " * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + edge_rows()
    got = pii.find(table(spark, rows, "row,kind,nth,spans")).collect()
    have = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"], s["score"]) for s in r["spans"]]) for r in got), key=str)
    assert have == sorted(((d, brute(t)) for d, t, *_ in rows), key=str)
    kinds = {s[0] for _, spans in have for s in spans}
    assert kinds == set(pii.KINDS)
    assert pii.find(table(spark, rows).limit(0)).count() == 0


def test_summary_equals_its_sql(spark):
    rows = [(i, t) for i, t in enumerate(random_texts(400, 2))] + [(1000, None), (1001, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(oracles()["op12_pii"])
    got = pii.summary(pii.find(table(spark, rows)))
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.select(*columns).fetchall())
    for r in got.collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in brute(rows[r["doc_id"]][1] if r["doc_id"] < 1000 else "") if k in pii.BASE)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_long_runs_are_read_once(spark):
    texts = ["a" * 2_000_000, "0" * 2_000_000, "1." * 1_000_000, "+1" + "(" * 2_000_000, "a@b.c " * 50_000]
    got = pii.summary(pii.find(table(spark, list(enumerate(texts)))))
    assert [r["n_email"] for r in got.orderBy("doc_id").collect()] == [0, 0, 0, 0, 50_000]


def test_no_python_worker(spark):
    plan = pii.summary(pii.find(table(spark, [(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
