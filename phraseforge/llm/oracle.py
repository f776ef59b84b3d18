"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from phraseforge.llm.pii import AFTER, AGAINST, BEFORE, CONTEXT, SCORES, THRESHOLD, WORDS

W = r"[^\x20\x09-\x0D]+"

OP8 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP9 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, CAST(source_size AS DOUBLE) * 2 AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM f WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.source_size, b.target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - (sum(size) OVER p - size))) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
WINDOW p AS (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{W}') AS ws FROM d),
g AS (
  SELECT doc_id, i, ws[i:i + 4] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
l AS (
  SELECT doc_id, source, text, x, len(regexp_extract_all(x, '{W}')) AS n,
         lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '{W}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
common AS (
  SELECT l.source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM l GROUP BY source, line) l
  JOIN h ON l.source IS NOT DISTINCT FROM h.source WHERE n > 10 AND n > docs * 0.1),
gone AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM l JOIN common c
  ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - n_removed_words >= n_words * 0.5 AS kept FROM f
"""


#: Without the share of the host's documents.
OP10_BY_COUNT = OP10.replace(" AND n > docs * 0.1", "")

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN s USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (total + 2 * v) AS BIGINT) AS p
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (w.n + 2)) // (total + 2 * v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) w
  JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY lang) USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM x QUALIFY part = 'pair' OR rank <= 10
"""


#: Patterns of the kinds of operator 12 for an engine without look-around, in the order of the kinds.
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "local_phone": r"\(?\b[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b",
}
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS kind, '{k}' AS name, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gaps, "
    f"{SCORES[k]} AS score, '{WORDS[k]}' AS words FROM d" for i, (k, p) in enumerate(_KINDS.items()))

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({_MATCHES}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM k),
m AS (
  SELECT doc_id, kind, name, words, score, ms[i] AS m, translate(ms[i], ' -().+', '') AS plain,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s,
         lower(right(gaps[i], {BEFORE})) AS tail, lower(left(gaps[i + 1], {AFTER})) AS head FROM i),
v AS (
  SELECT *, CASE name
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(plain) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(plain) + 1), lambda j:
      CASE WHEN j % 2 = 1 THEN CAST(reverse(plain)[j] AS INTEGER) ELSE CAST(translate(reverse(plain)[j], '0123456789', '0246813579') AS INTEGER) END)) % 10 = 0
    WHEN 'phone' THEN length(plain) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(plain[5:] || plain[:4], ''), lambda c:
      CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, c: (a * CASE WHEN c >= 10 THEN 100 ELSE 10 END + c) % 97) = 1
    WHEN 'ssn' THEN NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')
    ELSE true END AS valid,
    score + CASE WHEN regexp_matches(tail, words) OR regexp_matches(head, words) THEN {CONTEXT} ELSE 0 END
          - CASE WHEN regexp_matches(tail, '{AGAINST}') THEN {CONTEXT} ELSE 0 END AS points FROM m),
f AS (SELECT doc_id, kind, name, s, s + length(m) AS e FROM v WHERE valid AND (kind < 4 OR round(points, 3) >= {THRESHOLD})),
o AS (
  SELECT * FROM f WHERE kind < 4
  UNION ALL
  SELECT * FROM f WHERE kind >= 4 AND NOT EXISTS (FROM f b WHERE b.doc_id = f.doc_id AND b.kind < 4 AND b.s < f.e AND f.s < b.e)),
w AS (SELECT *, name || ':' || s || ':' || e AS span FROM o)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card,
       count(*) FILTER (kind = 3) AS n_phone, sha256(coalesce(string_agg(span, ',' ORDER BY kind, s) FILTER (kind < 4), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY kind, s), '') AS spans
FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id
"""


def oracles() -> dict[str, str]:
    return {"op8_exact_dedup": OP8, "op9_mixing": OP9, "op10_quality_rules": OP10, "quality_rules_by_count": OP10_BY_COUNT, "op11_divergence": OP11, "op12_pii": OP12}
