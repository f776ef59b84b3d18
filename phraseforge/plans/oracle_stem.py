"""DuckDB SQL of the English stemmer (X9): one CTE per step, and the stemmed queries."""

from __future__ import annotations

from phraseforge.functions.stem import (AFTER_1A, DOUBLES, EXCEPTIONS, LI_ENDINGS, R1_PREFIXES, STEP2, STEP3, STEP4, STOPWORDS, VOWELS)

V = f"[{VOWELS}]"
C = f"[^{VOWELS}]"
SHORT = f"(^{V}{C}|{C}{V}[^{VOWELS}wxY])$"


def _text(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _words(words) -> str:
    return ", ".join(_text(w) for w in sorted(words))


def _ends(suffixes) -> str:
    return _text("(" + "|".join(suffixes) + ")$")


def _case(table) -> str:
    return "CASE s " + " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in table) + " END"


def _region(word: str) -> str:
    return f"CASE WHEN regexp_matches({word}, '{V}{C}') THEN length(regexp_extract({word}, '^.*?{V}{C}')) ELSE length({word}) END"


def stem_ctes(source: str, name: str = "stems") -> str:
    """CTEs ending in ``name`` (token, stem) for the distinct non-null ``token`` of ``source``."""
    n = name
    known = f"regexp_extract(w, '^({'|'.join(R1_PREFIXES)})')"
    return f"""
{n}_a AS (SELECT token, lower(token) AS w0, regexp_replace(regexp_replace(lower(token), '^''', ''), '^y', 'Y') AS y
          FROM (SELECT DISTINCT token FROM {source} WHERE token IS NOT NULL)),
{n}_b AS (SELECT token, CASE WHEN length(w0) <= 2 OR w0 IN ({_words(STOPWORDS)}) THEN w0
                {' '.join(f'WHEN w0 = {_text(a)} THEN {_text(b)}' for a, b in EXCEPTIONS.items())} END AS done,
                array_to_string(list_transform(string_split(y, ''), lambda c, i: CASE WHEN c = 'y' AND i > 1 AND regexp_matches(y[i - 1], '{V}')
                                                                             THEN 'Y' ELSE c END), '') AS w FROM {n}_a),
{n}_c AS (SELECT *, CASE WHEN {known} <> '' THEN length({known}) ELSE {_region('w')} END AS r1 FROM {n}_b),
{n}_d AS (SELECT *, r1 + {_region('w[r1 + 1:]')} AS r2 FROM {n}_c),
{n}_0 AS (SELECT token, done, r1, r2, regexp_replace(w, {_ends(["'s'", "'s", "'"])}, '') AS w FROM {n}_d),
{n}_1 AS (SELECT token, done, r1, r2, CASE
    WHEN w LIKE '%sses' THEN w[:length(w) - 2]
    WHEN w LIKE '%ied' OR w LIKE '%ies' THEN w[:length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END]
    WHEN w LIKE '%us' OR w LIKE '%ss' THEN w
    WHEN w LIKE '%s' AND regexp_matches(w, '{V}.*.s$') THEN w[:length(w) - 1] ELSE w END AS w FROM {n}_0),
{n}_1b AS (SELECT token, r1, r2, w, coalesce(done, CASE WHEN w IN ({_words(AFTER_1A)}) THEN w END) AS done,
                  regexp_extract(w, {_ends(['eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'])}) AS s FROM {n}_1),
{n}_1e AS (SELECT token, done, r1, r2, s, w[:length(w) - length(s)] AS b, w FROM {n}_1b),
{n}_1f AS (SELECT token, done, r1, r2, CASE
    WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END
    WHEN s = '' OR NOT regexp_matches(b, '{V}') THEN w
    WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
    WHEN regexp_matches(b, {_ends(DOUBLES)}) THEN b[:length(b) - 1]
    WHEN regexp_matches(b, '{SHORT}') AND r1 >= length(b) THEN b || 'e' ELSE b END AS w FROM {n}_1e),
{n}_1c AS (SELECT token, done, r1, r2, regexp_replace(w, '^(.+{C})[yY]$', '\\1i') AS w FROM {n}_1f),
{n}_2s AS (SELECT *, regexp_extract(w, {_ends(x for x, _ in STEP2)}) AS s FROM {n}_1c),
{n}_2 AS (SELECT token, done, r1, r2, CASE
    WHEN s = '' OR length(w) - length(s) < r1 OR (s = 'ogi' AND w NOT LIKE '%logi') OR (s = 'li' AND NOT regexp_matches(w, '[{LI_ENDINGS}]li$')) THEN w
    ELSE w[:length(w) - length(s)] || {_case(STEP2)} END AS w FROM {n}_2s),
{n}_3s AS (SELECT *, regexp_extract(w, {_ends(x for x, _ in STEP3)}) AS s FROM {n}_2),
{n}_3 AS (SELECT token, done, r1, r2, CASE
    WHEN s = '' OR length(w) - length(s) < r1 OR (s = 'ative' AND length(w) - length(s) < r2) THEN w
    ELSE w[:length(w) - length(s)] || {_case(STEP3)} END AS w FROM {n}_3s),
{n}_4s AS (SELECT *, regexp_extract(w, {_ends(STEP4)}) AS s FROM {n}_3),
{n}_4 AS (SELECT token, done, r1, r2, CASE
    WHEN s = '' OR length(w) - length(s) < r2 OR (s = 'ion' AND NOT regexp_matches(w, '[st]ion$')) THEN w
    ELSE w[:length(w) - length(s)] END AS w FROM {n}_4s),
{n}_5 AS (SELECT token, done, CASE
    WHEN w LIKE '%e' AND (length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches(w[:length(w) - 1], '{SHORT}'))) THEN w[:length(w) - 1]
    WHEN w LIKE '%ll' AND length(w) > r2 THEN w[:length(w) - 1] ELSE w END AS w FROM {n}_4),
{n} AS (SELECT token, coalesce(done, replace(w, 'Y', 'y')) AS stem FROM {n}_5)"""


def stemmed_oracles(q: dict[str, str]) -> dict[str, str]:
    """The queries with the stemmer, from the SQL of those without it."""
    out: dict[str, str] = {}
    one_form = "nst AS (SELECT doc_id, generate_subscripts(toks, 1) AS i, unnest(toks) AS stem FROM nct)"
    tokens = "ntok AS (SELECT doc_id, generate_subscripts(toks, 1) AS i, unnest(toks) AS token FROM nct)," + stem_ctes("ntok")
    stemmed = tokens + ",\nnst AS (SELECT doc_id, i, token, stem FROM ntok JOIN stems USING (token))"
    for name in ("corpus_frequency", "ngram_tfidf"):
        out[f"{name}_stemmed"] = q[name].replace(one_form, stemmed)
    out["surface_forms_stemmed"] = q["surface_forms"].replace(one_form, stemmed).replace("list_distinct(list(stem))", "list_distinct(list(token))")
    out["stem_vocabulary"] = q["surface_forms"].split(one_form)[0] + tokens + "\nSELECT token, stem FROM stems"
    # dictionary entries are stemmed twice, document words once
    head, rest = q["dictionary_matches"].split("dw AS", 1)
    words, rest = rest.split("dterms AS", 1)
    out["dictionary_matches_stemmed"] = head.replace("dict AS", "plain AS") + "dw AS" + words + (
        "once_words AS (SELECT unnest(t) AS token FROM bt UNION ALL SELECT unnest(t) FROM dw)," + stem_ctes("once_words", "once") +
        ",\nall_words AS (SELECT token FROM once UNION ALL SELECT stem FROM once)," + stem_ctes("all_words") + """,
ptok AS (SELECT phrase AS entry, generate_subscripts(string_split(phrase, ' '), 1) AS i, unnest(string_split(phrase, ' ')) AS token FROM plain),
pone AS (SELECT entry, i, coalesce(stem, token) AS token FROM ptok LEFT JOIN stems USING (token)),
ptwo AS (SELECT entry, i, coalesce(stem, token) AS token FROM pone LEFT JOIN stems USING (token)),
dict AS (SELECT DISTINCT phrase FROM (SELECT string_agg(token, ' ' ORDER BY i) AS phrase FROM ptwo GROUP BY entry)),
dstem AS (SELECT doc_id, i, coalesce(stem, term) AS term FROM dpos LEFT JOIN stems ON token = term),
dterms AS""") + rest.replace("FROM dpos", "FROM dstem")
    # macro scores over stemmed phrases
    norms = {"gn": "gold", "pn": "pred"}
    sql = q["eval_macro"]
    words = ",\nphrases AS (SELECT phrase FROM gold UNION SELECT phrase FROM pred),\nparts AS (SELECT phrase, " \
            "generate_subscripts(string_split(lower(phrase), ' '), 1) AS i, unnest(string_split(lower(phrase), ' ')) AS token FROM phrases)," + stem_ctes("parts") + \
            ",\nnormal AS (SELECT phrase, string_agg(stem, ' ' ORDER BY i) AS norm FROM parts JOIN stems USING (token) GROUP BY phrase)"
    for name, of in norms.items():
        start = sql.index(f"{name} AS (")
        end = sql.index("),\n", start)
        distinct = "DISTINCT " if name == "pn" else ""
        sql = sql[:start] + f"{name} AS (SELECT {distinct}doc_id, norm FROM {of} JOIN normal USING (phrase)" + sql[end:]
    out["eval_macro_stemmed"] = sql.replace(",\ngn AS", words + ",\ngn AS")
    return out
