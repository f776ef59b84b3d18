"""DuckDB oracles for the registered queries.

Each string runs on the driver's pre-registered views.  The token table is
rebuilt in SQL with the same fixture rule as the Spark side (DuckDB lists are
1-based, so positions are shifted to Spark's 0-based ``posexplode``).
"""

from __future__ import annotations

import re

from phraseforge.functions.tagging import DT_WORDS, sql_fixture_tag, sql_token_array
from phraseforge.functions.text import GOOD_POS
from phraseforge.plans.oracle_stem import stemmed_oracles

GOOD = ", ".join(f"'{t}'" for t in GOOD_POS)


def tokens_cte() -> str:
    return f"""
arr AS (SELECT doc_id, {sql_token_array('text')} AS a FROM documents),
tok AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS word FROM arr),
tokens AS (SELECT doc_id, pos, word, {sql_fixture_tag('word')} AS tag FROM tok)"""


def runs_cte() -> str:
    """W1 + F3 runs: cw (content tokens with island id), runs, cand."""
    return f"""
cw AS (SELECT doc_id, pos, word, tag, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island
       FROM tokens WHERE tag IN ({GOOD})),
runs AS (SELECT doc_id, island, min(pos) AS start, string_agg(word, ' ' ORDER BY pos) AS phrase,
                arg_max(tag, pos) AS last_tag FROM cw GROUP BY doc_id, island),
cand AS (SELECT * FROM runs WHERE last_tag <> 'JJ')"""


def tfidf_cte() -> str:
    return f"""
ndocs AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM tokens WHERE tag IN ({GOOD}) AND word <> '' GROUP BY doc_id, word),
dfreq AS (SELECT word, count(DISTINCT doc_id) AS df FROM tokens GROUP BY word),
ws AS (SELECT tf.doc_id, tf.word, tf.tf, dfreq.df, tf.tf * log2(ndocs.n / (1.0 + dfreq.df)) AS score
       FROM tf JOIN dfreq USING (word) CROSS JOIN ndocs)"""


def phrase_score_cte(word_scores: str = "ws") -> str:
    """A10 over the W1 runs, then distinct (doc_id, phrase, score)."""
    return f"""
run_scores AS (SELECT cw.doc_id, cw.island, sum(CAST(round(coalesce(s.score, 0), 9) AS DECIMAL(38, 9))) AS score
               FROM cw LEFT JOIN {word_scores} s ON cw.doc_id = s.doc_id AND cw.word = s.word
               GROUP BY cw.doc_id, cw.island),
pscore AS (SELECT c.doc_id, c.phrase, any_value(r.score) AS score
           FROM cand c JOIN run_scores r ON c.doc_id = r.doc_id AND c.island = r.island
           GROUP BY c.doc_id, c.phrase)"""


def topk(src: str, k: int, key: str = "phrase", score: str = "score", part: str = "doc_id") -> str:
    return (f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY round({score}, 9) DESC, {key} ASC) AS INTEGER) AS rank "
            f"FROM {src}) WHERE rank <= {k})")


def oracles(top_k: int = 10) -> dict[str, str]:
    tok = "WITH " + tokens_cte()
    q: dict[str, str] = {}
    q["tagged_tokens"] = tok + "\nSELECT doc_id, pos, word, tag FROM tokens"
    q["content_words"] = tok + f"\nSELECT doc_id, pos, word, tag FROM tokens WHERE tag IN ({GOOD})"
    q["candidate_phrases"] = (tok + "," + runs_cte() +
                              "\nSELECT doc_id, phrase, count(*) AS n FROM cand GROUP BY doc_id, phrase")
    q["term_frequency"] = (tok + f"\nSELECT doc_id, word, count(*) AS tf FROM tokens "
                           f"WHERE tag IN ({GOOD}) AND word <> '' GROUP BY doc_id, word")
    q["document_frequency"] = tok + "\nSELECT word, count(DISTINCT doc_id) AS df FROM tokens GROUP BY word"
    q["word_positions"] = (tok + f"\nSELECT doc_id, word, count(*) AS tf, string_agg(CAST(pos + 1 AS VARCHAR), ',' ORDER BY pos) AS positions "
                           f"FROM tokens WHERE tag IN ({GOOD}) GROUP BY doc_id, word")
    q["doc_vocab"] = (tok + f"\nSELECT doc_id, count(*) AS doc_len, count(DISTINCT CASE WHEN tag IN ({GOOD}) THEN word END) AS vocab "
                      "FROM tokens GROUP BY doc_id")
    q["tfidf_words"] = tok + "," + tfidf_cte() + "\nSELECT doc_id, word, tf, df, round(score, 6) AS score FROM ws"
    q["tfidf_phrases"] = (tok + "," + runs_cte() + "," + tfidf_cte() + "," + phrase_score_cte() +
                          f"\nSELECT doc_id, rank, phrase, CAST(round(score, 6) AS DOUBLE) AS score FROM {topk('pscore', top_k)}")
    q.update(graph_oracles(top_k=top_k))
    q.update(ngram_oracles(DT_WORDS, top_k=top_k))
    q.update(misc_oracles(DT_WORDS, top_k=top_k))
    q["page_tokens"] = """WITH
pt AS (SELECT page_id, list_filter(regexp_split_to_array(html, '[ \t\r\n]+'), lambda x: x <> '') AS toks FROM pages),
pe AS (SELECT page_id, generate_subscripts(toks, 1) AS i, unnest(toks) AS tok FROM pt),
pw AS (SELECT page_id, i,
              lower(regexp_replace(CASE WHEN contains(tok, '_') THEN regexp_extract(tok, '^(.*)_[^_]*$', 1) ELSE tok END,
                                   '^[ \t]+|[ \t]+$', '', 'g')) AS word,
              CASE WHEN contains(tok, '_') THEN regexp_extract(tok, '_([^_]*)$', 1) ELSE tok END AS tag FROM pe),
kept AS (SELECT * FROM pw WHERE NOT (length(word) >= 2 AND (starts_with(word, '<') OR ends_with(word, '>'))))
SELECT page_id AS doc_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, word, tag FROM kept"""
    q["document_lines"] = """WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[]
                         ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS lines FROM documents)
SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(list_filter(lines, lambda x: x = '')) AS INTEGER) AS n_blank FROM l"""
    q.update(format_oracles(q))
    q.update(topic_oracles(top_n=top_k))
    q.update(stemmed_oracles(q))
    q["record_numbers"] = ("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, coalesce(source, '') AS title, text AS abstract "
                           "FROM documents WHERE lang = 'en' AND text IS NOT NULL")
    q["split_sentences"] = sentences_sql()
    q["nonredundant_phrases"] = q["redundancy_filter"]
    return q


# --- graphs -----------------------------------------------------------------

def pairs_cte(name: str, window: int, nodes_only: bool = True) -> str:
    """``name(doc_id, src, dst, cnt)`` from lead() over each document."""
    if nodes_only:
        pre = (f"{name}_nodes AS (SELECT DISTINCT doc_id, word FROM tokens WHERE tag IN ({GOOD}) AND word <> ''),\n"
               f"{name}_tn AS (SELECT t.doc_id, t.pos, n.word AS nw FROM tokens t LEFT JOIN {name}_nodes n "
               f"ON t.doc_id = n.doc_id AND t.word = n.word),\n")
    else:
        pre = f"{name}_tn AS (SELECT doc_id, pos, word AS nw FROM tokens),\n"
    leads = ", ".join(f"lead(nw, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS l{k}" for k in range(1, window + 1))
    lw = f"{name}_lw AS (SELECT doc_id, nw, {leads} FROM {name}_tn),\n"
    parts = []
    for k in range(1, window + 1):
        cond = f"nw IS NOT NULL AND l{k} IS NOT NULL"
        parts.append(f"SELECT doc_id, nw AS src, l{k} AS dst FROM {name}_lw WHERE {cond}")
        parts.append(f"SELECT doc_id, l{k} AS src, nw AS dst FROM {name}_lw WHERE {cond}")
    body = " UNION ALL ".join(parts)
    return pre + lw + f"{name} AS (SELECT doc_id, src, dst, count(*) AS cnt FROM ({body}) GROUP BY doc_id, src, dst)"


def iterate_cte(ew: str, out: str, rounds: int = 20, damping: float = 0.85) -> str:
    """J3 unrolled: out0 .. out{rounds}, each one Jacobi step over ``ew(doc_id, src, dst, w, base)``."""
    parts = [f"{out}0 AS (SELECT DISTINCT doc_id, src AS word, CAST(1.0 AS DOUBLE) AS score FROM {ew})"]
    for i in range(1, rounds + 1):
        parts.append(
            f"{out}{i} AS (SELECT e.doc_id, e.dst AS word, {damping} * sum(e.w * s.score) + any_value(e.base) AS score "
            f"FROM {ew} e JOIN {out}{i - 1} s ON e.doc_id = s.doc_id AND e.src = s.word GROUP BY e.doc_id, e.dst)")
    return ",\n".join(parts)


def sr_cte(window: int) -> str:
    return (pairs_cte("edges", window) + ",\n"
            "sr_ew AS (SELECT doc_id, src, dst, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY doc_id, src) AS w, "
            "0.15 / count(*) OVER (PARTITION BY doc_id) AS base FROM edges),\n" + iterate_cte("sr_ew", "sr"))


def tr_cte(window: int) -> str:
    return (pairs_cte("edges", window) + ",\n"
            "tr_ew AS (SELECT doc_id, src, dst, 1.0 / count(*) OVER (PARTITION BY doc_id, src) AS w, "
            "0.15 AS base FROM edges),\n" + iterate_cte("tr_ew", "tr"))


def tr_select_cte(ratio: float) -> str:
    """O2 + W2 + U4 over the TextRank scores ``tr20``."""
    return f"""
vcount AS (SELECT doc_id, count(DISTINCT word) AS v FROM tokens WHERE tag IN ({GOOD}) GROUP BY doc_id),
sel AS (SELECT doc_id, word FROM (
          SELECT s.doc_id, s.word, v.v, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(s.score, 9) DESC, s.word ASC) AS r
          FROM tr20 s JOIN vcount v ON s.doc_id = v.doc_id WHERE s.score <> 0)
        WHERE r <= ceil(v * {ratio!r})),
sw AS (SELECT t.doc_id, t.pos, t.word, t.pos - row_number() OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS island
       FROM tokens t SEMI JOIN sel s ON t.doc_id = s.doc_id AND t.word = s.word),
sruns AS (SELECT doc_id, island, min(pos) AS start, string_agg(word, ' ' ORDER BY pos) AS phrase FROM sw GROUP BY doc_id, island),
firsts AS (SELECT doc_id, phrase, min(start) AS first FROM sruns GROUP BY doc_id, phrase),
fam AS (SELECT doc_id, phrase, first, regexp_replace(phrase, 's+$', '') AS root FROM firsts),
fam_levels AS (SELECT doc_id, root, list_reduce(list(length(phrase) - length(root) ORDER BY first),
                 lambda acc, l: CASE WHEN list_contains(acc, l - 1) OR list_contains(acc, l + 1) THEN acc ELSE list_append(acc, l) END,
                 []::INTEGER[]) AS kept FROM fam GROUP BY doc_id, root),
tr_kept AS (SELECT f.doc_id, f.first, f.phrase FROM fam f JOIN fam_levels k ON f.doc_id = k.doc_id AND f.root = k.root
            WHERE list_contains(k.kept, CAST(length(f.phrase) - length(f.root) AS INTEGER)))"""


def similar_cte(k: int) -> str:
    """J4 + O3 over the TF-IDF vectors ``ws``: ``nbrs(doc_id, nbr_id, sim, rank)``."""
    return f"""
vnorm AS (SELECT doc_id, sqrt(sum(score * score)) AS norm FROM ws GROUP BY doc_id),
nz AS (SELECT doc_id, word, score AS w FROM ws WHERE score <> 0),
dots AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS dot FROM nz a JOIN nz b ON a.word = b.word AND a.doc_id < b.doc_id GROUP BY 1, 2),
sims AS (SELECT d.a, d.b, CASE WHEN na.norm * nb.norm <> 0 THEN d.dot / (na.norm * nb.norm) ELSE 0.0 END AS sim
         FROM dots d JOIN vnorm na ON na.doc_id = d.a JOIN vnorm nb ON nb.doc_id = d.b),
vdocs AS (SELECT DISTINCT doc_id FROM ws),
fill AS (SELECT doc_id FROM vdocs ORDER BY doc_id LIMIT {2 * k + 1}),
cands AS (SELECT a AS doc_id, b AS nbr_id, sim FROM sims UNION ALL SELECT b, a, sim FROM sims
          UNION ALL SELECT v.doc_id, f.doc_id, 0.0 FROM vdocs v CROSS JOIN fill f WHERE v.doc_id <> f.doc_id),
nbrs AS (SELECT * FROM (SELECT doc_id, nbr_id, sim, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, nbr_id ASC) AS INTEGER) AS rank
         FROM (SELECT doc_id, nbr_id, max(sim) AS sim FROM cands GROUP BY doc_id, nbr_id)) WHERE rank <= {k})"""


def er_cte(window: int) -> str:
    """J5 + base + iteration + isolated words: ``er_ew`` and ``erscores``."""
    return (pairs_cte("edges", window) + ",\n" + pairs_cte("allp", window, nodes_only=False) + f""",
er_add AS (SELECT e.doc_id, e.src, e.dst, sum(n.sim * a.cnt) AS extra FROM edges e JOIN nbrs n ON e.doc_id = n.doc_id
           JOIN allp a ON a.doc_id = n.nbr_id AND a.src = e.src AND a.dst = e.dst GROUP BY e.doc_id, e.src, e.dst),
er_w0 AS (SELECT e.doc_id, e.src, e.dst, e.cnt + coalesce(x.extra, 0) AS w0 FROM edges e
          LEFT JOIN er_add x ON e.doc_id = x.doc_id AND e.src = x.src AND e.dst = x.dst),
er_v AS (SELECT doc_id, count(DISTINCT word) AS v FROM tokens WHERE tag IN ({GOOD}) AND word <> '' GROUP BY doc_id),
er_e AS (SELECT doc_id, count(*) AS n_edges FROM edges GROUP BY doc_id),
er_base AS (SELECT v.doc_id, 0.15 / (v.v + coalesce(e.n_edges, 0)) AS base FROM er_v v LEFT JOIN er_e e ON v.doc_id = e.doc_id),
er_ew AS (SELECT w.doc_id, w.src, w.dst,
                 CASE WHEN sum(w0) OVER (PARTITION BY w.doc_id, w.src) <> 0 THEN w0 / sum(w0) OVER (PARTITION BY w.doc_id, w.src) ELSE 0.0 END AS w,
                 b.base FROM er_w0 w JOIN er_base b ON w.doc_id = b.doc_id),
""" + iterate_cte("er_ew", "er") + f""",
er_nodes AS (SELECT DISTINCT doc_id, src AS word FROM er_ew),
er_iso AS (SELECT DISTINCT t.doc_id, t.word FROM tokens t ANTI JOIN er_nodes n ON t.doc_id = n.doc_id AND t.word = n.word
           WHERE t.tag IN ({GOOD}) AND t.word <> ''),
er_long AS (SELECT doc_id FROM tokens GROUP BY doc_id HAVING count(*) >= 2),
er_nw AS (SELECT DISTINCT t.doc_id AS nbr_id, t.word FROM tokens t SEMI JOIN er_long l ON t.doc_id = l.doc_id),
er_seen AS (SELECT DISTINCT i.doc_id, i.word FROM er_iso i JOIN nbrs n ON i.doc_id = n.doc_id
            JOIN er_nw w ON w.nbr_id = n.nbr_id AND w.word = i.word),
erscores AS (SELECT doc_id, word, score FROM er20
             UNION ALL SELECT s.doc_id, s.word, b.base AS score FROM er_seen s JOIN er_base b ON s.doc_id = b.doc_id)""")


def graph_oracles(window: int = 2, ratio: float = 1.0 / 3.0, k: int = 5, top_k: int = 10) -> dict[str, str]:
    tok = "WITH " + tokens_cte() + ",\n"
    q: dict[str, str] = {}
    q["cooccurrence_edges"] = tok + pairs_cte("edges", window) + "\nSELECT doc_id, src, dst, cnt FROM edges"
    q["edge_counts"] = tok + pairs_cte("edges", window) + "\nSELECT doc_id, count(*) AS n_edges FROM edges GROUP BY doc_id"
    q["edge_weights"] = tok + sr_cte(window) + "\nSELECT doc_id, src, dst, round(w, 6) AS w FROM sr_ew"
    q["singlerank_scores"] = tok + sr_cte(window) + "\nSELECT doc_id, word, round(score, 6) AS score FROM sr20"
    q["singlerank_phrases"] = (tok + sr_cte(window) + "," + runs_cte() + "," + phrase_score_cte("sr20") +
                               f"\nSELECT doc_id, rank, phrase, CAST(round(score, 6) AS DOUBLE) AS score FROM {topk('pscore', top_k)}")
    q["textrank_scores"] = tok + tr_cte(window) + "\nSELECT doc_id, word, round(score, 6) AS score FROM tr20"
    q["textrank_phrases"] = (tok + tr_cte(window) + "," + tr_select_cte(ratio) +
                             "\nSELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INTEGER) AS rank, phrase FROM tr_kept")
    sim = tok + tfidf_cte() + "," + similar_cte(k)
    q["similar_documents"] = sim + "\nSELECT doc_id, rank, nbr_id, round(sim, 6) AS sim FROM nbrs"
    q["expandrank_edges"] = sim + ",\n" + er_cte(window) + "\nSELECT doc_id, src, dst, round(w, 6) AS w FROM er_ew"
    q["expandrank_phrases"] = (sim + ",\n" + er_cte(window) + "," + runs_cte() + "," + phrase_score_cte("erscores") +
                               f"\nSELECT doc_id, rank, phrase, CAST(round(score, 6) AS DOUBLE) AS score FROM {topk('pscore', top_k)}")
    return q


def sentences_sql(docs: str = "documents") -> str:
    """X10 by rule: words, abbreviations, ends of sentences."""
    shape = "[A-Za-z]+([.][A-Za-z]+)*"
    return f"""WITH
sw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS ws FROM {docs}),
st AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM sw),
sb AS (SELECT lower(regexp_replace(word, '[.,;:!?]+$', '')) AS name, regexp_matches(word, '^{shape}[.]$') AS period,
              regexp_replace(word, '[.,;:!?]+$', '') AS bare FROM st),
sa AS (SELECT name FROM sb WHERE regexp_matches(bare, '^{shape}$') AND length(bare) <= 5 GROUP BY name
       HAVING count(*) FILTER (period) >= 5 AND count(*) FILTER (period) >= 4 * count(*) FILTER (NOT period)),
se AS (SELECT doc_id, pos, word, CAST(regexp_matches(word, '[.!?]["'')\\]]*$')
              AND NOT (regexp_matches(word, '^{shape}[.]$') AND lower(regexp_replace(word, '[.]$', '')) IN (SELECT name FROM sa))
              AND NOT coalesce(regexp_matches(lead(word) OVER (PARTITION BY doc_id ORDER BY pos), '^[a-z]'), false) AS INTEGER) AS ends FROM st),
sn AS (SELECT doc_id, pos, word, CAST(coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS nth FROM se)
SELECT doc_id, nth, string_agg(word, ' ' ORDER BY pos) AS sentence FROM sn GROUP BY doc_id, nth"""


# --- n-gram TF-IDF ----------------------------------------------------------

def ngram_cte(stopwords) -> str:
    """``terms(doc_id, terms)`` and ``ng(doc_id, n, term)`` for n = 1..3."""
    sw = ", ".join(f"'{w}'" for w in stopwords)
    return f"""
nw AS (SELECT doc_id, regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r \\x1C-\\x1F]+') AS ws FROM documents),
nct AS (SELECT doc_id, list_filter(list_transform(list_filter(ws, lambda x: x <> ''),
                 lambda w: lower(regexp_replace(w, '\\W+|\\d+', '', 'g'))), lambda x: x <> '') AS toks FROM nw),
nst AS (SELECT doc_id, generate_subscripts(toks, 1) AS i, unnest(toks) AS stem FROM nct),
nkept AS (SELECT stem FROM nst GROUP BY stem HAVING count(*) > 3),
ntt AS (SELECT s.doc_id, s.i, s.stem FROM nst s SEMI JOIN nkept k ON s.stem = k.stem
        WHERE length(s.stem) >= 2 AND s.stem NOT IN ({sw})),
terms AS (SELECT doc_id, list(stem ORDER BY i) AS terms FROM ntt GROUP BY doc_id),
ng AS (SELECT doc_id, 1 AS n, unnest(terms) AS term FROM terms
       UNION ALL SELECT doc_id, 2 AS n, array_to_string(list_slice(terms, s, s + 1), ' ') FROM
         (SELECT doc_id, terms, unnest(generate_series(1, len(terms) - 1)) AS s FROM terms WHERE len(terms) >= 2)
       UNION ALL SELECT doc_id, 3 AS n, array_to_string(list_slice(terms, s, s + 2), ' ') FROM
         (SELECT doc_id, terms, unnest(generate_series(1, len(terms) - 2)) AS s FROM terms WHERE len(terms) >= 3))"""


def local_tfidf_cte(n_min: int, n_max: int) -> str:
    return f"""
nn AS (SELECT count(*) AS n FROM documents),
ncnt AS (SELECT doc_id, term, count(*) AS tf FROM ng WHERE n BETWEEN {n_min} AND {n_max} GROUP BY doc_id, term),
ndf AS (SELECT term, count(*) AS df FROM ncnt GROUP BY term HAVING count(*) BETWEEN 2 AND 1000),
nw0 AS (SELECT c.doc_id, c.term, c.tf * (ln((1.0 + nn.n) / (1.0 + d.df)) + 1.0) AS w FROM ncnt c JOIN ndf d ON c.term = d.term CROSS JOIN nn),
loc AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM nw0)"""


def global_cte() -> str:
    parts = []
    for n, thr in ((1, 0.01), (2, 0.005), (3, 0.005)):
        parts.append(f"SELECT term, {n} AS n, c / (SELECT sqrt(sum(c * c)) FROM (SELECT count(*) AS c FROM ng WHERE n = {n} GROUP BY term)) AS g "
                     f"FROM (SELECT term, count(*) AS c FROM ng WHERE n = {n} GROUP BY term) WHERE g > {thr}")
    return "\ngboost AS (" + " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts) + ")"


def top_terms_sql(src: str, k: int) -> str:
    return (f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(z, 9) DESC, round(x, 9) DESC, term DESC) AS INTEGER) AS rank "
            f"FROM {src} WHERE length(term) > 2) WHERE rank <= {k})")


def ngram_oracles(stopwords, k: int = 20, gold_k: int = 5, top_k: int = 10) -> dict[str, str]:
    q: dict[str, str] = {}
    base = "WITH " + ngram_cte(stopwords)
    q["corpus_frequency"] = (base.replace("nkept AS", "nfreq AS (SELECT stem, count(*) AS n FROM nst GROUP BY stem),\nnkept AS") +
                             "\nSELECT stem, n, n > 3 AS kept FROM nfreq")
    q["surface_forms"] = base + "\nSELECT stem, array_to_string(list_sort(list_distinct(list(stem))), ',') AS forms FROM nst GROUP BY stem"
    q["ngram_counts"] = base + "\nSELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM ng GROUP BY doc_id, term"
    q["ngram_tfidf"] = (base + "," + local_tfidf_cte(1, 1) +
                        f"\nSELECT doc_id, rank, term, round(x, 6) AS x FROM {top_terms_sql('(SELECT doc_id, term, x, x AS z FROM loc)', k)}")
    q["global_ngrams"] = base + "," + global_cte() + "\nSELECT term, n, round(g, 6) AS g FROM gboost"
    boosted = ("(SELECT l.doc_id, l.term, l.x, l.x + coalesce(g.g, 0) AS z FROM loc l LEFT JOIN gboost g ON l.term = g.term)")
    q["ngram_tfidf_boosted"] = (base + "," + local_tfidf_cte(1, 3) + "," + global_cte() +
                                f"\nSELECT replace(CAST(doc_id AS VARCHAR), '\\', '_') AS file_id, rank, "
                                f"concat_ws(',', term, CAST(round(z, 4) AS VARCHAR), CAST(round(x, 4) AS VARCHAR)) AS line, "
                                f"round(z, 6) AS z, round(x, 6) AS x FROM {top_terms_sql(boosted, k)}")
    # evaluation over the fixture gold and the M0 predictions
    ev = ("WITH " + tokens_cte() + "," + runs_cte() + "," + tfidf_cte() + "," + phrase_score_cte() + f""",
cands AS (SELECT doc_id, phrase, count(*) AS n FROM cand GROUP BY doc_id, phrase),
gold AS (SELECT doc_id, phrase FROM {topk('cands', gold_k, score='n')}),
pred AS (SELECT doc_id, phrase FROM {topk('pscore', top_k)})""")
    q["eval_micro"] = ev + """,
pv AS (SELECT DISTINCT doc_id, phrase, unnest([phrase, phrase || 's', regexp_replace(phrase, 's$', '')]) AS key FROM pred),
hits AS (SELECT DISTINCT pv.doc_id, pv.phrase FROM pv SEMI JOIN gold g ON pv.doc_id = g.doc_id AND pv.key = g.phrase),
c AS (SELECT (SELECT count(*) FROM hits) AS matched, (SELECT count(*) FROM (SELECT DISTINCT doc_id, phrase FROM pred)) AS predicted,
             (SELECT count(*) FROM (SELECT DISTINCT doc_id, phrase FROM gold)) AS total_keys)
SELECT matched, predicted, total_keys,
       round(CASE WHEN predicted > 0 THEN 100.0 * matched / predicted END, 6) AS precision,
       round(CASE WHEN total_keys > 0 THEN 100.0 * matched / total_keys END, 6) AS recall,
       round(CASE WHEN matched > 0 THEN 2 * (100.0 * matched / predicted) * (100.0 * matched / total_keys)
                  / ((100.0 * matched / predicted) + (100.0 * matched / total_keys)) END, 6) AS f1 FROM c"""
    q["eval_macro"] = ev + """,
gn AS (SELECT doc_id, array_to_string(string_split(lower(phrase), ' '), ' ') AS norm FROM gold),
pn AS (SELECT DISTINCT doc_id, array_to_string(string_split(lower(phrase), ' '), ' ') AS norm FROM pred),
npred AS (SELECT doc_id, count(*) AS n_pred FROM pred GROUP BY doc_id),
hit AS (SELECT g.doc_id, count(*) AS hits FROM gn g SEMI JOIN pn p ON g.doc_id = p.doc_id AND g.norm = p.norm GROUP BY g.doc_id),
per AS (SELECT g.doc_id, least(1.0, coalesce(coalesce(h.hits, 0) / nullif(coalesce(n.n_pred, 0), 0), 0.0)) AS p,
               coalesce(h.hits, 0) / g.n_gold AS r
        FROM (SELECT doc_id, count(*) AS n_gold FROM gn GROUP BY doc_id) g
        LEFT JOIN npred n ON g.doc_id = n.doc_id LEFT JOIN hit h ON g.doc_id = h.doc_id)
SELECT count(*) AS n_docs, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS f1 FROM per"""
    q["gold_keys"] = ("WITH gl AS (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))), ' ' || chr(9))) AS phrase FROM documents)\n"
                      "SELECT DISTINCT doc_id, phrase FROM gl WHERE phrase <> ''")
    return q


def string_ids(sql: str) -> str:
    """The same SQL over documents whose ids are strings like ``D-17``."""
    body = re.sub(r"\bdocuments\b", "sdocs", sql.removeprefix("WITH "))
    return "WITH sdocs AS (SELECT 'D-' || doc_id AS doc_id, text FROM documents),\n" + body


def format_oracles(q: dict[str, str]) -> dict[str, str]:
    """Parsing of the input formats, sinks, and jobs on string ids; ``q`` holds the oracles they repeat."""
    ws = "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F]"
    strip = lambda c: f"regexp_replace({c}, '^{ws}+|{ws}+$', '', 'g')"
    line = "translate(text, chr(10) || chr(13), '  ')"
    title = "translate(string_split(text, chr(10))[1], chr(10) || chr(13), '  ')"
    three = f"array_to_string(list_slice(string_split({line}, ' '), 1, 3), ',')"
    out = {f"ids_{n}": string_ids(q[n]) for n in ("singlerank_phrases", "textrank_phrases", "similar_documents", "expandrank_phrases")}
    out["ids_nearest_keywords"] = q["nearest_keywords"].replace("SELECT vec_id, label, CAST(embedding", "SELECT 'V-' || vec_id AS vec_id, label, CAST(embedding")
    out["benchmark_records"] = f"""SELECT CAST(doc_id AS VARCHAR) AS id, {strip(title)} AS title, {strip(line)} AS abstract,
  replace({strip(three)}, ',', '|') AS controlled, CAST(len(string_split({strip(three)}, ',')) AS INTEGER) AS n_controlled, 1 AS n_uncontrolled FROM documents"""
    out["two_column_records"] = f"SELECT CAST(doc_id AS VARCHAR) AS id, {strip(line)} AS text FROM documents"
    out["textbook_records"] = f"""SELECT CAST(doc_id AS VARCHAR) AS id, {strip(title)} AS title, {strip(three)} AS concepts,
  {strip('source')} AS wikipediafiles, {strip(line)} AS text FROM documents"""
    out["tsv_records"] = ("SELECT CAST(doc_id AS VARCHAR) AS id, lower(translate(text, chr(9) || chr(10) || chr(13), '   ')) AS text "
                          "FROM documents WHERE lang = 'en'")
    out["json_records"] = "SELECT coalesce(source, '') AS title, text AS abstract, 1 AS n_controlled FROM documents WHERE lang = 'en' AND text IS NOT NULL"
    out["stopword_records"] = f"SELECT DISTINCT lower({strip('x')}) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)"
    out["title_abstract"] = "SELECT doc_id, string_split(text, chr(10))[1] || '. ' || text AS text FROM documents"
    out["phrase_sink"], out["saved_artefact"] = q["tfidf_phrases"], q["bag_of_words"]
    out["small_scores"] = q["document_frequency"].replace("SELECT word, count(DISTINCT doc_id) AS df FROM",
                                                          "SELECT word, CAST(round(count(DISTINCT doc_id) / 10000.0, 4) AS VARCHAR) AS line FROM")
    out["odd_separators"] = (q["page_tokens"].replace("FROM pages", "FROM (SELECT doc_id, replace(text, 'e', chr(133) || '_') AS html FROM documents)")
                             .replace("page_id", "doc_id"))
    return out


TOPICS, ROUNDS = 200, 10  # of lda_topics


def topics_cte(k: int, rounds: int) -> str:
    """The EM topics: ``terms(term, p*)`` after ``rounds``, one CTE per step."""
    ks = range(k)
    total = " + ".join(f"t{j} * p{j}" for j in ks)
    out = f"""
corpus AS (SELECT 'd' || doc_id AS id, string_split(text, chr(10))[1] || '. ' || text AS text FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
bow AS MATERIALIZED (SELECT id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, unnest(string_split(lower(text), ' ')) AS term FROM corpus) GROUP BY id, term),
terms0 AS MATERIALIZED (SELECT term, {", ".join(f"CAST(('0x' || substr(md5(term || '#{j}'), 1, 8)) AS BIGINT) / 4294967296.0 + 1.0 AS p{j}" for j in ks)}
  FROM (SELECT DISTINCT term FROM bow)),
docs0 AS MATERIALIZED (SELECT DISTINCT id, {", ".join(f"1.0::DOUBLE AS t{j}" for j in ks)} FROM bow)"""
    for i in range(1, rounds + 1):
        out += f""",
shares{i} AS MATERIALIZED (SELECT id, term, {", ".join(f"n * t{j} * p{j} / ({total}) AS r{j}" for j in ks)}
  FROM bow JOIN terms{i - 1} USING (term) JOIN docs{i - 1} USING (id)),
docs{i} AS MATERIALIZED (SELECT id, {", ".join(f"sum(r{j}) + 0.1 AS t{j}" for j in ks)} FROM shares{i} GROUP BY id),
counts{i} AS MATERIALIZED (SELECT term, {", ".join(f"sum(r{j}) + 0.01 AS c{j}" for j in ks)} FROM shares{i} GROUP BY term),
terms{i} AS MATERIALIZED (SELECT term, {", ".join(f"c{j} / sum(c{j}) OVER () AS p{j}" for j in ks)} FROM counts{i})"""
    return out


def all_topics(k: int, rounds: int) -> str:
    """The EM topics of the whole job: as :func:`topics_cte`, an entry's sum over the topics written once."""
    ks = range(k)
    out = topics_cte(k, 0)
    for i in range(1, rounds + 1):
        out += f""",
shares{i} AS MATERIALIZED (SELECT id, term, {", ".join(f"n * x{j} / total AS r{j}" for j in ks)}
  FROM (SELECT id, term, n, {", ".join(f"x{j}" for j in ks)}, {" + ".join(f"x{j}" for j in ks)} AS total
    FROM (SELECT id, term, n, {", ".join(f"t{j} * p{j} AS x{j}" for j in ks)} FROM bow JOIN terms{i - 1} USING (term) JOIN docs{i - 1} USING (id)))),
docs{i} AS MATERIALIZED (SELECT id, {", ".join(f"sum(r{j}) + 0.1 AS t{j}" for j in ks)} FROM shares{i} GROUP BY id),
counts{i} AS MATERIALIZED (SELECT term, {", ".join(f"sum(r{j}) + 0.01 AS c{j}" for j in ks)} FROM shares{i} GROUP BY term),
terms{i} AS MATERIALIZED (SELECT term, {", ".join(f"c{j} / z{j} AS p{j}" for j in ks)} FROM counts{i}, (SELECT {", ".join(f"sum(c{j}) AS z{j}" for j in ks)} FROM counts{i}))"""
    return f"WITH {out}\nSELECT term, {', '.join(f'round(p{j} * 1e6, 4) AS p{j}' for j in ks)} FROM terms{rounds}"


def topic_oracles(k: int = 4, rounds: int = 2, gold_k: int = 5, top_n: int = 10) -> dict[str, str]:
    ks = range(k)
    topics = topics_cte(k, rounds)
    q = {"lda_topics": all_topics(TOPICS, ROUNDS)}
    total = " + ".join(f"p{j}" for j in ks)
    whole = " + ".join(f"r{j}" for j in ks)

    def fold(name: str, bow: str) -> str:
        return f"""
{name} AS (SELECT id, [{", ".join(f"CASE WHEN r{j} / ({whole}) < 0.01 THEN 0.0 ELSE r{j} / ({whole}) END" for j in ks)}] AS v
  FROM (SELECT id, {", ".join(f"sum(n * p{j} / ({total})) AS r{j}" for j in ks)} FROM {bow} JOIN terms{rounds} USING (term) GROUP BY id))"""

    q["lda_macro"] = "WITH " + tokens_cte() + "," + runs_cte() + f""",
cands AS (SELECT doc_id, phrase, count(*) AS n FROM cand GROUP BY doc_id, phrase),
gold AS MATERIALIZED {topk('cands', gold_k, score='n')},
kbow AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, unnest(string_split(lower(id), ' ')) AS term FROM (SELECT DISTINCT phrase AS id FROM gold)) GROUP BY id, term),
tbow AS (SELECT doc_id AS id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents) GROUP BY doc_id, term),
{topics},{fold('kv', 'kbow')},{fold('dv', 'tbow')},
dist AS (SELECT d.id AS doc_id, k.id AS keyword,
  1.0 - list_dot_product(d.v, k.v) / (sqrt(list_dot_product(d.v, d.v)) * sqrt(list_dot_product(k.v, k.v))) AS x FROM dv d CROSS JOIN kv k),
pred AS (SELECT doc_id, lower(keyword) AS norm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(x, 9), keyword) AS r FROM dist) WHERE r <= {top_n}),
per AS (SELECT g.doc_id, count(*) AS n_gold, count(p.norm) AS hits FROM gold g
  LEFT JOIN (SELECT DISTINCT doc_id, norm FROM pred) p ON g.doc_id = p.doc_id AND lower(g.phrase) = p.norm GROUP BY g.doc_id),
np AS (SELECT doc_id, count(*) AS n_pred FROM pred GROUP BY doc_id),
pr AS (SELECT least(1.0, coalesce(hits / n_pred, 0.0)) AS p, hits / n_gold AS r FROM per LEFT JOIN np USING (doc_id))
SELECT count(*) AS n_docs, round(avg(p), 4) AS precision, round(avg(r), 4) AS recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 4) AS f1 FROM pr"""
    return q


# --- dictionary, positions, text functions, sets, vectors ---------------------

WS = "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F]+"


def _punct_sql() -> str:
    from phraseforge.functions.text import PUNCTUATION
    return PUNCTUATION.replace("'", "''")


def misc_oracles(stopwords, gold_k: int = 5, top_k: int = 10, nearest: int = 3) -> dict[str, str]:
    sw = ", ".join(f"'{w}'" for w in stopwords)
    pu = _punct_sql()
    q: dict[str, str] = {}
    grams = lambda src, col: (  # noqa: E731  1..3-grams of list column `col` as (…, s0, n, g)
        f"SELECT *, s - 1 AS s0, 1 AS n, t1 AS g FROM (SELECT *, generate_subscripts({col}, 1) AS s, unnest({col}) AS t1 FROM {src})\n"
        f"UNION ALL SELECT *, s - 1, 2, array_to_string(list_slice({col}, s, s + 1), ' ') FROM "
        f"(SELECT *, unnest(generate_series(1, len({col}) - 1)) AS s, NULL AS t1 FROM {src} WHERE len({col}) >= 2)\n"
        f"UNION ALL SELECT *, s - 1, 3, array_to_string(list_slice({col}, s, s + 2), ' ') FROM "
        f"(SELECT *, unnest(generate_series(1, len({col}) - 2)) AS s, NULL AS t1 FROM {src} WHERE len({col}) >= 3)")
    q["dictionary_matches"] = f"""WITH
bt AS (SELECT list_filter(regexp_split_to_array(translate(lower(text), '{pu}', ''), '{WS}'), lambda x: x <> '') AS t FROM benchmark),
blines AS (SELECT g AS line FROM ({grams('bt', 't')})),
dict AS (SELECT DISTINCT array_to_string(list_transform(toks, lambda w: CASE WHEN length(w) > 2
             THEN regexp_replace(w, '[^\\x09-\\x0D\\x20-\\x7E]', '', 'g') ELSE w END), ' ') AS phrase
         FROM (SELECT list_filter(regexp_split_to_array(lower(line), '{WS}'), lambda x: x <> '') AS toks FROM blines
               WHERE lower(line) NOT IN ({sw})) WHERE len(toks) > 0),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(text), '{pu}', ''), '{WS}'), lambda x: x <> '') AS t FROM documents),
dpos AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS term FROM dw),
dterms AS (SELECT doc_id, list(term ORDER BY i) AS terms FROM dpos WHERE term NOT IN ({sw}) GROUP BY doc_id),
dg AS ({grams('dterms', 'terms')})
SELECT doc_id, n, CAST(s0 AS INTEGER) AS pos, g AS phrase FROM dg SEMI JOIN dict ON dg.g = dict.phrase"""
    tok = sql_token_array("text")
    q["phrase_positions"] = f"""WITH
dt AS (SELECT doc_id, {tok} AS t FROM documents),
bt AS (SELECT item_id, {tok} AS p FROM benchmark WHERE len({tok}) > 0),
dpos AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS tok FROM dt),
cand AS (SELECT d.doc_id, d.i, b.item_id FROM dpos d JOIN bt b ON d.tok = b.p[1])
SELECT c.doc_id, c.item_id, CAST(c.i - 1 AS INTEGER) AS pos FROM cand c JOIN dt ON c.doc_id = dt.doc_id JOIN bt ON c.item_id = bt.item_id
WHERE list_slice(dt.t, c.i, c.i + len(bt.p) - 1) = bt.p"""
    inside = "WITH " + tokens_cte() + "," + runs_cte() + """,
cands AS (SELECT doc_id, phrase, string_split(phrase, ' ') AS t FROM (SELECT DISTINCT doc_id, phrase FROM cand)),
cpos AS (SELECT doc_id, phrase, len(t) AS n, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM cands WHERE len(t) >= 2),
pair AS (SELECT a.doc_id, a.phrase, a.i, a.n, a.w || ' ' || b.w AS w2 FROM cpos a JOIN cpos b
         ON a.doc_id = b.doc_id AND a.phrase = b.phrase AND b.i = a.i + 1),
single AS (SELECT DISTINCT c.doc_id, c.phrase FROM cands c SEMI JOIN cpos p ON c.doc_id = p.doc_id AND c.phrase = p.w WHERE len(c.t) = 1),
near AS (SELECT c.doc_id, c.phrase, c.t, p.phrase AS other, p.i FROM cands c JOIN pair p
         ON c.doc_id = p.doc_id AND c.t[1] || ' ' || c.t[2] = p.w2 WHERE len(c.t) >= 2 AND c.phrase <> p.phrase AND len(c.t) <= p.n - p.i + 1),
multi AS (SELECT DISTINCT n.doc_id, n.phrase FROM near n JOIN cands o ON n.doc_id = o.doc_id AND n.other = o.phrase
          WHERE list_slice(o.t, n.i, n.i + len(n.t) - 1) = n.t)
"""
    q["redundancy_filter"] = inside + """SELECT doc_id, phrase FROM cands ANTI JOIN (SELECT * FROM single UNION ALL SELECT * FROM multi) r USING (doc_id, phrase)"""
    q["in_chunk"] = inside + "SELECT doc_id, phrase FROM multi"
    q["ascii_filter"] = "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS is_ascii FROM documents"
    wsc = "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F]"
    q["text_normalise"] = f"""SELECT doc_id,
  regexp_replace(text, '^{wsc}+|{wsc}+$', '', 'g') AS stripped,
  regexp_replace(lower(text), '\\W+|\\d+', '', 'g') AS no_symbols,
  translate(lower(text), '{pu}', '') AS no_punct,
  regexp_replace(text, '[^\\x09-\\x0D\\x20-\\x7E]', '', 'g') AS printable,
  regexp_replace(text, ' +', ' ', 'g') AS collapsed,
  array_to_string(list_transform(string_split(lower(text), ' '), lambda x: regexp_replace(x, '\\W+|\\d+', '', 'g')), ' ') AS normalised
FROM documents"""
    q["bag_of_words"] = ("SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term "
                         "FROM documents) GROUP BY doc_id, term")
    q["corpus_union"] = ("SELECT 'documents' AS corpus, doc_id AS id, CAST(0 AS BIGINT) AS part, text FROM documents\n"
                         "UNION ALL SELECT 'pages', page_id, CAST(0 AS BIGINT), html FROM pages\n"
                         "UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations")
    phrases = "WITH " + tokens_cte() + "," + runs_cte()
    q["distinct_keywords"] = phrases + "\nSELECT DISTINCT phrase FROM cand"
    q["gold_alternatives"] = string_ids(phrases + """,
cands AS (SELECT doc_id, phrase, count(*) AS n FROM cand GROUP BY doc_id, phrase),
gold AS (SELECT doc_id, phrase, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, phrase) - 1 AS INTEGER) AS key_pos FROM cands)
SELECT doc_id, key_pos, 0 AS alt_pos, phrase FROM gold
UNION ALL SELECT doc_id, key_pos, 1, phrase || 's' FROM gold""")
    q["nearest_keywords"] = f"""WITH
emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
comp AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM emb),
cent AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM comp GROUP BY label, i) GROUP BY label),
d AS (SELECT e.vec_id, c.label, 1.0 - list_dot_product(e.v, c.c) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.c, c.c))) AS dist
      FROM emb e CROSS JOIN cent c WHERE list_dot_product(e.v, e.v) > 0 AND list_dot_product(c.c, c.c) > 0)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, round(dist, 6) AS dist FROM
  (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), label) AS rank FROM d) WHERE rank <= {nearest}"""
    return q
