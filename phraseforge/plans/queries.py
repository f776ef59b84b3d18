"""The registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Job parameters (the reference reads them from parameter files that ship
blank) are fixed here as keyword defaults.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseforge.functions.tagging import DT_WORDS
from phraseforge.functions import tagging as TG
from phraseforge.functions import text as X
from phraseforge.operators import blocks as B
from phraseforge.operators import dictionary as D
from phraseforge.operators import evaluate as V
from phraseforge.operators import graph as G
from phraseforge.operators import ngrams as N
from phraseforge.operators import sentences as SE
from phraseforge.operators import similarity as S
from phraseforge.operators import tfidf as T
from phraseforge.operators import tokens as K
from phraseforge.operators import topics as TP
from phraseforge.functions import stem as ST
from phraseforge.session import checkpoint_dir, materialize
from phraseforge.sources import readers as RD
from phraseforge.sources import sinks as SK
from phraseforge.sources.tables import table

# --- fixed job parameters ---------------------------------------------------
TOP_K = 10          # phrases per document (M0, M2, M3)
WINDOW = 2          # co-occurrence window (M1-M3)
RATIO = 1.0 / 3.0   # TextRank selection ratio (M1)
NEIGHBOURS = 5      # ExpandRank neighbour count (M3, M10)
GOLD_PER_DOC = 5    # fixture gold of the evaluation jobs only: most frequent candidate phrases per doc (M7, M8)
NGRAM_TOP_K = 20    # terms per document (M4)
NEAREST_N = 3       # nearest keyword vectors per vector (O5)
# ----------------------------------------------------------------------------

R = 6  # decimals kept in compared doubles


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _string_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents under ids like ``D-17``, the kind that file readers give."""
    return _docs(spark, sf_dir).select(F.concat(F.lit("D-"), "doc_id").alias("doc_id"), "text")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tokens_from_text(_docs(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.texts_by_document(_docs(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.token_rows(_texts(spark, sf_dir))


def q_tagged_tokens(spark, sf_dir):
    """Fixture tokens written as ``word_TAG`` text and parsed back."""
    return K.parse_tagged(K.tagged_texts(_docs(spark, sf_dir)), dealt=True)


def q_content_words(spark, sf_dir):
    return K.content_words(_tokens(spark, sf_dir))


def q_candidate_phrases(spark, sf_dir):
    return K.candidate_phrases(_tokens(spark, sf_dir))


def q_term_frequency(spark, sf_dir):
    return T.term_frequency(_tokens(spark, sf_dir))


def q_document_frequency(spark, sf_dir):
    return T.document_frequency(_tokens(spark, sf_dir))


def q_word_positions(spark, sf_dir):
    wp = K.word_positions(_tokens(spark, sf_dir))
    return wp.select("doc_id", "word", "tf", F.array_join("positions", ",").alias("positions"))


def q_doc_vocab(spark, sf_dir):
    return K.doc_vocab(_tokens(spark, sf_dir))


def q_tfidf_words(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    w = T.tfidf_words(K.tokens_from_text(docs), T.n_docs(docs))
    return w.select("doc_id", "word", "tf", "df", F.round("score", R).alias("score"))


def q_tfidf_phrases(spark, sf_dir, k: int = TOP_K):
    docs = _docs(spark, sf_dir)
    p = T.tfidf_phrases(docs, T.n_docs(docs), k)
    return p.select("doc_id", "rank", "phrase", F.round("score", R).cast("double").alias("score"))


def q_cooccurrence_edges(spark, sf_dir, window: int = WINDOW):
    """Ordered co-occurrence counts between graph nodes."""
    return G.edge_rows(_rows(spark, sf_dir), window, "cnt")


def q_edge_counts(spark, sf_dir, window: int = WINDOW):
    """Distinct directed edges per document."""
    return G.edge_count_rows(_rows(spark, sf_dir), window)


def q_edge_weights(spark, sf_dir, window: int = WINDOW):
    """Row-normalised SingleRank weights."""
    e = G.edge_rows(_rows(spark, sf_dir), window, "w")
    return e.select("doc_id", "src", "dst", F.round("w", R).alias("w"))


def q_singlerank_scores(spark, sf_dir, window: int = WINDOW):
    s = G.singlerank_scores(_texts(spark, sf_dir), window)
    return s.select("doc_id", "word", F.round("score", R).alias("score"))


def q_singlerank_phrases(spark, sf_dir, window: int = WINDOW, k: int = TOP_K):
    p = G.singlerank_phrases(_texts(spark, sf_dir), window, k)
    return p.select("doc_id", "rank", "phrase", F.round("score", R).cast("double").alias("score"))


def q_textrank_scores(spark, sf_dir, window: int = WINDOW):
    s = G.textrank_scores(_texts(spark, sf_dir), window)
    return s.select("doc_id", "word", F.round("score", R).alias("score"))


def q_textrank_phrases(spark, sf_dir, window: int = WINDOW, ratio: float = RATIO):
    return G.textrank_phrases(_texts(spark, sf_dir), window, ratio)


def _neighbours(docs, k: int):
    return S.similar_documents(S.tfidf_blocks(docs.select("doc_id", "text"), T.n_docs(docs)), k)


def q_similar_documents(spark, sf_dir, k: int = NEIGHBOURS):
    """K nearest documents by TF-IDF cosine."""
    nb = _neighbours(_docs(spark, sf_dir), k)
    return nb.select("doc_id", "rank", "nbr_id", F.round("sim", R).alias("sim"))


def q_expandrank_edges(spark, sf_dir, window: int = WINDOW, k: int = NEIGHBOURS):
    """Own graph plus neighbour-weighted pair counts, normalised."""
    nb = _neighbours(_docs(spark, sf_dir), k)
    e = G.expandrank_edge_rows(G.expandrank_rows(_texts(spark, sf_dir), nb), window)
    return e.select("doc_id", "src", "dst", F.round("w", R).alias("w"))


def q_expandrank_phrases(spark, sf_dir, window: int = WINDOW, k: int = NEIGHBOURS, top: int = TOP_K):
    nb = _neighbours(_docs(spark, sf_dir), k)
    p = G.expandrank_phrases(_texts(spark, sf_dir), nb, window, top)
    return p.select("doc_id", "rank", "phrase", F.round("score", R).cast("double").alias("score"))


def _stopwords(spark):
    """Stopword table for the n-gram jobs: the fixture's fixed DT word list."""
    return spark.createDataFrame([(w,) for w in DT_WORDS], "word string")


def q_corpus_frequency(spark, sf_dir):
    """A3 + F6: corpus-wide stem counts and the > 3 filter."""
    return N.corpus_frequency(_docs(spark, sf_dir))


def q_surface_forms(spark, sf_dir):
    """A4: tokens per stem."""
    f = N.surface_forms(_docs(spark, sf_dir))
    return f.select("stem", F.array_join("forms", ",").alias("forms"))


def q_ngram_counts(spark, sf_dir):
    """1- to 3-gram counts per document after F5/F6."""
    terms = N.term_tokens(_docs(spark, sf_dir), _stopwords(spark))
    return N.ngram_counts(terms, 1, 3)


def q_ngram_tfidf(spark, sf_dir, k: int = NGRAM_TOP_K):
    """M4 as the reference's main call: 1-grams, no boost, top 20."""
    t = N.ngram_tfidf(_docs(spark, sf_dir), 1, 1, _stopwords(spark), top_k=k)
    return t.select("doc_id", "rank", "term", F.round("x", R).alias("x"))


def q_global_ngrams(spark, sf_dir):
    """O6 + F8: corpus-level n-gram scores above their thresholds."""
    g = N.global_ngrams(_docs(spark, sf_dir), _stopwords(spark))
    return g.select("term", "n", F.round("g", R).alias("g"))


def q_ngram_tfidf_boosted(spark, sf_dir, k: int = NGRAM_TOP_K):
    """J9 + O4 + F9 + K2: 1- to 3-grams plus the global boost, written as lines."""
    docs, sw = _docs(spark, sf_dir), _stopwords(spark)
    t = materialize(N.boosted_top_terms(docs, 1, 3, k, sw))  # read by the lines and by their join
    lines = N.scored_term_lines(t)
    return lines.join(t.select(F.col("doc_id").cast("string").alias("file_id"), "rank",
                               F.round("z", R).alias("z"), F.round("x", R).alias("x")), ["file_id", "rank"])


def _fixture_gold_and_pred(spark, sf_dir):
    """Fixture gold: each document's 5 most frequent candidate phrases (ties by
    phrase); predictions: the top-10 TF-IDF phrases (M0)."""
    docs = _docs(spark, sf_dir)
    gold = B.candidate_counts(_rows(spark, sf_dir), GOLD_PER_DOC).select("doc_id", "phrase")
    pred = T.tfidf_phrases(docs, T.n_docs(docs), TOP_K).select("doc_id", "phrase")
    return gold, pred


def q_eval_micro(spark, sf_dir):
    gold, pred = map(materialize, _fixture_gold_and_pred(spark, sf_dir))  # read by several branches
    m = V.micro_scores(pred, gold)
    return m.select("matched", "predicted", "total_keys",
                    *[F.round(c, R).alias(c) for c in ("precision", "recall", "f1")])


def q_eval_macro(spark, sf_dir):
    gold, pred = map(materialize, _fixture_gold_and_pred(spark, sf_dir))  # read by several branches
    m = V.macro_scores(pred, gold)
    return m.select("n_docs", *[F.round(c, R).alias(c) for c in ("precision", "recall", "f1")])


def q_eval_macro_stemmed(spark, sf_dir):
    """M8 with stems (J7, X11), the reference's default."""
    gold, pred = map(materialize, _fixture_gold_and_pred(spark, sf_dir))  # read by several branches
    m = V.macro_scores(pred, gold, stem=True)
    return m.select("n_docs", *[F.round(c, R).alias(c) for c in ("precision", "recall", "f1")])


def q_gold_keys(spark, sf_dir):
    """S3 + U3: every text line read as a gold keyphrase line."""
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return V.gold_from_lines(lines)


def q_dictionary_matches(spark, sf_dir):
    """Document 1-3-grams found in a dictionary made of the 1-3-grams
    of ``benchmark.text`` (read through the S10 line rules)."""
    sw = _stopwords(spark)
    bench = table(spark, sf_dir, "benchmark")
    btoks = X.split_nonempty(X.delete_punctuation(F.lower("text")), N.WHITESPACE)
    lines = bench.select(F.explode(X.ngrams(btoks, 1, 3)).alias("line"))
    return D.dictionary_matches(_docs(spark, sf_dir), D.dictionary_phrases(lines, sw), sw)


def q_phrase_positions(spark, sf_dir):
    """Every position where a benchmark passage's tokens occur in a document."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("tid"), TG.token_array("text").alias("toks"))
    pats = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), TG.token_array("text").alias("ptoks"))
    m = D.contiguous_matches(docs, pats)
    return m.select(F.col("tid").alias("doc_id"), F.col("pid").alias("item_id"), "pos")


def q_redundancy_filter(spark, sf_dir):
    """Candidate phrases not contained in another candidate of the document."""
    return D.redundancy_filter(B.candidate_lists(_rows(spark, sf_dir)))


def q_ascii_filter(spark, sf_dir):
    """is the document text pure ASCII."""
    return _docs(spark, sf_dir).select("doc_id", X.is_ascii("text").alias("is_ascii"))


def q_text_normalise(spark, sf_dir):
    """X2 / X5-X8 / X11 over whole texts."""
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id",
        X.py_strip(t).alias("stripped"),
        X.strip_symbols_digits(F.lower(t)).alias("no_symbols"),
        X.delete_punctuation(F.lower(t)).alias("no_punct"),
        X.printable_only(t).alias("printable"),
        X.collapse_spaces(t).alias("collapsed"),
        F.array_join(X.normalise_text(t, clean=True), " ").alias("normalised"),
    )


def q_sentences(spark, sf_dir):
    """Sentence split (JVM BreakIterator) -> words per sentence."""
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.sentences("text")).alias("sent", "words"))
    return s.select("doc_id", "sent", F.size("words").alias("n_words"))


def q_bag_of_words(spark, sf_dir):
    """Term counts of the X11 tokens (lower-case, split on single spaces)."""
    t = _docs(spark, sf_dir).select("doc_id", F.explode(X.normalise_text(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def q_corpus_union(spark, sf_dir):
    """Bag union of three corpora (no distinct)."""
    d = _docs(spark, sf_dir).select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"),
                                    F.lit(0).cast("bigint").alias("part"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("corpus"), F.col("page_id").alias("id"),
                                             F.lit(0).cast("bigint").alias("part"), F.col("html").alias("text"))
    c = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("corpus"), F.col("conv_id").alias("id"),
                                                     F.col("turn").alias("part"), "text")
    return V.corpus_union([d, p, c])


def q_distinct_keywords(spark, sf_dir):
    """Distinct keywords over all documents (all candidate phrases)."""
    return K.candidate_runs(_tokens(spark, sf_dir)).select("phrase").distinct()


def q_gold_alternatives(spark, sf_dir):
    """``ID : k1,k2,a+b`` lines (built from all candidate phrases, each key
    with its plural as an accepted alternative) parsed back into rows; ids like
    ``D-17``."""
    lists = B.candidate_lists(K.token_rows(K.texts_by_document(_string_docs(spark, sf_dir))))
    keys = F.transform("phrases", lambda p: F.concat(p, F.lit("+"), p, F.lit("s")))
    lines = lists.select("doc_id", F.concat("doc_id", F.lit(" : "), F.array_join(keys, ",")).alias("line"))
    return V.parse_stemmed_gold(lines)


def q_nearest_keywords(spark, sf_dir, n: int = NEAREST_N):
    """Each embedding's nearest label centroids by cosine distance."""
    emb = table(spark, sf_dir, "embeddings")
    kw = S.centroids(emb.select(F.col("label").alias("keyword"), F.col("embedding").alias("vec")), "keyword", "vec")
    nk = S.nearest_keywords(emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), kw, n)
    return nk.select(F.col("doc_id").alias("vec_id"), "rank", F.col("keyword").alias("label"), F.round("dist", R).alias("dist"))


def q_split_sentences(spark, sf_dir):
    """X10 by rule: sentences of every text, abbreviations learned from all of them."""
    return SE.split_sentences(_docs(spark, sf_dir))


def q_stem_vocabulary(spark, sf_dir):
    """The corpus vocabulary (cleaned tokens of the n-gram pipeline) and its stems."""
    toks = N.clean_tokens(_docs(spark, sf_dir)).select(F.explode("toks").alias("token"))
    return ST.stem_vocabulary(toks)


def q_lda_keywords(spark, sf_dir):
    """M5 at K = 200: topics of the training texts (four of five documents by a hash of
    the id, and every conversation turn twice), and for each held-out document its 10
    nearest of all distinct keywords (all candidate phrases)."""
    train, _ = _topic_corpora(spark, sf_dir)
    docs = _docs(spark, sf_dir).select("doc_id", TP.title_abstract(F.substring_index("text", "\n", 1), "text").alias("text"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    train = train.join(docs.where(held_out).select(F.concat(F.lit("d"), "doc_id").alias("id")), "id", "left_anti")
    keywords = K.candidate_runs(_tokens(spark, sf_dir)).select("doc_id", "phrase")
    return TP.lda_keywords(train.withColumnRenamed("id", "doc_id"), docs.where(held_out), keywords)


EM_TOPICS, EM_ROUNDS = 4, 2  # of lda_macro, whose SQL holds them; lda_topics has the job's TP.TOPICS and TP.ROUNDS


def _topic_corpora(spark, sf_dir):
    """Training texts: title and abstract of every document, and every conversation
    turn twice (the reference adds its validation corpus twice); test texts: the documents."""
    docs = _docs(spark, sf_dir)
    d = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"),
                    F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"))
    d = d.select("id", TP.title_abstract().alias("text"))
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return V.corpus_union([d, c], repeat={1: 2}), docs.select(F.col("doc_id").alias("id"), "text")


def q_lda_topics(spark, sf_dir, k: int = TP.TOPICS, rounds: int = TP.ROUNDS):
    """Topic weights of every term, the model kept as a table."""
    terms, _ = TP.em_topics(_topic_corpora(spark, sf_dir)[0], k, rounds)
    return terms.select("term", *[F.round(F.col(f"p{j}") * 1e6, 4).alias(f"p{j}") for j in range(k)])


def q_lda_macro(spark, sf_dir, k: int = EM_TOPICS, rounds: int = EM_ROUNDS):
    """M5 end to end: topics, each document's 10 nearest keywords, macro scores against the gold."""
    train, test = _topic_corpora(spark, sf_dir)
    gold = materialize(_fixture_gold_and_pred(spark, sf_dir)[0])
    near = TP.em_keywords(train, test, gold.select(F.col("phrase").alias("keyword")).distinct(), k, rounds)
    m = V.macro_scores(near.select("doc_id", F.col("keyword").alias("phrase")), gold)
    return m.select("n_docs", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def q_page_tokens(spark, sf_dir):
    """S1 / F2 on raw markup: ``pages.html`` read as tagged text (tokens without
    '_' keep word = tag); markup words take no position."""
    return K.parse_tagged(table(spark, sf_dir, "pages"), id_col="page_id", text_col="html")


# --- ids of any type ---------------------------------------------------------

def q_ids_singlerank_phrases(spark, sf_dir, window: int = WINDOW, k: int = TOP_K):
    p = G.singlerank_phrases(K.texts_by_document(_string_docs(spark, sf_dir)), window, k)
    return p.select("doc_id", "rank", "phrase", F.round("score", R).cast("double").alias("score"))


def q_ids_textrank_phrases(spark, sf_dir, window: int = WINDOW, ratio: float = RATIO):
    return G.textrank_phrases(K.texts_by_document(_string_docs(spark, sf_dir)), window, ratio)


def q_ids_similar_documents(spark, sf_dir, k: int = NEIGHBOURS):
    nb = _neighbours(_string_docs(spark, sf_dir), k)
    return nb.select("doc_id", "rank", "nbr_id", F.round("sim", R).alias("sim"))


def q_ids_expandrank_phrases(spark, sf_dir, window: int = WINDOW, k: int = NEIGHBOURS, top: int = TOP_K):
    docs = _string_docs(spark, sf_dir)
    p = G.expandrank_phrases(K.texts_by_document(docs), _neighbours(docs, k), window, top)
    return p.select("doc_id", "rank", "phrase", F.round("score", R).cast("double").alias("score"))


def q_ids_nearest_keywords(spark, sf_dir, n: int = NEAREST_N):
    emb = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.concat(F.lit("V-"), "vec_id"))
    kw = S.centroids(emb.select(F.col("label").alias("keyword"), F.col("embedding").alias("vec")), "keyword", "vec")
    nk = S.nearest_keywords(emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), kw, n, per_block=300)
    return nk.select(F.col("doc_id").alias("vec_id"), "rank", F.col("keyword").alias("label"), F.round("dist", R).alias("dist"))


# --- parsing of the input formats, on strings built from the documents ---------

def _one_line(c) -> F.Column:
    return F.translate(c, "\n\r", "  ")


def _quoted(c) -> F.Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _title() -> F.Column:
    return _one_line(F.substring_index("text", "\n", 1))


def _three_words() -> F.Column:
    return F.array_join(F.slice(F.split(_one_line(F.col("text")), " "), 1, 3), ",")


def q_benchmark_records(spark, sf_dir):
    """Quoted five-column records."""
    body = F.concat(F.lit(" "), _one_line(F.col("text")), F.lit(" "))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), _quoted(_title()), _quoted(body), _quoted(_three_words()), F.lit('""'))
    r = RD.benchmark_records(_docs(spark, sf_dir).select(line.alias("line")))
    return r.select("id", "title", "abstract", F.array_join("controlled", "|").alias("controlled"),
                    F.size("controlled").alias("n_controlled"), F.size("uncontrolled").alias("n_uncontrolled"))


def q_two_column_records(spark, sf_dir):
    """``id,text`` records."""
    line = F.concat_ws(",", F.col("doc_id").cast("string"), _quoted(_one_line(F.col("text"))))
    return RD.two_column_records(_docs(spark, sf_dir).select(line.alias("line")))


def q_textbook_records(spark, sf_dir):
    """Five-column records without a header."""
    line = F.concat_ws(",", F.col("doc_id").cast("string"), _quoted(_title()), _quoted(_three_words()),
                       F.concat(F.lit(" "), "source", F.lit(" ")), _quoted(_one_line(F.col("text"))))
    return RD.textbook_records(_docs(spark, sf_dir).select(line.alias("line")))


def q_tsv_records(spark, sf_dir):
    """Tab-separated lines; those without a tab (here: other than English) are rejected."""
    tab = F.when(F.col("lang") == "en", F.lit("\t")).otherwise(F.lit(" "))
    line = F.concat(F.col("doc_id").cast("string"), tab, _one_line(F.translate("text", "\t", " ")))
    return RD.tsv_records(_docs(spark, sf_dir).select(line.alias("line")))


def q_json_records(spark, sf_dir):
    """S8 + F10: JSON records, of which only those with an ``abstract`` (here: the English) stay."""
    line = F.to_json(F.struct(F.col("source").alias("title"), F.when(F.col("lang") == "en", F.col("text")).alias("abstract")))
    r = RD.json_records(_docs(spark, sf_dir).select(line.alias("line")))
    return r.select("title", "abstract", F.size("controlled").alias("n_controlled"))


def q_record_numbers(spark, sf_dir):
    """The kept JSON records numbered 0, 1, ... in the order of their documents."""
    docs = _docs(spark, sf_dir)
    line = F.to_json(F.struct(F.col("source").alias("title"), F.when(F.col("lang") == "en", F.col("text")).alias("abstract")))
    r = RD.json_records(docs.select("doc_id", line.alias("line")), by=["doc_id"])
    return r.select("id", "title", "abstract")


def q_stopword_records(spark, sf_dir):
    """Every line of every text read as a stopword line."""
    return RD.stopword_records(_docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line")))


def q_title_abstract(spark, sf_dir):
    """First line and whole text joined as title and abstract."""
    d = _docs(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"))
    return d.select("doc_id", TP.title_abstract().alias("text"))


def _shared_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_phrase_sink(spark, sf_dir):
    """K1: the TF-IDF phrases written to the shared folder and read back."""
    path = _shared_folder(spark, "phrases")
    SK.write_phrases(q_tfidf_phrases(spark, sf_dir), path)
    return spark.read.parquet(path)


def q_saved_artefact(spark, sf_dir):
    """K3: the bag of words saved to the shared folder and read back."""
    return SK.save_artefact(q_bag_of_words(spark, sf_dir), _shared_folder(spark, "bag"))


def q_small_scores(spark, sf_dir):
    """Document frequencies as small numbers, written without an exponent."""
    df = T.document_frequency(_tokens(spark, sf_dir))
    return df.select("word", N.plain_number(F.col("df") / 10000.0).alias("line"))


def q_odd_separators(spark, sf_dir):
    """S1 on tokens that hold U+0085 and several underscores."""
    text = F.replace("text", F.lit("e"), F.lit("\u0085_"))
    return K.parse_tagged(_docs(spark, sf_dir).select("doc_id", text.alias("text")))


def q_in_chunk(spark, sf_dir):
    """J10 (``isInChunk``): candidate phrases that another candidate of the document holds."""
    return D.in_chunk(B.candidate_lists(_rows(spark, sf_dir)))


# --- with the English stemmer (the reference's default) -------------------------

def _stems(spark, sf_dir):
    return q_stem_vocabulary(spark, sf_dir)


def _counts_and_stems(spark, sf_dir):
    """The texts' token counts, and the stems of these tokens: the texts are read once."""
    counts = materialize(N.token_counts(_docs(spark, sf_dir)))
    return counts, ST.stem_vocabulary(counts)


def q_surface_forms_stemmed(spark, sf_dir):
    f = N.surface_forms(*_counts_and_stems(spark, sf_dir))
    return f.select("stem", F.array_join("forms", ",").alias("forms"))


def q_corpus_frequency_stemmed(spark, sf_dir):
    return N.corpus_frequency(*_counts_and_stems(spark, sf_dir))


def q_ngram_tfidf_stemmed(spark, sf_dir, k: int = NGRAM_TOP_K):
    t = N.ngram_tfidf(_docs(spark, sf_dir), 1, 1, _stopwords(spark), _stems(spark, sf_dir), top_k=k)
    return t.select("doc_id", "rank", "term", F.round("x", R).alias("x"))


def q_dictionary_matches_stemmed(spark, sf_dir):
    sw = _stopwords(spark)
    bench = table(spark, sf_dir, "benchmark")
    btoks = X.split_nonempty(X.delete_punctuation(F.lower("text")), N.WHITESPACE)
    dtoks = X.split_nonempty(X.delete_punctuation(F.lower("text")), N.WHITESPACE)
    words = bench.select(F.explode(btoks).alias("token")).union(_docs(spark, sf_dir).select(F.explode(dtoks).alias("token")))
    once = ST.stem_vocabulary(words)
    # dictionary entries are stemmed twice, so stems are tokens too
    stems = ST.stem_vocabulary(once.select("token").union(once.select(F.col("stem").alias("token"))))
    lines = bench.select(F.explode(X.ngrams(btoks, 1, 3)).alias("line"))
    return D.dictionary_matches(_docs(spark, sf_dir), D.dictionary_phrases(lines, sw, stems), sw, stems)


def q_document_lines(spark, sf_dir):
    """Lines per text as a line reader counts them (blank lines count; a
    final newline does not open another line)."""
    body = F.regexp_replace("text", "\n$", "")
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))
    return _docs(spark, sf_dir).select("doc_id", F.size(lines).alias("n_lines"),
                                       F.size(F.filter(lines, lambda x: x == "")).alias("n_blank"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tagged_tokens": q_tagged_tokens,
        "content_words": q_content_words,
        "candidate_phrases": q_candidate_phrases,
        "term_frequency": q_term_frequency,
        "document_frequency": q_document_frequency,
        "word_positions": q_word_positions,
        "doc_vocab": q_doc_vocab,
        "tfidf_words": q_tfidf_words,
        "tfidf_phrases": q_tfidf_phrases,
        "cooccurrence_edges": q_cooccurrence_edges,
        "edge_counts": q_edge_counts,
        "edge_weights": q_edge_weights,
        "singlerank_scores": q_singlerank_scores,
        "singlerank_phrases": q_singlerank_phrases,
        "textrank_scores": q_textrank_scores,
        "textrank_phrases": q_textrank_phrases,
        "similar_documents": q_similar_documents,
        "expandrank_edges": q_expandrank_edges,
        "expandrank_phrases": q_expandrank_phrases,
        "corpus_frequency": q_corpus_frequency,
        "surface_forms": q_surface_forms,
        "ngram_counts": q_ngram_counts,
        "ngram_tfidf": q_ngram_tfidf,
        "global_ngrams": q_global_ngrams,
        "ngram_tfidf_boosted": q_ngram_tfidf_boosted,
        "eval_micro": q_eval_micro,
        "eval_macro": q_eval_macro,
        "gold_keys": q_gold_keys,
        "dictionary_matches": q_dictionary_matches,
        "phrase_positions": q_phrase_positions,
        "redundancy_filter": q_redundancy_filter,
        "ascii_filter": q_ascii_filter,
        "text_normalise": q_text_normalise,
        "sentences": q_sentences,
        "bag_of_words": q_bag_of_words,
        "corpus_union": q_corpus_union,
        "distinct_keywords": q_distinct_keywords,
        "gold_alternatives": q_gold_alternatives,
        "nearest_keywords": q_nearest_keywords,
        "stem_vocabulary": q_stem_vocabulary,
        "lda_keywords": q_lda_keywords,
        "page_tokens": q_page_tokens,
        "document_lines": q_document_lines,
        "lda_topics": q_lda_topics,
        "lda_macro": q_lda_macro,
        "ids_singlerank_phrases": q_ids_singlerank_phrases,
        "ids_textrank_phrases": q_ids_textrank_phrases,
        "ids_similar_documents": q_ids_similar_documents,
        "ids_expandrank_phrases": q_ids_expandrank_phrases,
        "ids_nearest_keywords": q_ids_nearest_keywords,
        "benchmark_records": q_benchmark_records,
        "two_column_records": q_two_column_records,
        "textbook_records": q_textbook_records,
        "tsv_records": q_tsv_records,
        "json_records": q_json_records,
        "record_numbers": q_record_numbers,
        "split_sentences": q_split_sentences,
        "stopword_records": q_stopword_records,
        "title_abstract": q_title_abstract,
        "phrase_sink": q_phrase_sink,
        "saved_artefact": q_saved_artefact,
        "small_scores": q_small_scores,
        "odd_separators": q_odd_separators,
        "in_chunk": q_in_chunk,
        "surface_forms_stemmed": q_surface_forms_stemmed,
        "corpus_frequency_stemmed": q_corpus_frequency_stemmed,
        "ngram_tfidf_stemmed": q_ngram_tfidf_stemmed,
        "dictionary_matches_stemmed": q_dictionary_matches_stemmed,
        "eval_macro_stemmed": q_eval_macro_stemmed,
        "nonredundant_phrases": q_redundancy_filter,
    }
