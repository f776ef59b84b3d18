"""Token tables and per-document runs.

Layout: one ``tokens(doc_id, pos, word, tag)`` row per token, ``pos`` 0-based
and counting every token that is not markup.  The document text is shuffled
by ``doc_id`` *before* it is exploded, so the (much larger) token table comes
out hash-partitioned by ``doc_id`` without a shuffle of its own, and every
per-document window or aggregate downstream reuses that partitioning.

A document's tokens come from one text cell, which one task reads whole, so a
per-document window is bounded by the largest single row of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.functions.tagging import fixture_kind, fixture_tag, token_array
from phraseforge.functions.text import is_good_pos, is_markup


def by_document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) hash-partitioned by doc_id into ``spark.sql.shuffle.partitions``.

    The count is explicit on purpose: AQE would coalesce a by-column
    repartition by its *input* bytes, and compact text expands into far more
    token work than its size suggests (at sf0.01 it merged everything into one
    task)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.repartition(n, "doc_id")


def tokens_from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Untagged text -> fixture-tagged tokens (see :mod:`phraseforge.functions.tagging`)."""
    d = by_document(docs, id_col, text_col)
    t = d.select("doc_id", F.posexplode(token_array("text")).alias("pos", "word"))
    return t.select("doc_id", "pos", "word", fixture_tag("word").alias("tag"))


def texts_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, texts): the texts of every id, which are one document; the only shuffle
    of the text.  Ids without a text have no tokens and are left out."""
    d = by_document(docs.where(F.col(text_col).isNotNull()), id_col, text_col)
    return d.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


def _kind(tag):
    """0: no content word, 1: content word, 2: one tagged JJ."""
    return F.when(is_good_pos(tag), F.when(tag == "JJ", F.lit(2)).otherwise(F.lit(1))).otherwise(F.lit(0)).cast("tinyint")


def _merged(texts):
    """(pos, word, kind) of the tokens of several texts of one document, by position."""
    def of_text(text):
        return F.transform(token_array(text), lambda w, i: F.struct(i.alias("pos"), w.alias("word"), fixture_kind(w).alias("kind")))

    return F.array_sort(F.flatten(F.transform(texts, of_text)))


def merged_words(texts):
    """The words of a document's texts, in the order of :func:`token_rows`."""
    return F.when(F.size(texts) > 1, F.transform(_merged(texts), lambda t: t["word"])).otherwise(token_array(F.element_at(texts, 1)))


def token_rows(df: DataFrame) -> DataFrame:
    """One row per document, (doc_id, at, words, kind) as :mod:`phraseforge.operators.blocks`
    reads it, from (doc_id, texts) or from a token table; other columns stay (texts only).
    ``at`` is null if the positions are 0, 1, 2, ..."""
    if "words" in df.columns:
        return df
    if "texts" not in df.columns:
        part = F.array_sort(F.collect_list(F.struct("pos", "word", _kind(F.col("tag")).alias("kind"))))
        return df.groupBy("doc_id").agg(part.alias("t")).select("doc_id", F.col("t.pos").alias("at"), F.col("t.word").alias("words"), F.col("t.kind").alias("kind"))
    more = [c for c in df.columns if c not in ("doc_id", "texts")]
    several = F.when(F.size("texts") > 1, _merged(F.col("texts")))
    t = df.select("*", several.alias("t"))
    words = F.when(F.col("t").isNull(), token_array(F.element_at("texts", 1))).otherwise(F.col("t.word"))
    t = t.select("doc_id", F.col("t.pos").alias("at"), words.alias("words"), F.col("t.kind").alias("kind"), *more)
    return t.select("doc_id", "at", "words", F.coalesce("kind", F.transform("words", fixture_kind)).alias("kind"), *more)


def tagged_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`tagged_text` of the fixture-tagged tokens of texts, without a row per token;
    an id whose texts have no token has the text ''."""
    tagged = lambda w: F.concat(w, F.lit("_"), fixture_tag(w))

    def of_text(text):
        return F.transform(token_array(text), lambda w, i: F.struct(i.alias("pos"), tagged(w).alias("t")))

    several = F.transform(F.array_sort(F.flatten(F.transform("texts", of_text))), lambda x: x["t"])
    t = F.when(F.size("texts") == 1, F.transform(token_array(F.element_at("texts", 1)), tagged)).otherwise(several)
    return texts_by_document(docs, id_col, text_col).select("doc_id", F.array_join(t, " ").alias("text"))


def tagged_text(tokens: DataFrame) -> DataFrame:
    """Inverse of :func:`parse_tagged`: ``word_TAG`` text per document."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("_", "word", "tag").alias("t"))))
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def parse_tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dealt: bool = False) -> DataFrame:
    """Parse ``word_TAG`` text; ``dealt``: the documents are dealt by id already.

    Tokens split on space/tab/CR/LF; each splits at its *last* ``_`` (no ``_``:
    word = tag = the token); the word is trimmed and lower-cased, the tag kept;
    markup words (F2) are dropped and take no position.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) if dealt else by_document(docs, id_col, text_col)

    def word(tok):
        # a token holds no space or tab, so nothing is left to trim
        return F.when(tok.contains("_"), F.left(tok, F.length(tok) - F.length(F.substring_index(tok, "_", -1)) - 1)).otherwise(tok)

    # separators at the ends would give empty pieces; only a text with < or > can hold markup
    text = F.btrim("text", F.lit(" \t\r\n"))
    toks = F.when(text != "", F.split(text, "[ \t\r\n]+"))
    kept = F.when(F.col("text").rlike("[<>]"), F.filter("toks", lambda t: ~is_markup(word(t)))).otherwise(F.col("toks"))
    t = d.select("doc_id", "text", toks.alias("toks")).select("doc_id", kept.alias("kept"))
    # outer: Spark would split every text once more below the shuffle to see whether it has tokens
    t = t.select("doc_id", F.posexplode_outer("kept").alias("pos", "tok")).where("pos IS NOT NULL")
    return t.select("doc_id", "pos", F.lower(word(F.col("tok"))).alias("word"), F.substring_index("tok", "_", -1).alias("tag"))


def content_words(tokens: DataFrame) -> DataFrame:
    """tokens whose tag marks a content word."""
    return tokens.where(is_good_pos("tag"))


def _runs(member: DataFrame) -> DataFrame:
    """Gaps and islands over the member tokens of each document: consecutive
    positions form one run.  Returns (doc_id, start, phrase, words, last_tag)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    isl = member.withColumn("island", F.col("pos") - F.row_number().over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", "word", "tag")))
    g = isl.groupBy("doc_id", "island").agg(parts.alias("p"))
    return g.select(
        "doc_id",
        F.col("p")[0]["pos"].alias("start"),
        F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("phrase"),
        F.transform("p", lambda x: x["word"]).alias("words"),
        F.element_at("p", -1)["tag"].alias("last_tag"),
    )


def candidate_runs(tokens: DataFrame) -> DataFrame:
    """W1 + F3: maximal runs of adjacent content-word occurrences; a run whose
    last tag is JJ is dropped whole (not trimmed)."""
    return _runs(content_words(tokens)).where(F.col("last_tag") != "JJ")


def candidate_phrases(tokens: DataFrame) -> DataFrame:
    """Occurrences of each candidate phrase per document."""
    return candidate_runs(tokens).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def selected_runs(tokens: DataFrame, selected: DataFrame) -> DataFrame:
    """Runs of adjacent tokens whose word *type* is selected, whatever the tag.

    ``selected`` is ``(doc_id, word)``."""
    member = tokens.join(selected.select("doc_id", "word"), ["doc_id", "word"], "left_semi")
    return _runs(member)


def word_positions(tokens: DataFrame) -> DataFrame:
    """A5: 1-based positions of each word's content-word occurrences."""
    return (content_words(tokens)
            .groupBy("doc_id", "word")
            .agg(F.count("*").alias("tf"), F.sort_array(F.collect_list(F.col("pos") + 1)).alias("positions")))


def doc_vocab(tokens: DataFrame) -> DataFrame:
    """Document length (all non-markup tokens) and number of distinct content words."""
    return tokens.groupBy("doc_id").agg(
        F.count("*").alias("doc_len"),
        F.count_distinct(F.when(is_good_pos("tag"), F.col("word"))).alias("vocab"),
    )
