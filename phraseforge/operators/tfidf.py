"""TF-IDF over content words and the TF-IDF phrase ranker.

Word score = tf x log2(N / (1 + df)), where tf counts a word's content-word
occurrences in the document and df counts documents containing the word with
*any* tag.  N is the number of documents, as a scalar subquery.

Plan notes: tf and the candidate runs are computed on the doc-partitioned
token table without a shuffle; df is a partial aggregate by word.  M0 deals the
distinct words of each block of documents by word, their idf back by block, and scores
the runs of a block as arrays (:mod:`phraseforge.operators.blocks`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.functions.tagging import fixture_kind, token_array
from phraseforge.operators.blocks import SCORE, Block, best_phrases, dealt, sorted_names, units
from phraseforge.operators.tokens import content_words, token_rows

# Decimals at which scores are compared when ranking: the width of the exact
# sums below, so only float noise is folded into ties.
RANK_DECIMALS = 9


def exact(x: Column) -> Column:
    """A score as DECIMAL(38, 9): sums of these are exact, so the result does not
    depend on the order in which partitions are added (long phrases sum
    thousands of word scores, some above 1e6).  The width is kept at 20 so a
    product with a DECIMAL(9, 0) count keeps all 9 decimals."""
    return F.round(x, 9).cast("decimal(20,9)")


def n_docs(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Number of documents as a scalar-subquery column (no driver round trip)."""
    return docs.select(F.count_distinct(id_col)).scalar()


def term_frequency(tokens: DataFrame) -> DataFrame:
    """A1: content-word occurrences per (doc, word); the empty word is skipped."""
    return content_words(tokens).where(F.col("word") != "").groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """A2: number of documents containing the word with any tag."""
    return tokens.groupBy("word").agg(F.count_distinct("doc_id").alias("df"))


def idf_log2(n: Column, df: Column) -> Column:
    """log2(N / (1 + df)); 0 when df = N - 1, negative when df = N."""
    return F.log2(n / (F.lit(1.0) + df))


def tfidf_words(tokens: DataFrame, n: Column) -> DataFrame:
    """(doc_id, word, tf, df, score) with score = tf * log2(N/(1+df))."""
    tf = term_frequency(tokens)
    df = document_frequency(tokens)
    return (tf.join(df, "word")
            .select("doc_id", "word", "tf", "df", (F.col("tf") * idf_log2(n, F.col("df"))).alias("score")))


def island_tokens(tokens: DataFrame) -> DataFrame:
    """Content-word tokens with their W1 run id (``island``: consecutive
    positions share one) -- a window over the doc-partitioned table."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return content_words(tokens).withColumn("island", F.col("pos") - F.row_number().over(w))


def scored_runs(scored: DataFrame) -> DataFrame:
    """A10 + F3 at run level: ``scored`` is island tokens with an exact token
    score ``s``; returns distinct (doc_id, phrase, score) for the runs not
    ending in JJ.  Every run of the same phrase has the same exact sum.

    Scoring tokens and summing per (doc, island) keeps the long phrase strings
    out of join and grouping keys; the grouping reuses the doc partitioning."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "word", "tag")))
    runs = scored.groupBy("doc_id", "island").agg(parts.alias("p"), F.sum("s").alias("score"))
    runs = runs.select("doc_id", F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("phrase"),
                       F.element_at("p", -1)["tag"].alias("last_tag"), "score").where(F.col("last_tag") != "JJ")
    return runs.groupBy("doc_id", "phrase").agg(F.max("score").alias("score"))


def phrase_scores(tokens: DataFrame, word_scores: DataFrame) -> DataFrame:
    """A10: phrase score = sum of its tokens' scores (repeats count each time,
    a word without a score counts 0), from a (doc_id, word, score) table.
    Returns distinct (doc_id, phrase, score) with ``score`` an exact
    DECIMAL(38, 9) sum of the word scores rounded to 9 places, so ranking and
    rounding do not depend on summation order."""
    cw = island_tokens(tokens).join(word_scores.select("doc_id", "word", "score"), ["doc_id", "word"], "left")
    return scored_runs(cw.withColumn("s", exact(F.coalesce(F.col("score"), F.lit(0.0)))))


def top_k(df: DataFrame, k: int, key: str, score: str = "score", part: str = "doc_id",
          rank_col: str = "rank") -> DataFrame:
    """O1/O3: the ``k`` best rows per ``part`` by (score desc, key asc).

    The reference fills k slots in key order and replaces the lowest on a
    strictly greater score, so boundary ties depend on slot order; here ties are
    broken deterministically by key.  Scores are compared at RANK_DECIMALS decimals so float
    noise from summation order cannot flip a rank.  With a constant k Catalyst
    applies a window group limit before the shuffle.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    w = Window.partitionBy(part).orderBy(F.round(F.col(score), RANK_DECIMALS).desc(), F.col(key).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def dealt_rows(tokens: DataFrame, blocks: int | None = None) -> DataFrame:
    """(block, doc_id, at, words, kind) from a token table or from (doc_id, text); ``blocks`` as in :func:`dealt`."""
    if "text" not in tokens.columns:
        return dealt(token_rows(tokens), F.size("words") * 5, "doc_id", "at", "words", "kind", blocks=blocks)
    t = dealt(tokens.where(F.col("text").isNotNull()), F.octet_length("text"), "doc_id", "text", blocks=blocks)
    t = t.select("block", "doc_id", F.lit(None).cast("array<int>").alias("at"), token_array("text").alias("words"))
    return t.select("*", F.transform("words", fixture_kind).alias("kind"))


def block_idf(rows: DataFrame, n: Column, *more: Column) -> DataFrame:
    """(block, slot, idf, *more) of the content words of every block, numbered in order.  Only the
    distinct words of blocks meet by word, each with its number of documents there."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block.of(table)
        block.encode()
        names, place = sorted_names(block.names)
        some = block.types[~block.null_ids()[block.types // block.n_names]]
        n_docs, content = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        n_docs[place] = np.bincount(some % block.n_names, minlength=len(names))
        content[place[block.code[block.kind > 0]]] = True
        return pa.table({"block": pa.array(np.full(len(names), key[0].as_py(), np.int32)), "word": names,
                         "slot": pa.array(np.arange(len(names)), pa.int32(), mask=~content), "n": pa.array(n_docs)})

    words = rows.groupBy("block").applyInArrow(run, "block int, word string, slot int, n long")
    df = words.withColumn("df", F.sum("n").over(Window.partitionBy("word"))).where(F.col("slot").isNotNull())
    return df.select("block", "slot", idf_log2(n, F.col("df")).alias("idf"), *more)


def tfidf_phrases(tokens: DataFrame, n: Column, k: int = 10) -> DataFrame:
    """M0: candidate runs scored by summed word TF-IDF, top ``k`` per document.
    ``tokens`` is a token table or (doc_id, text), which needs no row per token.

    Returns (doc_id, rank, phrase, score)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    rows = dealt_rows(tokens)
    idf = block_idf(rows, n).withColumnRenamed("block", "of")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        block = Block.of(table)
        block.encode()
        names, place = sorted_names(block.names)
        word_idf = np.zeros(len(names))
        word_idf[known.column("slot").to_numpy()] = known.column("idf").to_numpy()
        tf = np.bincount(block.of, weights=block.kind > 0, minlength=len(block.types))
        score = tf * np.nan_to_num(word_idf[place[block.types % block.n_names]])
        named = pc.not_equal(block.type_names(np.arange(len(block.types))), "").to_numpy(zero_copy_only=False)
        return pa.Table.from_batches([best_phrases(block, np.where(named, units(score), 0)[block.of], k)])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(idf.groupBy("of")).applyInArrow(run, f"doc_id {kind}, rank int, phrase string, score {SCORE}")
