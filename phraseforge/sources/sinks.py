"""Sinks (K1-K3).

Outputs are parquet tables clustered by document; one directory per
document (``partitionBy``) is offered only for small exports, since it makes
one file per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_phrases(phrases: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: (doc_id, rank, phrase, score) as parquet, rows of a document together."""
    (phrases.select("doc_id", "rank", "phrase", "score")
     .repartition("doc_id").sortWithinPartitions("doc_id", "rank")
     .write.mode(mode).parquet(path))


def export_phrase_files(phrases: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1, reference layout: one text directory per document, one phrase per
    line in rank order.  For small exports only."""
    (phrases.select(F.col("doc_id").cast("string").alias("doc"), "rank", "phrase")
     .repartition("doc").sortWithinPartitions("doc", "rank").select("doc", "phrase")
     .write.mode(mode).partitionBy("doc").text(path))


def write_scored_terms(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: (file_id, rank, line) from :func:`phraseforge.operators.ngrams.scored_term_lines`,
    one directory per file id with ``term,z,x`` lines in rank order."""
    (lines.repartition("file_id").sortWithinPartitions("file_id", "rank").select("file_id", "line")
     .write.mode(mode).partitionBy("file_id").text(path))


def save_artefact(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """K3: write an intermediate (parsed corpus, bag of words, ...) once and
    return the re-read table, cutting the lineage the way the reference's
    pickled stages do -- but reproducibly, on shared storage."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)
