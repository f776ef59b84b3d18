"""A corpus pipeline: STAGES in order, each reading what the one before kept.

All stages but the last return rows with the columns of ``documents``; every
stage's result is written as Parquet and reread as the next one's input.

Defined results: a null or empty text is scored like any other, is one text for
the copies' sake, has the fingerprint zero and no words to mix, so it leaves at
the mixing stage; rows without a doc_id are kept or dropped by their texts; ties
go to the larger doc_id among equal texts and to the smaller one among near
copies; repeated rows are copies; texts of any length are processed whole; an
empty table gives an empty result; extra columns of ``documents`` come through
all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseforge.llm import exact_dedup, mixing, pieces, quality_classifier, simhash
from phraseforge.session import checkpoint_dir
from phraseforge.sources.tables import table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents the classifier rejects (score below 0.3) go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of linked fingerprints the smallest doc_id stays."""
    return simhash.drop_near_copies(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows repeat once per copy taken; the document at a source's cut is shortened."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, max_epochs=2)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the ids of every text of the mix (doc_id, source, n_tokens, ids)."""
    import public_tokenizers

    encoded = pieces.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good_documents),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: No SQL: the classifier, the fingerprints and the pieces are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared
    checkpoint folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    return docs
