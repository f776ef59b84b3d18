"""The registered queries of this subpackage: ``name -> fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseforge.llm import (divergence, exact_dedup, language_id, mixing, pieces, pii, quality_classifier, quality_rules, simhash, spelling,
                             substring_dedup, suffix_dedup, token_counts)
from phraseforge.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text again."""
    coded = pieces.round_trip(_docs(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; over_limit: more than 512 tokens."""
    return token_counts.count_tokens(_docs(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), limit=512)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many go as repeats of 20 words or more, and a digest of those left."""
    kept = substring_dedup.remove_repeats(_docs(spark, sf_dir), block=10)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels.quality."""
    docs = _docs(spark, sf_dir)
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from text and lang outside the held-out fold."""
    docs = _docs(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (4-word shingles, 4 bits)."""
    groups = simhash.near_groups(_docs(spark, sf_dir), shingle=4, max_bits=4)
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that also stands earlier, with that earlier place."""
    return suffix_dedup.repeated_passages(_docs(spark, sf_dir), length=50)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    return exact_dedup.decisions(_docs(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document: weights 3, 1, 2 over sources, 150 % of all words."""
    return mixing.plan(_docs(spark, sf_dir), weights=(3, 1, 2), share=1.5, max_epochs=2).drop("source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(_docs(spark, sf_dir))


def quality_rules_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 with an absolute limit: a line on more than 10 distinct texts of its host goes, however large the host."""
    return quality_rules.judge(_docs(spark, sf_dir), min_docs=10, share=0)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against every other one of its language, and its ten most over-used terms."""
    return divergence.audit(_docs(spark, sf_dir), min_docs=10, top=10)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, counts and a digest of the base kinds."""
    return pii.summary(pii.find(_docs(spark, sf_dir)))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters and three occurrences or more, their near words and the form they stand for."""
    return spelling.variants(_docs(spark, sf_dir), min_length=5, min_count=3, misspell=97)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_token_counts": op2_token_counts,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_language_id": op5_language_id,
        "op6_simhash": op6_simhash,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_mixing": op9_mixing,
        "op10_quality_rules": op10_quality_rules,
        "quality_rules_by_count": quality_rules_by_count,
        "op11_divergence": op11_divergence,
        "op12_pii": op12_pii,
        "op13_spelling": op13_spelling,
    }
