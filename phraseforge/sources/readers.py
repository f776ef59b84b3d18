"""Readers for the reference's input formats.

All are ``spark.read`` scans plus column expressions; file names become ids
through ``input_file_name`` so a directory of per-document files is one scan,
not a driver loop.  Schemas are given explicitly (no inference).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseforge.functions.text import py_strip
from phraseforge.operators.dictionary import dictionary_phrases
from phraseforge.operators.evaluate import gold_from_lines, parse_stemmed_gold
from phraseforge.operators.tokens import parse_tagged
from phraseforge.sources import split_csv
from phraseforge.sources.numbering import number_lines, number_rows


def _file_id(suffix: str = "") -> F.Column:
    """Base name of the input file, minus ``suffix``."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return F.regexp_replace(name, f"{suffix}$", "") if suffix else name


def tagged_corpus(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """One ``word_TAG`` text file per document -> tokens(doc_id, pos, word, tag).
    ``doc_id`` is the file name (``suffix`` removed)."""
    docs = spark.read.text(path, wholetext=True).select(_file_id(suffix).alias("doc_id"), F.col("value").alias("text"))
    return parse_tagged(docs)


def document_list(spark: SparkSession, path: str) -> DataFrame:
    """One document name per line -> (ordinal, name), ordinals 0, 1, ... in file
    order.  The reference's N (IDF numerator) is the number of lines, blank ones
    included: ``document_list(...).count()`` or ``.select(F.count('*')).scalar()``.
    Lists pair by position with ``numbering.pair_by_position`` (S3)."""
    return number_lines(spark, path).select("ordinal", F.col("value").alias("name"))


def gold_keys(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """S3 + U3: one keyphrase per line, one file per document -> (doc_id,
    phrase), trimmed (space/tab), lower-cased, distinct, empty lines ignored."""
    lines = spark.read.text(path).select(_file_id(suffix).alias("doc_id"), F.col("value").alias("line"))
    return gold_from_lines(lines)


BENCHMARK_SCHEMA = "id string, title string, abstract string, controlled string, uncontrolled string"
TWO_COLUMN_SCHEMA = "id string, text string"
TEXTBOOK_SCHEMA = "id string, title string, concepts string, wikipediafiles string, text string"
CSV_QUOTES = split_csv.QUOTES


def _stripped(c: str) -> F.Column:
    return F.coalesce(py_strip(F.col(c)), F.lit("")).alias(c)


def _benchmark_columns(df: DataFrame) -> DataFrame:
    return df.select("id", _stripped("title"), _stripped("abstract"), F.split(_stripped("controlled"), ",").alias("controlled"),
                     F.split(_stripped("uncontrolled"), ",").alias("uncontrolled"))


def _textbook_columns(df: DataFrame) -> DataFrame:
    return df.select("id", *[_stripped(c) for c in ("title", "concepts", "wikipediafiles", "text")])


def _csv_records(lines: DataFrame, schema: str, line_col: str) -> DataFrame:
    """CSV records held in a string column."""
    return lines.select(F.from_csv(F.col(line_col), schema, CSV_QUOTES).alias("r")).select("r.*")


def benchmark_records(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """S4 on records in a column (no header among them)."""
    return _benchmark_columns(_csv_records(lines, BENCHMARK_SCHEMA, line_col))


def two_column_records(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """S5 on records in a column."""
    return _csv_records(lines, TWO_COLUMN_SCHEMA, line_col).select("id", _stripped("text"))


def textbook_records(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """S6 on records in a column."""
    return _textbook_columns(_csv_records(lines, TEXTBOOK_SCHEMA, line_col))


def _read_csv(spark: SparkSession, path: str, schema: str, header: bool, multiline: bool) -> DataFrame:
    if multiline:
        return split_csv.read(spark, path, schema, header)
    return spark.read.csv(path, schema=schema, header=header, **CSV_QUOTES)


def benchmark_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Comma CSV with a header: id, title, abstract, controlled,
    uncontrolled.  All but id stripped; keyword columns split on ','
    (an empty column gives [''], a list of length 1, as in the reference).

    ``multiline=True`` reads records that span lines, by many tasks a file
    (:mod:`phraseforge.sources.split_csv`); ``False`` is Spark's reader for files
    whose records are single lines."""
    return _benchmark_columns(_read_csv(spark, path, BENCHMARK_SCHEMA, True, multiline))


def two_column_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``id,text`` without a header; text stripped (``multiline`` as in S4)."""
    return _read_csv(spark, path, TWO_COLUMN_SCHEMA, False, multiline).select("id", _stripped("text"))


def textbook_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``id,title,concepts,wikipediafiles,text`` without a header; all but id
    stripped (``multiline`` as in S4)."""
    return _textbook_columns(_read_csv(spark, path, TEXTBOOK_SCHEMA, False, multiline))


def tsv_lines(spark: SparkSession, path: str) -> DataFrame:
    """``id <TAB> text`` per line, split at the first tab; text lower-cased.
    Lines without a tab are rejected (the reference raises on them)."""
    return tsv_records(spark.read.text(path), "value")


def tsv_records(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """S7 on lines in a column."""
    v = F.col(line_col)
    cut = F.substring(v, F.instr(v, "\t") + 1, F.length(v))
    return lines.where(F.instr(v, "\t") > 0).select(F.substring_index(v, "\t", 1).alias("id"), F.lower(cut).alias("text"))


def abstracts_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; records that *have* an ``abstract`` key are kept; ids count the
    kept records 0, 1, ... in file order; keyword lists are ['']."""
    kept = number_lines(spark, path, F.from_json("value", _JSON)["abstract"].isNotNull(), "id")
    return _json_columns(kept, "value")


_JSON = "title string, abstract string"


def _json_columns(lines: DataFrame, line_col: str) -> DataFrame:
    df = lines.select("id", F.from_json(F.col(line_col), _JSON).alias("r")).select("id", "r.*")
    empty = F.array(F.lit(""))
    return df.select("id", F.coalesce("title", F.lit("")).alias("title"), "abstract", empty.alias("controlled"), empty.alias("uncontrolled"))


def json_records(lines: DataFrame, line_col: str = "line", by: list[str] | None = None) -> DataFrame:
    """S8 / F10 on JSON lines in a column: records without an ``abstract`` go.  Ids are
    unique; with ``by`` they count the kept records 0, 1, ... in that order."""
    kept = lines.where(F.from_json(F.col(line_col), _JSON)["abstract"].isNotNull())
    numbered = number_rows(kept, by, "id") if by else kept.withColumn("id", F.monotonically_increasing_id())
    return _json_columns(numbered, line_col)


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, lower-cased and stripped, as a set (word)."""
    return stopword_records(spark.read.text(path), "value")


def stopword_records(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """S9 on lines in a column."""
    return lines.select(F.lower(py_strip(F.col(line_col))).alias("word")).distinct()


def phrase_dictionary(spark: SparkSession, path: str, stop: DataFrame | None = None,
                      stem_map: DataFrame | None = None) -> DataFrame:
    """Phrase dictionary file(s) -> (phrase), see
    :func:`phraseforge.operators.dictionary.dictionary_phrases`."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return dictionary_phrases(lines, stop, stem_map)


def stemmed_gold(spark: SparkSession, path: str) -> DataFrame:
    """``ID : k1,k2,a+b`` lines -> (doc_id, key_pos, alt_pos, phrase).
    ``doc_id`` stays a string (ids like ``C-41``)."""
    return parse_stemmed_gold(spark.read.text(path), "value")


__all__ = ["tagged_corpus", "document_list", "gold_keys", "benchmark_csv", "two_column_csv", "textbook_csv",
           "tsv_lines", "abstracts_json", "stopwords", "phrase_dictionary", "stemmed_gold", "parse_stemmed_gold"]
