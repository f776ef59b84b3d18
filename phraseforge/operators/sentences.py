"""Sentence split (X10): a rule on words, and abbreviations learned from the corpus.

A sentence ends with a word that ends in ``.``, ``!`` or ``?`` (and closing quotes
or brackets), unless the next word starts in lower case or the word is an
abbreviation: a short word that the corpus writes with a final period far more
often than without.  Words are counted by partial aggregates; the abbreviations
are looked up where the documents are.

Defined results: null and empty texts have no sentences; the words of a sentence
are joined by one space; the last words of a text are a sentence however they end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.functions.text import split_nonempty
from phraseforge.operators.frequent import frequent_join
from phraseforge.operators.tokens import by_document

# --- fixed values -----------------------------------------------------------
#: White space between words; ends of sentences; what an abbreviation looks like without its last period.
SPACE = "[ \\t\\n\\r\\f]+"
END = "[.!?][\"')\\]]*$"
SHAPE = "[A-Za-z]+([.][A-Za-z]+)*"
#: An abbreviation has this many letters at most, is seen so often with its period, and so many times as often as without.
MOST_CHARS, LEAST_SEEN, TIMES = 5, 5, 4
# ----------------------------------------------------------------------------


def _words(text: str = "text") -> Column:
    return split_nonempty(text, SPACE)


def abbreviations(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(abbreviation, seen): lower-cased, without the last period."""
    words = docs.select(F.explode(_words(text_col)).alias("word"))
    period = F.col("word").rlike(f"^{SHAPE}[.]$")
    bare = F.regexp_replace("word", "[.,;:!?]+$", "")
    words = words.select(F.lower(bare).alias("abbreviation"), period.alias("period")).where(bare.rlike(f"^{SHAPE}$") & (F.length(bare) <= MOST_CHARS))
    counts = words.groupBy("abbreviation").agg(F.count_if("period").alias("seen"), F.count_if(~F.col("period")).alias("without"))
    return counts.where((F.col("seen") >= LEAST_SEEN) & (F.col("seen") >= TIMES * F.col("without"))).select("abbreviation", "seen")


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, nth, sentence), sentences numbered from 0."""
    t = by_document(docs, id_col, text_col).select("doc_id", F.posexplode(_words()).alias("pos", "word"))
    name = F.when(F.col("word").rlike(f"^{SHAPE}[.]$"), F.lower(F.regexp_replace("word", "[.]$", "")))
    t = frequent_join(t.withColumn("abbreviation", name), abbreviations(docs, text_col), "abbreviation", "seen", "left")
    order = Window.partitionBy("doc_id").orderBy("pos")
    after = F.lead("word").over(order)
    ends = F.col("word").rlike(END) & F.col("seen").isNull() & ~F.coalesce(after.rlike("^[a-z]"), F.lit(False))
    t = t.select("doc_id", "pos", "word", ends.cast("int").alias("ends"))
    before = F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.select("doc_id", "pos", "word", F.coalesce(before, F.lit(0)).cast("int").alias("nth"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return t.groupBy("doc_id", "nth").agg(F.array_join(F.transform(parts, lambda x: x["word"]), " ").alias("sentence"))
