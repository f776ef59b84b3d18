"""Spelling variant grouping (operator 13): pivotal grams.

1. Words are counted over all texts.  (A documented share of the runs of letters
   loses one letter first, by a hash of document and run; ``misspell=None``
   counts them as they are.)
2. All bigrams are ordered by the number of words that hold them, rare ones
   first, and by place where a word holds one more than once.  A word's prefix
   is its first three (and the last of them again, if it also stands at the next
   place); dynamic programming picks the two of the three that do not overlap
   and are rarest together: its pivots.
3. One edit leaves one of two disjoint bigrams as it is, and all that stands on one
   side of it.  So of two words one edit apart, a pivot of the one whose prefix
   ends earlier in the order stands in the other's prefix: at the same place from
   the left, with the same letters before it, or from the right, with the same
   letters after it.  Pivots are dealt with each of these parts under the three
   lengths the other word may have, and meet prefix bigrams with an equal part
   and length; the pairs are verified by edit distance.
4. A word's form is its most frequent near word, if that is at least twice as
   frequent; forms are followed to the last one by doubling the steps.

Defined results: null and empty texts have no words; a null doc_id counts as
the empty string in the hash; repeated rows count each; ties go to the smaller
word in code-point order; texts and words of any length are processed whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.session import materialize

#: A run of letters.
RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, MISSPELL = 5, 3, 97
#: What one edit does to a word's length.
CHANGES = (-1, 0, 1)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, misspell: int | None = MISSPELL) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if misspell is not None:
        runs = runs.select("word", F.crc32(F.concat("id", F.lit(":"), "word")).alias("h"))
        runs = runs.withColumn("at", F.expr("cast(h % char_length(word) as int)"))
        cut = F.expr("concat(substring(word, 1, at), substring(word, at + 2))")
        runs = runs.select(F.when(F.col("h") % misspell == 0, cut).otherwise(F.col("word")).alias("word"))
    counts = runs.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count)


def bigrams(word: str) -> list[str]:
    return [word[i:i + 2] for i in range(len(word) - 1)]


def bigram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """(rank, words that hold it) of each bigram, rare ones first.

    A bigram has two of the 90 letters of a lower-cased run: 8,100 at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            grams = [g for w in rows.column(0).to_pylist() for g in set(bigrams(w))]
            counts = pa.array(grams, pa.string()).value_counts()
            yield pa.record_batch([counts.field("values"), counts.field("counts")], ["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {g: (rank, n) for rank, (n, g) in enumerate(sorted((r["n"], r["gram"]) for r in rows))}


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[int], list[int], int]:
    """(places of the prefix, places of the two pivots, where the prefix ends in the order)."""
    grams = [order[g] for g in bigrams(word)]
    rarest = sorted((rank, i) for i, (rank, _) in enumerate(grams))[:3]
    places = sorted(i for _, i in rarest)
    # least sum of frequencies of one bigram so far, and of two that do not overlap
    one: list[tuple[int, int]] = []
    pair: tuple[int, int, int] | None = None
    for k, i in enumerate(places):
        n = grams[i][1]
        apart = sum(j <= i - 2 for j in places[:k])
        if apart and (pair is None or one[apart - 1][0] + n < pair[0]):
            pair = (one[apart - 1][0] + n, one[apart - 1][1], i)
        one.append(min((n, i), one[k - 1]) if k else (n, i))
    rank, at = rarest[-1]
    # the last bigram again at the next place: an edit may have moved it there
    more = [at + 1] if at + 1 < len(grams) and grams[at + 1][0] == rank else []
    return places + more, list(pair[1:]), rank << 32 | at


def _grams(words: DataFrame, order, pivots: bool) -> DataFrame:
    """(side, part, length, word, n, last) of every prefix bigram: the word up to the end
    of the bigram (side 0) and from its begin (side 1); of every pivot, the same under
    the lengths its near words may have."""
    table = words.sparkSession.sparkContext.broadcast(order)
    names = ["side", "part", "length", "word", "n", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for word, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                prefix, pivot, last = prefix_and_pivots(word, table.value)
                changes = CHANGES if pivots else (0,)
                for i in pivot if pivots else prefix:
                    out += [(side, part, len(word) + e, word, n, last) for side, part in ((0, word[:i + 2]), (1, word[i:])) for e in changes]
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return words.select("word", "n").mapInArrow(run, "side int, part string, length int, word string, n long, last long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words one edit apart, from both sides (some more than once)."""
    order = bigram_order(words)
    p, x = _grams(words, order, True).alias("p"), _grams(words, order, False).alias("x")
    met = [F.col(f"p.{c}") == F.col(f"x.{c}") for c in ("side", "part", "length")]
    pairs = p.join(x, met + [F.col("p.last") <= F.col("x.last"), F.col("p.word") != F.col("x.word"),
                             F.levenshtein("p.word", "x.word", 1) == 1])
    sides = [F.struct(F.col(f"{a}.word").alias("word"), F.col(f"{a}.n").alias("n"), F.col(f"{b}.word").alias("near"), F.col(f"{b}.n").alias("near_n"))
             for a, b in ("px", "xp")]
    return pairs.select(F.explode(F.array(*sides)).alias("s")).select("s.*")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): every round doubles the steps taken.  A form is at
    least twice as frequent as its word, so there are no circles and few rounds."""
    roots = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        # columns of their own for the second side
        step = roots.toDF("at", "next")
        roots = materialize(roots.join(step, F.col("root") == F.col("at"), "left")
                            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.filter("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, misspell: int | None = MISSPELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    if min_length < 5:
        raise ValueError("two disjoint pivots out of three bigrams, and their places, need words of five letters")
    words = materialize(word_counts(docs, min_length, min_count, misspell))
    # a word has at most 90 near words for each place and edit: the set is small
    near = near_words(words).groupBy("word").agg(
        F.size(F.collect_set("near")).cast("long").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= 2 * F.col("n")
    found = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                    F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = last_forms(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
