"""Mixing sources to target weights (operator 9), DataFrame functions only.

Every source gets a budget of words; its documents, in the order of a random
key drawn by hash, are taken until the budget is spent, whole epochs first.
The order is cut at the exact word by prefix sums: a source's key space is
split into ranges of about ``ROWS_PER_RANGE`` rows, each range is sorted and
summed on its own, and the sums of the ranges before it are added.  No task
sees more than one range, however large a source is.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own (last in order); sources whose documents are all
empty have target 0; an empty table gives an empty plan.  Rows with equal
doc_id, source and size are interchangeable, so a tie between them does not
show in the result.  Extra columns are ignored by :func:`plan` and kept by
:func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.llm.common import WORD, text_or_empty, word_count
from phraseforge.session import materialize

ROWS_PER_RANGE = 1 << 11


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, source_rows, target, budget, epochs, rest) per source.

    The shared total ``share * all words`` is dealt by weight; a source holds at
    most ``max_epochs`` times its size and the excess goes to the others.  With
    sources sorted by size/weight the full ones are a prefix, and the level all
    others reach per unit of weight is the largest of (total - sizes before) /
    (weights from here on).  The windows run over one row per source."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_epochs
    t = total.withColumn("w", weight).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    all_rows = Window.partitionBy(F.lit(1))
    t = t.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - before) / after)
    t = t.withColumn("target", F.least(F.col("cap"), F.max("level").over(all_rows) * F.col("w")))
    t = t.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("epochs", full).withColumn("rest", F.col("budget") - full * F.col("source_size"))
    return t.select("source", "source_size", "source_rows", "target", "epochs", "rest")


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
         seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, taken."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size"), key.alias("key")))
    targets = source_targets(sized, weights, share, max_epochs)
    d, t = sized.alias("d"), targets.alias("t")
    rows = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", *[f"t.{c}" for c in targets.columns if c != "source"])
    # the first 32 bits of the key, scaled to the number of ranges of its source
    ranges = F.ceil(F.col("source_rows") / rows_per_range).cast("long")
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.shiftright(at * ranges, 32))
    before = (rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("n"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    r, b = rows.withColumn("upto", F.sum("size").over(inside)).alias("r"), before.alias("b")
    rows = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.range") == F.col("b.range"))).select("r.*", "b.before")
    left = F.col("rest") - (F.col("before") + F.col("upto") - F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: a row for each whole
    copy the mix takes, and, for the one document at which a source's budget
    runs out, a row whose text ends after the words still due (``n_chars``, if
    there, follows)."""
    # rows that share doc_id, source and size are numbered, so that the join below pairs them one to one
    def numbered(df, *order):
        w = Window.partitionBy("doc_id", "source", "size").orderBy(*order)
        return df.withColumn("nth", F.row_number().over(w))

    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text", word_count().alias("size"))
    d, p = numbered(rows, text_or_empty()).alias("d"), numbered(plan(docs, **options), "taken").alias("p")
    same = (F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source"))
            & (F.col("d.size") == F.col("p.size")) & (F.col("d.nth") == F.col("p.nth")))
    took = d.join(p.filter("taken > 0"), same).select("d.row", "d.text", "d.size", "p.taken")
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))
    took = took.withColumn("copy", F.explode(copies))
    due = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), due.cast("int")), "")
    whole = due == F.col("size")
    took = took.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(whole, out["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return took.select(*[e.alias(c) for c, e in out.items()])
