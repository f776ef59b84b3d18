"""Connected components of a link table by alternating star contractions.

Large-star hangs every larger neighbour of a node on the smallest node it
knows; small-star does so with the smaller ones.  Each step is an aggregate and
an equi-join over links (never over a node's neighbours in one task); the links
are written to the shared checkpoint folder after each round, and the loop ends
when a round changes nothing.  The driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseforge.session import materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    hung = links.join(low, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between distinct ids -> (id, label): label is the smallest id
    reachable; smallest ids themselves, and ids without a link, are left out."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = materialize(links)
    state = _state(links)
    while state[0]:
        links = materialize(_small_star(_large_star(links)))
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
