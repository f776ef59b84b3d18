"""Fixture tag rule: turns the driver's untagged ``documents`` text into the
``(word, tag)`` tokens the rankers read.

The reference reads text that was POS-tagged elsewhere.  The driver tables are
untagged, so this suffix rule stands in for that input.  It is not a tagger and
is never presented as one; the same rule is written in the DuckDB oracle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Token pattern: a run of letters, or one character that is neither a letter
# nor white space.
TOKEN_PATTERN = r"\p{L}+|[^\p{L}\s]"
# Words tagged DT by the fixture rule.
DT_WORDS = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are",
            "was", "were", "be", "by", "as", "at", "it", "this", "that", "from")
# Suffix rules, tried in this order after SYM and DT (patterns: the SQL; suffixes: Spark).
RB_SUFFIX = "ly$"
VB_SUFFIX = "(ing|ed)$"
JJ_SUFFIX = "(al|ic|ous|ive|able|ible)$"
RB_END, VB_ENDS, JJ_ENDS = "ly", ("ing", "ed"), ("al", "ic", "ous", "ive", "able", "ible")
# ----------------------------------------------------------------------------


def _tag_rule(word, sym, dt, rb, vb, jj, nn) -> Column:
    w = F.col(word) if isinstance(word, str) else word
    # the pattern is matched only for words that do not begin with a to z
    letter = ((w >= "a") & (w < "{")) | w.rlike(r"^\p{L}")
    return (F.when(~letter, sym)
            .when(w.isin(*DT_WORDS), dt)
            .when(w.endswith(RB_END), rb)
            .when(reduce(or_, (w.endswith(x) for x in VB_ENDS)), vb)
            .when(reduce(or_, (w.endswith(x) for x in JJ_ENDS)), jj)
            .otherwise(nn))


def fixture_tag(word) -> Column:
    """Tag of one lower-cased token under the fixture rule."""
    return _tag_rule(word, *map(F.lit, ("SYM", "DT", "RB", "VB", "JJ", "NN")))


def fixture_kind(word) -> Column:
    """The tag as a number: 0 for no content word, 1 for NN, 2 for JJ."""
    return _tag_rule(word, *(F.lit(x).cast("tinyint") for x in (0, 0, 0, 0, 2, 1)))


def token_array(text) -> Column:
    """All tokens of a text, lower-cased, in order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)


def sql_token_array(text_sql: str) -> str:
    """DuckDB spelling of :func:`token_array` (used by the oracle)."""
    return f"regexp_extract_all(lower({text_sql}), '{TOKEN_PATTERN}')"


def sql_fixture_tag(word_sql: str) -> str:
    """DuckDB spelling of :func:`fixture_tag` (used by the oracle)."""
    dt = ", ".join(f"'{w}'" for w in DT_WORDS)
    return (f"CASE WHEN NOT regexp_matches({word_sql}, '^\\p{{L}}') THEN 'SYM' "
            f"WHEN {word_sql} IN ({dt}) THEN 'DT' "
            f"WHEN regexp_matches({word_sql}, '{RB_SUFFIX}') THEN 'RB' "
            f"WHEN regexp_matches({word_sql}, '{VB_SUFFIX}') THEN 'VB' "
            f"WHEN regexp_matches({word_sql}, '{JJ_SUFFIX}') THEN 'JJ' ELSE 'NN' END")
