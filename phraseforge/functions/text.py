"""Scalar text expressions (X1-X8, X11, X16, X17) and token predicates.

Everything returns a ``Column`` built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Part-of-speech tags that make a token a content word (nouns and adjectives).
GOOD_POS = ("NN", "NNS", "NNP", "NNPS", "JJ")
# Python's string.punctuation, deleted (not replaced) before n-gram matching.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# ----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_good_pos(tag) -> Column:
    """tag is one of the content-word tags."""
    return _c(tag).isin(*GOOD_POS)


def is_markup(word) -> Column:
    """a word of >= 2 chars that starts with '<' or ends with '>'."""
    w = _c(word)
    return (F.length(w) >= 2) & (w.startswith("<") | w.endswith(">"))


def is_ascii(s) -> Column:
    """true iff the string holds only ASCII characters."""
    return ~_c(s).rlike("[^\\x00-\\x7F]")


def trim_space_tab(s) -> Column:
    """X2 (C++ variant): strip spaces and tabs at both ends."""
    return F.regexp_replace(_c(s), "^[ \\t]+|[ \\t]+$", "")


def py_strip(s) -> Column:
    """X2 (Python variant): ``str.strip()`` -- all ASCII whitespace."""
    ws = "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F]"
    return F.regexp_replace(_c(s), f"^{ws}+|{ws}+$", "")


def split_nonempty(s, pattern: str = "[ \\t\\r\\n]+") -> Column:
    """Split and drop empty pieces (C++ ``strtok`` / Python ``split()``)."""
    return F.filter(F.split(_c(s), pattern), lambda x: x != "")


def split_space(s) -> Column:
    """``s.split(' ')`` -- empty pieces are kept."""
    return F.split(_c(s), " ")


def strip_symbols_digits(s) -> Column:
    """``re.sub(r'\\W+|\\d+', '', s)`` with ASCII ``\\W`` (Java's default too)."""
    return F.regexp_replace(_c(s), "\\W+|\\d+", "")


def delete_punctuation(s) -> Column:
    """Delete every ``string.punctuation`` character (``web-service`` -> ``webservice``)."""
    return F.translate(_c(s), PUNCTUATION, "")


def printable_only(s) -> Column:
    """Keep ``string.printable`` characters only."""
    return F.regexp_replace(_c(s), "[^\\x09-\\x0D\\x20-\\x7E]", "")


def collapse_spaces(s) -> Column:
    """Runs of spaces become one space."""
    return F.regexp_replace(_c(s), " +", " ")


def plural_variants(p) -> Column:
    """The phrase, the phrase + 's', and the phrase minus a trailing 's'."""
    p = _c(p)
    return F.array_distinct(F.array(p, F.concat(p, F.lit("s")), F.regexp_replace(p, "s$", "")))


def match_positions(text_tokens, pattern_tokens) -> Column:
    """All (overlapping) 0-based start positions of ``pattern`` in ``text``.

    Both are arrays of tokens.  ``sequence(0, -1)`` counts down in Spark, so the
    range is only built when the pattern fits.
    """
    t, p = _c(text_tokens), _c(pattern_tokens)
    n, m = F.size(t), F.size(p)
    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(t, i + 1, m) == p)


def ngrams(tokens, n_min: int, n_max: int) -> Column:
    """All n-grams of length ``n_min..n_max``, ordered by n then position.

    Each n-gram is a space-joined string.  The ``size >= n`` guard keeps
    ``sequence`` from counting down for short token lists.
    """
    t = _c(tokens)

    def gram(n):
        # one-argument lambda: F.transform passes (element, index) to two-argument ones
        return lambda i: F.array_join(F.slice(t, i + 1, n), " ")

    parts = []
    for n in range(n_min, n_max + 1):
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, gram(n)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def normalise_text(s, clean: bool = False) -> Column:
    """X11: lower-case and split on single spaces.

    ``clean=False`` (default) is the reference's actual behaviour: the
    symbol/digit-stripped list is computed and then overwritten, so the raw
    split survives.  ``clean=True`` applies X5 to each token, the apparent
    intent.  Stemming is applied by the caller (vocabulary job, X9).
    """
    toks = split_space(F.lower(_c(s)))
    if clean:
        toks = F.transform(toks, lambda x: strip_symbols_digits(x))
    return toks
