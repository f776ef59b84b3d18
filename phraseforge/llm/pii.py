"""Personal data (operator 12): proposed by pattern, confirmed by checksum, scored by context.

One pass over each text, in DataFrame functions only:

1. A regular expression per kind proposes matches.  The text between them gives
   their places and the words beside them; only lengths, digits that a validator
   needs and what the context says leave the row.
2. Validators confirm a match: digits of a card by Luhn, of an IBAN by mod 97,
   parts of an address by their size, digits of a phone number by their number.
3. A kind's score starts from its pattern, and rises with a confirmed checksum
   and with words of the kind near by; words that name other numbers lower it.
   The base kinds are decided by their patterns and validators alone; the added
   kinds need the score, and go where they overlap a base span.

The patterns take the same matches as the plain ones in ``BASE``, but never try
a run of characters twice, so a text's cost is in proportion to its length.

Defined results: null and empty texts have no spans; rows are judged one by one,
whatever their doc_id (null or repeated); ties cannot occur within a kind; texts
of any length are processed whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseforge.llm.common import text_or_empty

_LOCAL = "[A-Za-z0-9._%+-]"
_ALONE, _ENDS = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

#: Plain patterns of the kinds that every valid match of is personal data.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches, without a second try inside a run.
_LINEAR = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE["phone"],
}
#: Kinds that need a checksum or words near by.
ADDED = {
    "iban": _ALONE + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?" + _ENDS,
    "ssn": _ALONE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _ENDS,
    "local_phone": r"\(?" + _ALONE + r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}" + _ENDS,
}
KINDS = [*BASE, *ADDED]

#: Score of a valid match without context; what context adds or takes; the score an added kind needs.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.4, "local_phone": 0.4}
CONTEXT, THRESHOLD = 0.3, 0.6
#: Code points before and after a match that are searched for words.
BEFORE, AFTER = 40, 20
#: Words near a match that speak for its kind (in the corpus' languages), and against any kind.
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel|write to",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|karte|tarjeta|carte|visa|mastercard|payment|paid",
    "phone": "phone|tel|call|mobile|fax|telefon|ruf|móvil|llam|appel",
    "iban": "iban|account|konto|cuenta|compte|bank",
    "ssn": "ssn|social security|tax|taxpayer",
    "local_phone": "phone|tel|call|mobile|fax|telefon|ruf|móvil|llam|appel",
}
AGAINST = "isbn|version|order no|invoice no|serial no"


def _proposals(kind: str, pattern: str) -> Column:
    """What is needed of the text around each match of a kind, in order; one more
    entry, without a match, for the text after the last one."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    around = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), found.alias("match"))

    def entry(x: Column, i: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), x["match"].alias("match"), F.char_length(x["gap"]).alias("gap"),
                        F.left(x["gap"], F.lit(AFTER)).alias("head"), F.right(x["gap"], F.lit(BEFORE)).alias("tail"))

    return F.when(F.size(found) > 0, F.transform(around, entry))


def _luhn(digits: Column) -> Column:
    """Digits (19 at most) from the right, every second one doubled and its digits added."""
    back = F.rpad(F.reverse(digits), 19, "0")
    doubled = F.translate(back, "0123456789", "0246813579")
    total = F.lit(0)
    for k in range(19):
        total = total + F.substring(doubled if k % 2 else back, k + 1, 1).cast("int")
    return total % 10 == 0


def _mod97(iban: Column) -> Column:
    """Its first four characters moved to the end, letters as 10 to 35: 1 modulo 97."""
    chars = F.filter(F.split(F.concat(F.expr("substring(plain, 5)"), F.left(iban, F.lit(4))), ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        return F.when(c >= "A", (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + c.cast("int")) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def _is(kind: str) -> Column:
    return F.col("kind") == KINDS.index(kind)


def _valid() -> Column:
    """Whether a match stands the checks of its kind; ``plain`` is the match without separators."""
    n = F.char_length("plain")
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (F.when(_is("email"), True)
            .when(_is("ip"), F.col("match").rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(_is("card"), F.when(n.between(13, 19), _luhn(F.col("plain"))).otherwise(False))
            .when(_is("phone"), n.between(9, 15))
            .when(_is("iban"), F.when(n.between(15, 34), _mod97(F.col("plain"))).otherwise(False))
            .when(_is("ssn"), ~F.col("match").rlike("^(?:000|666|9)|-00-|-0000$"))
            .when(_is("local_phone"), True))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row: kind, start, end (code points, end exclusive) and
    score, by kind as in ``KINDS``, then start."""
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    patterns = _LINEAR | ADDED
    none = F.array().cast("array<struct<kind:int,nth:int,match:string,gap:int,head:string,tail:string>>")
    found = F.concat(*[F.coalesce(_proposals(k, patterns[k]), none) for k in KINDS])
    found = rows.select("doc_id", "row", F.explode_outer(found).alias("f")).select("doc_id", "row", "f.*")
    found = found.withColumn("plain", F.translate("match", " -().+", ""))
    near = F.lower("tail")
    hints = F.coalesce(*[F.when(_is(k), near.rlike(w)) for k, w in WORDS.items()])
    # nothing of the text but the few code points after a match goes on from here
    found = found.select("doc_id", "row", "kind", "nth", "gap", F.char_length("match").alias("n"), F.lower("head").alias("head"),
                         hints.alias("hint"), near.rlike(AGAINST).alias("against"), F.when(F.col("match").isNotNull(), _valid()).alias("valid"))
    found = found.repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("nth")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.coalesce("n", F.lit(0))).over(upto)
    after = F.lead("head").over(order)
    found = found.select("doc_id", "row", "kind", "valid", (end - F.col("n")).alias("start"), end.alias("end"), "hint", "against", after.alias("after"))
    hint = F.col("hint") | F.coalesce(*[F.when(_is(k), F.col("after").rlike(w)) for k, w in WORDS.items()])
    score = F.coalesce(*[F.when(_is(k), F.lit(s)) for k, s in SCORES.items()])
    score = score + F.when(hint, CONTEXT).otherwise(0.0) - F.when(F.col("against"), CONTEXT).otherwise(0.0)
    base = F.col("kind") < len(BASE)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)
    found = found.select("doc_id", "row", "kind", "start", "end", score.alias("score"), base.alias("base"),
                         (F.col("valid") & (base | (score >= THRESHOLD))).alias("stays"))
    # an added span goes where it meets a base span
    place = Window.partitionBy("row").orderBy("start", "kind")
    sure = F.col("base") & F.col("stays")
    before = F.max(F.when(sure, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(sure, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    meets = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False))
    found = found.withColumn("stays", F.col("stays") & (F.col("base") | ~meets))
    spans = F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("kind", "start", "end", "score"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), spans.alias("s"))
    return found.select("doc_id", F.transform("s", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"),
                                                                     s["end"].alias("end"), s["score"].alias("score"))).alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as one string."""
    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
