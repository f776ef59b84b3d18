"""Dictionary phrases, phrase positions and redundancy.

Contiguous-match search (X16) is an equi-join on an *anchor*: an n-gram of
``min(len(pattern), 3)`` tokens, the rarest of each pattern, against the n-grams
of every text, followed by a comparison of the whole pattern.  That finds
every (overlapping) occurrence -- what the reference's Knuth-Morris-Pratt loop
does per pair -- without pairing every text with every pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseforge.functions.text import delete_punctuation, printable_only, py_strip, split_nonempty
from phraseforge.operators.blocks import Lists, dealt, flat, gram_texts, grams, map_blocks, one_batch, rewrite_words
from phraseforge.operators.frequent import BROADCAST_BYTES
from phraseforge.session import materialize

ANCHOR = 3  # tokens of a pattern used as its join key
PATTERN_BYTES = 8 << 20  # patterns of no more text go to every task
PLACES = 1 << 20  # places that are compared at once
SHORT = 8  # phrases of more tokens are looked for as text, not in sets of n-grams


def dictionary_phrases(lines: DataFrame, stopwords: DataFrame | None = None, stem_map: DataFrame | None = None,
                       line_col: str = "line") -> DataFrame:
    """Dictionary lines -> ``(phrase)``.

    A line is lower-cased and stripped; a line that is itself a stopword is
    dropped whole; tokens longer than 2 characters keep printable characters
    only (shorter ones are kept as they are); tokens are joined by one space.
    The reference stems twice here (once per token, again when the trie is
    built); with ``stem_map`` both passes are applied."""
    s = lines.select(F.lower(py_strip(F.col(line_col))).alias("line"))
    if stopwords is not None:
        s = s.join(stopwords.select(F.col("word").alias("line")), "line", "left_anti")
    toks = F.transform(split_nonempty("line", "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F]+"),
                       lambda t: F.when(F.length(t) > 2, printable_only(t)).otherwise(t))
    s = s.select(toks.alias("toks")).where(F.size("toks") > 0)
    if stem_map is not None:
        s = _stem_tokens(_stem_tokens(s, stem_map), stem_map)
    return s.select(F.array_join("toks", " ").alias("phrase")).distinct()


def _stem_tokens(df: DataFrame, stem_map: DataFrame) -> DataFrame:
    """Replace every token of ``toks`` by its stem through a join on the
    (doc-independent) vocabulary table; order is kept by position."""
    m = stem_map.select("token", "stem")
    rid = df.withColumn("_rid", F.monotonically_increasing_id())
    ex = rid.select("_rid", F.posexplode("toks").alias("i", "token")).join(m, "token", "left")
    back = ex.groupBy("_rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("stem", "token").alias("s")))),
                                              lambda x: x["s"]).alias("toks"))
    return back


def document_terms(docs: DataFrame, stopwords: DataFrame | None = None, stem_map: DataFrame | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Document side of M6: lower-case, delete punctuation (X6), split on
    white space, stem, drop stopwords.  Returns (block, doc_id, terms); only the distinct
    words of each block of documents meet the stems and stopwords."""
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = dealt(d, F.octet_length("text"), "doc_id", "text")
    toks = split_nonempty(delete_punctuation(F.lower("text")), "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F]+")

    def kept(words: DataFrame) -> DataFrame:
        if stem_map is None:
            words = words.withColumn("term", F.col("word"))
        else:
            words = words.join(stem_map.select(F.col("token").alias("word"), "stem"), "word", "left").withColumn("term", F.coalesce("stem", "word"))
        return words if stopwords is None else words.join(stopwords.select(F.col("word").alias("term")), "term", "left_anti")

    return rewrite_words(d.select("block", "doc_id", toks.alias("toks")), kept)


def _small(table: DataFrame, *keys: str) -> DataFrame:
    """``table``, written already, marked to be sent to every task if it is measured to be small."""
    size = table.agg(F.sum(sum((F.octet_length(k) for k in keys), F.lit(16 + 16 * len(table.columns))))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def dictionary_matches(docs: DataFrame, dictionary: DataFrame, stopwords: DataFrame | None = None,
                       stem_map: DataFrame | None = None, n_min: int = 1, n_max: int = 3) -> DataFrame:
    """M6 (J8 + W5): every 1- to 3-gram of a document's kept terms that is a
    dictionary phrase, duplicates kept; ordered by n, then position.

    Returns (doc_id, n, pos, phrase).  The n-grams are made where they are looked up: the
    dictionary goes to every task if it is measured to be small."""
    import numpy as np
    import pyarrow as pa

    terms = document_terms(docs, stopwords, stem_map)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists, parts = Lists(rows.column(1), rows.column(2)), []
        for n, at, _ in grams(lists.words, lists.doc, n_min, n_max):
            parts.append(pa.table({"doc_id": lists.ids.take(pa.array(lists.doc[at])), "n": pa.array(np.full(len(at), n, np.int32)),
                                   "pos": pa.array(lists.pos[at], pa.int32()), "phrase": gram_texts(lists.words, at, n)}))
        return one_batch(pa.concat_tables(parts), "doc_id", "n", "pos", "phrase")

    kind = terms.schema["doc_id"].dataType.simpleString()
    found = map_blocks(terms, run, f"doc_id {kind}, n int, pos int, phrase string", lambda rows: rows)
    return found.join(_small(materialize(dictionary.select("phrase")), "phrase"), "phrase", "left_semi").select("doc_id", "n", "pos", "phrase")


def _grams(toks: str, size: Column) -> Column:
    """Structs (at, a, gram) of the n-grams of an array at every place: n is ``size``; null for a shorter array."""
    grams = F.transform(F.sequence(F.lit(0), F.size(toks) - size), lambda i: F.struct(
        i.alias("at"), size.alias("a"), F.array_join(F.slice(toks, i + 1, size), " ").alias("gram")))
    return F.when(F.size(toks) >= size, grams)


def _anchors(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pid, a, gram, offset): each pattern's rarest n-gram in the texts, by measured
    counts; the first of equally rare ones."""
    own = patterns.select("pid", F.explode(_grams("ptoks", F.least(F.size("ptoks"), F.lit(ANCHOR)))).alias("g")).select("pid", "g.*")
    wanted = materialize(own.select("a", "gram").distinct())
    found = texts.select(F.explode(_all_grams("toks", _sizes(wanted))).alias("g")).select("g.a", "g.gram").join(_small(wanted, "gram"), ["a", "gram"], "left_semi")
    # a gram that no text holds is the best anchor of all
    counts = found.groupBy("a", "gram").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("at"), F.col("a"), F.col("gram")))
    return (own.join(counts, ["a", "gram"], "left").groupBy("pid").agg(best.alias("b"))
            .select("pid", "b.a", "b.gram", F.col("b.at").alias("offset")))


def _sizes(anchors: DataFrame) -> list[int]:
    """The sizes that occur among the anchors, from 1 to ANCHOR."""
    return sorted(r["a"] for r in anchors.select("a").distinct().collect())


def _all_grams(toks: str, sizes: list[int]) -> Column:
    """The structs of all n-grams an anchor may be."""
    none = F.array().cast("array<struct<at:int,a:int,gram:string>>")
    return F.flatten(F.array(*[F.coalesce(_grams(toks, F.lit(a)), none) for a in sizes or [1]]))


def _matches_in_blocks(texts: DataFrame, patterns: DataFrame, key: str | None) -> DataFrame:
    """:func:`contiguous_matches` for few patterns: every block of texts looks up each
    pattern by its rarest token there and compares the others, so that no text and no candidate
    leaves its task.  A long pattern's match counts once for every pair of rows of its
    text's and pattern's ids that hold it, as in the join of candidates and texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = patterns.select("pid", "ptoks", *([key] if key else [])).toArrow().combine_chunks()
    pids, (ptoks, sizes) = table.column("pid").combine_chunks(), flat(one_batch(table, "ptoks").column(0))
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    pkeys = table.column(key).combine_chunks() if key else None

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        words, lengths = flat(rows.column(2))
        doc, begin = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        pcode = pc.fill_null(pc.index_in(ptoks, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
        by_code, counts = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(coded.dictionary))
        # each pattern's rarest token, the first of equally rare ones; none has a token that is not there
        n = np.where(pcode < 0, 0, counts[pcode])
        rarest = np.lexsort((np.arange(len(n)), n, of))[starts]
        some = np.flatnonzero(n[rarest])
        first, share = (np.cumsum(counts) - counts)[pcode[rarest[some]]], np.cumsum(n[rarest[some]]) // PLACES
        found = []
        for s in np.unique(share):
            these, at = some[share == s], first[share == s]
            c = n[rarest[these]]
            pattern = np.repeat(these, c)
            place = by_code[np.repeat(at - np.cumsum(c) + c, c) + np.arange(len(pattern))] - np.repeat(rarest[these] - starts[these], c)
            fits = (place >= 0) & (place + sizes[pattern] <= len(code))
            pattern, place = pattern[fits], place[fits]
            fits = doc[place] == doc[place + sizes[pattern] - 1]
            if key:
                tkey = rows.column(1).dictionary_encode()
                pkey = pc.fill_null(pc.index_in(pkeys, value_set=tkey.dictionary, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
                fits &= pc.fill_null(tkey.indices, -2).to_numpy(zero_copy_only=False)[doc[place]] == pkey[pattern]
            pattern, place = pattern[fits], place[fits]
            j = 0
            while len(pattern):
                whole = sizes[pattern] == j
                found.append((pattern[whole], place[whole]))
                pattern, place = pattern[~whole], place[~whole]
                same = code[place + j] == pcode[starts[pattern] + j]
                pattern, place, j = pattern[same], place[same], j + 1
        pattern, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        out = [rows.column(0).take(pa.array(doc[place])), pids.take(pa.array(pattern)), pa.array((place - begin[doc[place]]).astype(np.int32)),
               pa.array(sizes[pattern].astype(np.int32)), rows.column(1).take(pa.array(doc[place]))]
        return pa.record_batch(out, ["tid", "pid", "pos", "size", "key"])

    t = texts.where(F.size("toks") > 0).select("tid", (F.col(key) if key else F.lit(None).cast("int")).alias("key"), "toks")
    tid, pid, kind = (x.schema[c].dataType.simpleString() for x, c in ((t, "tid"), (patterns, "pid"), (t, "key")))
    found = map_blocks(t, run, f"tid {tid}, pid {pid}, pos int, size int, key {kind}", lambda rows: rows)
    long = F.col("size") > ANCHOR
    found = found.where(~long | F.col("tid").isNotNull() & F.col("pid").isNotNull()).groupBy("tid", "pid", "pos", "size", "key").agg(F.count(F.lit(1)).alias("c"))
    times = F.when(long, F.col("c") * F.col("c")).otherwise(F.col("c")).cast("int")
    found = found.select("tid", "pid", "pos", "key", F.explode(F.array_repeat(F.lit(0), times)))
    return found.select("tid", "pid", "pos", *([F.col("key").alias(key)] if key else []))


def contiguous_matches(texts: DataFrame, patterns: DataFrame, key: str | None = None) -> DataFrame:
    """All (overlapping) 0-based positions where a pattern's token list
    occurs contiguously in a text's token list.

    ``texts`` is (tid, toks[, key]); ``patterns`` is (pid, ptoks[, key]), one row
    per pattern; with ``key`` only pairs with the same key are searched.  Empty
    patterns match nowhere.  A pattern is looked up by one anchor: its rarest
    n-gram in the texts, at its offset (with ``key``: its first n-gram, as a
    key's texts bound the candidates).  A text's candidates are gathered as
    numbers only -- place, length and a hash of the pattern -- compared in the
    row, and what is left is compared with the pattern itself.  Patterns that are
    measured to be small go to the texts instead (:func:`_matches_in_blocks`).
    Returns (tid, pid, pos[, key])."""
    kc = [key] if key else []
    p = patterns.where(F.size("ptoks") > 0)
    p = materialize(p if key else p.where("pid IS NOT NULL"))
    if (p.agg(F.sum(F.octet_length(F.array_join("ptoks", " ")) + 16)).first()[0] or 0) <= PATTERN_BYTES:
        return _matches_in_blocks(texts, p, key)
    if key:
        first = F.least(F.size("ptoks"), F.lit(ANCHOR))
        p = p.select("pid", *kc, "ptoks", first.alias("a"), F.array_join(F.slice("ptoks", 1, first), " ").alias("gram"), F.lit(0).alias("offset"))
    else:
        p = p.join(_anchors(texts, p), "pid")
    t = texts.select("tid", "toks", *kc).where(F.size("toks") > 0)
    anchors = materialize(p.select("pid", "a", "gram", "offset", *kc, F.size("ptoks").alias("size"), F.xxhash64("ptoks").alias("h")))
    out = t.select("tid", *kc, F.explode(_all_grams("toks", _sizes(anchors))).alias("g")).select("tid", *kc, "g.*")
    # anchors and candidates that are measured to be small go to where the texts are
    cand = out.join(_small(anchors, "gram"), ["a", "gram", *kc]).select("tid", "pid", *kc, (F.col("at") - F.col("offset")).alias("pos"), "size", "h").where("pos >= 0")
    cand = materialize(cand)
    # a pattern no longer than its anchor has matched already
    sure = cand.where(F.col("size") <= ANCHOR).select("tid", "pid", "pos", *kc)
    open_ = cand.where(F.col("size") > ANCHOR).groupBy("tid", *kc).agg(F.collect_list(F.struct("pid", "pos", "size", "h")).alias("c"))
    hit = F.filter("c", lambda x: F.xxhash64(F.slice("toks", x["pos"] + 1, x["size"])) == x["h"])
    if cand.count() * 64 <= BROADCAST_BYTES:
        open_ = F.broadcast(open_)
    hits = open_.join(t, ["tid", *kc]).select("tid", *kc, "toks", F.explode(hit).alias("c"))
    hits = hits.select("tid", *kc, "c.pid", "c.pos", F.expr("slice(toks, c.pos + 1, c.size)").alias("found"))
    checked = hits.join(p.select("pid", "ptoks", *kc), ["pid", *kc]).where(F.col("found") == F.col("ptoks")).select("tid", "pid", "pos", *kc)
    return sure.unionByName(checked)


def _contained(phrases: list[str]) -> list[bool]:
    """Which of one document's distinct phrases occur contiguously inside another one, token-wise."""
    toks = [p.split(" ") for p in phrases]
    size = [len(t) for t in toks]
    grams = {n: set() for n in set(size) if n <= SHORT}
    for t in toks:
        for n, found in grams.items():
            if n < len(t):
                found.update(t if n == 1 else map(" ".join, zip(*(t[j:] for j in range(n)))))
    inside = [n <= SHORT and p in grams[n] for p, n in zip(phrases, size)]
    # phrases of more tokens are few: each is looked for in the text of those that are longer still
    order = sorted((i for i, n in enumerate(size) if n > SHORT), key=lambda i: -size[i])
    text = "\0".join(f" {phrases[i]} " for i in order)
    end, n = {}, 0
    for i in order:
        end.setdefault(size[i], n)
        n += len(phrases[i]) + 3
    for i in order:
        if "\0" in toks[i]:  # the mark between phrases
            inside[i] = any(size[j] > size[i] and f" {phrases[i]} " in f" {phrases[j]} " for j in order)
        else:
            inside[i] = text.find(f" {phrases[i]} ", 0, end[size[i]]) >= 0
    return inside


def _judged(phrases: DataFrame, keep: Callable[[bool, str], bool]) -> DataFrame:
    """(doc_id, phrase): the phrases that ``keep`` (is it inside another phrase of its document,
    phrase) says.  ``phrases`` is (doc_id, phrase) or (doc_id, phrases): all of a document stand
    in one row.  Phrases without a document's id are in none."""
    if "phrases" not in phrases.columns:
        phrases = phrases.groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            places, found = [], []
            for row, (i, names) in enumerate(zip(batch.column(0).is_valid().to_pylist(), batch.column(1))):
                names = names.as_py()
                some = [p for p, inside in zip(names, _contained(names) if i else [False] * len(names)) if keep(inside, p)]
                places += [row] * len(some)
                found += some
            yield pa.record_batch([batch.column(0).take(pa.array(places, pa.int64())), pa.array(found, pa.string())], ["doc_id", "phrase"])

    kind = phrases.schema["doc_id"].dataType.simpleString()
    return phrases.select("doc_id", "phrases").mapInArrow(run, f"doc_id {kind}, phrase string")


def redundant_phrases(phrases: DataFrame) -> DataFrame:
    """M9 / J10 (``isAlreadyPresent``): (doc_id, phrase) -> the phrases that occur
    contiguously inside another phrase of the same document (token-wise)."""
    return _judged(phrases, lambda inside, p: inside)


def in_chunk(phrases: DataFrame) -> DataFrame:
    """J10 (``isInChunk``): as :func:`redundant_phrases`, but a single word counts
    only when a whole phrase equals it, which another phrase never does."""
    return _judged(phrases, lambda inside, p: inside and " " in p)


def redundancy_filter(phrases: DataFrame) -> DataFrame:
    """M9: keep the phrases not contained in another phrase of their document."""
    return _judged(phrases, lambda inside, p: not inside)
