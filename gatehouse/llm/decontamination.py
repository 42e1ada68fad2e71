"""Benchmark decontamination with a positional inverted index.  DataFrame functions only.

The index holds one posting ``(row, pos, term)`` for every word of every training document, written once, sorted by term within each of
its files; so the files are shards by document and a term is found by its file statistics.  A test phrase is looked up from
its rarest term: the postings of that term, less its offset in the phrase, are the places where the phrase could start; the other terms' lists,
less their offsets, are intersected with those.  Lists of frequent terms are only read for documents that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.llm.arrow import quoted
from gatehouse.llm.storage import stored

WINDOW = 13
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z in lower case; words are runs of anything but ASCII signs, spaces and controls.  Null has no words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Of ASCII text, `lower` changes nothing else and is much faster than `translate`.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of whole texts, written and read back: ``row, pos, term, doc, n_words``.

    ``row`` numbers the rows of ``docs``, so repeated keys and repeated rows stay apart.  Each row of ``docs`` also has one
    posting without a term, which alone carries its key and its number of words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(key)).alias("doc"), words(F.col(quoted(text))).alias("w"))
    tagged = rows.select("row", "doc", F.concat(F.array(F.lit(None).cast("string")), "w").alias("w"))
    flat = tagged.select("row", "doc", F.size("w").alias("size"), F.posexplode("w").alias("pos", "term"))
    head = F.col("term").isNull()
    postings = flat.select("row", F.col("pos").cast("int").alias("pos"), "term", F.when(head, F.col("doc")).alias("doc"), F.when(head, F.col("size") - 1).cast("long").alias("n_words"))
    return stored(postings.sortWithinPartitions("term"), "postings", compression="zstd")


def documents_of(index: DataFrame) -> DataFrame:
    return index.where("term is null").select("row", "doc", "n_words")


def phrase_terms(phrases: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Words of the test phrases, written and read back: ``item, name, size, at, term``.

    ``name`` is the key as text ('' for null).  Phrases of equal name and words are one; null and empty ones have no words.
    """
    lists = phrases.select(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")).alias("name"), words(F.col(quoted(text))).alias("w")).where("size(w) > 0").distinct()
    numbered = lists.select(F.xxhash64("name", "w").alias("item"), "name", "w")
    return stored(numbered.select("item", "name", F.size("w").alias("size"), F.posexplode("w").alias("at", "term")), "phrase-terms")


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: how often each test term occurs in the index; absent terms have no row."""
    wanted = terms.select("term").distinct()
    return stored(index.where("term is not null").select("term").join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), "term-frequencies")


def _windows(terms: DataFrame, window: int) -> DataFrame:
    """One row for each term of each window: ``item, start, at, term``.  A phrase shorter than the window is one window."""
    last = F.greatest(F.col("size") - window, F.lit(0))
    first = F.greatest(F.col("at") - (window - 1), F.lit(0))
    return terms.withColumn("start", F.explode(F.sequence(first, F.greatest(F.least(F.col("at"), last), first)))).where(F.col("start") <= last)


def _rarest(terms: DataFrame, freq: DataFrame, window: int, rank: int) -> DataFrame:
    """``item, at, term`` of the rarest terms (the first ``rank``) of the windows all of whose terms occur at all."""
    rows = _windows(terms, window).join(freq, "term", "left")
    # A window is a bounded group of at most `window` terms.
    spec = Window.partitionBy("item", "start")
    ranked = rows.select("item", "start", "at", "term", F.min(F.coalesce("n", F.lit(0))).over(spec).alias("least"), F.row_number().over(spec.orderBy("n", "at")).alias("k"))
    return ranked.where((F.col("least") > 0) & (F.col("k") <= rank))


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every occurrence of every window of ``window`` consecutive words: ``row, item, name, start`` (of the window in the phrase), ``pos``
    (of its first word in the document), ``width``.

    Exact: words are compared as text, not by hash.
    """
    freq = frequencies(index, terms)
    rare = _rarest(terms, freq, window, 2)
    first = stored(rare.where("k = 1").select("item", "at", "term").distinct(), "rarest-terms")
    # The next rarest term of the windows of an anchor; places where it is missing for all of them are dropped early.
    second = stored(rare.where("k = 1").select("item", "start", "at").join(rare.where("k = 2").select("item", "start", F.col("at").alias("next_at"), F.col("term").alias("next")), ["item", "start"], "left").select("item", "at", "next_at", "next").distinct(), "next-rarest-terms")
    entries = index.where("term is not null").select("row", "pos", "term")
    places = stored(entries.join(first, "term").select("row", "item", "at", (F.col("pos") - F.col("at")).alias("shift")), "places")
    asked = places.join(second, ["item", "at"])
    alone = asked.where("next is null").select("row", "item", "shift")
    both = asked.where("next is not null").select("row", "item", "shift", (F.col("shift") + F.col("next_at")).alias("pos"), F.col("next").alias("term"))
    nexts = entries.join(second.select(F.col("next").alias("term")).distinct(), "term", "left_semi")
    aligned = stored(both.join(nexts, ["row", "pos", "term"], "left_semi").select("row", "item", "shift").unionByName(alone).distinct(), "alignments")
    # All terms of the phrase at each alignment, against the postings of the documents that are left.
    rows = stored(aligned.select("row").distinct(), "aligned-rows")
    left = entries.join(terms.select("term").distinct(), "term", "left_semi").join(rows, "row", "left_semi")
    probes = aligned.join(terms.select("item", "at", "term"), "item").select("row", "item", "shift", "at", "term", (F.col("shift") + F.col("at")).alias("pos"))
    met = probes.join(left, ["row", "pos", "term"], "left_semi").groupBy("row", "item", "shift").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    names = terms.where("at = 0").select("item", "name", "size")
    sized = met.join(names, "item").withColumn("width", F.least(F.col("size"), F.lit(window)))
    # A run of `width` met offsets is an occurrence of the window that starts there.
    runs = F.filter("ats", lambda a, i: F.get("ats", i + F.col("width") - 1) == a + F.col("width") - 1)
    return sized.select("row", "item", "name", "shift", "width", F.explode(runs).alias("start")).select("row", "item", "name", "start", (F.col("shift") + F.col("start")).alias("pos"), "width")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row for each row of ``docs``: its key, ``n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in an occurrence of a window of any item; a document is contaminated if a word is hit and hit words are at
    least one in ``share``.  Null and empty texts have no words and are clean; repeated rows are judged one by one;
    without items all documents are clean.
    """
    index = build_index(docs, key, text)
    found = phrase_matches(index, phrase_terms(items, item_key, item_text), window)
    # Positions fall together before they are counted: a word lies in up to `window` windows and in several items.
    spots = stored(found.select("row", "name", "pos", "width").distinct(), "occurrences")
    hit = spots.select("row", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("width") - 1)).alias("p")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = spots.select("row", "name").distinct().groupBy("row").agg(F.array_sort(F.collect_list("name")).alias("names"))
    of = named.join(hit, "row").select("row", "n_hit", F.size("names").cast("long").alias("n_items"), F.array_join("names", ",").alias("names"))
    out = documents_of(index).join(of, "row", "left").select(F.col("doc").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """``row, item, name, pos``: places where all words of a phrase occur, in any order, within its length plus ``slop`` words.

    ``pos`` is the first word of such a stretch, itself a word of the phrase.  A word that the phrase repeats is asked for once.
    """
    freq = frequencies(index, terms)
    span = terms.groupBy("item", "name").agg(F.max("size").alias("size"), F.countDistinct("term").alias("kinds")).withColumn("span", F.col("size") + slop)
    kinds = terms.select("item", "term").distinct()
    counted = kinds.join(freq, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = counted.groupBy("item").agg(F.min(F.struct("n", "term")).alias("r")).where("r.n > 0").select("item", F.col("r.term").alias("term"))
    entries = index.where("term is not null").select("row", "pos", "term")
    anchors = stored(entries.join(rare, "term").join(span, "item").select("row", "item", "name", "span", "kinds", F.col("pos").alias("anchor")), "anchors")
    pairs = anchors.select("row", "item", "span").distinct()
    near = entries.join(kinds, "term").join(pairs, ["row", "item"]).withColumn("cell", F.floor(F.col("pos") / F.col("span")))
    # Whatever shares a stretch with an anchor lies in its cell of `span` words or in one beside it.
    cells = anchors.withColumn("cell", F.explode(F.array(*[F.floor(F.col("anchor") / F.col("span")) + d for d in (-1, 0, 1)])))
    around = cells.join(near.select("row", "item", "cell", "pos", "term"), ["row", "item", "cell"]).where(F.abs(F.col("pos") - F.col("anchor")) < F.col("span"))
    # At most two spans of postings for each anchor.
    lists = around.groupBy("row", "item", "name", "span", "kinds", "anchor").agg(F.collect_set(F.struct("pos", "term")).alias("ps"))

    def whole(start: Column) -> Column:
        inside = F.filter("ps", lambda p: (p["pos"] >= start["pos"]) & (p["pos"] < start["pos"] + F.col("span")))
        return (start["pos"] <= F.col("anchor")) & (F.size(F.array_distinct(F.transform(inside, lambda p: p["term"]))) == F.col("kinds"))

    return lists.select("row", "item", "name", F.explode(F.transform(F.filter("ps", whole), lambda p: p["pos"])).alias("pos")).distinct()
