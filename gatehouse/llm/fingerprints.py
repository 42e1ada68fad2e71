"""Document fingerprints by consistent weighted sampling.  DataFrame functions only.

For each sample number, every weighted term of a text draws from its own hash: r and c from Gamma(2, 1) and b uniform.  With
t = floor(ln w / r + b), its value is ln a = ln c - r (t - b + 1); the term with the least value is the sample.  The same term and weight
range give the same value in every text, so two texts have equal samples with a probability of their generalised Jaccard similarity,
sum of min(w) over sum of max(w).  The least value itself names the sample: it depends on term and t only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.llm.arrow import quoted
from gatehouse.llm.storage import stored

SAMPLES = 24
# Characters of a sample in the fingerprint, hexadecimal.
DIGITS = 8
# A word weighs its count times its length beyond this many characters (half a character at least): function words are short.
SHORT = 3
MOST_RANGES = 4096


def _uniform(h: Column, at: int, bits: int) -> Column:
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of a term, given as a hash, for sample number ``k``."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    # The sum of two exponential draws is Gamma(2, 1).
    r = -F.log(_uniform(one, 0, 21) * _uniform(one, 21, 21))
    c = -F.log(_uniform(two, 0, 21) * _uniform(two, 21, 21))
    b = _uniform(two, 42, 22)
    t = F.floor(log_weight / r + b)
    return F.log(c) - r * (t - b + 1.0)


def weighted_terms(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """``by..., term, w``: words (runs of non-space, in lower case) as hashes, with their weights."""
    words = texts.select(*by, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word")).where("word <> ''")
    keyed = words.select(*by, F.xxhash64("word").alias("term"), F.greatest(F.length("word") - SHORT, F.lit(0.5)).alias("unit"))
    return keyed.groupBy(*by, "term").agg(F.sum("unit").alias("w"))


def signatures(texts: DataFrame, by: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row for each value of ``by``: the samples as an array of strings; texts without words have no row.

    Keeps the partitioning of ``texts`` if that is by ``by`` or a part of it: no text or term is shuffled then.
    """
    terms = weighted_terms(texts, by, text).withColumn("lw", F.log("w"))
    least = terms.groupBy(*by).agg(*[F.min(sample_value(F.col("term"), F.col("lw"), k)).alias(f"m{k}") for k in range(samples)])
    as_text = [F.substring(F.lower(F.lpad(F.hex(F.xxhash64(f"m{k}")), 16, "0")), 1, DIGITS) for k in range(samples)]
    return least.select(*by, F.array(*as_text).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike, one such text is like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a).cast("double")
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``id``) and ``range``: the number of cut points that are not above the id; null ids are in the lowest range.

    The cut points are quantiles of the ids: a bounded list of numbers, four for each shuffle partition, at most MOST_RANGES.
    """
    wanted = min(MOST_RANGES, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("id", [k / wanted for k in range(1, wanted)], 20 * wanted)).first()[0]
    points = F.from_json(F.lit(str(sorted(set(cuts or [])))), "array<bigint>")
    return rows.withColumn("range", F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.size(F.filter(points, lambda p: p <= F.col("id")))))


def with_next(rows: DataFrame) -> DataFrame:
    """``row, id, text, range`` with ``next_row, next_text``: the next row in descending order of ``id`` (then of ``row``); after the
    last comes the first.  Null ids are least.

    One shuffle of the rows, by range: a window runs inside each range, and the last row of a range is followed by the first one
    of the range below it.  The result is partitioned by ``range``.
    """
    key = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "row")
    tops = rows.groupBy("range").agg(F.max(key).alias("top")).select("range", F.col("top.row").alias("row"))
    around = Window.orderBy(F.desc("range"))  # one row a range
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = stored(tops.select("range", F.coalesce(F.lead("row").over(around), F.first("row").over(whole)).alias("row")), "first-rows")
    follow = rows.select("row", "text").join(below, "row").select("range", F.col("row").alias("below_row"), F.col("text").alias("below_text"))
    inside = Window.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), F.col("row").desc())
    linked = rows.select("row", "id", "text", "range", F.lead("row").over(inside).alias("lead_row"), F.lead("text").over(inside).alias("lead_text"))
    return linked.join(follow, "range").select("row", "id", "text", "range", F.coalesce("lead_row", "below_row").alias("next_row"), F.coalesce("lead_text", "below_text").alias("next_text"))


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and of how alike they are; one row for each row of ``docs``.

    The edited text: the last floor(n / 2) characters replaced by as many of the first characters (or all) of the next document in
    descending order of the key, a whole number.  Returns the key, ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  Null texts count as empty; texts without words have an empty fingerprint.  Rows with equal keys are ordered
    by their place in the table; null keys come last.  A single document is its own next.

    ``docs`` is read several times and rows are numbered by their place: it must be a stored table, or else give the same rows in
    the same partitions each time.
    """
    rows = in_ranges(docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(key)).cast("long").alias("id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    pairs = with_next(rows)
    forms = F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("text")), F.struct(F.lit(1).alias("form"), edited.alias("text"))))
    prints = signatures(pairs.select("range", "row", "id", forms.alias("v")).select("range", "row", "v.form", "v.text"), ["range", "row", "form"], samples=samples)
    two = prints.groupBy("range", "row").agg(*[F.max(F.when(F.col("form") == k, F.col("samples"))).alias(name) for k, name in enumerate("ab")])
    facts = pairs.select("range", "row", "id", "next_row", F.length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    done = stored(facts.join(two, ["range", "row"], "left").drop("range"), "fingerprints")
    out = done.join(done.select(F.col("row").alias("next_row"), F.col("a").alias("c")), "next_row")
    joined = lambda c: F.coalesce(F.array_join(c, ""), F.lit(""))
    return out.select(F.col("id").alias(key), "n_chars", "edited_sha256", joined("a").alias("fingerprint"), joined("b").alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
