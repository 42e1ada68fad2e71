"""URL filters: path rules first, then a logistic regression on hashed character n-grams.  DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.functions.bind import let

BUCKETS = 1024
GRAMS = (3, 4)
EPOCHS = 20
RATE = 0.4
DECAY = 1e-4

# Host words of the labelled table, general words of the two kinds; none is a host of the pages tables.  Each is spelled out as several
# URLs by `labelled_urls`, in domains and paths that are the same for both labels.
UNWANTED = [
    "poker-casino", "casino", "betting-tips", "sport-bets", "lottery-win", "slot-machine", "viagra-shop", "diet-pills", "pharmacy-pills", "cheap-watches",
    "adult-chat", "adult-dating", "porn-tube", "xxx-cams", "spam-blaster", "seo-farm", "ads-server", "ad-tracker", "click-ads", "free-money",
    "free-ringtones", "win-iphone", "payday-loans", "replica-bags", "crack-serials", "popup-ads", "gambling", "track-pixel", "spamming", "content-farm",
]
WANTED = [
    "library", "weather", "museum", "recipes", "garden", "history", "science", "travel", "schools", "harbour", "theatre", "council",
    "railway", "algebra", "storms", "tribune", "poetry", "bibliotheque", "wetterdienst", "universidad", "nationalpark", "orchestra",
    "voices", "dictionary", "city-hall", "open-data", "handwerk", "hospital", "public-radio", "river-trust",
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table ``url, label`` (1: unwanted): each host word with a few prefixes, domains and paths."""
    forms = [("http://{}.test/a/{}", 11), ("https://www.{}.invalid/news/{}.html", 24), ("https://{}.co.test/item/{}/", 35), ("http://shop.{}.invalid/p/{}", 47)]
    rows = [(form.format(word, n * 7 + i), label) for words, label in ((UNWANTED, 1), (WANTED, 0)) for i, word in enumerate(words) for form, n in forms]
    return spark.sql("select * from values " + ", ".join(f"('{u}', {y})" for u, y in rows) + " as t(url, label)")


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.  Path: from there up to ``?``,
    ``#`` or the end.  Both are empty for null and where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return _lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def buckets(host: Column, path: Column, size: int = BUCKETS) -> Column:
    """Bucket numbers of the character n-grams of host and path, each with its part as a mark; a gram as often as it occurs."""
    def grams(text: Column, n: int, mark: str) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), text.substr(i, F.lit(n))), F.lit(size)).cast("int"))

    marked = [(F.concat(F.lit("^"), host, F.lit("$")), "h"), (F.concat(path, F.lit("$")), "p")]
    return F.concat(*[grams(text, n, mark) for text, mark in marked for n in GRAMS])


def train(labelled: DataFrame, size: int = BUCKETS, epochs: int = EPOCHS) -> list[float]:
    """Weights of the regression (the last one is the bias), fitted by stochastic descent in one row.

    The labelled table is small by contract: it is gathered into one array, ordered by hash, and an ``aggregate``
    runs over it once per epoch.  Rows without a label are left out; an empty table gives zero weights (probability 1/2).
    """
    host, path = host_and_path(F.col("url"))
    grams = labelled.where(F.col("label").isNotNull()).select("url", "label", buckets(host, path, size).alias("b"))
    counts = F.aggregate("b", F.array_repeat(F.lit(0.0), size), lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)))
    unit = let(counts, lambda c: let(F.sqrt(F.aggregate(c, F.lit(1.0), lambda a, v: a + v * v)), lambda n: F.concat(F.transform(c, lambda v: v / n), F.array(F.lit(1.0)))))
    rows = grams.select(F.struct(F.xxhash64("url").alias("k"), F.col("label").cast("double").alias("y"), unit.alias("x")).alias("e"))
    one = rows.agg(F.sort_array(F.collect_list("e")).alias("es"))

    def step(w: Column, e: Column) -> Column:
        margin = F.aggregate(F.zip_with(w, e["x"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return let(F.lit(RATE) * (e["y"] - 1.0 / (1.0 + F.exp(-margin))), lambda g: F.zip_with(w, e["x"], lambda a, b: a * (1.0 - RATE * DECAY) + g * b))

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), F.array_repeat(F.lit(0.0), size + 1), lambda w, _: F.aggregate("es", w, step))
    return list(one.select(fitted.alias("w")).first()[0])


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that a URL is unwanted."""
    size = len(weights) - 1
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")

    def score(b: Column) -> Column:
        dot = F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(w, i))
        # Norm of the count vector with the bias as one more entry: ranks of equal buckets are counted by array order.
        squares = F.aggregate(F.array_sort(b), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(1.0).alias("sum")),
                              lambda a, i: F.struct(i.alias("last"), F.when(i == a["last"], a["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
                                                    F.when(i == a["last"], a["sum"] + 2.0 * a["run"] + 1.0).otherwise(a["sum"] + 1.0).alias("sum")))["sum"]
        return 1.0 / (1.0 + F.exp(-(dot / F.sqrt(squares) + F.lit(weights[-1]))))

    return let(buckets(host, path, size), score)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule ``(action, host, path)`` that fits, as ``struct(n, rule, action)``; null if none does.

    A rule fits its host and all subdomains if the path of the URL starts with the path of the rule.  Of two rules
    of one length, the one later in the alphabet counts.
    """
    def fits(a: str, h: str, p: str) -> Column:
        here = (host == h) | host.endswith("." + h)
        text = h + p
        return F.when(here & path.startswith(p), F.struct(F.lit(len(text)).alias("n"), F.lit(text).alias("rule"), F.lit(a).alias("action")))

    found = [fits(*r) for r in rules]
    if not found:
        return F.lit(None).cast("struct<n:int,rule:string,action:string>")
    return found[0] if len(found) == 1 else F.greatest(*found)


def filter_urls(df: DataFrame, url: str, rules: list[tuple[str, str, str]], weights: list[float]) -> DataFrame:
    """``df`` with ``host, path, rule, probability, verdict``; one narrow pass, one row out for each row in.

    The verdict is the action of the longest fitting rule, else ``block`` where the regression gives 1/2 or more.
    Null or empty URLs and URLs without ``://`` have an empty host and path, fit no rule and are judged by the
    regression on what is left.  Columns of those names in ``df`` are replaced; all others stay.
    """
    host, path = host_and_path(F.col(url))
    # Named apart first, so that a clash with the input's own columns cannot change what is read.
    out = df.withColumns({"__host": host, "__path": path})
    out = out.withColumns({"__rule": rule_of(F.col("__host"), F.col("__path"), rules), "__p": probability(F.col("__host"), F.col("__path"), weights)})
    verdict = F.coalesce(F.col("__rule.action"), F.when(F.col("__p") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule.rule"), "probability": F.col("__p"), "verdict": verdict}).drop("__host", "__path", "__rule", "__p")
