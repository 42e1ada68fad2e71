"""Claims found in generated text: links, citations, percentages, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows, let
from gatehouse.functions.patterns import SPACE_BODY
from gatehouse.operators.findings import claim_verdict, pick
from gatehouse.operators.imports import ECOSYSTEMS, import_entries, with_existence

CLAIM_COLUMNS = ["subject_id", "check_type", "text", "verdict", "confidence", "evidence"]

# Patterns of links and identifiers in text.
_URL_BODY = rf"[^{SPACE_BODY}\"')\]>]"
URL = rf"https?://{_URL_BODY}+"
_DOI = rf"(?<![A-Za-z0-9_])(10\.[0-9]+(?:/{_URL_BODY}*)?)"
_ARXIV = rf"(?i)arXiv:([^{SPACE_BODY}\"')\]>,]+)"
# Anchored at a sentence start: a later start inside the same sentence can match no more than that one,
# and without the anchor every character would start a new search.
_PERCENT_SENTENCE = (r"(?:\A|(?<=[.!?\n]))([^.!?\n]+[0-9]+(?:\.[0-9]+)?%[^.!?\n]*[0-9]+(?:\.[0-9]+)?%[^.!?\n]*[.!?\n])")


def _claims(df: DataFrame, check_type: str | Column, verdict: str | Column, confidence: float | Column, evidence: Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("subject_id", lit(check_type).alias("check_type"), "text", lit(verdict).alias("verdict"),
                     lit(confidence).cast("double").alias("confidence"), evidence.alias("evidence"))


def _explode_all(df: DataFrame, id_col: str, text_col: str, needs: Column, regex: str, group: int) -> DataFrame:
    hits = F.regexp_extract_all(F.col(text_col), F.lit(regex), F.lit(group))
    return explode_rows(df.where(needs), [F.col(id_col).alias("subject_id")], hits, "text")


def citation_format_findings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    doi = _explode_all(df, id_col, text_col, text.contains("10."), _DOI, 1).where(
        ~F.col("text").rlike(rf"^10\.[0-9]{{4,}}/[^{SPACE_BODY}]"))
    arxiv = _explode_all(df, id_col, text_col, text.rlike("(?i)arxiv:"), _ARXIV, 1).where(
        ~F.col("text").rlike(r"\A[0-9]{4}\.[0-9]{4,5}\z") & ~F.col("text").rlike(r"\A[a-z-]+/[0-9]{7}\z"))
    return _claims(doi, "malformed_doi", "FLAG", 0.7, F.lit("DOI lacks four or more digits and a suffix")).unionByName(
        _claims(arxiv.withColumn("text", F.concat(F.lit("arXiv:"), "text")), "malformed_arxiv_id", "FLAG", 0.75,
                F.lit("arXiv identifier is neither YYMM.NNNNN nor category/YYMMNNN")))


def numeric_contradictions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = _explode_all(df, id_col, text_col, F.col(text_col).rlike("%[^%]*%"), _PERCENT_SENTENCE, 1)
    numbers = F.transform(F.regexp_extract_all(F.col("text"), F.lit(rf"([0-9]+(?:\.[0-9]+)?)[{SPACE_BODY}]*%"), F.lit(1)),
                          lambda n: n.cast("double"))
    up = F.col("text").rlike("(?i)increas|improv|grew|better")
    down = F.col("text").rlike("(?i)decreas|fell|worse|reduc")
    judged = found.withColumn("over", F.exists(numbers, lambda n: n > 100)).where(F.col("over") | (up & down)).where(F.size(numbers) >= 2)
    trimmed = F.regexp_replace(F.col("text"), rf"\A[{SPACE_BODY}]+|[{SPACE_BODY}]+\z", "")
    return _claims(judged.withColumn("text", trimmed), "numeric_contradiction", "FLAG", 0.6,
                   F.when(F.col("over"), "percentage above 100").otherwise("increase and decrease wording"))


def extract_urls(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    urls = _explode_all(df, id_col, text_col, F.col(text_col).contains("://"), URL, 0)
    return urls.where(~F.col("text").rlike(r"localhost|127\.0\.0\.1|0\.0\.0\.0"))


def link_status(df: DataFrame, id_col: str, text_col: str, crawl: DataFrame) -> DataFrame:
    """``crawl`` has one row per ``url`` with the last HTTP ``status``; a missing row is an unreachable URL."""
    joined = extract_urls(df, id_col, text_col).join(crawl.select(F.col("url").alias("text"), "status"), "text", "left")
    gone = F.col("status").isin(404, 410)
    bad = joined.where(F.col("status").isNull() | gone)
    return _claims(bad, F.when(gone, "url_not_found").otherwise("url_unreachable"), F.when(gone, "BLOCK").otherwise("FLAG"),
                   F.when(gone, 0.9).otherwise(0.5),
                   F.when(gone, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).otherwise("no response"))


_CANDIDATE = "array<struct<kind:string,text:string,name:string>>"
_DOI_OK = rf"^10\.[0-9]{{4,}}/[^{SPACE_BODY}]"
_ARXIV_OK = r"\A[0-9]{4}\.[0-9]{4,5}\z|\A[a-z-]+/[0-9]{7}\z"
_LOCAL = r"localhost|127\.0\.0\.1|0\.0\.0\.0"


def _candidates(text: Column, language: Column | None) -> Column:
    """Everything in a text that is or may become a claim: links and imports are decided by the snapshots, the rest here."""
    none = F.array().cast(_CANDIDATE)
    entry = lambda kind, t, name=None: F.struct(F.lit(kind).alias("kind"), t.alias("text"), F.lit(name).cast("string").alias("name") if not isinstance(name, Column) else name.alias("name"))
    every = lambda regex, group: F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    number = rf"([0-9]+(?:\.[0-9]+)?)[{SPACE_BODY}]*%"

    def judged(t: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(t, F.lit(number), F.lit(1)), lambda n: n.cast("double"))
        trimmed = F.regexp_replace(t, rf"\A[{SPACE_BODY}]+|[{SPACE_BODY}]+\z", "")
        both = t.rlike("(?i)increas|improv|grew|better") & t.rlike("(?i)decreas|fell|worse|reduc")
        kind = lambda n: F.when(F.size(n) < 2, F.lit(None)).when(F.exists(n, lambda v: v > 100), "over").when(both, "both")
        return F.struct(let(numbers, kind).alias("kind"), trimmed.alias("text"), F.lit(None).cast("string").alias("name"))

    parts = [
        F.when(text.contains("://"), F.transform(F.filter(every(URL, 0), lambda u: ~u.rlike(_LOCAL)), lambda u: entry("url", u))),
        F.when(text.contains("10."), F.transform(F.filter(every(_DOI, 1), lambda t: ~t.rlike(_DOI_OK)), lambda t: entry("malformed_doi", t))),
        F.when(text.rlike("(?i)arxiv:"), F.transform(F.filter(every(_ARXIV, 1), lambda t: ~t.rlike(_ARXIV_OK)), lambda t: entry("malformed_arxiv_id", F.concat(F.lit("arXiv:"), t)))),
        F.when(text.rlike("%[^%]*%"), F.filter(F.transform(every(_PERCENT_SENTENCE, 1), judged), lambda x: x["kind"].isNotNull())),
    ]
    if language is not None:
        parts.append(F.when(language.isNotNull(), F.transform(import_entries(text, language), lambda i: entry("import", i["raw"], i["name"]))))
    return F.concat(*[F.coalesce(p.cast(_CANDIDATE), none) for p in parts])


def output_claims(df: DataFrame, id_col: str, text_col: str, registry: DataFrame, crawl: DataFrame,
                  language_col: str | None = None) -> DataFrame:
    """All claims of a table of generated outputs, read once; imports are checked where a language is given.

    One array of candidates per text is opened once; links then look up the crawl and imports the registry.  A candidate of another kind has a key of
    its own in these joins, so that they do not all meet in one task.
    """
    language = F.lit(None).cast("string") if language_col is None else F.col(language_col)
    base = df.select(F.col(id_col).alias("subject_id"), F.col(text_col).alias("_text"), language.alias("_language"))
    found = explode_rows(base, ["subject_id", "_language"], _candidates(F.col("_text"), None if language_col is None else F.col("_language")), "c").select("subject_id", "_language", "c.*")
    kind = F.col("kind")
    alone = F.concat(F.lit("\0"), F.xxhash64("subject_id", "text").cast("string"))
    links = crawl.select(F.col("url").alias("_url"), "status")
    seen = found.withColumn("_url", F.when(kind == "url", F.col("text")).otherwise(alone)).join(links, "_url", "left").drop("_url")
    if language_col is not None:
        seen = seen.withColumn("ecosystem", F.when(kind == "import", pick(ECOSYSTEMS, F.col("_language"))).otherwise(F.lit("\0"))).withColumn(
            "name", F.when(kind == "import", F.col("name")).otherwise(alone))
        seen = with_existence(seen, registry)
    else:
        seen = seen.withColumn("existence", F.lit(None).cast("string"))
    gone = F.col("status").isin(404, 410)
    silent = F.col("status").isNull()
    fake = F.col("existence") == "hallucinated"
    claim = lambda check, verdict, confidence, evidence: F.struct(
        F.lit(check).alias("check_type"), F.lit(verdict).alias("verdict"), F.lit(confidence).cast("double").alias("confidence"), (evidence if isinstance(evidence, Column) else F.lit(evidence)).alias("evidence"))
    judged = (
        F.when((kind == "url") & gone, claim("url_not_found", "BLOCK", 0.9, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
        .when((kind == "url") & silent, claim("url_unreachable", "FLAG", 0.5, "no response"))
        .when(kind == "malformed_doi", claim("malformed_doi", "FLAG", 0.7, "DOI lacks four or more digits and a suffix"))
        .when(kind == "malformed_arxiv_id", claim("malformed_arxiv_id", "FLAG", 0.75, "arXiv identifier is neither YYMM.NNNNN nor category/YYMMNNN"))
        .when(kind == "over", claim("numeric_contradiction", "FLAG", 0.6, "percentage above 100"))
        .when(kind == "both", claim("numeric_contradiction", "FLAG", 0.6, "increase and decrease wording"))
        .when((kind == "import") & fake, claim("hallucinated_package", "BLOCK", 0.95, F.concat(F.col("name"), F.lit(" not found"))))
        .when((kind == "import") & (F.col("existence") == "unknown"), claim("unknown_package", "FLAG", 0.4, "no registry snapshot")))
    return seen.withColumn("j", judged).where("j is not null").select("subject_id", "j.check_type", "text", "j.verdict", "j.confidence", "j.evidence")


def verify_outputs(df: DataFrame, id_col: str, text_col: str, registry: DataFrame, crawl: DataFrame,
                   language_col: str | None = None, mode: str = "block") -> DataFrame:
    return claim_verdict(output_claims(df, id_col, text_col, registry, crawl, language_col), df, mode, id_col)
