"""Imports of code snippets, checked against registry and vulnerability snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows, let
from gatehouse.functions.patterns import SPACE, SPACE_BODY, line_start
from gatehouse.operators.findings import pick
from gatehouse.operators.pairs import join_many

_S = SPACE
_BOL = line_start()
_NAME = r"[^'\"./][^'\"]*"

# Import forms per language; group 1 is the imported path.
_PYTHON = [rf"{_BOL}import{_S}+([A-Za-z0-9_.]+)", rf"{_BOL}from{_S}+([A-Za-z0-9_.]+){_S}+import"]
_SCRIPT = [
    rf"(?:{_BOL}|{_S})import{_S}+(?:[A-Za-z0-9_*{{}},{SPACE_BODY}]+{_S}+from{_S}+)?['\"]({_NAME})['\"]",
    rf"require{_S}*\({_S}*['\"]({_NAME})['\"]{_S}*\)",
    rf"import{_S}*\({_S}*['\"]({_NAME})['\"]{_S}*\)",
]
_RUST = [rf"{_BOL}use{_S}+([A-Za-z0-9_]+)(?:::|;)", rf"{_BOL}extern{_S}+crate{_S}+([A-Za-z0-9_]+)"]
_GO = [rf"import{_S}+\"([^\"]+)\"", rf"{_BOL}{_S}+\"([^\"]+)\""]
IMPORT_FORMS = {"python": _PYTHON, "javascript": _SCRIPT, "typescript": _SCRIPT, "rust": _RUST, "go": _GO}

# Package ecosystem per language.
ECOSYSTEMS = {"python": "PyPI", "javascript": "npm", "typescript": "npm", "rust": "crates.io", "go": "Go"}

# Standard-library names, all languages together.
STDLIB = """
os sys re io abc ast copy csv enum math json time uuid typing pathlib logging hashlib datetime functools itertools
collections contextlib threading subprocess urllib http email html xml socket struct base64 binascii codecs string
textwrap random secrets statistics decimal fractions numbers traceback warnings unittest dataclasses inspect __future__
builtins gc weakref array queue
fmt io net log sync sort strings strconv bytes errors context runtime encoding unicode reflect bufio path flag
std core alloc proc_macro test
fs path https url util events stream buffer crypto child_process net dns readline querystring zlib assert cluster dgram
domain module perf_hooks process timers tty vm worker_threads v8 inspector
""".split()

_ENTRY = "array<struct<name:string,raw:string>>"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE_BODY}]+|[{SPACE_BODY}]+\z", "")


def _found(code: Column, forms: list[str]) -> Column:
    parts = []
    for rx in forms:
        paths = F.regexp_extract_all(code, F.lit(rx), F.lit(1))
        raws = F.regexp_extract_all(code, F.lit(rx), F.lit(0))
        parts.append(F.zip_with(paths, raws, lambda p, r: F.struct(
            F.regexp_extract(_trim(p), r"\A[^./]*", 0).alias("name"), _trim(r).alias("raw"))))
    return F.concat(*parts).cast(_ENTRY)


def import_entries(code: Column, language: Column) -> Column:
    """Distinct top-level packages of a snippet as an array of ``name, raw``, in order, standard library and relative ones left out."""
    by_language = F.array().cast(_ENTRY)
    for lang, forms in IMPORT_FORMS.items():
        by_language = F.when(language == lang, _found(code, forms)).otherwise(by_language)
    return let(by_language, lambda e: F.filter(e, lambda x, i: (x["name"] != "") & ~x["name"].isin(STDLIB) & ~x["name"].startswith("node:")
                                               & ~F.exists(F.slice(e, F.lit(1), i), lambda y: y["name"] == x["name"])))


def extract_imports(df: DataFrame, id_col: str, code_col: str, language: str) -> DataFrame:
    """One row per distinct top-level package of a snippet (``language`` is a column name)."""
    base = df.select(F.col(id_col).alias("subject_id"), F.col(language).alias("language"), F.col(code_col).alias("_code"))
    return explode_rows(base, ["subject_id", "language"], import_entries(F.col("_code"), F.col("language")), "i").select(
        "subject_id", "language", "i.name", "i.raw")


def with_ecosystem(imports: DataFrame) -> DataFrame:
    return imports.withColumn("ecosystem", pick(ECOSYSTEMS, F.col("language")))


def package_existence(imports: DataFrame, registry: DataFrame) -> DataFrame:
    """``registry`` holds ``ecosystem, name`` of every published package.  An ecosystem without any row
    has no snapshot, and its packages stay unknown."""
    return with_existence(with_ecosystem(imports), registry).select("subject_id", "language", "ecosystem", "name", "raw", F.col("existence").alias("status"))


def with_existence(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``existence`` (valid, hallucinated, unknown) to rows of ``ecosystem, name``."""
    known = registry.select("ecosystem", "name").distinct().withColumn("listed", F.lit(True))
    # One row per known ecosystem at most, so it is sent along: imports are not shuffled by a handful of values.
    covered = registry.where(F.col("ecosystem").isin(sorted(set(ECOSYSTEMS.values())))).select("ecosystem").distinct().withColumn("covered", F.lit(True))
    joined = df.join(F.broadcast(covered), "ecosystem", "left").join(known, ["ecosystem", "name"], "left")
    return joined.withColumn("existence", F.when(F.col("listed"), "valid").when(F.col("covered"), "hallucinated").otherwise("unknown")).drop("listed", "covered")


def hallucination_rate(checked: DataFrame, *by: str) -> DataFrame:
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "valid").alias("valid"),
        F.count_if(F.col("status") == "hallucinated").alias("hallucinated"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
        F.avg(F.when(F.col("status") == "hallucinated", 1.0).otherwise(0.0)).alias("hallucination_rate"))


def _affected(osv: DataFrame) -> DataFrame:
    """One row per package and vulnerability."""
    return osv.select(
        "id", F.coalesce("summary", "details", F.lit("")).alias("summary"),
        F.coalesce(F.upper(F.nullif("db_severity", F.lit(""))), F.nullif("score", F.lit("")), F.lit("UNKNOWN")).alias("severity"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.explode("affected").alias("a"),
    ).select("id", "summary", "severity", "aliases", F.col("a.ecosystem").alias("ecosystem"), F.col("a.name").alias("name")
             ).dropDuplicates(["ecosystem", "name", "id"])


def _packages(imports: DataFrame) -> DataFrame:
    return with_ecosystem(imports).select("subject_id", "ecosystem", "name").distinct()


def vulnerabilities(imports: DataFrame, osv: DataFrame) -> DataFrame:
    """``osv``: ``id, summary, details, db_severity, score, aliases, affected array<struct<ecosystem,name>>``.
    One row per package of a subject and vulnerability, with severity and summary."""
    return join_many(_packages(imports), _affected(osv), ["ecosystem", "name"]).select("subject_id", "ecosystem", "name", "id", "severity", "summary", "aliases")


def vulnerability_summary(imports: DataFrame, osv: DataFrame) -> DataFrame:
    """Vulnerabilities are counted per package before subjects meet them, so a package that very many subjects import and very many
    vulnerabilities name is one row."""
    known = _affected(osv).groupBy("ecosystem", "name").agg(F.count(F.lit(1)).alias("n"))
    listed = F.col("n").isNotNull()
    # Packages without an ecosystem are in no count.
    sums = _packages(imports).join(known, ["ecosystem", "name"], "left").groupBy("subject_id").agg(
        F.count_if(F.col("ecosystem").isNotNull() & F.col("name").isNotNull()).alias("total_packages"),
        F.count_if(listed).alias("vulnerable_packages"), F.coalesce(F.sum("n"), F.lit(0)).alias("vulnerabilities"))
    return sums.select("subject_id", "total_packages", "vulnerable_packages", "vulnerabilities", (F.col("vulnerable_packages") == 0).alias("safe"))
