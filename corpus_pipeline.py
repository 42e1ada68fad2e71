"""From raw documents to encoded training data, in stages that are written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  Classifiers learn from the labelled documents of
``sf_dir``.  All stages but the last return the columns of ``docs``, with rows in no particular order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import decontamination, language, near_copies, quality, sentence_pieces
from gatehouse.llm.queries import PIECES
from gatehouse.llm.storage import stored
from gatehouse.sources.tables import load

# A document whose language is this doubtful goes.
LEAST_LANGUAGE_SCORE = 0.35


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, which tells rows apart where ids are null or repeated: rows that agree in it have the same id and, but for
    a clash of hashes, the same text.  Rows with an id come first in its order."""
    return docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.length("text").alias("length")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network takes for label 1 stay; null and empty texts are judged like any other."""
    net = quality.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return quality.score(docs, net, names=("__score", "__predicted")).where("__predicted = 1").drop("__score", "__predicted")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter (``und``, null texts too) and doubtful ones go."""
    found = language.identify(docs, language.train(load(spark, sf_dir, "documents")), names=("__lang", "__score"))
    return found.where((F.col("__lang") != language.UNDETERMINED) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).drop("__lang", "__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id; of repeated rows, one.

    Two texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    A document without an id only stays if no document of its group has one.
    """
    named = _named(docs)
    kept = near_copies.near_copies(named, "__row").where("__row = component_id").select("__row").distinct()
    return named.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if words of theirs, one in twenty at least, lie in passages of 13 words of a benchmark item."""
    named = _named(docs)
    tainted = decontamination.contamination(named, load(spark, sf_dir, "benchmark"), key="__row").where("contaminated").select("__row").distinct()
    return named.join(tainted, "__row", "left_anti").drop("__row")


def sentence_piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text: ``doc_id, ids, n_ids``."""
    return sentence_pieces.encode(docs, PIECES, keep=["doc_id"])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentence_piece_encoding", sentence_piece_encoding),
]

# Learned models and SimHash have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
