"""The registered queries of the subpackage and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from gatehouse.llm.queries import ORACLE, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op2": {"doc_id", "n_ids", "exact"},
    "op3": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4": {"doc_id", "held_out", "score", "predicted"},
    "op5": {"doc_id", "n_tokens"},
    "op6": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op7": {"doc_id", "held_out", "lang_pred", "score"},
    "op8": {"page_id", "host", "path", "rule", "verdict"},
    "op9": {"doc_id", "fingerprint", "component_id"},
    "op10": {"page_id", "url", "text", "n_chars"},
    "op11": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op12": {"vec_id", "n_links", "component_id", "kept"},
    "op13": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    table = "pages" if name.startswith(("op8", "op10")) else "embeddings" if name.startswith(("op11", "op12")) else "documents"
    if not name.startswith("op11"):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ORACLE:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        rel = con.sql(ORACLE[name])
        columns = list(rel.columns)
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(rel.fetchall())


def test_native_plans(spark):
    """The native operators run no Python."""
    for name in ("op1_decontamination", "op3_fingerprints", "op8_url_filter"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    more = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, "s", 0), (None, passage, "en", "s", 1), (None, "Der der die und das ist ein kleiner Satz, der nur hier steht.", "de", "s", 1), (9003, "12 34 !!", None, "s", 8)], docs.schema)
    return docs.union(more).union(docs.limit(3)).withColumn("score", F.lit("mine")).withColumn("predicted", F.lit("mine"))


def test_stages(spark, odd):
    df = odd
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, stage(spark, df, SF).cache()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert df.columns == odd.columns and df.subtract(before).count() == 0 and df.where("score <> 'mine'").count() == 0
            assert stage(spark, odd.where("false"), SF).count() == 0
    assert df.columns == ["doc_id", "ids", "n_ids"] and df.count() == before.count()


def test_near_dedup_keeps_one_of_each_group(spark, odd):
    rows = odd.where("doc_id is not null").collect()
    label = brute.groups([r["doc_id"] for r in rows], [brute.simhash(r["text"]) for r in rows])
    kept = corpus_pipeline.near_dedup(spark, odd.where("doc_id is not null"), SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label))


def test_decontamination_drops_what_the_rule_says(spark, odd):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = odd.collect()
    clean = [r["text"] for r, f in zip(rows, brute.contamination([(r["doc_id"], r["text"]) for r in rows], items)) if not f[-1]]
    assert len(clean) < len(rows)
    assert sorted(map(repr, clean)) == sorted(repr(r["text"]) for r in corpus_pipeline.benchmark_decontamination(spark, odd, SF).collect())


def test_language_stage_drops_texts_without_letters(spark, odd):
    left = corpus_pipeline.language_id(spark, odd, SF)
    assert left.where("doc_id in (9001, 9002, 9003)").count() == 0 and left.count() == odd.count() - 3


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and len({r["doc_id"] for r in got}) == len(got)
