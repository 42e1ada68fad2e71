"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from gatehouse.llm import alignment, decontamination, embedding_dedup, fingerprints, hard_negatives, html_text, language, quality, sentence_pieces, simhash, token_counts, token_ids, url_filter
from gatehouse.llm.arrow import crc_mod
from gatehouse.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Vocabulary files, on every machine at the same place.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

# Path rules of the URL query: action, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op1_decontamination"] = f"""
    with d as (select doc_id, {_WORDS} as w from documents),
    b as (select item_id, {_WORDS} as w from benchmark),
    bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
           from b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as t(i) where len(w) > 0),
    dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from d, (select distinct n from bw), unnest(range(1, len(w) - n + 2)) as t(i)),
    hits as (select doc_id, i, n, item_id from dw join bw using (n, g)),
    spots as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
    named as (select doc_id, count(*) as n_items, string_agg(v, ',' order by v) as names
              from (select distinct doc_id, cast(item_id as varchar) as v from hits) group by doc_id)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join spots using (doc_id) left join named using (doc_id)"""


@query
def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.contamination(load(spark, d, "documents"), load(spark, d, "benchmark"))


@query
def op2_sentence_pieces(spark: SparkSession, d: str) -> DataFrame:
    return sentence_pieces.round_trips(load(spark, d, "documents"), PIECES, keep=["doc_id"])


@query
def op3_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(load(spark, d, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    out = quality.score(docs, quality.train(docs, load(spark, d, "labels")), keep=["doc_id"])
    return out.select("doc_id", (crc_mod(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"), "score", "predicted")


@query
def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(load(spark, d, "documents"), PIECES, keep=["doc_id", "n_chars"])


@query
def op6_token_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids.read_documents(token_ids.write_ids(load(spark, d, "documents"), WORD_BPE))


@query
def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    out = language.identify(docs, language.train(docs), keep=["doc_id"])
    return out.select("doc_id", (crc_mod(F.col("doc_id"), language.FOLDS) == language.HELD_OUT).alias("held_out"), "lang_pred", "score")


@query
def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    weights = url_filter.train(url_filter.labelled_urls(spark))
    out = url_filter.filter_urls(load(spark, d, "pages").select("page_id", "url"), "url", URL_RULES, weights)
    return out.select("page_id", "host", "path", "rule", "verdict", "probability")


@query
def op9_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, d, "documents"))


@query
def op10_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(load(spark, d, "pages"), keep=["page_id", "url"])


_SOUND = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

ORACLE["op11_hard_negatives"] = f"""
    with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
               from embeddings where label is not null and {_SOUND}),
    s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5),
    n as (select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank, s.vec_id as negative_id,
                 p.score as positive_score, s.score as negative_score
          from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
    select * from n where rank <= 10"""


@query
def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE["op12_embedding_near_dedup"] = f"""
    with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
                         where label is not null and {_SOUND} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as materialized (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(x, y) as (select vec_id, vec_id from embeddings union select reach.x, links.y from reach join links on links.x = reach.y),
    named as (select x, min(y) as component_id from reach group by x)
    select vec_id, (select count(*) from links where x = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join named on x = vec_id"""


@query
def op12_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, d, "embeddings"))


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.alignments(load(spark, d, "documents"), BYTE_BPE, PIECES)
