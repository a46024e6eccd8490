"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm import audio, bpe, classifier, hard_negatives, language, licenses, minhash, packing, pii, prefix_trie, quality_rules, token_store, top_k


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), near=True)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), trusted_ids(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_digest(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_file_digest(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, moved)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_licenses, op2_packing, op3_quality, op4_bpe, op5_minhash, op6_classifier, op7_language, op8_media, op9_pii, op10_tokens, op11_top_k, op12_prefix_trie, op13_hard_negatives]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.oracle(), "op11_top_k": TOP_K, "op12_prefix_trie": PREFIX_TRIE, "op13_hard_negatives": HARD_NEGATIVES}


_WHOLE = """WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
TOP_K = f"""{_WHOLE}, scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""
HARD_NEGATIVES = f"""{_WHOLE}, named AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM whole WHERE label IS NOT NULL
), scored AS MATERIALIZED (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM named q JOIN named c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), found AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3"""
# crc32 goes bit by bit over the digits: DuckDB has no function for it. The text of a prefix stands for it.
PREFIX_TRIE = """WITH numbered AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT c, max(pos) AS n, c - c % 5 AS base FROM numbered GROUP BY c
), hashed AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: list_transform(range(0, 8), lambda k: ((ascii(substr(c::VARCHAR, i, 1)) >> k) & 1)::BIGINT)))),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 9 AS h FROM ids
), rebuilt AS (
  SELECT i.c, t.pos AS d, t.role, t.text FROM hashed i JOIN numbered t ON t.c = i.base AND t.pos <= i.h
  UNION ALL SELECT i.c, t.pos - i.h + least(i.h, coalesce(b.n, 0)), t.role, t.text FROM hashed i JOIN numbered t ON t.c = i.c AND t.pos > i.h LEFT JOIN ids b ON b.c = i.base
), lengths AS (SELECT i.c, coalesce(max(d), 0) AS m FROM ids i LEFT JOIN rebuilt r ON r.c = i.c GROUP BY i.c
), paths AS (
  SELECT c, d, strlen(text) AS bytes, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM ids
), nodes AS (SELECT p, min(c) AS owner, any_value(d) AS depth, any_value(bytes) AS bytes, count(*) AS n FROM paths GROUP BY p
), tree AS (SELECT x.*, up.p AS parent, o.owner AS parent_owner FROM nodes x LEFT JOIN paths up ON up.c = x.owner AND up.d = x.depth - 1 LEFT JOIN nodes o ON o.p = up.p
), kids AS (SELECT parent AS p, count(*) AS k FROM tree WHERE parent IS NOT NULL GROUP BY parent
), below AS (SELECT a.p, sum((x.n - 1) * x.bytes) AS saved, count(*) FILTER (k.k IS NULL) AS leaves FROM nodes x JOIN paths a ON a.c = x.owner AND a.d <= x.depth LEFT JOIN kids k ON k.p = x.p GROUP BY a.p
), ends AS (SELECT p, string_agg(l.c::VARCHAR, ',' ORDER BY l.c) AS e FROM lengths l JOIN paths q ON q.c = l.c AND q.d = l.m GROUP BY p)
SELECT owner AS conv_id, depth::BIGINT AS depth, parent_owner AS parent_conv_id, n::BIGINT AS n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM tree t JOIN below b ON b.p = t.p LEFT JOIN kids ON kids.p = t.p LEFT JOIN ends ON ends.p = t.p"""
