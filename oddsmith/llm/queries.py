"""One registered query for each operator, over its whole table, and SQL where it can state it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm import (
    bpe,
    disclosure,
    embedding_dups,
    exact_dedup,
    filter_audit,
    maxent,
    mixing,
    near_dups,
    quality,
    sharding,
    spelling,
    token_counts,
    toxicity,
)
from oddsmith.llm._shared import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(table(spark, sf_dir, "documents"), whole=True)


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_report(table(spark, sf_dir, "documents"), path)


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_shard": op2_shard,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_disclosure": op5_disclosure,
    "op6_maxent": op6_maxent,
    "op7_bpe": op7_bpe,
    "op8_near_dups": op8_near_dups,
    "op9_embedding_dups": op9_embedding_dups,
    "op10_token_counts": op10_token_counts,
    "op11_toxicity": op11_toxicity,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling": op13_spelling,
}

ORACLE = {
    "op1_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
keyed AS (
  SELECT *, ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, body)), 1, 15))::BIGINT AS ord
  FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM sizes),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(rank % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, row_number() OVER w AS place,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
            ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (
            ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rank)),
targets AS (
  SELECT *, least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level < cap / weight)
                                * weight, cap)) AS target FROM levels),
queue AS (
  SELECT k.doc_id, k.size, k.ord, t.source_size, t.target, t.rank, t.weight,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.ord, k.doc_id, k.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (c * source_size + done)::BIGINT / weight AS finish
  FROM queue, (VALUES (0), (1)) v(c) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, c, ord, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM copies),
took AS (
  SELECT doc_id, ord, count(*) AS times FROM cut
  WHERE total <= 1.5::DOUBLE * (SELECT sum(source_size) FROM sizes) GROUP BY doc_id, ord)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.times, 0))::BIGINT AS taken
FROM queue q LEFT JOIN took t ON q.doc_id = t.doc_id AND q.ord = t.ord""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op12_filter_audit": r"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
fails AS (
  SELECT part, doc_id,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body))::INT
         + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(first_id < doc_id, false)::INT AS bits
  FROM rows),
counted AS (
  SELECT part, bits, bit_count(bits)::INT AS failing, count(*) AS n,
         count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
         count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM fails GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits_of
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step::INT AS step, bits_of[step] AS mine,
         coalesce(list_sum(bits_of[1:step - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) r(step))
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (bits & (earlier | mine) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (bits & mine > 0 AND bits & earlier = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (bits & mine > 0 AND bits & earlier > 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (bits = mine), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (bits & mine > 0 AND bits & earlier = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (bits & mine > 0 AND bits & earlier = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(failing, 1))) FILTER (bits & mine > 0), 0)::BIGINT AS shapley
FROM counted, steps GROUP BY ALL""",
}
