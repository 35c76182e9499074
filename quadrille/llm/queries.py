"""The queries of this folder's operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .byte_bpe import encode
from .decontaminate import decontaminate
from .html_extract import extract_pages
from .jaccard_join import jaccard_join
from .lm_score import score_documents
from .quality import score_quality
from .shard import shard_rows
from .token_counts import token_counts
from .topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("whole", ",").alias("whole"), F.array_join("licenses", ",").alias("licenses"), "n_notices")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_rows(_table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_grams", "is_first")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_decontaminate, op3_byte_bpe, op4_license_scan, op5_shard, op6_quality, op7_topk, op8_lm_score, op9_html_extract, op10_jaccard_join)}


_OP2 = r"""
WITH words AS (
  SELECT row_number() OVER () AS rn, doc_id, w, len(w) AS n FROM (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents)
),
items AS (
  SELECT item_id, w, len(w) AS n FROM (
    SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
),
windows AS (
  SELECT DISTINCT item_id, least(n, 13) AS k, array_to_string(w[i:i + least(n, 13) - 1], ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, greatest(1, n - 12))) AS i FROM items)
),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT rn, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT rn, w, k, unnest(generate_series(1, n - k + 1)) AS i FROM words, lengths WHERE n >= k)
),
hits AS (SELECT rn, i, k, item_id FROM places JOIN windows USING (k, s)),
marked AS (SELECT rn, count(DISTINCT j) AS n_hit FROM (SELECT rn, unnest(generate_series(i, i + k - 1)) AS j FROM hits) GROUP BY rn),
listed AS (SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY rn)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM words LEFT JOIN marked USING (rn) LEFT JOIN listed USING (rn)
"""

_OP7 = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS cuid, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0 AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, cuid) AS rank FROM s) WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2, "op4_license_scan": licenses.oracle_sql(), "op7_topk": _OP7}
