"""A corpus pipeline: four operators, each working on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.byte_bpe import encode
from quadrille.llm.common import written
from quadrille.llm.decontaminate import decontaminate
from quadrille.llm.jaccard_join import jaccard_join
from quadrille.llm.quality import score_quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, carry=docs.columns).filter("keep").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, by any number of steps, the one of smallest doc_id stays, and of repeated rows the one whose columns
    come first as JSON; documents without words all stay."""
    found = jaccard_join(docs)
    keep = written(found.filter("is_first").groupBy("doc_id", "tx").agg(F.count(F.lit(1)).alias("n"), F.max("n_grams").alias("n_grams")))
    keys = keep.select("doc_id", "tx", ((F.col("n") > 1) & (F.col("n_grams") > 0)).alias("repeated")).alias("k")
    packed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("tx"), F.struct(*docs.columns).alias("carried")).alias("d")
    kept = packed.join(keys.hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.tx") == F.col("k.tx"))).select("d.doc_id", "d.tx", "carried", "repeated")
    if keys.filter("repeated").isEmpty():
        return kept.select("carried.*")
    once = kept.filter("repeated").groupBy("doc_id", "tx").agg(F.min_by("carried", F.to_json("carried")).alias("carried"))
    return kept.filter("NOT repeated").select("carried").unionByName(once.select("carried")).select("carried.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, carry=docs.columns).filter("NOT contaminated").select("carried.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text again."""
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_decontamination), ("byte-level BPE", byte_bpe)]

#: The classifier's fit and the encoding aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k < len(STAGES) else docs
    return docs
