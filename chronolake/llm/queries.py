"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embeddings, hamming, language_model, packing, quality, simhash, suffixes, toxicity, url_trust
from .common import fold_of, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of the bytes they decode to."""
    import public_tokenizers

    found = byte_bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_hpyp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability; the fold crc32(doc_id) mod 7 = 2 is never learnt from. Rows with null ids aren't
    learnt from either, and aren't held_out."""
    fold = fold_of("doc_id", 7)
    found = language_model.scores(table(spark, sf_dir, "documents"), fold != 2).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the fold crc32(doc_id) mod 4 = 2 are never learnt from."""
    docs, fold = table(spark, sf_dir, "documents"), fold_of("doc_id", 4)
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold != 2)
    scored = quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_trust.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and group of near duplicates of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the fold crc32(doc_id) mod 5 = 0 are never learnt from."""
    docs, fold = table(spark, sf_dir, "documents"), fold_of("doc_id", 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 20."""
    found = hamming.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP8_SQL = """
with codes as (select vec_id, embedding from embeddings where vec_id is not null and embedding is not null),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (c.embedding[i] > 0))::int))::int as distance
  from codes q join codes c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, distance
from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs) where rank <= 10
"""


def op9_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near-duplicate vectors of one label."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings that documents with smaller ids have."""
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_hpyp_scores": op2_hpyp_scores,
    "op3_retrieval_packing": op3_retrieval_packing,
    "op4_quality": op4_quality,
    "op5_url_trust": op5_url_trust,
    "op6_simhash_golay": op6_simhash_golay,
    "op7_toxicity_mil": op7_toxicity_mil,
    "op8_hamming_topk": op8_hamming_topk,
    "op9_embedding_cells": op9_embedding_cells,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES: dict[str, str] = {"op5_url_trust": url_trust.judge_sql(), "op8_hamming_topk": OP8_SQL}
