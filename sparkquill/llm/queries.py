"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import centroids, chat, licenses, middle, mixing, oracle, quality
from sparkquill.llm.bpe import round_trip
from sparkquill.llm.common import table
from sparkquill.llm.langid import held_out, identify, learn
from sparkquill.llm.media import media_digest
from sparkquill.llm.minhash import minhash_dedup
from sparkquill.llm.repeats import repeat_digest
from sparkquill.llm.sharding import shard_rows
from sparkquill.llm.vectors import vector_dedup


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs.where(~held_out(docs["doc_id"])))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "rejected")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), threshold=0.85).select("doc_id", "n_shingles", "component_id", "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: /source/thousands/twenties/doc_id.txt."""
    path = F.expr("concat('/', source, '/', doc_id div 1000, '/', doc_id div 20, '/', doc_id, '.txt')")
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS x(conv_id, turn, role, text)")
    return chat.format_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"), length=200)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=8)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.middle_digest(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(~quality.held_out(labels["doc_id"])))
    found = quality.quality_scores(docs, model, threshold=0.3)
    return found.select("doc_id", quality.held_out(found["doc_id"]).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_language_id,
        op3_minhash_near_dedup,
        op4_license_scan,
        op5_chat_formatting,
        op6_suffix_array_dedup,
        op7_byte_bpe,
        op8_media_columns,
        op9_source_mixing,
        op10_sharding,
        op11_fill_in_middle,
        op12_centroid_clustering,
        op13_quality_classifier,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": oracle.NEAR_VECTORS,
    "op3_minhash_near_dedup": oracle.NEAR_TEXTS,
    "op4_license_scan": licenses.ORACLE_SQL,
    "op5_chat_formatting": chat.ORACLE_SQL,
    "op6_suffix_array_dedup": oracle.REPEATS,
    "op9_source_mixing": mixing.ORACLE_SQL,
    "op11_fill_in_middle": middle.ORACLE_SQL,
    "op12_centroid_clustering": centroids.ORACLE_SQL,
}
