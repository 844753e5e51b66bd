"""A corpus pipeline of five stages over documents: language, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents; the last
one returns the encoded rows.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.llm import langid
from sparkquill.llm.bpe import round_trip
from sparkquill.llm.common import shared_folder, table
from sparkquill.llm.langid import held_out, identify, learn
from sparkquill.llm.minhash import minhash_dedup
from sparkquill.llm.mixing import ADDED, mix_sources, repeat_rows
from sparkquill.llm.repeats import remove_repeats


def _aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs with columns of these names, which an operator would replace, under others."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in names})


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs of what an operator made of _aside(docs)."""
    return rows.select(*[F.col(f"__own_{c}").alias(c) if f"__own_{c}" in rows.columns else F.col(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is too close to call."""
    found = identify(_aside(docs, langid.ADDED), learn(docs.where(~held_out(docs["doc_id"]))))
    return _back(found.where(~F.col("rejected")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document of least id (and then of least hash of its text).

    Rows that repeat an id with unrelated texts are documents of their own; of rows that repeat id and text the first by their
    further columns, as JSON, stays. Documents without words or id stay.
    """
    found = minhash_dedup(docs, threshold=0.8).where("doc_id IS NOT NULL")
    one = F.struct("doc_id", "text_key")
    kept = found.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min(one).alias("x")).select("x.*")
    kept = kept.unionByName(found.where("group_key IS NULL").select("doc_id", "text_key").distinct())
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    further = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.join(kept, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key")))
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.to_json(F.struct(*further)) if further else F.lit(1)))
    named = named.withColumn("__first", first).where("__first = 1").select(*docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 200 bytes or more that stands more than once; documents of which nothing is left go."""
    cleaned = remove_repeats(docs, length=200)
    return cleaned.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    own = _aside(docs, ADDED)
    return _back(repeat_rows(mix_sources(own), own.columns), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: Compression, sketches and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read back. A stage's folder goes when the next one is written; the last stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return docs
