"""The corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again
before the next one. All but the last return the columns of ``documents``.

Null and empty texts count as texts without words: the rules reject them. Rows without a ``doc_id`` are judged
and cleaned, but are no one's duplicate. Repeated rows leave one. An empty table stays empty in every stage.
Further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import near_dups, packing, quality, recompression, secrets
from loamline.llm.blocks import free_name, small_batches
from loamline.llm.queries import word_vocabulary
from loamline.session import prepare, scratch_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules accept."""
    small_batches(spark)
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = free_name(docs, "_quality")
    return quality.judge(docs, rules, into=verdict).filter(F.col(verdict)["kept"]).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; repeated rows count as
    one document, and a text that shares its id with another is judged by itself."""
    small_batches(spark)
    number = free_name(docs, "_row")
    apart = near_dups.numbered(docs, number)
    if apart is None:
        gone = (near_dups.near_duplicates(docs).filter(~F.col("kept"))
                .select(F.col("doc_id").alias("_gone")).distinct())
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    by_row = apart.select(F.when(F.col("doc_id").isNotNull(), F.col(number)).alias("doc_id"), "text")
    found = near_dups.near_duplicates(by_row).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = apart.select(F.col(number).alias("_row"), F.col("doc_id").alias("_id"))
    first = found.join(ids, "_row").groupBy("_group").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_first"))
    kept = apart.join(first, apart[number] == first["_first"], "left_semi")
    return kept.unionByName(apart.filter(F.col("doc_id").isNull())).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier."""
    small_batches(spark)
    into = free_name(docs, "_cut")
    cut = recompression.cut_repeats(docs, into=into)
    return cut.select(*[F.col(into)["text"].alias("text") if c == "text" else F.col(c) for c in docs.columns])


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    return secrets.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    small_batches(spark)
    return packing.pack(docs, word_vocabulary)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeated_passages", cut_repeated_passages),
    ("secrets", hide_secrets),
    ("packing", pack_tokens),
]

# Learned rules, min-max hashing and token ids have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it wrote."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
