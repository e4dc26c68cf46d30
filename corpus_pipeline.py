"""Corpus pipeline over ``documents``: toxicity, quality rules, near-duplicates,
mixing to target weights, packing.  Every stage reads all that the stage before
it kept; all but the last return the columns of documents.

In every stage a null text is read as an empty one, texts of any length are read
whole, repeated rows are rows of their own unless the stage says otherwise, an empty
table gives an empty result, and extra columns of any name not beginning with two
underscores are carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import mixing, near_dup, packing, quality_rules, toxicity
from rowmill.llm.queries import tokenizer_path
from rowmill.llm.stored import drop, stored

#: Bytes of texts that a task passes to Python at once; a longer text goes alone.
BATCH, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH bytes (64 MB by default), in which both an
    executor and its Python workers hold texts.  It stays set, as a stage's result is
    computed when it is written; no result depends on it.  A lower setting is kept."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF)) > BATCH:
        spark.conf.set(BATCH_CONF, f"{BATCH}b")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; one of exactly 0.5 goes.  The model learns from
    the stage's own documents and the labels beside them; without labels of both
    kinds all stay.  Null and empty texts, which have no passage, stay or go by the
    score of a text without evidence; equal texts go the same way."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.withColumn("__tox", toxicity.scorer(model)("text"))
    return scored.where(F.col("__tox.score") < 0.5).select(*(f"`{c}`" for c in docs.columns))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Votes of the whole corpus are counted
    first; the second reading weighs them, so no text is stored in between.  Null and
    empty texts have no words and go; equal texts go the same way; a posterior of
    exactly 0.5 stays."""
    small_batches(spark)
    stats = docs.withColumn("__s", quality_rules.text_stats()("text"))
    model = quality_rules.learn(stats.select("__s.*"))
    return stats.where(quality_rules.verdict(model, "__s.")["kept"]).select(*(f"`{c}`" for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id.

    Rows go by numbers of their own, so rows that share a doc_id are told apart;
    those without a doc_id stay alone and are kept, as do texts without words.  Of
    rows with the smallest doc_id of a group the first read stays."""
    small_batches(spark)
    rows = stored(docs.withColumn("__no", F.monotonically_increasing_id()))
    known = rows.where("doc_id is not null")
    group = near_dup.near_duplicates(known, "__no").select("__no", F.col("component_id").alias("__group"))
    first = known.select("__no", "doc_id").join(group, "__no").groupBy("__group").agg(F.min(F.struct("doc_id", "__no")).alias("__first")).select(F.col("__first.__no").alias("__no"))
    return rows.join(first, "__no", "left_semi").unionByName(rows.where("doc_id is null")).drop("__no")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in its new proportions: a document is repeated as often as the mix
    takes its source whole, and the blocks drawn beyond that follow as pieces of it.
    Texts without words are never drawn; null sources are one source, and null or
    repeated doc_ids have their own places."""
    return mixing.rebuilt(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.  Every row is packed for itself, those of null or
    repeated doc_id too; null and empty texts are the closing mark alone."""
    small_batches(spark)
    out = packing.packed(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("near_dup", drop_copies), ("mixing", mix_sources), ("packing", pack)]

#: No stage is plain SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again,
    and deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        drop(before)
    return docs
