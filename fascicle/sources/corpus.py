"""Adapters from the test tables to the engine's tables, mirrored in SQL by plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.functions.dates import date_int
from fascicle.functions.filters import SECTIONS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 31).cast("int"))
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % 16).cast("int") + 1)
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("page_content"), F.substring(F.concat("source", F.lit(" "), "lang"), 1, 350).alias("heading"), d.cast("string").alias("date"), date_int(d).alias("dateInt"),
        ((F.col("doc_id") % 16).cast("int") + 1).alias("pageNumber"), section.alias("section"), F.lit(1).alias("chunkIndex"), F.lit(1).alias("chunkTotal"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(read(spark, sf_dir, "conversations"))


def messages_of(conversations: DataFrame) -> DataFrame:
    """Messages of a table or stream of conversations. A stored chat has two roles, so system rows are none."""
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return conversations.where("role <> 'system'").select(
        F.col("conv_id").alias("sessionId"), F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("userId"), "role", F.col("text").alias("content"), at.alias("createdAt"), (F.col("conv_id") * 1000 + F.col("turn")).alias("messageId")
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.concat("event_type", F.lit(" "), F.col("props")).alias("message"), (F.col("event_id") % 97).cast("string").alias("requestId"), F.col("ts").cast("timestamp").alias("createdAt"), F.col("props").alias("meta"))


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated articles: every document, with its whole text as summary. The quality label gives the
    relevance: high, low, or medium where there is none."""
    from fascicle.operators.curation import SECTIONS as NAMES

    section = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 9).cast("int") + 1)
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    relevance = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit(".pdf")).alias("source"), ((F.col("doc_id") % 16).cast("int") + 1).alias("pageNumber"), F.concat("lang", F.lit(" article "), F.col("doc_id").cast("string")).alias("title"), section.alias("section"), relevance.alias("examRelevance"),
        F.col("text").alias("summary"), F.array("lang", "source").alias("examTags"), F.timestamp_seconds(F.lit(1767225600) + (F.col("doc_id") * 7919) % 86400).alias("createdAt"),
    )
