"""The reference's relations over the tables of a data directory, with repeated rows merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.runtime import load

RANKED_TYPES = ("PERSON", "ORG", "GPE", "EVENT", "PRODUCT", "NORP")


def articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row an id: the one created last. Only the asked columns are read; the window's key is the id, so no key is hot."""
    rows = load(spark, sf_dir, "articles").where(F.col("id").isNotNull())
    if columns:
        rows = rows.select(*dict.fromkeys(("id", "created_at", *columns)))
    order = Window.partitionBy("id").orderBy(F.col("created_at").desc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an entity id."""
    rows = load(spark, sf_dir, "named_entities").where(F.col("id").isNotNull())
    return rows.groupBy("id").agg(*(F.max(c).alias(c) for c in rows.columns if c != "id"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, entity_id, ordinal, mentions, relevance, origin): one row a pair, the first ordinal and the largest values."""
    rows = load(spark, sf_dir, "article_entities").where(F.col("article_id").isNotNull() & F.col("entity_id").isNotNull())
    return rows.groupBy("article_id", "entity_id").agg(F.min("ordinal").alias("ordinal"), F.max("mentions").alias("mentions"), F.max("relevance").alias("relevance"), F.min("origin").alias("origin"))


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model-call log: events as calls (task, started_at, duration, success)."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("task_name"), F.col("ts").alias("started_at"), F.col("value").alias("duration_seconds"), F.col("user_id").alias("model"), (F.col("event_type") != "error").cast("int").alias("success"))


def url_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL cache: every article's page by the hash of its address; one in seven is a redirect to its front page."""
    a = articles(spark, sf_dir, "url", "content")
    domain = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    moved = F.col("id") % 7 == 0
    target = F.concat(F.lit("https://"), domain, F.lit("/"))
    rows = a.where(F.col("url").isNotNull()).select(F.col("url"), domain.alias("domain"), F.when(moved, target).otherwise(F.coalesce("content", F.lit(""))).alias("content"), F.when(moved, 301).otherwise(200).alias("status_code"), "created_at")
    return rows.select(F.sha2("url", 256).alias("url_hash"), "url", "domain", "content", "status_code", F.length("content").cast("long").alias("content_length"), "created_at")
