"""Keyed merges: articles with change detection, the URL cache, and rows that must not repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` merged by hash, else by url, and ``action``: kept, updated, reset or created.

    A row is reset (its clusterized_at is cleared) if it is forced or its cleaned_html_hash is missing on either side or changed.
    Both have hash, url, title, cleaned_html_hash; ``old`` also id and clusterized_at. Two equi-joins stand
    for the alternative keys, so nothing is compared pairwise.
    """
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in ("hash", "url", "title", "cleaned_html_hash"))).dropDuplicates(["n_hash"])
    by_hash = old.join(n, old["hash"] == n["n_hash"], "left")
    left = n.join(old.select("hash"), n["n_hash"] == F.col("hash"), "left_anti")
    u = left.dropDuplicates(["n_url"]).select(*(F.col(f"n_{c}").alias(f"u_{c}") for c in ("hash", "url", "title", "cleaned_html_hash")))
    both = by_hash.join(u, F.col("n_hash").isNull() & (by_hash["url"] == u["u_url"]), "left")
    pick = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(f"u_{c}"))
    hit = F.col("n_hash").isNotNull() | F.col("u_hash").isNotNull()
    changed = F.lit(force) | pick("cleaned_html_hash").isNull() | F.col("cleaned_html_hash").isNull() | (pick("cleaned_html_hash") != F.col("cleaned_html_hash"))
    action = F.when(~hit, "kept").when(changed, "reset").otherwise("updated")
    merged = both.select("id", F.when(hit, pick("url")).otherwise(F.col("url")).alias("url"), F.when(hit, pick("cleaned_html_hash")).otherwise(F.col("cleaned_html_hash")).alias("cleaned_html_hash"), F.when(hit, pick("hash")).otherwise(F.col("hash")).alias("hash"), F.when(hit, pick("title")).otherwise(F.col("title")).alias("title"), F.when(hit & changed, F.lit(None)).otherwise(F.col("clusterized_at")).alias("clusterized_at"), action.alias("action"))
    fresh = left.join(old.select(F.col("url").alias("o_url")).where(F.col("url").isNotNull()).distinct(), F.col("n_url") == F.col("o_url"), "left_anti")
    created = fresh.select(F.lit(None).cast("long").alias("id"), F.col("n_url").alias("url"), F.col("n_cleaned_html_hash").alias("cleaned_html_hash"), F.col("n_hash").alias("hash"), F.col("n_title").alias("title"), F.lit(None).cast("timestamp_ntz").alias("clusterized_at"), F.lit("created").alias("action"))
    return merged.unionByName(created)


def cache_upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new pages by url_hash; a page keeps the time it was first stored."""
    first = old.select("url_hash", F.col("created_at").alias("first"))
    fresh = new.withColumn("content_length", F.length("content").cast("long")).join(first, "url_hash", "left").withColumn("created_at", F.coalesce("first", "created_at")).drop("first")
    return old.join(new.select("url_hash"), "url_hash", "left_anti").unionByName(fresh)


def redirect_followed(cache: DataFrame) -> DataFrame:
    """(url_hash, status_code, final_hash, content_length) after at most one redirect; a target that is missing leaves the redirect itself."""
    target = cache.select(F.col("url_hash").alias("t_hash"), F.col("status_code").alias("t_status"), F.col("content_length").alias("t_length"))
    moved = F.col("status_code").between(300, 399)
    rows = cache.withColumn("to", F.when(moved, F.sha2("content", 256))).join(target, F.col("to") == F.col("t_hash"), "left")
    return rows.select("url_hash", F.coalesce("t_status", "status_code").alias("status_code"), F.coalesce("t_hash", "url_hash").alias("final_hash"), F.coalesce("t_length", "content_length").alias("content_length"))


def by_hash(cache: DataFrame, key: str) -> DataFrame:
    """The entry of a hash, or those that begin with at least eight characters of it; the prefix reaches the scan."""
    if len(key) == 64:
        return cache.where(F.col("url_hash") == key)
    if len(key) < 8:
        raise ValueError("a prefix needs at least eight characters")
    return cache.where(F.col("url_hash").startswith(key))


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, key: str, column: str) -> DataFrame:
    """The rows that stay when parents (key) are deleted: a cascade over one child table."""
    return rows.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def if_given(condition: Column, value: object) -> Column:
    """An optional filter: no value, no condition."""
    return F.lit(True) if value is None else condition
