"""Queries over date texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.timestamps import parsed, site_zones, utc_text
from lectern.runtime import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, published_utc) of every article whose published_date denotes an instant; null ids are left out."""
    rows = load(spark, sf_dir, "articles").select("id", "source_id", "source_domain", "published_date").where(F.col("id").isNotNull() & F.col("published_date").isNotNull())
    # Repeated rows go before the parse: only ids and short texts are shuffled.
    placed = site_zones(rows.distinct(), load(spark, sf_dir, "sources").select("id", "domain", "locale", "timezone"))
    out = placed.select("id", parsed(F.col("published_date"), F.col("site_zone"), F.col("month_first")).alias("instant")).where(F.col("instant").isNotNull())
    return out.select("id", utc_text(F.col("instant")).alias("published_utc")).distinct()
