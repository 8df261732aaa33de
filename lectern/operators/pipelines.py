"""Pipelines composed of the single operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import html
from lectern.operators import ingest
from lectern.runtime import staged


def extracted(pages: DataFrame, domains: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(articles, failed) of pages (url, domain, content): cleaned, hashed and taken apart by the layout of their domain.

    ``domains`` names the layout of each domain that has one; pages of other domains, and those without a title, fail with a reason.
    """
    layout = F.coalesce(*(F.when(F.col("domain") == d, F.lit(name)) for d, name in domains.items()), F.lit(None).cast("string"))
    rows = pages.select("url", "domain", "content", layout.alias("layout"))
    known = None
    for name in sorted(set(domains.values())):
        own = rows.where(F.col("layout") == name).withColumn("f", html.fields_column(F.col("content"), name))
        known = own if known is None else known.unionByName(own)
    cleaned = known.withColumn("cleaned_html_hash", F.sha2(html.clean_html_column(F.col("content")), 256))
    made = staged(cleaned.select("url", "domain", F.sha2("url", 256).alias("hash"), "cleaned_html_hash", "f.*"), "extracted")
    lost = rows.where(F.col("layout").isNull()).select("url", "domain", F.lit("no extractor").alias("reason"))
    return made.where(F.col("title").isNotNull()), lost.unionByName(made.where(F.col("title").isNull()).select("url", "domain", F.lit("no title").alias("reason")))


def reingested(cache: DataFrame, old: DataFrame, domains: dict[str, str], reindex: bool = False, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(articles, report): the cached pages taken into ``old``, and (status, pages).

    Redirects are left out. Pages whose article is known by hash or address are skipped unless they are to be indexed again.
    """
    pages = cache.where(~F.col("status_code").between(300, 399))
    known = pages.join(old.select(F.col("hash").alias("url_hash")).where(F.col("url_hash").isNotNull()).distinct(), "url_hash", "left_semi").select("url")
    known = known.unionByName(pages.join(old.select("url").where(F.col("url").isNotNull()).distinct(), "url", "left_semi").select("url")).distinct()
    todo = pages if reindex else pages.join(known, "url", "left_anti")
    new, failed = extracted(todo, domains)
    merged = ingest.upserted(old, new, force)
    count = lambda rows, status: rows.agg(F.lit(status).alias("status"), F.count(F.lit(1)).alias("pages"))
    report = count(merged.where(F.col("action") == "created"), "created").unionByName(count(merged.where(F.col("action").isin("updated", "reset")), "updated"))
    report = report.unionByName(count(failed, "error")).unionByName(count(pages.limit(0) if reindex else pages.join(known, "url", "left_semi"), "skipped"))
    return merged, report
