"""Lines repeated across the documents of one site.

Method: lines are nodes weighted by the site's distinct articles that hold them, consecutive lines are edges
weighted likewise; nodes and edges of high support stay, their connected components are the site's
boilerplate blocks, and every occurrence of a block's line is a row of the result.

A line is repeated if at least ``MIN_ARTICLES`` distinct articles of its site hold it and at least
``MIN_SHARE`` of the site's distinct articles do, those without content included. Ties do not arise: the bounds
are inclusive. Empty tables give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.lines import alike, line_array, one_row_each, with_site
from lectern.runtime import load, staged

MIN_ARTICLES = 3
MIN_SHARE = 0.2


def digests(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, site, lines) with each line as its number and the hash of its comparable form; one row an article."""
    sited = with_site(one_row_each(articles, "id").select("id", "source_id", "source_domain", "content"), sources)
    lines = F.transform(line_array(F.col("content")), lambda l: F.struct(l["no"].alias("no"), F.xxhash64(alike(l["text"])).alias("h")))
    return sited.select("id", "site", lines.alias("lines"))


def repeated_nodes(digest: DataFrame, min_articles: int = MIN_ARTICLES, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, h, articles): the lines of high support."""
    sizes = digest.groupBy("site").agg(F.count(F.lit(1)).alias("size"))
    held = digest.select("site", F.explode(F.array_distinct(F.transform("lines", lambda l: l["h"]))).alias("h")).groupBy("site", "h").agg(F.count(F.lit(1)).alias("articles"))
    return held.where(F.col("articles") >= min_articles).join(sizes, "site").where(F.col("articles") >= F.lit(min_share) * F.col("size")).select("site", "h", "articles")


def _site_sets(nodes: DataFrame) -> DataFrame:
    """One row a site. Its set is bounded by the lines of an average article over ``MIN_SHARE``, whatever the site's size."""
    return nodes.groupBy("site").agg(F.sort_array(F.collect_set("h")).alias("hot"))


def occurrences(digest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, site, hits): the occurrences of the nodes in each article, in the order of the lines."""
    hits = F.filter("lines", lambda l: F.array_contains(F.col("hot"), l["h"]))
    return digest.join(_site_sets(nodes), "site").select("id", "site", hits.alias("hits"), F.transform("lines", lambda l: F.when(F.array_contains(F.col("hot"), l["h"]), l["h"])).alias("seq"))


def blocks(found: DataFrame, nodes: DataFrame, min_articles: int = MIN_ARTICLES) -> DataFrame:
    """(site, h, block, articles): components of the graph of consecutive repeated lines, named by their least hash."""
    pairs = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), F.size("seq") - 2), lambda i: F.struct(F.get("seq", i).alias("a"), F.get("seq", i + 1).alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != p["b"])))
    edges = found.where(F.size("seq") > 1).select("site", F.explode(pairs).alias("p")).groupBy("site", "p.a", "p.b").agg(F.count(F.lit(1)).alias("articles")).where(F.col("articles") >= min_articles)
    loops = nodes.select("site", F.col("h").alias("a"), F.col("h").alias("b"), "articles")
    schema = "site string, h long, block long, articles long"

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        # One site's graph: its nodes are bounded (see _site_sets), so its edges are too.
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        own = pdf[pdf["a"] == pdf["b"]]
        return pd.DataFrame({"site": own["site"], "h": own["a"], "block": [root(x) for x in own["a"].tolist()], "articles": own["articles"]})

    return loops.unionByName(edges).groupBy("site").applyInPandas(components, schema)


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    digest = staged(digests(load(spark, sf_dir, "articles"), load(spark, sf_dir, "sources")), "line-digests")
    nodes = staged(repeated_nodes(digest), "repeated-lines")
    return digest, nodes, occurrences(digest, nodes)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line_no) of every occurrence of a line that belongs to a boilerplate block of its site."""
    _, nodes, found = _parts(spark, sf_dir)
    members = blocks(found, nodes).groupBy("site").agg(F.collect_set("h").alias("members"))
    kept = found.join(members, "site").select("id", F.filter("hits", lambda l: F.array_contains(F.col("members"), l["h"])).alias("hits"))
    return kept.select("id", F.explode(F.col("hits.no")).alias("line_no"))


def p7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, block, lines, articles): the blocks of each site with the largest support of their lines."""
    _, nodes, found = _parts(spark, sf_dir)
    return blocks(found, nodes).groupBy("site", "block").agg(F.count(F.lit(1)).alias("lines"), F.max("articles").alias("articles"))


def removed(articles: DataFrame, found: DataFrame) -> DataFrame:
    """(id, content) of the articles without the found (id, line_no) lines; articles with no such line keep their content."""
    gone = found.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    rows = articles.where(F.col("id").isNotNull()).select("id", "content").dropDuplicates(["id"])
    kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), (i + 1).cast("int")))
    return rows.join(gone, "id", "left").select("id", F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"))
