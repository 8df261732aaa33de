"""Entity graph: weighted co-occurrence, column-stochastic transitions, PageRank and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.runtime import staged

THRESHOLD = 0.3
DAMPING = 0.85


def time_weight(published: Column, as_of: Column, decay_days: float | None) -> Column:
    """exp(-days / decay) for past dates, else 1."""
    days = F.datediff(as_of, published)
    return F.lit(1.0) if decay_days is None else F.when(days > 0, F.exp(-days / F.lit(decay_days))).otherwise(F.lit(1.0))


def members(links: DataFrame, entities: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(article_id, name, relevance, size): ranked mentions of articles with at least two of them; null relevance counts as 0."""
    ranked = entities.where(F.col("entity_type").isin(*types)).select(F.col("id").alias("entity_id"), "name")
    rows = links.join(ranked, "entity_id").select("article_id", "name", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))
    sizes = rows.groupBy("article_id").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, "article_id").where(F.col("size") >= 2)


def edges(ranked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(src, dst, weight): for every ordered pair of an article, unless both are below the threshold, the relevance of dst over the article's size."""
    a = ranked.select("article_id", F.col("name").alias("src"), F.col("relevance").alias("rs"))
    b = ranked.select("article_id", F.col("name").alias("dst"), F.col("relevance").alias("rd"), "size")
    pairs = a.join(b, "article_id").where((F.col("src") != F.col("dst")) & ~((F.col("rs") < threshold) & (F.col("rd") < threshold)))
    return pairs.groupBy("src", "dst").agg(F.sum(F.col("rd") / F.col("size")).alias("weight"))


def transitions(graph: DataFrame) -> DataFrame:
    """(src, dst, p): each node's out-weights over their sum; nodes without weight have no rows."""
    out = graph.groupBy("src").agg(F.sum("weight").alias("total")).where(F.col("total") > 0)
    return graph.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))


def pagerank(nodes: DataFrame, moves: DataFrame, iterations: int, damping: float = DAMPING, tolerance: float | None = None, start: DataFrame | None = None) -> DataFrame:
    """(name, pr) by power iteration with dangling mass spread evenly.

    ``start`` (name, pr) warms the start; new nodes get the middle of its range. With a tolerance the vector
    before the last update is returned once the L1 change falls below it. The vector is a written table each
    round; only its sums reach the driver.
    """
    nodes = staged(nodes.select("name").distinct(), "nodes")
    moves = staged(moves, "moves")
    n = nodes.count()
    if not n:
        return nodes.withColumn("pr", F.lit(0.0))
    dangling = staged(nodes.join(moves.select(F.col("src").alias("name")).distinct(), "name", "left_anti"), "dangling")
    pr = nodes.withColumn("pr", F.lit(1.0 / n))
    if start is not None:
        low, high = start.agg(F.min("pr"), F.max("pr")).first()
        raw = nodes.join(start, "name", "left").select("name", F.coalesce("pr", F.lit(((low or 0) + (high or 0)) / 2 or 1.0 / n)).alias("pr"))
        total = raw.agg(F.sum("pr")).first()[0]
        pr = staged(raw.select("name", (F.col("pr") / F.lit(total)).alias("pr")), "rank")
    for _ in range(iterations):
        lost = (dangling.join(pr, "name").agg(F.sum("pr")).first()[0] or 0.0) * damping / n
        pushed = moves.join(pr, moves.src == pr.name).groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("p") * F.col("pr")).alias("in"))
        new = staged(nodes.join(pushed, "name", "left").select("name", (F.lit((1 - damping) / n + lost) + damping * F.coalesce("in", F.lit(0.0))).alias("pr")), "rank")
        total = new.agg(F.sum("pr")).first()[0]
        new = new.select("name", (F.col("pr") / F.lit(total)).alias("pr"))
        if tolerance is not None:
            delta = new.join(pr.withColumnRenamed("pr", "old"), "name").agg(F.sum(F.abs(F.col("pr") - F.col("old")))).first()[0]
            if delta < tolerance:
                return pr
        pr = new
    return pr


def min_max(ranks: DataFrame) -> DataFrame:
    """Adds ``scaled``: from 0 to 1 over all nodes, 1 if all are equal."""
    low, high = ranks.agg(F.min("pr"), F.max("pr")).first() or (None, None)
    if low is None or low == high:
        return ranks.withColumn("scaled", F.lit(1.0))
    return ranks.withColumn("scaled", (F.col("pr") - F.lit(low)) / F.lit(high - low))


def metrics(links: DataFrame, entities: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(name, article_count, total_relevance, avg_relevance, diversity): articles with one entity count too."""
    ranked = entities.where(F.col("entity_type").isin(*types)).select(F.col("id").alias("entity_id"), "name")
    rows = links.join(ranked, "entity_id").select("article_id", "name", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))
    own = rows.groupBy("name").agg(F.count(F.lit(1)).alias("article_count"), F.sum("relevance").alias("total_relevance"), F.avg("relevance").alias("avg_relevance"))
    near = rows.select("article_id", "name").join(rows.select("article_id", F.col("name").alias("other")), "article_id").where(F.col("name") != F.col("other"))
    met = near.select("name", "other").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("diversity"))
    return own.join(met, "name", "left").select("name", "article_count", "total_relevance", "avg_relevance", F.coalesce("diversity", F.lit(0)).alias("diversity"))
