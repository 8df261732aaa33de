"""Relevance scores: entities within articles, clusters within articles, flash items against their peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import dot, norm

WEIGHTS = {"entity": 0.45, "freshness": 0.25, "quality": 0.15, "diversity": 0.10, "authority": 0.05}
HALF_LIVES = {"breaking": 6.0, "timely": 12.0, "evergreen": 48.0}
TIERS = ((0.75, "critical"), (0.55, "high"), (0.35, "medium"))


def entity_relevance(name: Column, mentions: Column, total: Column, title: Column, subtitle: Column, flat: Column) -> Column:
    """``flat`` is the content in lower case with collapsed white space. The share of mentions, raised by half of it for the title, a quarter for the subtitle, and for early places and many mentions; 0 without mentions."""
    holds = lambda text: F.coalesce(F.contains(F.lower(text), F.lower(name)), F.lit(False))
    place = F.try_divide(F.instr(flat, F.lower(name)) - 1, F.length(flat))
    found = F.instr(flat, F.lower(name)) > 0
    bonus = F.when(holds(title), 0.5).otherwise(0.0) + F.when(holds(subtitle), 0.25).otherwise(0.0)
    bonus = bonus + F.when(found & (place < 0.2), 0.3).when(found & (place < 0.4), 0.15).otherwise(0.0)
    bonus = bonus + F.when(mentions > 3, 0.1 * F.least(mentions - 3, F.lit(5))).otherwise(0.0)
    score = mentions / total * (F.lit(1.0) + bonus)
    return F.when(total > 0, score).otherwise(0.0)


def local_relevance(mentions: DataFrame) -> DataFrame:
    """Adds ``local``: ``base`` over the article's largest among rows that count (``ignored`` = 0); the others get 0.

    Windows are per article, whose entities are few.
    """
    top = F.max(F.when(F.col("ignored") == 0, F.col("base"))).over(Window.partitionBy("article_id"))
    factor = F.when(F.coalesce(top, F.lit(0.0)) > 0, 1.0 / top).otherwise(1.0)
    return mentions.withColumn("local", F.when(F.col("ignored") == 1, 0.0).otherwise(F.col("base") * factor))


def with_transfers(scored: DataFrame, refs: DataFrame) -> DataFrame:
    """(article_id, entity_id, relevance): what ignored entities scored goes in equal parts to the canonicals of (entity_id, canonical_id) in the same article."""
    top = F.max(F.when(F.col("ignored") == 0, F.col("base"))).over(Window.partitionBy("article_id"))
    rows = scored.withColumn("raw", F.col("base") * F.when(F.coalesce(top, F.lit(0.0)) > 0, 1.0 / top).otherwise(1.0))
    share = refs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("k")).join(refs, "entity_id")
    given = rows.where(F.col("ignored") == 1).join(share, "entity_id").select("article_id", F.col("canonical_id").alias("entity_id"), (F.col("raw") / F.col("k")).alias("r"))
    own = rows.select("article_id", "entity_id", F.when(F.col("ignored") == 1, 0.0).otherwise(F.col("raw")).alias("r"))
    given = given.join(own.select("article_id", "entity_id"), ["article_id", "entity_id"], "left_semi")
    return own.unionByName(given).groupBy("article_id", "entity_id").agg(F.sum("r").alias("relevance"))


def cluster_boost(name: Column, core: Column, secondary: Column) -> Column:
    """1.3 for a name in a core sentence, else 1 for one in a secondary sentence, else 0.7; texts and name in lower case."""
    return F.when(F.contains(core, name), 1.3).when(F.contains(secondary, name), 1.0).otherwise(0.7)


def cluster_score(size: Column, total: Column, to_title: Column, to_article: Column, mean_index: Column, probability: Column) -> Column:
    last = F.greatest(F.lit(1), total - 1)
    return 0.35 * size / total + 0.30 * (to_title + 1) / 2 + 0.20 * (to_article + 1) / 2 + 0.10 * (1 - mean_index / last) + 0.05 * probability


def cluster_category(label: Column, score: Column) -> Column:
    """Noise is filler or secondary; other clusters are core, secondary or filler."""
    noise = F.when(score < 0.35, "filler").otherwise("secondary")
    return F.when(label == -1, noise).when(score >= 0.60, "core").when(score >= 0.30, "secondary").otherwise("filler")


def freshness(hours: Column, kind: Column) -> Column:
    """exp(-hours / H) with H by kind (12 where unknown); no date gives 0.3, breaking news under an hour 1."""
    half = F.lit(12.0)
    for name, h in HALF_LIVES.items():
        half = F.when(kind == name, h).otherwise(half)
    return F.when(hours.isNull(), 0.3).when((kind == "breaking") & (hours < 1), 1.0).otherwise(F.exp(-hours / half))


def quality(score: Column, size: Column) -> Column:
    return F.least(score * F.when(size < 3, 0.8).when(size > 10, 1.2).otherwise(1.0), F.lit(1.0))


def entity_importance(top: DataFrame) -> DataFrame:
    """(article_id, importance) of (article_id, local, overall): the mean product of the five best, raised if one of the best third is prominent."""
    order = Window.partitionBy("article_id").orderBy(F.desc_nulls_last("local"), "entity_id")
    five = top.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= 5).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("article_id")))
    leading = F.col("rn") <= F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("n") * 0.33)))
    agg = five.groupBy("article_id").agg(F.avg(F.col("local") * F.col("overall")).alias("mean"), F.max(F.when(leading, F.col("overall"))).alias("peak"))
    return agg.select("article_id", F.least(F.col("mean") * F.when(F.col("peak") > 0.8, 1.3).otherwise(1.0), F.lit(1.0)).alias("importance"))


#: Items and peers of one block pair: bounds what one row holds and spreads the comparisons over tasks.
BLOCK = 256


def topic_diversity(items: DataFrame, since: Column) -> DataFrame:
    """(id, diversity) of (id, embedding, created_at): 1 minus the largest cosine to another item created since ``since``.

    No vector gives 0.5, no peers 1, and a cosine under 0.3 counts as none. Items meet the peers block by block.
    """
    held = items.where(F.col("embedding").isNotNull()).withColumn("length", norm(F.col("embedding")))
    recent = held.where(F.col("created_at") >= since)
    count = recent.agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    block = lambda rows: rows.join(F.broadcast(count)).where(F.col("blocks") > 0)  # noqa: E731 - one row
    peers = block(recent).select(F.struct(F.col("id").alias("id"), F.col("embedding").alias("v"), F.col("length").alias("length")).alias("p"), F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    peers = peers.groupBy("block").agg(F.collect_list("p").alias("peers"))
    own = block(held).select("id", "embedding", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    others = F.filter("peers", lambda p: p["id"] != F.col("id"))
    near = own.join(peers, "block").select("id", F.array_max(F.transform(others, lambda p: dot(F.col("embedding"), p["v"]) / F.nullif(F.col("length") * p["length"], F.lit(0.0)))).alias("near")).groupBy("id").agg(F.max("near").alias("near"))
    rows = items.select("id", F.col("embedding").isNull().alias("none")).join(near, "id", "left")
    return rows.select("id", F.when(F.col("none"), 0.5).when(F.col("near").isNull() | (F.col("near") < 0.3), 1.0).otherwise(1.0 - F.col("near")).alias("diversity"))


def weighted(weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of the component columns; the weights must total 1 within 0.01."""
    weights = weights or WEIGHTS
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("weights must total 1")
    parts = [F.lit(w) * F.col(c) for c, w in weights.items()]
    return sum(parts[1:], parts[0])


def tier(score: Column) -> Column:
    out = F.lit("low")
    for bound, name in reversed(TIERS):
        out = F.when(score >= bound, name).otherwise(out)
    return out
