"""Selection of a balanced digest, without a sequential loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def digest(items: DataFrame, min_count: int = 1, max_count: int = 5, low: float = 0.55, high: float = 0.75, per_source: int = 2) -> DataFrame:
    """(id, source, score, place) of (id, source, score): all critical items, normal ones up to the maximum, fillers up to the minimum.

    No source has more than ``per_source`` items. The closed form holds for ``min_count <= max_count``. Ties go
    to the smaller id. What is ranked over all sources is at most ``per_source`` items of each.
    """
    if min_count > max_count:
        raise ValueError("min_count must not exceed max_count")
    by_source = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    fit = items.where(F.col("score").isNotNull()).withColumn("rs", F.row_number().over(by_source)).where(F.col("rs") <= per_source)
    group = F.when(F.col("score") >= high, 0).when(F.col("score") >= low, 1).otherwise(2)
    # Only the first max_count of a group can be chosen, beside all critical ones.
    critical = fit.where(F.col("score") >= high)
    rest = [fit.where((group == g)).orderBy(F.desc("score"), "id").limit(max_count) for g in (1, 2)]
    few = critical.unionByName(rest[0]).unionByName(rest[1]).withColumn("g", group)
    ranked = few.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "id")))
    sizes = few.agg(F.count_if(F.col("g") == 0).alias("nc"), F.count_if(F.col("g") == 1).alias("nn"))
    normal = F.greatest(F.lit(0), F.least(F.col("nn"), F.lit(max_count) - F.col("nc")))
    chosen = (F.col("g") == 0) | ((F.col("g") == 1) & (F.col("rn") <= normal)) | ((F.col("g") == 2) & (F.col("rn") <= F.greatest(F.lit(0), F.lit(min_count) - F.col("nc") - normal)))
    out = ranked.join(F.broadcast(sizes)).where(chosen)  # one row
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id"))).select("id", "source", "score", "place")


def training_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, label) of articles (id, cat, sub): 0.95 in the subcategory, 0.7 in another one of the category, 0 in another category, 1 with itself.

    Partners follow in the order of a hash of the id, wrapping round at the end: the next article of the subcategory, and for the
    wider tiers one of the next group, by the article's number. Articles of subcategories with fewer than two articles have no
    pairs of their own, but serve as partners.
    """
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.sha2(F.col("id").cast("string"), 256), "id")
    size = F.count(F.lit(1)).over(Window.partitionBy("cat", "sub"))
    placed = rows.select("id", "cat", "sub", (F.row_number().over(by("cat", "sub")) - 1).alias("n"), size.alias("size"))
    # The groups are few: subcategories by category, and categories, each with the next one of its kind.
    wrapped = lambda name, within: F.coalesce(F.lead(name).over(within.orderBy(name)), F.min(name).over(within))
    subs = placed.groupBy("cat", "sub").agg(F.count(F.lit(1)).alias("size"))
    cats = placed.groupBy("cat").agg(F.count(F.lit(1)).alias("other_size"))
    beside = subs.select("cat", "sub", wrapped("sub", Window.partitionBy("cat")).alias("other")).where(F.col("sub") != F.col("other"))
    beside = beside.join(subs.select("cat", F.col("sub").alias("other"), F.col("size").alias("other_size")), ["cat", "other"])
    apart = cats.select("cat", wrapped("cat", Window.partitionBy(F.lit(0))).alias("other")).where(F.col("cat") != F.col("other"))
    apart = apart.join(cats.withColumnRenamed("cat", "other"), "other")
    from_sub = placed.select("cat", F.col("sub").alias("other"), F.col("n").alias("at"), F.col("id").alias("b"))
    from_cat = rows.select(F.col("cat").alias("other"), (F.row_number().over(by("cat")) - 1).alias("at"), F.col("id").alias("b"))
    own = placed.where(F.col("size") >= 2)
    labelled = lambda pairs, label: pairs.select(F.col("id").alias("a"), "b", F.lit(label).alias("label"))
    strong = own.withColumn("at", (F.col("n") + 1) % F.col("size")).withColumnRenamed("sub", "other").join(from_sub, ["cat", "other", "at"])
    medium = own.join(beside, ["cat", "sub"]).withColumn("at", F.col("n") % F.col("other_size")).join(from_sub, ["cat", "other", "at"])
    none = own.join(apart, "cat").withColumn("at", F.col("n") % F.col("other_size")).join(from_cat, ["other", "at"])
    itself = own.withColumn("b", F.col("id"))
    return labelled(strong, 0.95).unionByName(labelled(medium, 0.7)).unionByName(labelled(none, 0.0)).unionByName(labelled(itself, 1.0))


def ratio_pairs(rows: DataFrame, same_sub: int = 2, same_cat: int = 1, other_cat: int = 2) -> DataFrame:
    """(a, b, label) of articles (id, cat, sub) with so many partners of each kind: 0.95 in the subcategory, 0.7 in the next subcategory, 0 in the next category, 1 with itself.

    Small subcategories are not skipped; an article alone in its subcategory has no partner there. Partners follow in the order of a hash of the id and wrap round.
    """
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.sha2(F.col("id").cast("string"), 256), "id")
    wrapped = lambda name, within: F.coalesce(F.lead(name).over(within.orderBy(name)), F.min(name).over(within))
    placed = rows.select("id", "cat", "sub", (F.row_number().over(by("cat", "sub")) - 1).alias("n"), (F.row_number().over(by("cat")) - 1).alias("m"), F.count(F.lit(1)).over(Window.partitionBy("cat", "sub")).alias("size"))
    subs, cats = placed.groupBy("cat", "sub").agg(F.count(F.lit(1)).alias("k")), placed.groupBy("cat").agg(F.count(F.lit(1)).alias("k"))
    beside = subs.select("cat", "sub", wrapped("sub", Window.partitionBy("cat")).alias("other")).where(F.col("sub") != F.col("other")).join(subs.select("cat", F.col("sub").alias("other"), "k"), ["cat", "other"])
    apart = cats.select("cat", wrapped("cat", Window.partitionBy(F.lit(0))).alias("other")).where(F.col("cat") != F.col("other")).join(cats.select(F.col("cat").alias("other"), "k"), "other")
    times = lambda x, n, at: x.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("at", at)
    by_sub, by_cat = placed.select("cat", F.col("sub").alias("other"), F.col("n").alias("at"), F.col("id").alias("b")), placed.select(F.col("cat").alias("other"), F.col("m").alias("at"), F.col("id").alias("b"))
    strong = times(placed.withColumnRenamed("sub", "other"), same_sub, (F.col("n") + F.col("j")) % F.col("size")).join(by_sub, ["cat", "other", "at"]).where(F.col("id") != F.col("b"))
    medium = times(placed.join(beside, ["cat", "sub"]), same_cat, (F.col("n") + F.col("j")) % F.col("k")).join(by_sub, ["cat", "other", "at"])
    none = times(placed.join(apart, "cat"), other_cat, (F.col("n") + F.col("j")) % F.col("k")).join(by_cat, ["other", "at"])
    labelled = lambda x, label: x.select(F.col("id").alias("a"), "b", F.lit(label).alias("label"))
    return labelled(strong, 0.95).unionByName(labelled(medium, 0.7)).unionByName(labelled(none, 0.0)).unionByName(labelled(placed.withColumn("b", F.col("id")), 1.0))
