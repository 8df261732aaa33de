"""Items that appear together: an incremental table of pair counts and their association.

Method: the baskets that changed emit signed deltas, minus one for every pair and item of the old basket and plus
one for the new; the deltas merge into counts kept in hash buckets, of which only touched ones are rewritten;
scores are recomputed from the merged counts.

Rows with a null basket or item take no part; repeated rows count once. Baskets larger than ``LONG`` items
do not emit all their pairs: their rows are kept as they are, and a pair's occurrences in them are looked up for
the pairs that can matter, so counts stay exact (see ``associations``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.runtime import load, staged

#: A basket of more items is long. At most this many squared over two pairs come from one basket.
LONG = 512
#: Items of one cell of a basket: bounds the array one task holds, whatever the basket's size.
CELL = 64
#: Buckets of a table unless it says otherwise, and the tasks that write each of them.
BUCKETS = 16
WRITERS = 4


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, item): the distinct pairs without nulls."""
    return rows.select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("item")).dropna().distinct()


def basket_pairs(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """(a, b, n) with a < b: in how many baskets of (basket, item, size) each pair stands, summed with ``weight``.

    A basket of s items is cut into ceil(s / CELL) blocks and each block pair is one cell, so no row or task
    holds more than two blocks of a basket, and the pairs of one basket spread over many tasks.
    """
    weight = F.lit(1) if weight is None else weight
    count = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    placed = rows.select("basket", "item", weight.alias("weight"), count.alias("blocks"), F.pmod(F.xxhash64("item"), count).cast("int").alias("block"))
    lows = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    cells = placed.select("basket", "item", "weight", "block", F.explode(lows).alias("c")).groupBy("basket", "c", "weight").agg(
        F.sort_array(F.collect_list(F.when(F.col("block") == F.col("c.x"), F.col("item")))).alias("left"),
        F.sort_array(F.collect_list(F.when(F.col("block") == F.col("c.y"), F.col("item")))).alias("right"),
    )
    pair = lambda i: F.transform(F.filter("right", lambda j: (F.col("c.x") != F.col("c.y")) | (j > i)), lambda j: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b")))
    return cells.select("weight", F.explode(F.flatten(F.transform("left", pair))).alias("p")).groupBy("p.a", "p.b").agg(F.sum("weight").alias("n"))


def _bucket(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a bucket in ``WRITERS`` tasks, so that neither their number nor their size hangs on the buckets."""
    return rows.repartition("bucket", F.pmod(F.hash(*keys), F.lit(WRITERS)))


@dataclass
class PairTable:
    """Persistent counts: one stored DataFrame a bucket for pairs and items, the long baskets, and the number of baskets."""

    spark: SparkSession
    pairs: dict[int, DataFrame] = field(default_factory=dict)
    items: dict[int, DataFrame] = field(default_factory=dict)
    long_rows: DataFrame | None = None
    baskets: int = 0
    buckets: int = BUCKETS

    def updated(self, old: DataFrame | None, new: DataFrame | None) -> PairTable:
        """The table after the changed baskets' old rows (basket, item) are replaced by the new ones."""
        signed = [x.withColumn("sign", F.lit(s)) for x, s in ((old, -1), (new, 1)) if x is not None]
        rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
        sizes = staged(rows.groupBy("basket", "sign").agg(F.count(F.lit(1)).alias("size")), "basket-sizes")
        rows = staged(rows.join(sizes, ["basket", "sign"]), "changed-baskets")
        short, long = rows.where(F.col("size") <= LONG), rows.where(F.col("size") > LONG)
        count = sizes.groupBy().agg(F.sum("sign").alias("n")).first().n or 0
        pairs = self._merged(self.pairs, basket_pairs(short, F.col("sign")), ["a", "b"])
        items = self._merged(self.items, rows.groupBy("item").agg(F.sum("sign").alias("n")), ["item"])
        kept = long.where(F.col("sign") == 1).select("basket", "item")
        if self.long_rows is not None:
            kept = self.long_rows.join(long.where(F.col("sign") == -1).select("basket").distinct(), "basket", "left_anti").unionByName(kept)
        return PairTable(self.spark, pairs, items, staged(kept, "long-baskets"), self.baskets + count, self.buckets)

    def _merged(self, state: dict[int, DataFrame], delta: DataFrame, keys: list[str]) -> dict[int, DataFrame]:
        """``state`` with the touched buckets rewritten: one pass over the delta and the buckets it touches."""
        delta = staged(delta.where(F.col("n") != 0).withColumn("bucket", _bucket(self.buckets, *keys)).transform(_spread, *keys), "deltas", ["bucket"])
        touched = sorted(r.bucket for r in delta.select("bucket").distinct().collect())  # at most as many rows as buckets
        before = [state[b].withColumn("bucket", F.lit(b)) for b in touched if b in state]
        merged = delta.select(*keys, "n", "bucket")
        if before:
            for x in before:
                merged = merged.unionByName(x.select(*keys, "n", "bucket"))
            merged = staged(merged.groupBy("bucket", *keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0).transform(_spread, *keys), "counts", ["bucket"])
        return {**state, **{b: merged.where(F.col("bucket") == b).select(*keys, "n") for b in touched}}

    def _all(self, state: dict[int, DataFrame], schema: str) -> DataFrame:
        out = None
        for b in state.values():
            out = b if out is None else out.unionByName(b)
        return self.spark.createDataFrame([], schema) if out is None else out

    def save(self, path: str) -> None:
        """Write the table into a folder that ``loaded`` reads back, one partition a bucket."""
        for name, state, schema in (("pairs", self.pairs, "a long, b long, n long"), ("items", self.items, "item long, n long")):
            rows = [x.withColumn("bucket", F.lit(b)) for b, x in state.items()] or [self.spark.createDataFrame([], f"{schema}, bucket int")]
            reduce(DataFrame.unionByName, rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        long = self.long_rows if self.long_rows is not None else self.spark.createDataFrame([], "basket long, item long")
        long.write.mode("overwrite").parquet(f"{path}/long")
        self.spark.createDataFrame([(self.baskets, self.buckets)], "baskets long, buckets int").write.mode("overwrite").parquet(f"{path}/counts")

    @classmethod
    def loaded(cls, spark: SparkSession, path: str) -> PairTable:
        """The table that ``save`` wrote."""
        counts = spark.read.parquet(f"{path}/counts").first()

        def state(name: str, schema: str) -> dict[int, DataFrame]:
            rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{name}")
            known = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most as many rows as buckets
            return {b: rows.where(F.col("bucket") == b).drop("bucket") for b in known}

        return cls(spark, state("pairs", "a long, b long, n long"), state("items", "item long, n long"), spark.read.parquet(f"{path}/long"), counts.baskets, counts.buckets)

    def affected(self, items: DataFrame, min_count: int) -> DataFrame:
        """``associations`` of the pairs with one of the ``items`` (item), whose own or common counts an update has changed."""
        scored = self.associations(min_count)
        mine = lambda side: items.select(F.col("item").alias(side)).distinct()
        one = scored.join(mine("entity_a"), "entity_a", "left_semi")
        return one.unionByName(scored.join(mine("entity_a"), "entity_a", "left_anti").join(mine("entity_b"), "entity_b", "left_semi"))

    def associations(self, min_count: int) -> DataFrame:
        """(entity_a, entity_b, n_ab, n_a, n_b, lift) of the pairs that share at least ``min_count`` baskets.

        Long baskets: pairs known from short ones are looked up in them by two joins. A pair that no short basket
        holds needs ``min_count`` long ones, so only items of that many long baskets form pairs there.
        """
        pairs = self._all(self.pairs, "a long, b long, n long").select("a", "b", "n")
        items = self._all(self.items, "item long, n long")
        long = self.long_rows
        if long is not None and not long.isEmpty():
            known = pairs.select("a", "b")
            left, right = long.select("basket", F.col("item").alias("a")), long.select("basket", F.col("item").alias("b"))
            both = known.join(left, "a").join(right, ["basket", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
            often = long.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("item")
            narrow = long.join(often, "item")
            narrow = narrow.join(narrow.groupBy("basket").agg(F.count(F.lit(1)).alias("size")), "basket")
            only = basket_pairs(narrow).where(F.col("n") >= min_count).join(known, ["a", "b"], "left_anti")
            pairs = pairs.unionByName(both).unionByName(only).groupBy("a", "b").agg(F.sum("n").alias("n"))
        frequent = pairs.where(F.col("n") >= min_count)
        n_a, n_b = items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), items.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
        lift = F.col("n") * F.lit(float(self.baskets)) / (F.col("n_a") * F.col("n_b").cast("double"))
        scored = frequent.join(n_a, "a").join(n_b, "b")
        return scored.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), F.col("n").alias("n_ab"), "n_a", "n_b", lift.alias("lift"))


def more_often(scored: DataFrame, baskets_count: int, times: int) -> DataFrame:
    """The pairs that meet at least ``times`` as often as by chance, compared in whole numbers."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    return scored.where(whole("n_ab") * F.lit(baskets_count).cast("decimal(19,0)") >= whole("n_a") * whole("n_b") * F.lit(times).cast("decimal(2,0)"))


MIN_SHARED = 5
MIN_LIFT = 3


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_a, entity_b) of the pairs in at least 5 shared articles and at least 3 times as often as by chance."""
    table = PairTable(spark).updated(None, baskets(load(spark, sf_dir, "article_entities"), "article_id", "entity_id"))
    return more_often(table.associations(MIN_SHARED), table.baskets, MIN_LIFT).select("entity_a", "entity_b")


def p2_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored pairs after an update: the table is first built without the rows of origin ``classification``, whose articles then change."""
    rows = load(spark, sf_dir, "article_entities")
    early = baskets(rows.where(F.coalesce("origin", F.lit("")) != "classification"), "article_id", "entity_id")
    changed = rows.where(F.col("origin") == "classification").select(F.col("article_id").alias("basket")).distinct()
    table = PairTable(spark).updated(None, early)
    table = table.updated(early.join(changed, "basket", "left_semi"), baskets(rows, "article_id", "entity_id").join(changed, "basket", "left_semi"))
    scored = more_often(table.associations(MIN_SHARED), table.baskets, MIN_LIFT)
    return scored.select("entity_a", "entity_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))
