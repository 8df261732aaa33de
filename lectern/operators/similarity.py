"""Approximate similarity join: MinHash over shingles, banded, with optional exact verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import shingles
from lectern.runtime import task_count

HASHES, BANDS = 50, 25
#: Names of one block of ``grid``: a task holds two of them, and their pairs by ``TILE`` names at a time.
BLOCK, TILE = 4096, 512
#: Columns of shingles that are multiplied at once.
COLUMNS = 1024


def minhash(grams: Column, hashes: int = HASHES) -> Column:
    """For each seed the least md5 of "seed:gram"; hex digests order as the numbers do. Null for no grams."""
    return F.when(F.size(grams) > 0, F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.array_min(F.transform(grams, lambda g: F.md5(F.concat(i.cast("string"), F.lit(":"), g))))))


def bands(signature: Column, count: int = BANDS, hashes: int = HASHES) -> Column:
    rows = hashes // count
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.array_join(F.slice(signature, b * rows + 1, F.lit(rows)), "|"))


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two arrays of distinct values, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def estimated(a: Column, b: Column, hashes: int = HASHES) -> Column:
    """The share of equal signature slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(hashes))


def signed(names: DataFrame, n: int = 2) -> DataFrame:
    """(id, type, grams, signature) of (id, name, type); names without shingles are left out."""
    grams = names.select("id", "type", shingles(F.col("name"), n).alias("grams")).where(F.size("grams") > 0)
    return grams.withColumn("signature", minhash(F.col("grams")))


def candidates(signatures: DataFrame) -> DataFrame:
    """(a, b) with a < b: names of one type that share a band. Equal bands meet by a hash join; a pair counts once."""
    rows = signatures.select("id", "type", F.posexplode(bands(F.col("signature"))).alias("band", "key"))
    left, right = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")
    return left.join(right, ["type", "band", "key"]).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def scored(signatures: DataFrame) -> DataFrame:
    """(a, b, exact, estimate) of the candidates."""
    side = lambda n: signatures.select(F.col("id").alias(n), F.col("grams").alias(f"g{n}"), F.col("signature").alias(f"s{n}"))
    both = candidates(signatures).join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", jaccard(F.col("ga"), F.col("gb")).alias("exact"), estimated(F.col("sa"), F.col("sb")).alias("estimate"))


def best(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """For each name its ``limit`` nearest candidates by the estimate, ties by id."""
    either = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "estimate").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "estimate"))
    order = Window.partitionBy("id").orderBy(F.desc("estimate"), "other")
    return either.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def evaluation(pairs: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Hits, misses and false pairs, precision, recall and F1 of (a, b, exact) against true (a, b) for each threshold."""
    known = truth.select("a", "b").distinct().withColumn("true", F.lit(1))
    joined = pairs.join(known, ["a", "b"], "full")
    flat = joined.select(F.coalesce("true", F.lit(0)).alias("true"), F.coalesce("exact", F.lit(-1.0)).alias("exact"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    found = F.col("exact") >= F.col("threshold")
    agg = flat.groupBy("threshold").agg(F.count_if(found & (F.col("true") == 1)).alias("tp"), F.count_if(found & (F.col("true") == 0)).alias("fp"), F.count_if(~found & (F.col("true") == 1)).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return agg.select("threshold", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def grid(signatures: DataFrame, words: DataFrame, counts: list[int], threshold: float, hashes: int = HASHES) -> DataFrame:
    """(bands, tp, fp, fn) for each number of bands in ``counts``: ``evaluation`` of the pairs that share a band, true if their words (id, type, word) are equal.

    With many bands nearly all pairs of a type are candidates, so no pair is listed: the names of a type are cut into blocks, each two of
    which are one task's, and only what it counts leaves it. True pairs are counted by the sizes of their groups.
    """
    slots = F.transform("signature", lambda x: F.conv(F.substring(x, 1, 15), 16, 10).cast("long"))
    rows = signatures.where(F.col("type").isNotNull()).select("id", "type", "grams", slots.alias("slots")).join(words.select("id", "word"), "id", "left")
    sizes = rows.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = rows.join(sizes, "type").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y"))))
    cut = placed.select("type", "block", "grams", "slots", "word", cells.alias("c")).select("type", F.col("c.x").alias("x"), F.col("c.y").alias("y"), "block", "grams", "slots", "word")

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _counted(pdf, counts, threshold)
        return pd.DataFrame([(c, *n) for c, n in found.items()], columns=["bands", "tp", "fp"])

    # Small rows, but much work: the optimizer must not put many cells into few tasks.
    tasks = max(task_count(cut.sparkSession), int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hits = cut.repartition(tasks, "type", "x", "y").groupBy("type", "x", "y").applyInPandas(counted, "bands int, tp long, fp long").groupBy("bands").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    groups = words.where(F.col("type").isNotNull() & F.col("word").isNotNull()).groupBy("type", "word").agg(F.count(F.lit(1)).alias("n"))
    true = groups.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("true"))
    every = true.select("true", F.explode(F.array(*(F.lit(c) for c in counts))).alias("bands"))
    tp, fp = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    return every.join(hits, "bands", "left").where(F.col("true") + fp > 0).select("bands", tp.alias("tp"), fp.alias("fp"), (F.col("true") - tp).alias("fn"))


def _counted(pdf: pd.DataFrame, counts: list[int], threshold: float) -> dict[int, list[int]]:
    """[true, false] pairs of a cell that reach the threshold and share a band, for each number of bands."""
    block, first, second = pdf["block"].to_numpy(), pdf["x"].iloc[0], pdf["y"].iloc[0]
    slots, size = np.stack(pdf["slots"].to_numpy()), pdf["grams"].map(len).to_numpy()
    word = pd.factorize(pdf["word"])[0]
    gram = pd.factorize(np.concatenate(pdf["grams"].to_numpy()))[0]
    owner = np.repeat(np.arange(len(pdf)), size)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    width = int(gram.max()) + 1

    def held(rows: np.ndarray, start: int) -> np.ndarray:
        """Which of the shingles from ``start`` on each of the rows has."""
        at = np.full(len(pdf), -1)
        at[rows] = np.arange(len(rows))
        mine = (at[owner] >= 0) & (gram >= start) & (gram < start + COLUMNS)
        matrix = np.zeros((len(rows), min(COLUMNS, width - start)), np.float32)
        matrix[at[owner[mine]], gram[mine] - start] = 1
        return matrix

    out = {c: [0, 0] for c in counts}
    for low in range(0, len(left), TILE):
        rows = left[low : low + TILE]
        common = np.zeros((len(rows), len(right)), np.float32)
        for start in range(0, width, COLUMNS):
            common += held(rows, start) @ held(right, start).T
        near = common / (size[rows][:, None] + size[right][None, :] - common.astype(np.float64)) >= threshold
        if first == second:
            near &= rows[:, None] < right[None, :]
        at, to = np.nonzero(near)
        for k in range(0, len(at), 1 << 18):
            a, b = rows[at[k : k + (1 << 18)]], right[to[k : k + (1 << 18)]]
            equal, true = slots[a] == slots[b], (word[a] == word[b]) & (word[a] >= 0)
            for c in counts:
                met = equal.reshape(len(a), c, -1).all(axis=2).any(axis=1)
                out[c][0] += int((met & true).sum())
                out[c][1] += int((met & ~true).sum())
    return out
