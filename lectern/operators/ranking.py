"""Places over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import staged


def _in_ranges(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part``, one row a part with how many rows stand before it): equal keys are in one part, parts are in order."""
    parts = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row a partition.
    before = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part"))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return parts, F.broadcast(before.select("part", (F.col("upto") - F.col("n")).alias("before"), "total"))


def competition_rank(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``place``, one more than the rows with a larger ``by``, and ``total``. Null ``by`` has no place; rows with it are left out."""
    parts, before = _in_ranges(rows.where(F.col(by).isNotNull()), [F.desc(by)])
    own = F.rank().over(Window.partitionBy("part").orderBy(F.desc(by)))
    return parts.withColumn("own", own).join(before, "part").withColumn("place", F.col("own") + F.col("before")).drop("own", "before", "part")


def numbered(rows: DataFrame, name: str, *order: str, start: int = 1) -> DataFrame:
    """Adds ``name``: consecutive numbers from ``start`` in the given order."""
    parts, before = _in_ranges(rows, [F.col(c) for c in order])
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("own", own).join(before, "part").withColumn(name, F.col("own") + F.col("before") + F.lit(start - 1)).drop("own", "before", "part", "total")
