"""Questions about periods that may be open on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_at(memberships: DataFrame, moment: Column) -> DataFrame:
    """The memberships (group_id, member_id, since, until) that hold at a moment; both ends belong to a period."""
    return memberships.where((F.col("since").isNull() | (F.col("since") <= moment)) & (F.col("until").isNull() | (F.col("until") >= moment)))


def overlaps(memberships: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: periods of one member in one group that overlap; touching ones do not."""
    low, high = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    rows = memberships.select("id", "group_id", "member_id", F.coalesce("since", low).alias("s"), F.coalesce("until", high).alias("u"))
    a, b = rows.toDF("id_a", "group_id", "member_id", "sa", "ua"), rows.toDF("id_b", "group_id", "member_id", "sb", "ub")
    return a.join(b, ["group_id", "member_id"]).where((F.col("id_a") < F.col("id_b")) & (F.col("sa") < F.col("ub")) & (F.col("ua") > F.col("sb"))).select("id_a", "id_b")
