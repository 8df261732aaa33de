"""Entity classes (canonical, alias, ambiguous, not an entity) and what a change of one does to the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, classified_as, outgoing, incoming) of the entities whose references break their class.

    Canonicals point nowhere; aliases point to exactly one and ambiguous ones to at least two, and nothing points to them; what is
    not an entity has no references.
    """
    out = refs.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("canonical_id").alias("outgoing"))
    into = refs.groupBy(F.col("canonical_id").alias("id")).agg(F.countDistinct("entity_id").alias("incoming"))
    rows = entities.join(out, "id", "left").join(into, "id", "left").select("id", "classified_as", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))
    o, i, c = F.col("outgoing"), F.col("incoming"), F.col("classified_as")
    bad = F.when(c == "canonical", o > 0).when(c == "alias", (o != 1) | (i > 0)).when(c == "ambiguous", (o < 2) | (i > 0)).when(c == "not_an_entity", (o > 0) | (i > 0)).otherwise(F.lit(True))
    return rows.where(bad)


def redirected(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """The references after canonicals of ``changes`` (entity_id, target_id) become aliases or ambiguous.

    A changed entity points to its targets, and whoever pointed to it now does. Changes do not chain: every
    target must stay canonical. References to oneself disappear; equal ones count once.
    """
    moved = changes.select(F.col("entity_id").alias("canonical_id"), "target_id")
    followed = refs.join(moved, "canonical_id", "left").select("entity_id", F.coalesce("target_id", "canonical_id").alias("canonical_id"))
    own = changes.select("entity_id", F.col("target_id").alias("canonical_id"))
    return followed.unionByName(own).where(F.col("entity_id") != F.col("canonical_id")).distinct()


def classes(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, classified_as) as the references say: none keeps canonical or not an entity, one is an alias, more are ambiguous."""
    out = refs.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("canonical_id").alias("n"))
    return entities.join(out, "id", "left").select("id", F.when(F.col("n") == 1, "alias").when(F.col("n") > 1, "ambiguous").when(F.col("classified_as") == "not_an_entity", "not_an_entity").otherwise("canonical").alias("classified_as"))


def needs_rerank(links: DataFrame, changed: DataFrame, queued: DataFrame) -> DataFrame:
    """(article_id) of the articles of changed entities (entity_id) that are not queued yet."""
    return links.join(changed.select("entity_id").distinct(), "entity_id", "left_semi").select("article_id").distinct().join(queued, "article_id", "left_anti")


def uncompared(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """The pairs (a, b), in either order, that ``done`` does not hold in either order."""
    key = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return key(pairs).join(key(done), ["a", "b"], "left_anti")
