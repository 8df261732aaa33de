"""Upkeep of the stored tables: rows made on demand, write-backs, publishing, queues and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranking import numbered


def got_or_created(old: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``old`` (id, key) with a row for each wanted key it lacks; new ids go on from the largest, in the order of the keys. Null keys are left out."""
    last = old.agg(F.max("id")).first()[0] or 0
    new = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(old.select(key), key, "left_anti")
    return old.select("id", key).unionByName(numbered(new, "id", key, start=last + 1).select(F.col("id").cast("long"), key))


def process_rows(domains: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(domain_id, kind, last_run): for each new source one row a kind of process, never run so far."""
    return domains.select(F.col("id").alias("domain_id"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").alias("last_run"))


def rank_written_back(entities: DataFrame, ranks: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(id, global_relevance, pagerank): the new scores by name; what the graph lacks keeps its old ones, and types that are not ranked get 0."""
    new = ranks.select("name", F.col("pr").alias("new_rank"), F.col("scaled").alias("new_relevance"))
    ranked = F.col("entity_type").isin(*types)
    rows = entities.join(new, "name", "left")
    pick = lambda new, old: F.when(~F.coalesce(ranked, F.lit(False)), 0.0).otherwise(F.coalesce(new, old))
    return rows.select("id", pick("new_relevance", "global_relevance").alias("global_relevance"), pick("new_rank", "pagerank").alias("pagerank"))


def publication(items: DataFrame, asked: DataFrame, publish: bool = True) -> DataFrame:
    """(id, status) of the asked ids: changed, already or not_found. ``items`` has id and published."""
    state = items.select("id", F.col("published").alias("_p"))
    rows = asked.select("id").where(F.col("id").isNotNull()).distinct().join(state, "id", "left")
    return rows.select("id", F.when(F.col("_p").isNull(), "not_found").when(F.col("_p") == F.lit(publish), "already").otherwise("changed").alias("status"))


def unscored(items: DataFrame) -> DataFrame:
    """The unpublished items without a score: nothing may be published while there is one."""
    return items.where(~F.col("published") & F.col("score").isNull())


def publishable(items: DataFrame) -> bool:
    """Whether every unpublished item is scored."""
    return unscored(items).isEmpty()


def drained(queue: DataFrame, succeeded: DataFrame) -> DataFrame:
    """The queue without the articles that were really processed, whatever failed between them."""
    return queue.join(succeeded.select("article_id").distinct(), "article_id", "left_anti")


def scoring_batch(items: DataFrame, mode: str, key: int | None = None) -> DataFrame:
    """The items that a scoring run takes: one id, those without a score, or all."""
    if mode == "one":
        return items.where(F.col("id") == key)
    if mode == "unscored":
        return items.where(F.col("score").isNull())
    if mode == "all":
        return items
    raise ValueError(f"unknown mode {mode}")


def limited(rows: DataFrame, n: int | None) -> DataFrame:
    """At most ``n`` rows; without a number, or with 0, all of them."""
    return rows.limit(n) if n else rows


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """A log with new rows at its end; columns that a side lacks are null."""
    return log.unionByName(new, allowMissingColumns=True)


def corpus_merged(old: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """``old`` and ``new`` by key: new values hold, but a row keeps the time it was first exported (created_at)."""
    first = old.select(key, F.col("created_at").alias("_first"))
    kept = new.dropDuplicates([key]).join(first, key, "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(kept)


def not_entities(refs: DataFrame, gone: DataFrame) -> DataFrame:
    """The references (entity_id, canonical_id) after the entities of ``gone`` (id) are declared none: cleared in both directions."""
    for side in ("entity_id", "canonical_id"):
        refs = refs.join(gone.select(F.col("id").alias(side)).distinct(), side, "left_anti")
    return refs.select("entity_id", "canonical_id")


def made_canonical(entities: DataFrame, refs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, status) of the asked entities: canonical, or refused while they point to others, or not_found."""
    out = refs.select(F.col("entity_id").alias("id"), F.lit(True).alias("_out")).distinct()
    known = entities.select("id", F.lit(True).alias("_known"))
    rows = asked.select("id").distinct().join(known, "id", "left").join(out, "id", "left")
    return rows.select("id", F.when(F.col("_known").isNull(), "not_found").when(F.col("_out"), "refused").otherwise("canonical").alias("status"))


def group_problems(members: DataFrame, as_of: Column) -> DataFrame:
    """(id, problem) of memberships (id, group_id, member_id, since, until) that break a rule: self, order, future, overlap."""
    own = F.when(F.col("group_id").cast("string") == F.col("member_id").cast("string"), "self").when(F.col("until") < F.col("since"), "order").when(F.col("since") > as_of, "future")
    wrong = members.select("id", own.alias("problem")).where(F.col("problem").isNotNull())
    # Periods of one pair in the order of their starts overlap if one begins before the latest end so far.
    far, early = F.lit("9999-12-31").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")
    since, until = F.coalesce("since", early), F.coalesce("until", far)
    before = Window.partitionBy("group_id", "member_id").orderBy(since, "id").rowsBetween(Window.unboundedPreceding, -1)
    late = members.withColumn("_end", F.max(until).over(before)).where(F.col("_end") >= since)
    return wrong.unionByName(late.select("id", F.lit("overlap").alias("problem")))
