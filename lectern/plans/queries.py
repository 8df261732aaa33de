"""Registered queries of the core: name → callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import cosine
from lectern.operators import graph, ingest, ranking, resolution, scoring, selection, similarity, temporal
from lectern.plans import dates
from lectern.runtime import load, staged
from lectern.sources import views as V

#: The moment that stands for now, so results do not depend on the day of the run.
AS_OF = "2026-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
now = lambda at=AS_OF: F.lit(at).cast("timestamp_ntz")
r6 = lambda c: F.round(c, 6)
#: Sums and means of four-digit numbers often lie halfway between two results; the nudge decides such ties alike in every engine.
even6 = lambda c: F.round(F.col(c) + 1e-9 if isinstance(c, str) else c + 1e-9, 6)


def _per(rows: DataFrame, *keys: str) -> DataFrame:
    """Calls, time, successes and their rate by keys."""
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), r6(F.sum("duration_seconds")).alias("total_seconds"), r6(F.avg("duration_seconds")).alias("avg_seconds"), F.sum("success").alias("successes"))
    return agg.withColumn("success_rate", r6(100.0 * F.col("successes") / F.col("calls")))


def llm_analyze_by_task(s: SparkSession, d: str) -> DataFrame:
    recent = V.llm_calls(s, d).where(F.col("started_at") >= now(EVENTS_AS_OF) - F.expr("interval 20 days"))
    return _per(recent, "task_name").orderBy(F.desc("calls"), "task_name")


def llm_calls_by_hour(s: SparkSession, d: str) -> DataFrame:
    hour = F.date_format("started_at", "yyyy-MM-dd HH:00").alias("period")
    return V.llm_calls(s, d).groupBy(hour).agg(F.count(F.lit(1)).alias("calls"), F.sum("success").alias("successes")).orderBy("period")


def llm_calls_by_day(s: SparkSession, d: str) -> DataFrame:
    day = F.date_format("started_at", "yyyy-MM-dd").alias("period")
    return V.llm_calls(s, d).groupBy(day).agg(F.count(F.lit(1)).alias("calls"), r6(F.avg("duration_seconds")).alias("avg_seconds")).orderBy("period")


def llm_usage_overview(s: SparkSession, d: str) -> DataFrame:
    """All figures in one pass over the log."""
    day = F.col("started_at") >= now(EVENTS_AS_OF) - F.expr("interval 1 day")
    week = F.col("started_at") >= now(EVENTS_AS_OF) - F.expr("interval 7 days")
    return V.llm_calls(s, d).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(day).alias("calls_1d"), F.count_if(week).alias("calls_7d"), F.count_if(F.col("success") == 0).alias("failed"),
        r6(F.coalesce(F.sum("duration_seconds"), F.lit(0.0))).alias("total_seconds"), r6(F.avg("duration_seconds")).alias("avg_seconds"),
    )


def sources_status(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d, "source_id", "clusterized_at").groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"), F.count("clusterized_at").alias("enriched"))
    src = load(s, d, "sources").select(F.col("id").alias("source_id"), "domain")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return src.join(a, "source_id", "left").select("domain", zero("articles").alias("articles"), zero("enriched").alias("enriched"), (zero("articles") - zero("enriched")).alias("pending"))


def articles_without_entities(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "article_entities").select(F.col("article_id").alias("id")).where(F.col("id").isNotNull())
    return V.articles(s, d, "url").join(e, "id", "left_anti").select("id", "url")


def articles_to_enrich(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d, "url", "clusterized_at").where(F.col("clusterized_at").isNull()).orderBy(F.desc_nulls_last("created_at"), "id").limit(20).select("id", "url")


def article_listing(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d, "source_id", "title", "author", "category")
    src = load(s, d, "sources").where(F.col("domain") == "harborledger.example").select(F.col("id").alias("source_id"), "name")
    return a.join(src, "source_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(25).select("id", "title", "author", "category", "name")


def entity_listing(s: SparkSession, d: str) -> DataFrame:
    e = V.entities(s, d).where((F.col("article_count") >= 5) & F.col("entity_type").isin("PERSON", "ORG"))
    return e.orderBy(F.desc_nulls_last("global_relevance"), "id").limit(30).select("id", "name", "entity_type", "global_relevance")


def entity_search(s: SparkSession, d: str) -> DataFrame:
    return V.entities(s, d).where(F.contains(F.lower("name"), F.lit("banco"))).select("id", "name", "article_count")


def entity_rank_position(s: SparkSession, d: str) -> DataFrame:
    """The competition rank of each entity with a relevance among all of them."""
    e = V.entities(s, d).where((F.col("global_relevance") > 0) & ~F.isnan("global_relevance")).select("id", "entity_type", "global_relevance")
    return ranking.competition_rank(e, "global_relevance").select("id", "entity_type", "place", "total")


def entity_type_counts(s: SparkSession, d: str) -> DataFrame:
    return V.entities(s, d).groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.sum("is_group").alias("groups"))


def score_distribution(s: SparkSession, d: str) -> DataFrame:
    p = F.col("pagerank")
    return V.entities(s, d).groupBy("entity_type").agg(r6(F.min(p)).alias("low"), r6(F.max(p)).alias("high"), r6(F.avg(p)).alias("mean"), r6(F.median(p)).alias("middle"), r6(F.stddev_pop(p)).alias("spread"))


def average_local_relevance(s: SparkSession, d: str) -> DataFrame:
    return V.links(s, d).groupBy("entity_id").agg(even6(F.avg(F.coalesce("relevance", F.lit(0.0)))).alias("avg_local_relevance"), F.count(F.lit(1)).alias("articles"))


def top5_entities_per_article(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("article_id").orderBy(F.desc_nulls_last("relevance"), "entity_id")
    five = V.links(s, d).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= 5)
    n = F.count(F.lit(1)).over(Window.partitionBy("article_id"))
    return five.select("article_id", "entity_id", "rn", (F.col("rn") <= F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(n * 0.33)))).alias("boost"))


def shared_articles(s: SparkSession, d: str) -> DataFrame:
    """How many articles the two most linked entities of a type share with each other entity of it."""
    e = V.entities(s, d).select(F.col("id").alias("entity_id"), "entity_type")
    rows = V.links(s, d).select("article_id", "entity_id").join(e, "entity_id")
    size = rows.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    lead = size.withColumn("rn", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("n"), "entity_id"))).where(F.col("rn") <= 2).select("entity_type", "entity_id")
    a = rows.join(lead, ["entity_type", "entity_id"]).select("article_id", "entity_type", F.col("entity_id").alias("lead_id"))
    both = a.join(rows.withColumnRenamed("entity_id", "other_id"), ["article_id", "entity_type"]).where(F.col("lead_id") != F.col("other_id"))
    return both.groupBy("lead_id", "other_id").agg(F.count(F.lit(1)).alias("shared"), F.min("article_id").alias("first_article"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return graph.members(V.links(s, d), V.entities(s, d), V.RANKED_TYPES)


def cooccurrence_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.edges(_ranked(s, d)).select("src", "dst", even6("weight").alias("weight"))


def transition_matrix(s: SparkSession, d: str) -> DataFrame:
    return graph.transitions(graph.edges(_ranked(s, d))).select("src", "dst", r6("p").alias("p"))


def pagerank_k5(s: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(s, d)
    pr = graph.pagerank(ranked.select("name"), graph.transitions(graph.edges(ranked)), 5)
    return graph.min_max(pr).select("name", r6("pr").alias("pr"), F.round("scaled", 4).alias("scaled"))


def entity_metrics(s: SparkSession, d: str) -> DataFrame:
    m = graph.metrics(V.links(s, d), V.entities(s, d), V.RANKED_TYPES)
    return m.select("name", "article_count", even6("total_relevance").alias("total_relevance"), even6("avg_relevance").alias("avg_relevance"), "diversity")


def name_tokens(s: SparkSession, d: str) -> DataFrame:
    e = V.entities(s, d).select("id", F.posexplode(T.name_words(F.col("name"))).alias("position", "token"))
    plain = T.normalize_token(F.col("token"))
    return e.select("id", "position", "token", plain.alias("normalized"), plain.isin(*T.STOPWORDS).cast("int").alias("is_stopword"))


def name_shingles(s: SparkSession, d: str) -> DataFrame:
    return V.entities(s, d).select("id", F.explode(T.shingles(F.col("name"))).alias("gram"))


def _signed(s: SparkSession, d: str) -> DataFrame:
    e = V.entities(s, d).where(F.col("classified_as") == "canonical").select("id", "name", F.col("entity_type").alias("type"))
    # The signatures are dear and read several times.
    return staged(similarity.signed(e), "signatures")


def minhash_signature(s: SparkSession, d: str) -> DataFrame:
    return _signed(s, d).select("id", F.md5(F.array_join("signature", ",")).alias("digest"))


def lsh_candidates(s: SparkSession, d: str) -> DataFrame:
    p = similarity.scored(_signed(s, d))
    return p.select("a", "b", r6("exact").alias("exact"), r6("estimate").alias("estimate"))


def lsh_best(s: SparkSession, d: str) -> DataFrame:
    return similarity.best(similarity.scored(_signed(s, d))).select("id", "other", "place")


def lsh_eval(s: SparkSession, d: str) -> DataFrame:
    """The candidates against all pairs of canonical entities of a type whose names share their last word, found by the bands or not."""
    sig = _signed(s, d)
    last = V.entities(s, d).where(F.col("classified_as") == "canonical").select("id", F.col("entity_type").alias("type"), F.element_at(F.split("name", " "), -1).alias("w"))
    true = last.withColumnRenamed("id", "a").join(last.withColumnRenamed("id", "b"), ["type", "w"]).where(F.col("a") < F.col("b")).select("a", "b")
    e = similarity.evaluation(similarity.scored(sig), true, [0.1, 0.3, 0.5, 0.7, 0.9])
    return e.select("threshold", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


def doc_sentences(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d, "content").where(F.col("content").isNotNull())
    return a.select("id", F.posexplode(T.simple_sentences(F.col("content"))).alias("sentence_index", "sentence_text"))


def plain_text_export(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d, "hash", "source_id", "title", "content", "category")
    src = load(s, d, "sources").select(F.col("id").alias("source_id"), "domain", "name")
    c = T.split_category(F.col("category"))
    return a.join(src, "source_id").select("hash", "title", T.plain_text(F.col("content")).alias("body"), "domain", "name", c["category"].alias("category"), c["subcategory"].alias("subcategory"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


def category_rollup(s: SparkSession, d: str) -> DataFrame:
    c = T.split_category(F.col("category"))
    rows = V.articles(s, d, "category").where(F.col("category").isNotNull()).select(c["category"].alias("category"), F.coalesce(c["subcategory"], F.lit("-")).alias("subcategory"))
    return rows.rollup("category", "subcategory").agg(F.count(F.lit(1)).alias("articles")).select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("subcategory", F.lit("*")).alias("subcategory"), "articles", (F.col("articles") * 6).alias("pairs"))


def training_pairs(s: SparkSession, d: str) -> DataFrame:
    """(a, b, label): each titled article with one of its subcategory, of another subcategory of its category, of another category, and with its own body."""
    c = T.split_category(F.col("category"))
    rows = V.articles(s, d, "title", "category").where((F.coalesce("title", F.lit("")) != "") & F.col("category").isNotNull())
    return selection.training_pairs(rows.select("id", c["category"].alias("cat"), F.coalesce(c["subcategory"], F.lit("-")).alias("sub")))


def _based(s: SparkSession, d: str) -> DataFrame:
    """(article_id, entity_id, base, classified_as): the texts are flattened once an article, not once a mention."""
    e = V.entities(s, d).select(F.col("id").alias("entity_id"), "name", "classified_as")
    rows = V.links(s, d).where(F.col("mentions").isNotNull()).join(e, "entity_id")
    named = rows.groupBy("article_id").agg(F.sum("mentions").alias("total"), F.collect_list(F.struct("entity_id", "name", "classified_as", "mentions")).alias("named"))
    a = V.articles(s, d, "title", "subtitle", "content").withColumnRenamed("id", "article_id")
    a = a.select("article_id", "title", "subtitle", F.lower(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")).alias("flat"))
    each = named.join(a, "article_id").select("article_id", "total", "title", "subtitle", "flat", F.explode("named").alias("m")).select("article_id", "total", "title", "subtitle", "flat", "m.*")
    base = scoring.entity_relevance(F.col("name"), F.col("mentions"), F.col("total"), F.col("title"), F.col("subtitle"), F.col("flat"))
    return each.select("article_id", "entity_id", base.alias("base"), "classified_as")


def local_relevance(s: SparkSession, d: str) -> DataFrame:
    rows = _based(s, d).withColumn("ignored", (F.col("classified_as") != "canonical").cast("int"))
    return scoring.local_relevance(rows).select("article_id", "entity_id", r6("base").alias("base"), r6("local").alias("local"))


def relevance_transfers(s: SparkSession, d: str) -> DataFrame:
    """Local relevance after what ignored entities scored goes to their canonicals in the same article; the classes are those of the references."""
    e, refs = _references(s, d)
    rows = _based(s, d).drop("classified_as").join(e.withColumnRenamed("id", "entity_id"), "entity_id")
    scored = rows.withColumn("ignored", (F.col("classified_as") != "canonical").cast("int"))
    return scoring.with_transfers(scored, refs).select("article_id", "entity_id", F.round("relevance", 5).alias("relevance"))


def flash_scores(s: SparkSession, d: str) -> DataFrame:
    """Articles as flash items: importance of their entities, freshness, quality, authority, and the tier of the sum."""
    e = V.entities(s, d).select(F.col("id").alias("entity_id"), "global_relevance")
    fallback = e.agg(F.coalesce(F.avg("global_relevance"), F.lit(0.6)).alias("usual"))
    top = V.links(s, d).join(e, "entity_id", "left").join(F.broadcast(fallback))  # one row
    top = top.select("article_id", "entity_id", F.coalesce("relevance", F.lit(0.0)).alias("local"), F.coalesce("global_relevance", "usual").alias("overall"))
    src = load(s, d, "sources").select(F.col("id").alias("source_id"), "authority_score")
    a = V.articles(s, d, "source_id", "clusterized_at").join(src, "source_id", "left").join(scoring.entity_importance(top).withColumnRenamed("article_id", "id"), "id", "left")
    hours = (F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.unix_seconds(F.col("clusterized_at").cast("timestamp"))) / 3600.0
    kind = F.element_at(F.array(F.lit("breaking"), F.lit("timely"), F.lit("evergreen")), (F.col("id") % 3 + 1).cast("int"))
    parts = a.select("id", "source_id", F.coalesce("importance", F.lit(0.0)).alias("entity"), scoring.freshness(hours / 1000, kind).alias("freshness"), scoring.quality((F.col("id") % 10) / 10.0, F.col("id") % 15).alias("quality"), F.lit(0.5).alias("diversity"), F.coalesce("authority_score", F.lit(0.5)).alias("authority"))
    scored = parts.withColumn("score", scoring.weighted())
    return scored.select("id", "source_id", r6("entity").alias("entity"), r6("freshness").alias("freshness"), r6("score").alias("score"), scoring.tier(F.col("score")).alias("tier"))


def tier_counts(s: SparkSession, d: str) -> DataFrame:
    """Tiers without items count 0."""
    tiers = s.createDataFrame([(t,) for t in ("critical", "high", "medium", "low")], "tier string")
    return tiers.join(flash_scores(s, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def newsletter_selection(s: SparkSession, d: str) -> DataFrame:
    items = flash_scores(s, d).select("id", F.col("source_id").alias("source"), "score")
    return selection.digest(items, min_count=3, max_count=8, low=0.35, high=0.5).select("id", "source", r6("score").alias("score"), "place")


def cluster_scores(s: SparkSession, d: str) -> DataFrame:
    """Vectors as sentences and labels as clusters of one text: size, nearness of the centroids, place and category."""
    v = load(s, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x"))
    mean = lambda by: v.groupBy(*by, "k").agg(F.avg("x").alias("m")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("c"))
    whole = mean([]).select(F.col("c").alias("all_c"))
    own = mean(["label"])
    stats = load(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("vec_id").alias("place"))
    total = load(s, d, "embeddings").agg(F.count(F.lit(1)).alias("total"))
    rows = own.join(stats, "label").join(F.broadcast(whole)).join(F.broadcast(total))  # one row each
    near = cosine(F.col("c"), F.col("all_c"))
    score = scoring.cluster_score(F.col("size"), F.col("total"), near, near, F.col("place"), F.lit(1.0))
    return rows.select("label", "size", r6(score).alias("score"), scoring.cluster_category(F.col("label"), score).alias("category"))


def topic_diversity(s: SparkSession, d: str) -> DataFrame:
    """Every item against the other items of the last 24 hours; ``created_at`` is a minute apart for each id."""
    v = load(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.timestamp_seconds(F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.col("vec_id") * 60).alias("created_at"))
    since = F.timestamp_seconds(F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.lit(24 * 3600))
    return scoring.topic_diversity(v, since).select("id", r6("diversity").alias("diversity"))


def _memberships(s: SparkSession, d: str) -> DataFrame:
    """Customers as members of the group of an order priority, from their first to their last order of a year; some periods are open."""
    o = load(s, d, "orders")
    g = o.groupBy(F.col("o_orderpriority").alias("group_id"), F.col("o_custkey").alias("member_id"), F.year("o_orderdate").alias("y")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.min("o_orderkey").alias("id"))
    return g.select("id", "group_id", "member_id", F.when(F.col("id") % 11 != 0, F.col("a")).alias("since"), F.when(F.col("id") % 7 != 0, F.col("b")).alias("until"))


def members_active_at(s: SparkSession, d: str) -> DataFrame:
    return temporal.active_at(_memberships(s, d), F.lit("1998-06-01").cast("timestamp_ntz")).groupBy("group_id").agg(F.count(F.lit(1)).alias("periods"), F.countDistinct("member_id").alias("members"))


def membership_overlaps(s: SparkSession, d: str) -> DataFrame:
    return temporal.overlaps(_memberships(s, d))


def _references(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities with classes and references by their ids: one in five an alias, one in seven ambiguous."""
    e = V.entities(s, d).select("id", "entity_type")
    heads = e.where((F.col("id") % 5 != 0) & (F.col("id") % 7 != 0)).groupBy("entity_type").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    rows = e.join(heads, "entity_type", "left")
    cls = F.when(F.col("id") % 5 == 0, "alias").when(F.col("id") % 7 == 0, "ambiguous").when(F.col("id") % 13 == 0, "not_an_entity").otherwise("canonical")
    refs = rows.where(F.col("id") % 5 == 0).select(F.col("id").alias("entity_id"), F.col("lo").alias("canonical_id"))
    refs = refs.unionByName(rows.where((F.col("id") % 5 != 0) & (F.col("id") % 7 == 0)).select(F.col("id").alias("entity_id"), F.explode(F.array("lo", "hi")).alias("canonical_id")))
    return rows.select("id", cls.alias("classified_as")), refs.where(F.col("canonical_id").isNotNull()).distinct()


def classification_violations(s: SparkSession, d: str) -> DataFrame:
    """The classes against the references of all but every tenth entity."""
    e, refs = _references(s, d)
    return resolution.violations(e, refs.where(F.col("entity_id") % 10 != 0))


def alias_cascade(s: SparkSession, d: str) -> DataFrame:
    """The classes after the first head of every type becomes an alias of the last."""
    e, refs = _references(s, d)
    types = V.entities(s, d).where((F.col("id") % 5 != 0) & (F.col("id") % 7 != 0)).groupBy("entity_type").agg(F.min("id").alias("entity_id"), F.max("id").alias("target_id")).where(F.col("entity_id") != F.col("target_id"))
    return resolution.classes(e, resolution.redirected(refs, types.select("entity_id", "target_id")))


def upsert_articles(s: SparkSession, d: str) -> DataFrame:
    """A second crawl: every third article again, some with a new page hash, some under a new hash but the old address, some new."""
    a = V.articles(s, d, "hash", "url", "title", "cleaned_html_hash", "clusterized_at").where(F.col("hash").isNotNull() & F.col("url").isNotNull())
    i = F.col("id")
    h = F.when(i % 9 == 0, F.sha2(F.concat(F.lit("v2"), "hash"), 256)).otherwise(F.col("hash"))
    u = F.when(i % 27 == 0, F.concat("url", F.lit("?v=2"))).otherwise(F.col("url"))
    page = F.when(i % 2 == 0, F.sha2("hash", 256)).otherwise(F.col("cleaned_html_hash"))
    new = a.where(i % 3 == 0).select(h.alias("hash"), u.alias("url"), F.concat(F.coalesce("title", F.lit("")), F.lit(" *")).alias("title"), page.alias("cleaned_html_hash"))
    return ingest.upserted(a, new).groupBy("action").agg(F.count(F.lit(1)).alias("articles"), F.count("clusterized_at").alias("still_enriched"), F.count("id").alias("known"))


def redirect_follow(s: SparkSession, d: str) -> DataFrame:
    return ingest.redirect_followed(V.url_cache(s, d)).select("url_hash", "status_code", "final_hash", "content_length")


def cache_domain_stats(s: SparkSession, d: str) -> DataFrame:
    c = V.url_cache(s, d).groupBy("domain").agg(F.count(F.lit(1)).alias("entries"), F.sum("content_length").alias("size"))
    return c.select("domain", "entries", "size", T.size_text(F.col("size")).alias("size_text"))


def cache_overview(s: SparkSession, d: str) -> DataFrame:
    return V.url_cache(s, d).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("content_length"), F.lit(0)).alias("size"), F.countDistinct("domain").alias("domains"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    c = T.split_category(F.col("category"))["category"]
    rows = V.articles(s, d, "category").where(F.col("category").isNotNull()).groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("articles"))
    return rows.orderBy(F.desc("articles"), "category").limit(10)


def batch_rollup(s: SparkSession, d: str) -> DataFrame:
    """A day's calls of a user as a batch: counts, and failed if any call did."""
    b = V.llm_calls(s, d).groupBy(F.col("model").alias("batch"), F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("processed"), F.sum("success").alias("successful"))
    failed = F.col("processed") - F.col("successful")
    return b.select("batch", F.date_format("day", "yyyy-MM-dd").alias("day"), "processed", "successful", failed.alias("failed"), F.when(failed > 0, "failed").otherwise("completed").alias("status"))


def uncompared_pairs(s: SparkSession, d: str) -> DataFrame:
    p = similarity.candidates(_signed(s, d))
    return resolution.uncompared(p, p.where((F.col("a") + F.col("b")) % 3 == 0).select(F.col("b").alias("a"), F.col("a").alias("b")))


QUERIES: dict = {
    "p1_found": dates.p1_found,
    **{f.__name__: f for f in (
        llm_analyze_by_task, llm_calls_by_hour, llm_calls_by_day, llm_usage_overview, sources_status, articles_without_entities, articles_to_enrich, article_listing, entity_listing, entity_search,
        entity_rank_position, entity_type_counts, score_distribution, average_local_relevance, top5_entities_per_article, shared_articles, cooccurrence_edges, transition_matrix, pagerank_k5, entity_metrics,
        name_tokens, name_shingles, minhash_signature, lsh_candidates, lsh_best, lsh_eval, doc_sentences, plain_text_export, category_rollup, training_pairs, local_relevance, relevance_transfers, flash_scores, tier_counts,
        newsletter_selection, cluster_scores, topic_diversity, members_active_at, membership_overlaps, classification_violations, alias_cascade, upsert_articles, redirect_follow, cache_domain_stats,
        cache_overview, corpus_stats, batch_rollup, uncompared_pairs,
    )},
}
