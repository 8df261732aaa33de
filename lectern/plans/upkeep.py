"""Registered queries of upkeep, listings, evaluation of the similarity join, and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import norm
from lectern.operators import graph, ingest, pipelines, resolution, scoring, selection, similarity, upkeep
from lectern.plans import queries as Q
from lectern.runtime import load
from lectern.sources import views as V

r6 = Q.r6


def entity_by_name(s: SparkSession, d: str) -> DataFrame:
    """Names equal but for case."""
    return V.entities(s, d).where(F.lower("name") == F.lit("república de veceronu")).select("id", "name", "entity_type")


def article_previews(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d, "title", "content").select("id", F.substring("title", 1, 50).alias("title"), F.substring("content", 1, 100).alias("preview"))


def training_texts(s: SparkSession, d: str) -> DataFrame:
    """Titles and bodies as training text: line feeds as blanks, cut to 400 and 300 characters."""
    flat = lambda c, n: F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), 1, n)
    return V.articles(s, d, "title", "content").select("id", flat("title", 400).alias("title"), flat("content", 300).alias("body"))


def call_durations(s: SparkSession, d: str) -> DataFrame:
    """Seconds between the start of a call and its completion, the next call of its user."""
    c = V.llm_calls(s, d)
    done = F.lead("started_at").over(Window.partitionBy("model").orderBy("started_at", "id"))
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    return c.withColumn("done", done).where(F.col("done").isNotNull()).select("id", ((micros("done") - micros("started_at")) / 1e6).alias("duration"))


def entity_context(s: SparkSession, d: str) -> DataFrame:
    """For each entity its mentions, its articles, and up to three context sentences: two at most of each of its first three articles."""
    rows = load(s, d, "article_entities").where(F.col("article_id").isNotNull() & F.col("entity_id").isNotNull())
    one = rows.groupBy("entity_id", "article_id").agg(F.max("mentions").alias("mentions"), F.max("context_sentences").alias("context"))
    totals = one.groupBy("entity_id").agg(F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions"), F.count(F.lit(1)).alias("articles"))
    first = one.where(F.size("context") > 0).withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("article_id"))).where(F.col("n") <= 3)
    said = first.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("n", F.slice("context", 1, 2).alias("c")))).alias("all"))
    told = said.select("entity_id", F.array_join(F.slice(F.flatten(F.transform("all", lambda x: x["c"])), 1, 3), " | ").alias("context"))
    return totals.join(told, "entity_id", "left")


def article_tags(s: SparkSession, d: str) -> DataFrame:
    """Articles by tag: the lower-case words of their categories are the tags of a link table without payload."""
    words = F.array_distinct(F.filter(F.split(F.lower("category"), " "), lambda w: w != ""))
    link = V.articles(s, d, "category").where(F.col("category").isNotNull()).select(F.col("id").alias("article_id"), F.explode(words).alias("tag"))
    tags = link.select("tag").distinct().where(F.length("tag") >= 4)
    return link.join(tags, "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("articles"), F.min("article_id").alias("first_article"))


def tags_created(s: SparkSession, d: str) -> DataFrame:
    """The tags of odd articles added to those of even ones; new ids go on from the largest."""
    c = T.split_category(F.col("category"))["category"]
    rows = V.articles(s, d, "category").where(F.col("category").isNotNull()).select("id", c.alias("name"))
    old = upkeep.numbered(rows.where(F.col("id") % 2 == 0).select("name").distinct(), "id", "name")
    return upkeep.got_or_created(old, rows.where(F.col("id") % 2 == 1), "name")


def sources_created(s: SparkSession, d: str) -> DataFrame:
    """The process rows of the sources whose domain no article names by address."""
    known = V.articles(s, d, "url").select(F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/?#]*)", 1).alias("domain")).distinct()
    return upkeep.process_rows(load(s, d, "sources").join(known, "domain", "left_anti"), ("enrich", "analyze", "flash")).select("domain_id", "kind")


def text_mentions(s: SparkSession, d: str) -> DataFrame:
    """How often each text is extracted from an article, with the type seen first."""
    e = load(s, d, "extracted_entities").where(F.col("article_id").isNotNull() & F.col("text").isNotNull())
    return e.groupBy("article_id", "text").agg(F.count(F.lit(1)).alias("mentions"), F.min_by("type", "id").alias("type"))


def cluster_stats(s: SparkSession, d: str) -> DataFrame:
    """Clusters and their share by category."""
    c = Q.cluster_scores(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("clusters"))
    return c.join(F.broadcast(c.agg(F.sum("clusters").alias("all"))), how="cross").select("category", "clusters", r6(100.0 * F.col("clusters") / F.col("all")).alias("percent"))  # one row


def run_averages(s: SparkSession, d: str) -> DataFrame:
    """Averages over the last ten runs of the log."""
    last = V.llm_calls(s, d).orderBy(F.desc("started_at"), F.desc("id")).limit(10)
    return last.agg(F.count(F.lit(1)).alias("runs"), r6(F.avg("duration_seconds")).alias("avg_seconds"), F.sum("success").alias("successes"))


def longest_names(s: SparkSession, d: str) -> DataFrame:
    e = V.entities(s, d).select("id", "name", F.length("name").alias("name_length"), F.coalesce("article_count", F.lit(0)).alias("article_count"))
    return upkeep.limited(e.orderBy(F.desc("name_length"), F.desc("article_count"), "id"), 20)


def top_ranked(s: SparkSession, d: str) -> DataFrame:
    """The ten entities of the highest rank; equal ones by name."""
    return V.entities(s, d).where(F.col("pagerank").isNotNull() & ~F.isnan("pagerank")).orderBy(F.desc("pagerank"), "name").limit(10).select("name", r6("pagerank").alias("pagerank"))


def newest_articles(s: SparkSession, d: str) -> DataFrame:
    when = F.coalesce("clusterized_at", "created_at")
    return V.articles(s, d, "clusterized_at").orderBy(F.desc_nulls_last(when), "id").limit(5).select("id", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("at"))


def work_selection(s: SparkSession, d: str) -> DataFrame:
    """The twenty newest articles for each kind of work: to enrich, to analyse (enriched), and without entities."""
    a = V.articles(s, d, "clusterized_at")
    done = load(s, d, "article_entities").select(F.col("article_id").alias("id"))
    newest = lambda rows, kind: rows.orderBy(F.desc_nulls_last("created_at"), "id").limit(20).select("id", F.lit(kind).alias("work"))
    open_, ready = a.where(F.col("clusterized_at").isNull()), a.where(F.col("clusterized_at").isNotNull())
    return newest(open_, "enrich").unionByName(newest(ready, "analyze")).unionByName(newest(a.join(done, "id", "left_anti"), "entities"))


def bench_grams(s: SparkSession, d: str) -> DataFrame:
    """The padded trigrams of the names in the benchmark's form."""
    return V.entities(s, d).select("id", F.explode(T.bench_ngrams(T.bench_normalized(F.col("name")), 3)).alias("gram"))


def bench_words(s: SparkSession, d: str) -> DataFrame:
    """The word pairs and words of the names in the benchmark's form."""
    return V.entities(s, d).select("id", F.explode(T.bench_word_ngrams(T.bench_normalized(F.col("name")))).alias("gram"))


def _last_words(s: SparkSession, d: str) -> DataFrame:
    return V.entities(s, d).where(F.col("classified_as") == "canonical").select("id", F.col("entity_type").alias("type"), F.element_at(F.split("name", " "), -1).alias("word"))


def _truth(s: SparkSession, d: str) -> DataFrame:
    last = _last_words(s, d)
    return last.withColumnRenamed("id", "a").join(last.withColumnRenamed("id", "b"), ["type", "word"]).where(F.col("a") < F.col("b")).select("a", "b")


def band_collisions(s: SparkSession, d: str) -> DataFrame:
    """For the true pairs whether any band of the signatures is equal."""
    sig = Q._signed(s, d).select("id", similarity.bands(F.col("signature")).alias("bands"))
    side = lambda n: sig.select(F.col("id").alias(n), F.col("bands").alias(f"bands_{n}"))
    both = _truth(s, d).join(side("a"), "a").join(side("b"), "b")
    hit = F.exists(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), lambda x: x)
    return both.select("a", "b", F.when(hit, 1.0).otherwise(0.0).alias("collides"))


def lsh_errors(s: SparkSession, d: str) -> DataFrame:
    """The true pairs that the candidates miss, and the candidates that are no true pairs, at a similarity of 0.3."""
    found = similarity.scored(Q._signed(s, d)).where(F.col("exact") >= 0.3).select("a", "b")
    true = _truth(s, d)
    missed = true.join(found, ["a", "b"], "left_anti").withColumn("error", F.lit("missed"))
    return missed.unionByName(found.join(true, ["a", "b"], "left_anti").withColumn("error", F.lit("extra")))


def lsh_thresholds(s: SparkSession, d: str) -> DataFrame:
    """How many candidates reach a threshold exactly and by the estimate."""
    p = similarity.scored(Q._signed(s, d))
    steps = F.explode(F.array(*(F.lit(x) for x in (0.3, 0.5, 0.7)))).alias("threshold")
    return p.select(steps, "exact", "estimate").groupBy("threshold").agg(F.count_if(F.col("exact") >= F.col("threshold")).alias("exact"), F.count_if(F.col("estimate") >= F.col("threshold")).alias("estimated"))


def best_comparison(s: SparkSession, d: str) -> DataFrame:
    """For each name the comparison of the highest confidence; the first one wins ties."""
    p = similarity.scored(Q._signed(s, d)).select("a", "b", r6("exact").alias("confidence"))
    either = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    order = Window.partitionBy("a").orderBy(F.desc("confidence"), "b")
    return either.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).select(F.col("a").alias("id"), F.col("b").alias("other"), "confidence")


def comparison_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Comparisons saved once a pair: under a confidence of 0.7 only a suggestion, else the shorter name is the alias of the longer."""
    p = similarity.scored(Q._signed(s, d)).select("a", "b", r6("exact").alias("confidence"))
    n = V.entities(s, d).select("id", F.length("name").alias("len"))
    both = p.join(n.withColumnRenamed("id", "a").withColumnRenamed("len", "la"), "a").join(n.withColumnRenamed("id", "b").withColumnRenamed("len", "lb"), "b")
    alias = F.when(F.col("confidence") >= 0.7, F.when(F.col("la") < F.col("lb"), F.col("a")).otherwise(F.col("b")))
    return both.select("a", "b", "confidence", F.when(alias.isNull(), "suggestion").otherwise("alias").alias("outcome"), alias.alias("alias_id"))


def time_weighted_edges(s: SparkSession, d: str) -> DataFrame:
    """Co-occurrence weights that fade with the age of the article, over thirty days."""
    a = V.articles(s, d).select(F.col("id").alias("article_id"), graph.time_weight(F.to_date("created_at"), F.lit("2026-01-01").cast("date"), 30.0).alias("tw"))
    rows = Q._ranked(s, d).join(a, "article_id").withColumn("relevance", F.col("relevance"))
    x = rows.select("article_id", F.col("name").alias("src"), F.col("relevance").alias("rs"))
    y = rows.select("article_id", F.col("name").alias("dst"), F.col("relevance").alias("rd"), "size", "tw")
    pairs = x.join(y, "article_id").where((F.col("src") != F.col("dst")) & ~((F.col("rs") < graph.THRESHOLD) & (F.col("rd") < graph.THRESHOLD)))
    return pairs.groupBy("src", "dst").agg(F.round(F.sum(F.col("rd") / F.col("size") * F.col("tw")), 4).alias("weight"))


def rank_run_statistics(s: SparkSession, d: str) -> DataFrame:
    """Size and density of the matrix of a rank run."""
    ranked = Q._ranked(s, d)
    moves = graph.transitions(graph.edges(ranked)).agg(F.count(F.lit(1)).alias("nnz"))
    nodes = ranked.select("name").distinct().agg(F.count(F.lit(1)).alias("nodes"))
    both = nodes.join(F.broadcast(moves), how="cross")  # one row each
    density = F.when(F.col("nodes") > 0, 100.0 * F.col("nnz") / (F.col("nodes") * F.col("nodes"))).otherwise(0.0)
    return both.select("nodes", "nnz", r6(density).alias("density"), r6(100.0 - density).alias("sparsity"), (F.col("nnz") * 12 + (F.col("nodes") + 1) * 4).alias("csr_bytes"))


def pagerank_converged(s: SparkSession, d: str) -> DataFrame:
    """The rank run until an update changes it by less than 1e-6."""
    ranked = Q._ranked(s, d)
    pr = graph.pagerank(ranked.select("name"), graph.transitions(graph.edges(ranked)), 1000, tolerance=1e-6)
    return pr.select("name", F.round("pr", 5).alias("pr"))


def rank_write_back(s: SparkSession, d: str) -> DataFrame:
    """The scores of all entities after a rank run of five steps."""
    ranked = Q._ranked(s, d)
    pr = graph.min_max(graph.pagerank(ranked.select("name"), graph.transitions(graph.edges(ranked)), 5))
    old = V.entities(s, d).withColumn("pagerank", F.nanvl("pagerank", F.lit(None))).withColumn("global_relevance", F.nanvl("global_relevance", F.lit(None)))
    return upkeep.rank_written_back(old, pr, V.RANKED_TYPES).select("id", F.round("global_relevance", 4).alias("global_relevance"), F.round("pagerank", 6).alias("pagerank"))


def publication_report(s: SparkSession, d: str) -> DataFrame:
    """Publishing every third flash item by id, of which every second is out already; some ids are of no item."""
    items = Q.flash_scores(s, d).select("id", (F.col("id") % 2 == 0).alias("published"))
    asked = items.where(F.col("id") % 3 == 0).select("id").unionByName(items.where(F.col("id") % 30 == 0).select((-F.col("id")).alias("id")))
    return upkeep.publication(items, asked).groupBy("status").agg(F.count(F.lit(1)).alias("items"))


def publish_guard(s: SparkSession, d: str) -> DataFrame:
    """The unpublished items without a score, each of which stops publishing."""
    items = Q.flash_scores(s, d).select("id", (F.col("id") % 2 == 0).alias("published"), F.when(F.col("id") % 5 != 0, F.col("score")).alias("score"))
    return upkeep.unscored(items).select("id")


def scoring_modes(s: SparkSession, d: str) -> DataFrame:
    """How many items each mode of a scoring run takes."""
    items = Q.flash_scores(s, d).select("id", F.when(F.col("id") % 5 != 0, F.col("score")).alias("score"))
    count = lambda mode, key=None: upkeep.scoring_batch(items, mode, key).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("items"))
    return count("one", 7).unionByName(count("unscored")).unionByName(count("all"))


def rerank_queue(s: SparkSession, d: str) -> DataFrame:
    """The articles that a change of the organisations puts into the queue, of which those of even ids are queued already, after the multiples of three are done."""
    links = V.links(s, d)
    changed = V.entities(s, d).where(F.col("entity_type") == "ORG").select(F.col("id").alias("entity_id"))
    queued = links.select("article_id").where(F.col("article_id") % 2 == 0).distinct()
    queue = resolution.needs_rerank(links, changed, queued)
    return upkeep.drained(queue, queue.where(F.col("article_id") % 3 == 0))


def ambiguous_cascade(s: SparkSession, d: str) -> DataFrame:
    """The classes after the first head of every type becomes ambiguous between the last and the middle ones."""
    e, refs = Q._references(s, d)
    heads = V.entities(s, d).where((F.col("id") % 5 != 0) & (F.col("id") % 7 != 0)).groupBy("entity_type").agg(F.min("id").alias("entity_id"), F.sort_array(F.collect_set("id")).alias("ids"))
    two = heads.where(F.size("ids") >= 3).select("entity_id", F.explode(F.array(F.element_at("ids", 2), F.element_at("ids", -1))).alias("target_id"))
    return resolution.classes(e, resolution.redirected(refs, two))


def not_entity_refs(s: SparkSession, d: str) -> DataFrame:
    """The references after every third entity is declared none."""
    e, refs = Q._references(s, d)
    return upkeep.not_entities(refs, e.where(F.col("id") % 3 == 0).select("id"))


def canonical_requests(s: SparkSession, d: str) -> DataFrame:
    """What becomes of the request to make every second entity canonical."""
    e, refs = Q._references(s, d)
    asked = e.where(F.col("id") % 2 == 0).select("id").unionByName(e.where(F.col("id") % 50 == 0).select((-F.col("id")).alias("id")))
    return upkeep.made_canonical(e, refs, asked)


def group_violations(s: SparkSession, d: str) -> DataFrame:
    return upkeep.group_problems(Q._memberships(s, d), F.lit("1998-06-01").cast("timestamp_ntz"))


def corpus_upsert(s: SparkSession, d: str) -> DataFrame:
    """An export of the even articles, then of every third: rows by their first export."""
    a = V.articles(s, d, "hash", "title").where(F.col("hash").isNotNull())
    rows = a.select("id", "hash", "title", F.when(F.col("id") % 2 == 0, "2025-01-01 00:00:00").otherwise("2025-02-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    old = rows.where(F.col("id") % 2 == 0).dropDuplicates(["hash"])
    new = rows.where(F.col("id") % 3 == 0).withColumn("created_at", F.lit("2025-02-01 00:00:00").cast("timestamp_ntz"))
    merged = upkeep.corpus_merged(old, new)
    return merged.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("first_export")).agg(F.count(F.lit(1)).alias("articles"))


def call_log_appended(s: SparkSession, d: str) -> DataFrame:
    """The call log after two more calls, one of which failed."""
    log = V.llm_calls(s, d)
    new = s.createDataFrame([("added", 1, 0.5), ("added", 0, 1.5)], "task_name string, success int, duration_seconds double")
    return upkeep.appended(log, new).groupBy("task_name").agg(F.count(F.lit(1)).alias("calls"), F.sum("success").alias("successes"))


def cache_prefix(s: SparkSession, d: str) -> DataFrame:
    """The cache entries by the beginnings of hashes: those of the three least hashes."""
    cache = V.url_cache(s, d)
    keys = [r.url_hash[:10] for r in cache.select("url_hash").distinct().orderBy("url_hash").limit(3).collect()]
    found = [ingest.by_hash(cache, k) for k in keys] or [cache.limit(0)]
    for x in found[1:]:
        found[0] = found[0].unionByName(x)
    return found[0].select("url_hash", "url").distinct()


def cache_upsert(s: SparkSession, d: str) -> DataFrame:
    """The cache after every second page is stored again with a new text."""
    cache = V.url_cache(s, d).dropDuplicates(["url_hash"])
    new = cache.where(F.col("status_code") == 200).withColumn("content", F.lit("again")).withColumn("created_at", F.lit("2027-01-01 00:00:00").cast("timestamp_ntz"))
    return ingest.cache_upserted(cache, new).groupBy("status_code").agg(F.count(F.lit(1)).alias("pages"), F.sum("content_length").alias("size"), F.max("created_at").alias("newest"))


def cache_cleared(s: SparkSession, d: str) -> DataFrame:
    """How many entries go and stay when a domain is cleared."""
    cache = V.url_cache(s, d)
    gone = cache.where(F.contains("domain", F.lit("harborledger"))).select("url_hash")
    left = ingest.without(cache, gone, "url_hash", "url_hash")
    return cache.agg(F.count(F.lit(1)).alias("before")).join(F.broadcast(left.agg(F.count(F.lit(1)).alias("after"))), how="cross")  # one row each


def links_ignored(s: SparkSession, d: str) -> DataFrame:
    """Links inserted where the article has none of the entity: all links into those of even entities."""
    rows = V.links(s, d).select("article_id", "entity_id")
    both = ingest.inserted_or_ignored(rows.where(F.col("entity_id") % 2 == 0), rows, ["article_id", "entity_id"])
    return both.groupBy("entity_id").agg(F.count(F.lit(1)).alias("articles"))


def links_replaced(s: SparkSession, d: str) -> DataFrame:
    """The links of every third article replaced by their first entity alone."""
    rows = V.links(s, d).select("article_id", "entity_id")
    new = rows.where(F.col("article_id") % 3 == 0).groupBy("article_id").agg(F.min("entity_id").alias("entity_id"))
    return ingest.replaced(rows, new, "article_id")


def articles_deleted(s: SparkSession, d: str) -> DataFrame:
    """What a deletion of the articles of the third source leaves: links by entity."""
    gone = V.articles(s, d, "source_id").where(F.col("source_id") == 3).select("id")
    return ingest.without(V.links(s, d), gone, "id", "article_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("articles"))


def position_feature(s: SparkSession, d: str) -> DataFrame:
    """For each vector of a label its place among the label's, from 0 to 0.15."""
    w = Window.partitionBy("label")
    rows = load(s, d, "embeddings").select("vec_id", "label", (F.row_number().over(w.orderBy("vec_id")) - 1).alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.select("vec_id", r6(F.when(F.col("n") > 1, F.col("at") / (F.col("n") - 1) * 0.15).otherwise(0.0)).alias("position"))


def vector_lengths(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 4).alias("length"))


def flash_sources(s: SparkSession, d: str) -> DataFrame:
    """Clusters that serve for flash items: core ones, and only where a text has none the secondary ones above 0.6; labels stand for texts by their last digit."""
    c = Q.cluster_scores(s, d).withColumn("text_id", F.abs("label") % 3)
    core = F.max((F.col("category") == "core").cast("int")).over(Window.partitionBy("text_id"))
    return c.withColumn("core", core).where((F.col("category") == "core") | (F.col("core") == 0) & (F.col("category") == "secondary") & (F.col("score") > 0.6)).select("label", "text_id")


def cluster_boost(s: SparkSession, d: str) -> DataFrame:
    """For each entity of an article 1.3 if a sentence of the core names it, else 1 if a secondary one does, else 0.7; the first two sentences are the core, the next three secondary."""
    a = V.articles(s, d, "content").where(F.col("content").isNotNull())
    parts = T.simple_sentences(F.lower(F.col("content")))
    texts = a.select(F.col("id").alias("article_id"), F.array_join(F.slice(parts, 1, 2), "\n").alias("core"), F.array_join(F.slice(parts, 3, 3), "\n").alias("secondary"))
    named = V.links(s, d).select("article_id", "entity_id").join(V.entities(s, d).select(F.col("id").alias("entity_id"), F.lower("name").alias("name")), "entity_id")
    return named.join(texts, "article_id").select("article_id", "entity_id", scoring.cluster_boost(F.col("name"), F.col("core"), F.col("secondary")).alias("boost"))


def _site_pages(s: SparkSession, d: str) -> DataFrame:
    """The cache with pages in the known layout: the title as heading, the rest as the body; every tenth page has no title."""
    cache = V.url_cache(s, d).dropDuplicates(["url"])
    a = V.articles(s, d, "url", "title").where(F.col("url").isNotNull()).select("url", F.when(F.col("id") % 10 != 0, F.concat(F.lit("T"), F.col("id").cast("string"))).alias("h")).dropDuplicates(["url"])
    page = F.concat(F.lit("<html><body>"), F.coalesce(F.concat(F.lit("<h1>"), F.col("h"), F.lit("</h1>")), F.lit("")), F.lit("<div class='detail-body'><p>Text.</p></div><script>x</script></body></html>"))
    return cache.join(a, "url").withColumn("content", F.when(F.col("status_code") == 200, page).otherwise(F.col("content"))).drop("h")


def cached_reingest(s: SparkSession, d: str) -> DataFrame:
    """The cached pages taken in beside the even articles; only three sites have an extractor."""
    old = V.articles(s, d, "hash", "url", "title", "cleaned_html_hash", "clusterized_at").where((F.col("id") % 2 == 0) & F.col("url").isNotNull())
    domains = [r.domain for r in load(s, d, "sources").select("domain").distinct().orderBy("domain").limit(12).collect()]
    named = {x: "default" for d2 in domains for x in (d2, f"www.{d2}")}
    return pipelines.reingested(_site_pages(s, d), old, named)[1]


def ratio_training_pairs(s: SparkSession, d: str) -> DataFrame:
    """Two partners in the subcategory, one in the next one, two in the next category, and the own body."""
    c = T.split_category(F.col("category"))
    rows = V.articles(s, d, "title", "category").where((F.coalesce("title", F.lit("")) != "") & F.col("category").isNotNull())
    return selection.ratio_pairs(rows.select("id", c["category"].alias("cat"), F.coalesce(c["subcategory"], F.lit("-")).alias("sub")))


def lsh_grid(s: SparkSession, d: str) -> DataFrame:
    """Hits, false pairs and misses at a similarity of 0.3 for several numbers of bands; those that do not divide the signature are left out."""
    counts = [n for n in (10, 12, 25, 50) if similarity.HASHES % n == 0]
    return similarity.grid(Q._signed(s, d), _last_words(s, d), counts, 0.3)


def corpus_overview(s: SparkSession, d: str) -> DataFrame:
    """The corpus in figures: all articles, those of each source, and the first and last times."""
    a = V.articles(s, d, "source_id").join(load(s, d, "sources").select(F.col("id").alias("source_id"), "domain"), "source_id", "left")
    one = lambda part, key, value: F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    whole = a.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    figures = whole.select(F.explode(F.array(one("all", F.lit("articles"), F.col("n")), one("time", F.lit("first"), stamp("first")), one("time", F.lit("last"), stamp("last")))).alias("x")).select("x.*")
    by_source = a.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("part"), F.col("domain").alias("key"), F.col("n").cast("string").alias("value"))
    return figures.unionByName(by_source)


QUERIES: dict = {f.__name__: f for f in (
    entity_by_name, article_previews, training_texts, call_durations, entity_context, article_tags, tags_created, sources_created, text_mentions, cluster_stats, run_averages, longest_names, top_ranked,
    newest_articles, work_selection, bench_grams, bench_words, band_collisions, lsh_errors, lsh_thresholds, best_comparison, comparison_outcomes, time_weighted_edges, rank_run_statistics, pagerank_converged,
    rank_write_back, publication_report, publish_guard, scoring_modes, rerank_queue, ambiguous_cascade, not_entity_refs, canonical_requests, group_violations, corpus_upsert, call_log_appended, cache_prefix,
    cache_upsert, cache_cleared, links_ignored, links_replaced, articles_deleted, position_feature, vector_lengths, flash_sources, cluster_boost,
    cached_reingest, ratio_training_pairs, lsh_grid, corpus_overview,
)}
