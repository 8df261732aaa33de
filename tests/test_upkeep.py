"""Ranks over whole tables and the upkeep operators on small rows, with ties, nulls, repeated rows and empty tables."""

from pyspark.sql import functions as F

from lectern.operators import pipelines, ranking, selection, upkeep


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ranks(spark):
    df = spark.createDataFrame([(i, float(x) if x is not None else None) for i, x in enumerate([3, 1, 3, None, 2, 3])], "id long, v double")
    assert rows(ranking.competition_rank(df, "v"), "id", "place", "total") == [(0, 1, 5), (1, 5, 5), (2, 1, 5), (4, 4, 5), (5, 1, 5)]
    assert ranking.competition_rank(df.limit(0), "v").count() == 0
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(300)], "name string")
    assert rows(ranking.numbered(names, "id", "name", start=7), "id", "name") == [(7 + i, f"n{i:03d}") for i in range(300)]


def test_rows_made_on_demand(spark):
    old = spark.createDataFrame([(4, "b"), (9, "a")], "id long, name string")
    wanted = spark.createDataFrame([("c",), ("a",), (None,), ("aa",), ("c",)], "name string")
    assert rows(upkeep.got_or_created(old, wanted, "name"), "id", "name") == [(4, "b"), (9, "a"), (10, "aa"), (11, "c")]
    assert rows(upkeep.got_or_created(old.limit(0), wanted.limit(0), "name"), "id") == []
    assert upkeep.process_rows(old, ("x", "y")).count() == 4


def test_publication_and_batches(spark):
    items = spark.createDataFrame([(1, True, 0.5), (2, False, None), (3, False, 0.2)], "id long, published boolean, score double")
    asked = spark.createDataFrame([(1,), (2,), (2,), (8,), (None,)], "id long")
    assert rows(upkeep.publication(items, asked), "id", "status") == [(1, "already"), (2, "changed"), (8, "not_found")]
    assert rows(upkeep.publication(items, asked, publish=False), "id", "status") == [(1, "changed"), (2, "already"), (8, "not_found")]
    assert not upkeep.publishable(items) and upkeep.publishable(items.where("id <> 2")) and upkeep.publishable(items.limit(0))
    assert [upkeep.scoring_batch(items, m, 3).count() for m in ("one", "unscored", "all")] == [1, 1, 3]
    assert upkeep.limited(items, None).count() == upkeep.limited(items, 0).count() == 3 and upkeep.limited(items, 2).count() == 2


def test_merges_and_resolution(spark):
    e = spark.createDataFrame([(1, "a", "PERSON", 0.1, 0.2), (2, "b", "PERSON", 0.3, 0.4), (3, "c", "DATE", 0.5, 0.6), (4, None, None, 0.7, 0.8)], "id long, name string, entity_type string, global_relevance double, pagerank double")
    ranks = spark.createDataFrame([("a", 0.9, 1.0)], "name string, pr double, scaled double")
    assert rows(upkeep.rank_written_back(e, ranks, ("PERSON",)), "id", "global_relevance", "pagerank") == [(1, 1.0, 0.9), (2, 0.3, 0.4), (3, 0.0, 0.0), (4, 0.0, 0.0)]
    refs = spark.createDataFrame([(1, 2), (3, 2), (2, 4)], "entity_id long, canonical_id long")
    assert rows(upkeep.not_entities(refs, spark.createDataFrame([(3,), (4,)], "id long")), "entity_id", "canonical_id") == [(1, 2)]
    asked = spark.createDataFrame([(1,), (4,), (7,)], "id long")
    assert rows(upkeep.made_canonical(e, refs, asked), "id", "status") == [(1, "refused"), (4, "canonical"), (7, "not_found")]
    queue = spark.createDataFrame([(1,), (2,), (3,)], "article_id long")
    assert rows(upkeep.drained(queue, queue.where("article_id = 2")), "article_id") == [(1,), (3,)]
    m = spark.sql("select * from values (1L, 'g', 5L, timestamp_ntz'2020-01-01', timestamp_ntz'2020-06-01'), (2L, 'g', 5L, timestamp_ntz'2020-05-01', null), (3L, 'h', 5L, timestamp_ntz'2020-05-01', timestamp_ntz'2020-04-01'), (4L, '7', 7L, null, null), (5L, 'k', 8L, timestamp_ntz'2030-01-01', null) as t(id, group_id, member_id, since, until)")
    assert rows(upkeep.group_problems(m, F.lit("2025-01-01").cast("timestamp_ntz")), "id", "problem") == [(2, "overlap"), (3, "order"), (4, "self"), (5, "future")]
    assert upkeep.group_problems(m.limit(0), F.lit("2025-01-01").cast("timestamp_ntz")).count() == 0


def test_reingest(spark):
    page = lambda t: f"<body>{f'<h1>{t}</h1>' if t else ''}<div class='detail-body'><p>x</p></div></body>"
    cache = spark.createDataFrame([("h1", "u1", "a", page("T"), 200), ("h2", "u2", "a", page("T"), 301), ("h3", "u3", "b", page("T"), 200), ("h4", "u4", "a", page(""), 200), ("h5", "u5", "a", page("N"), 200)], "url_hash string, url string, domain string, content string, status_code int")
    old = spark.sql("select 1L as id, 'h1' as hash, 'u1' as url, 'T' as title, 'z' as cleaned_html_hash, timestamp_ntz'2020-01-01' as clusterized_at")
    _, report = pipelines.reingested(cache, old, {"a": "default"})
    assert dict(rows(report, "status", "pages")) == {"created": 1, "updated": 0, "error": 2, "skipped": 1}
    merged, report = pipelines.reingested(cache, old, {"a": "default"}, reindex=True)
    assert dict(rows(report, "status", "pages")) == {"created": 1, "updated": 1, "error": 2, "skipped": 0}
    changed = merged.where("url = 'u1'").first()
    assert changed.clusterized_at is None and len(changed.cleaned_html_hash) == 64 and changed.action == "reset"


def test_ratio_pairs(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "-")], "id long, cat string, sub string")
    got = rows(selection.ratio_pairs(df), "a", "b", "label")
    assert {p for p in got if p[2] == 0.95} == {(1, 2, 0.95), (2, 1, 0.95)} and sum(p[2] == 1.0 for p in got) == 4
    assert all({p[0], p[1]} & {4} for p in got if p[2] == 0.0) and selection.ratio_pairs(df.limit(0)).count() == 0
