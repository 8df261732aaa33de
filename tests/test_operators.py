"""Operators against plain Python on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, ingest, resolution, selection, similarity, temporal


def greedy(items, low_n, top_n, low, high, cap):
    used, chosen = {}, []
    order = sorted(items, key=lambda x: (-x[2], x[0]))
    for name, keep in (("c", lambda s: s >= high), ("n", lambda s: low <= s < high), ("f", lambda s: s < low)):
        for i, src, s in order:
            if keep(s) and used.get(src, 0) < cap and (name == "c" or name == "n" and len(chosen) < top_n or name == "f" and len(chosen) < low_n):
                chosen.append(i)
                used[src] = used.get(src, 0) + 1
    return set(chosen)


def test_digest_equals_the_loop(spark):
    rnd = random.Random(5)
    for _ in range(4):
        items = [(i, rnd.randrange(4), round(rnd.random(), 2)) for i in range(30)]
        df = spark.createDataFrame(items, "id long, source long, score double")
        got = {r.id for r in selection.digest(df, 2, 6, 0.4, 0.9, 2).collect()}
        assert got == greedy(items, 2, 6, 0.4, 0.9, 2)
    with pytest.raises(ValueError):
        selection.digest(df, 3, 2)


def test_pagerank_sums_to_one_and_stops(spark):
    moves = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 0.5)], "src string, dst string, p double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    pr = {r.name: r.pr for r in graph.pagerank(nodes, moves, 60, tolerance=1e-6).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-9 and pr["b"] > pr["c"]
    warm = graph.pagerank(nodes, moves, 1, start=spark.createDataFrame([("a", 0.9)], "name string, pr double"))
    assert abs(warm.agg(F.sum("pr")).first()[0] - 1) < 1e-9
    assert graph.pagerank(nodes.limit(0), moves, 3).count() == 0
    scaled = {r.name: r.scaled for r in graph.min_max(spark.createDataFrame(pr.items(), "name string, pr double")).collect()}
    assert min(scaled.values()) == 0 and max(scaled.values()) == 1


def test_periods(spark):
    m = spark.createDataFrame([(1, "g", "m", "2020-01-01", "2020-06-01"), (2, "g", "m", "2020-06-01", None), (3, "g", "m", "2020-05-01", "2020-07-01"), (4, "g", "x", None, None)], "id long, group_id string, member_id string, since string, until string")
    m = m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})
    assert sorted(map(tuple, temporal.overlaps(m).collect())) == [(1, 3), (2, 3)]  # touching periods do not overlap
    assert {r.id for r in temporal.active_at(m, F.lit("2020-06-01").cast("timestamp_ntz")).collect()} == {1, 2, 3, 4}


def test_cascade(spark):
    refs = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "entity_id long, canonical_id long")
    entities = spark.createDataFrame([(i, "canonical") for i in (1, 2, 3, 10, 11)], "id long, classified_as string")
    moved = resolution.redirected(refs, spark.createDataFrame([(1, 2)], "entity_id long, target_id long"))
    got = {r.id: r.classified_as for r in resolution.classes(entities, moved).collect()}
    assert got == {1: "alias", 2: "canonical", 3: "canonical", 10: "alias", 11: "alias"}
    split = resolution.redirected(refs, spark.createDataFrame([(1, 2), (1, 3)], "entity_id long, target_id long"))
    assert {r.id: r.classified_as for r in resolution.classes(entities, split).collect()}[10] == "ambiguous"
    assert {r.id for r in resolution.violations(entities, refs).collect()} == {10, 11}


def test_merges(spark):
    old = spark.createDataFrame([(1, "h1", "u1", "t", "p", "2024-01-01"), (2, "h2", "u2", "t", "p", "2024-01-01"), (3, "h3", "u3", "t", "p", "2024-01-01")], "id long, hash string, url string, title string, cleaned_html_hash string, clusterized_at string").withColumn("clusterized_at", F.col("clusterized_at").cast("timestamp_ntz"))
    new = spark.createDataFrame([("h1", "u1", "n", "p"), ("x2", "u2", "n", "q"), ("h9", "u9", "n", None)], "hash string, url string, title string, cleaned_html_hash string")
    got = {r.hash: (r.action, r.clusterized_at is None) for r in ingest.upserted(old, new).collect()}
    assert got == {"h1": ("updated", False), "x2": ("reset", True), "h3": ("kept", False), "h9": ("created", True)}
    kept = ingest.inserted_or_ignored(old.select("id", "title"), spark.createDataFrame([(1, "z"), (7, "z"), (7, "z")], "id long, title string"), ["id"])
    assert sorted((r.id, r.title) for r in kept.collect()) == [(1, "t"), (2, "t"), (3, "t"), (7, "z")]
    with pytest.raises(ValueError):
        ingest.by_hash(old, "abc")


def test_similarity(spark):
    names = spark.createDataFrame([(1, "Banco Central", "ORG"), (2, "Banco Central.", "ORG"), (3, "Xyz", "ORG"), (4, "Banco Central", "GPE"), (5, "a", "ORG")], "id long, name string, type string")
    pairs = {(r.a, r.b): (r.exact, r.estimate) for r in similarity.scored(similarity.signed(names)).collect()}
    assert pairs == {(1, 2): (1.0, 1.0)}


def test_stream(spark, tmp_path):
    from lectern.streaming.calls import hourly_calls

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 09:00:00", "b"), (None, "a")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    q = hourly_calls(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hourly").collect())) == [("2024-01-01 00:00", "a", 2), ("2024-01-01 09:00", "b", 1)]


def data_dir(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_topic_diversity_of_every_item(spark, tmp_path, monkeypatch):
    from lectern.operators import scoring
    from lectern.plans import queries

    monkeypatch.setattr(scoring, "BLOCK", 7)
    rnd = random.Random(3)
    vectors = {i: [rnd.random() - 0.4 for _ in range(4)] for i in (*range(0, 1500, 41), 359, 361, 1439, 1440, 1441, 1999)}
    d = data_dir(spark, tmp_path, embeddings=(list(vectors.items()), "vec_id long, embedding array<float>"))
    got = {r.id: r.diversity for r in queries.topic_diversity(spark, d).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    near = {i: max(cos(v, w) for j, w in vectors.items() if j != i and j <= 1440) for i, v in vectors.items()}
    assert got == pytest.approx({i: 1.0 if n < 0.3 else 1 - n for i, n in near.items()}, abs=1e-5)


def test_training_pairs_have_four_tiers(spark, tmp_path):
    from lectern.plans import queries

    kinds = {i: c for i, c in enumerate(["A/x"] * 5 + ["A/y"] * 3 + ["A/z"] + ["B/x"] * 4 + ["C"] * 2)}
    schema = "id long, created_at timestamp_ntz, title string, category string"
    d = data_dir(spark, tmp_path, articles=([(i, None, f"t{i}", c) for i, c in kinds.items()] + [(90, None, "", "A/x"), (91, None, "t", None)], schema))
    tiers = {}
    for r in queries.training_pairs(spark, d).collect():
        assert tiers.setdefault(r.label, {}).setdefault(r.a, r.b) == r.b
    alone, top = {8}, {i: c.split("/")[0] for i, c in kinds.items()}
    assert all(a != b and kinds[a] == kinds[b] for a, b in tiers[0.95].items()) and set(tiers[0.95]) == set(kinds) - alone
    assert all(top[a] == top[b] and kinds[a] != kinds[b] for a, b in tiers[0.7].items()) and set(tiers[0.7]) == set(range(8))
    assert all(top[a] != top[b] for a, b in tiers[0.0].items()) and set(tiers[0.0]) == set(kinds) - alone
    assert tiers[1.0] == {i: i for i in set(kinds) - alone}


def test_lsh_evaluation_counts_pairs_the_bands_miss(spark, tmp_path):
    from lectern.plans import queries

    names = ["Bo Lee", "Maximiliana Wolkenstein Lee", "Other Name", "Bo Lea"]
    rows = [(i, n, "PERSON", "canonical") for i, n in enumerate(names)] + [(9, "Third Lee", "ORG", "canonical"), (10, "Fourth Lee", "PERSON", "alias")]
    d = data_dir(spark, tmp_path, named_entities=(rows, "id long, name string, entity_type string, classified_as string"))
    assert (0, 1) not in {(r.a, r.b) for r in queries.lsh_candidates(spark, d).collect()}
    for r in queries.lsh_eval(spark, d).collect():
        assert r.tp + r.fn == 1 and r.fn == 1 and r.recall == 0


def test_grid_counts_pairs_without_listing_them(spark, tmp_path, monkeypatch):
    """The blocks' counts equal those of the listed pairs, whatever the blocks, and no band is joined with itself."""
    from lectern.plans import upkeep

    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "TILE", 2)
    monkeypatch.setattr(similarity, "COLUMNS", 5)
    names = ["Ana Lee", "Ana Leo", "Anna Lee", "Hana Lee", "Bo Lee", "Ana Lea", "Xu", "Ana Lee", "..", "Bob Lee"]
    rows = [(i, n, "PERSON" if i != 7 else "ORG", "canonical") for i, n in enumerate(names)] + [(20, "Ana Lee", None, "canonical"), (21, "Ana Lee", "PERSON", "alias"), (22, None, "ORG", "canonical")]
    d = data_dir(spark, tmp_path, named_entities=(rows, "id long, name string, entity_type string, classified_as string"))
    sig = similarity.signed(spark.createDataFrame([r[:3] for r in rows if r[3] == "canonical"], "id long, name string, type string")).collect()
    word = {i: (t, n.split(" ")[-1]) for i, n, t, c in rows if c == "canonical" and t and n}
    true = {(a, b) for a in word for b in word if a < b and word[a] == word[b]}
    want = []
    for n in (10, 25, 50):
        keys = {r.id: {(k, *r.signature[k * (50 // n) : (k + 1) * (50 // n)]) for k in range(n)} for r in sig}
        near = {(x.id, y.id) for x in sig for y in sig if x.id < y.id and x.type and x.type == y.type and keys[x.id] & keys[y.id] and len({*x.grams} & {*y.grams}) / len({*x.grams} | {*y.grams}) >= 0.3}
        want.append((n, len(near & true), len(near - true), len(true - near)))
    grid = upkeep.lsh_grid(spark, d)
    assert sorted(map(tuple, grid.collect())) == want and want[0] != want[1]
    assert "posexplode" not in grid._jdf.queryExecution().optimizedPlan().toString()
