"""SQL with the same results as the core's registered queries, for DuckDB."""

from __future__ import annotations

from lectern.functions.text import MARKED, PLAIN, STOPWORDS

ARTICLES = "a AS (SELECT * FROM articles WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)"
ENTITIES = "e AS (SELECT id, max(name) AS name, max(entity_type) AS entity_type, max(classified_as) AS classified_as, max(is_group) AS is_group, max(global_relevance) AS global_relevance, max(pagerank) AS pagerank, max(article_count) AS article_count FROM named_entities WHERE id IS NOT NULL GROUP BY id)"
LINKS = "l AS (SELECT article_id, entity_id, min(ordinal) AS ordinal, max(mentions) AS mentions, max(relevance) AS relevance FROM article_entities WHERE article_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY article_id, entity_id)"
CALLS = "c AS (SELECT event_id AS id, event_type AS task_name, ts AS started_at, value AS duration_seconds, user_id AS model, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS success FROM events)"
CACHE = f"{ARTICLES}, k AS (SELECT sha256(url) AS url_hash, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, CASE WHEN id % 7 = 0 THEN 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' ELSE coalesce(content, '') END AS content, CASE WHEN id % 7 = 0 THEN 301 ELSE 200 END AS status_code, created_at FROM a WHERE url IS NOT NULL)"
RANKED = f"{ENTITIES}, {LINKS}, r0 AS (SELECT l.article_id, e.name, coalesce(l.relevance, 0) AS relevance FROM l JOIN e ON e.id = l.entity_id WHERE e.entity_type IN ('PERSON', 'ORG', 'GPE', 'EVENT', 'PRODUCT', 'NORP')), r AS (SELECT *, count(*) OVER (PARTITION BY article_id) AS size FROM r0 QUALIFY count(*) OVER (PARTITION BY article_id) >= 2)"
EDGES = f"{RANKED}, g AS (SELECT x.name AS src, y.name AS dst, sum(y.relevance / y.size) AS weight FROM r x JOIN r y ON x.article_id = y.article_id AND x.name <> y.name WHERE NOT (x.relevance < 0.3 AND y.relevance < 0.3) GROUP BY 1, 2)"
MOVES = f"{EDGES}, t AS (SELECT src, sum(weight) AS total FROM g GROUP BY src HAVING sum(weight) > 0), m AS (SELECT g.src, g.dst, g.weight / t.total AS p FROM g JOIN t USING (src))"


def _category(x: str, part: int) -> str:
    """The SQL of the category (1) or subcategory (2) of a text."""
    branches = "".join(f" WHEN contains({x}, '{s}') THEN " + (f"trim(substring({x}, 1, instr({x}, '{s}') - 1))" if part == 1 else f"trim(substring({x}, instr({x}, '{s}') + {len(s)}))") for s in (" > ", " - ", " / ", ">", "-", "/"))
    return f"CASE{branches} ELSE {f'trim({x})' if part == 1 else 'NULL'} END"


def _pagerank(rounds: int) -> str:
    parts = [f"WITH {MOVES}, n AS (SELECT DISTINCT name FROM r), z AS (SELECT count(*) AS n FROM n), d AS (SELECT name FROM n WHERE name NOT IN (SELECT src FROM m)), p0 AS (SELECT name, 1.0::DOUBLE / (SELECT n FROM z) AS pr FROM n)"]
    for k in range(rounds):
        lost = f"coalesce((SELECT sum(pr) FROM p{k} WHERE name IN (SELECT name FROM d)), 0) * 0.85 / (SELECT n FROM z)"
        parts.append(f"q{k} AS (SELECT n.name, 0.15::DOUBLE / (SELECT n FROM z) + {lost} + 0.85 * coalesce(i.s, 0) AS pr FROM n LEFT JOIN (SELECT m.dst, sum(m.p * p.pr) AS s FROM m JOIN p{k} p ON p.name = m.src GROUP BY m.dst) i ON i.dst = n.name)")
        parts.append(f"p{k + 1} AS (SELECT name, pr / (SELECT sum(pr) FROM q{k}) AS pr FROM q{k})")
    return ", ".join(parts) + f" SELECT name, round(pr, 6) AS pr, round((pr - (SELECT min(pr) FROM p{rounds})) / (SELECT max(pr) - min(pr) FROM p{rounds}), 4) AS scaled FROM p{rounds}"


_WORDS = r"list_transform(regexp_extract_all(name, '[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*'), lambda w: CASE WHEN contains(w, '.') THEN w || '.' ELSE w END)"
_NAME = r"trim(regexp_replace(regexp_replace(translate(lower(name), 'áéíóúñüàèìòù', 'aeiounuaeiou'), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
#: No name of the tables is plural initials, so the special case of the shingles needs no SQL.
GRAMS = f"s0 AS (SELECT id, entity_type AS type, classified_as, {_NAME} AS x FROM e), s AS (SELECT id, type, classified_as, list_filter(list_distinct(list_transform(range(1, length(x)), lambda i: substring(x, i, 2))), lambda g: trim(g) <> '') AS grams FROM s0 WHERE length(x) >= 2)"
SIGNED = f"{ENTITIES}, {GRAMS}, y AS (SELECT id, type, grams, list_transform(range(0, 50), lambda i: list_min(list_transform(grams, lambda g: md5(i::VARCHAR || ':' || g)))) AS sig FROM s WHERE classified_as = 'canonical' AND len(grams) > 0)"
CANDIDATES = f"{SIGNED}, b AS (SELECT id, type, k, sig[2 * k + 1] || '|' || sig[2 * k + 2] AS key FROM y, range(0, 25) t(k)), p AS (SELECT DISTINCT x.id AS a, z.id AS b FROM b x JOIN b z ON x.type = z.type AND x.k = z.k AND x.key = z.key AND x.id < z.id), q AS (SELECT p.a, p.b, len(list_intersect(u.grams, v.grams))::DOUBLE / (len(u.grams) + len(v.grams) - len(list_intersect(u.grams, v.grams))) AS exact, len(list_filter(range(1, 51), lambda i: u.sig[i] = v.sig[i])) / 50.0::DOUBLE AS estimate FROM p JOIN y u ON u.id = p.a JOIN y v ON v.id = p.b)"
MEMBERS = "m0 AS (SELECT o_orderpriority AS group_id, o_custkey AS member_id, min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_orderkey) AS id FROM orders GROUP BY o_orderpriority, o_custkey, year(o_orderdate)), m AS (SELECT id, group_id, member_id, CASE WHEN id % 11 <> 0 THEN a END AS since, CASE WHEN id % 7 <> 0 THEN b END AS until FROM m0)"
REFS = f"{ENTITIES}, h AS (SELECT entity_type, min(id) AS lo, max(id) AS hi FROM e WHERE id % 5 <> 0 AND id % 7 <> 0 GROUP BY entity_type), f AS (SELECT e.id AS entity_id, h.lo AS canonical_id FROM e JOIN h USING (entity_type) WHERE e.id % 5 = 0 UNION SELECT e.id, h.lo FROM e JOIN h USING (entity_type) WHERE e.id % 5 <> 0 AND e.id % 7 = 0 UNION SELECT e.id, h.hi FROM e JOIN h USING (entity_type) WHERE e.id % 5 <> 0 AND e.id % 7 = 0), w AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'alias' WHEN id % 7 = 0 THEN 'ambiguous' WHEN id % 13 = 0 THEN 'not_an_entity' ELSE 'canonical' END AS classified_as FROM e)"
FLASH = f"""{ARTICLES}, {ENTITIES}, {LINKS}, usual AS (SELECT coalesce(avg(global_relevance), 0.6) AS g FROM e),
 t0 AS (SELECT article_id, coalesce(relevance, 0) AS local, coalesce(global_relevance, (SELECT g FROM usual)) AS overall, row_number() OVER (PARTITION BY article_id ORDER BY coalesce(relevance, 0) DESC, entity_id) AS rn FROM l LEFT JOIN e ON e.id = l.entity_id QUALIFY rn <= 5),
 t1 AS (SELECT *, count(*) OVER (PARTITION BY article_id) AS n FROM t0),
 t2 AS (SELECT article_id, least(avg(local * overall) * CASE WHEN max(CASE WHEN rn <= least(5, greatest(1, ceil(n * 0.33))) THEN overall END) > 0.8 THEN 1.3 ELSE 1.0 END, 1.0) AS importance FROM t1 GROUP BY article_id),
 f0 AS (SELECT a.id, a.source_id, coalesce(importance, 0) AS entity,
  (epoch(TIMESTAMP '2026-01-01 00:00:00')::BIGINT - floor(epoch(a.clusterized_at))::BIGINT) / 3600.0::DOUBLE / 1000 AS hours, a.id % 3 AS kind, (a.id % 10) / 10.0::DOUBLE AS q, a.id % 15 AS size, coalesce(s.authority_score, 0.5) AS authority
  FROM a LEFT JOIN sources s ON s.id = a.source_id LEFT JOIN t2 ON t2.article_id = a.id),
 f1 AS (SELECT *, CASE WHEN hours IS NULL THEN 0.3 WHEN kind = 0 AND hours < 1 THEN 1.0 ELSE exp(-hours / CASE kind WHEN 0 THEN 6.0 WHEN 1 THEN 12.0 ELSE 48.0 END) END AS freshness, least(q * CASE WHEN size < 3 THEN 0.8 WHEN size > 10 THEN 1.2 ELSE 1.0 END, 1.0) AS quality FROM f0),
 f2 AS (SELECT *, 0.45 * entity + 0.25 * freshness + 0.15 * quality + 0.10 * 0.5 + 0.05 * authority AS score FROM f1),
 f AS (SELECT *, CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.55 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS tier FROM f2)"""

ORACLES: dict[str, str] = {
    "llm_analyze_by_task": f"WITH {CALLS} SELECT task_name, count(*) AS calls, round(sum(duration_seconds), 6) AS total_seconds, round(avg(duration_seconds), 6) AS avg_seconds, sum(success)::BIGINT AS successes, round(100.0::DOUBLE * sum(success) / count(*), 6) AS success_rate FROM c WHERE started_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY GROUP BY task_name",
    "llm_calls_by_hour": f"WITH {CALLS} SELECT strftime(started_at, '%Y-%m-%d %H:00') AS period, count(*) AS calls, sum(success)::BIGINT AS successes FROM c GROUP BY 1",
    "llm_calls_by_day": f"WITH {CALLS} SELECT strftime(started_at, '%Y-%m-%d') AS period, count(*) AS calls, round(avg(duration_seconds), 6) AS avg_seconds FROM c GROUP BY 1",
    "llm_usage_overview": f"WITH {CALLS} SELECT count(*) AS calls, count(*) FILTER (started_at >= TIMESTAMP '2024-01-30 00:00:00') AS calls_1d, count(*) FILTER (started_at >= TIMESTAMP '2024-01-24 00:00:00') AS calls_7d, count(*) FILTER (success = 0) AS failed, round(coalesce(sum(duration_seconds), 0), 6) AS total_seconds, round(avg(duration_seconds), 6) AS avg_seconds FROM c",
    "sources_status": f"WITH {ARTICLES} SELECT s.domain, count(a.id) AS articles, count(a.clusterized_at) AS enriched, count(a.id) - count(a.clusterized_at) AS pending FROM sources s LEFT JOIN a ON a.source_id = s.id GROUP BY s.id, s.domain",
    "articles_without_entities": f"WITH {ARTICLES} SELECT id, url FROM a WHERE id NOT IN (SELECT article_id FROM article_entities WHERE article_id IS NOT NULL)",
    "articles_to_enrich": f"WITH {ARTICLES} SELECT id, url FROM a WHERE clusterized_at IS NULL ORDER BY created_at DESC NULLS LAST, id LIMIT 20",
    "article_listing": f"WITH {ARTICLES} SELECT a.id, a.title, a.author, a.category, s.name FROM a JOIN sources s ON s.id = a.source_id WHERE s.domain = 'harborledger.example' ORDER BY a.created_at DESC NULLS LAST, a.id DESC LIMIT 25",
    "entity_listing": f"WITH {ENTITIES} SELECT id, name, entity_type, global_relevance FROM e WHERE article_count >= 5 AND entity_type IN ('PERSON', 'ORG') ORDER BY global_relevance DESC NULLS LAST, id LIMIT 30",
    "entity_search": f"WITH {ENTITIES} SELECT id, name, article_count FROM e WHERE contains(lower(name), 'banco')",
    "entity_rank_position": f"WITH {ENTITIES}, x AS (SELECT * FROM e WHERE global_relevance > 0 AND NOT isnan(global_relevance)) SELECT id, entity_type, (SELECT count(*) FROM x y WHERE y.global_relevance > x.global_relevance) + 1 AS place, (SELECT count(*) FROM x) AS total FROM x",
    "entity_type_counts": f"WITH {ENTITIES} SELECT entity_type, count(*) AS entities, sum(is_group)::BIGINT AS groups FROM e GROUP BY entity_type",
    "score_distribution": f"WITH {ENTITIES} SELECT entity_type, round(min(pagerank), 6) AS low, round(max(pagerank), 6) AS high, round(avg(pagerank), 6) AS mean, round(median(pagerank), 6) AS middle, round(stddev_pop(pagerank), 6) AS spread FROM e GROUP BY entity_type",
    "average_local_relevance": f"WITH {LINKS} SELECT entity_id, round(avg(coalesce(relevance, 0)) + 1e-9, 6) AS avg_local_relevance, count(*) AS articles FROM l GROUP BY entity_id",
    "top5_entities_per_article": f"WITH {LINKS}, t AS (SELECT article_id, entity_id, row_number() OVER (PARTITION BY article_id ORDER BY relevance DESC NULLS LAST, entity_id) AS rn FROM l QUALIFY rn <= 5) SELECT article_id, entity_id, rn, rn <= least(5, greatest(1, ceil(count(*) OVER (PARTITION BY article_id) * 0.33))) AS boost FROM t",
    "shared_articles": f"WITH {ENTITIES}, {LINKS}, x AS (SELECT l.article_id, l.entity_id, e.entity_type FROM l JOIN e ON e.id = l.entity_id), z AS (SELECT entity_type, entity_id FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY count(*) DESC, entity_id) <= 2) SELECT u.entity_id AS lead_id, v.entity_id AS other_id, count(*) AS shared, min(u.article_id) AS first_article FROM x u JOIN z USING (entity_type, entity_id) JOIN x v ON v.article_id = u.article_id AND v.entity_type = u.entity_type AND v.entity_id <> u.entity_id GROUP BY 1, 2",
    "cooccurrence_edges": f"WITH {EDGES} SELECT src, dst, round(weight + 1e-9, 6) AS weight FROM g",
    "transition_matrix": f"WITH {MOVES} SELECT src, dst, round(p, 6) AS p FROM m",
    "pagerank_k5": _pagerank(5),
    "entity_metrics": f"WITH {RANKED}, o AS (SELECT name, count(*) AS article_count, sum(relevance) AS total, avg(relevance) AS mean FROM r0 GROUP BY name), v AS (SELECT x.name, count(DISTINCT z.name) AS diversity FROM r0 x JOIN r0 z ON x.article_id = z.article_id AND x.name <> z.name GROUP BY x.name) SELECT o.name, article_count, round(total + 1e-9, 6) AS total_relevance, round(mean + 1e-9, 6) AS avg_relevance, coalesce(diversity, 0) AS diversity FROM o LEFT JOIN v ON v.name = o.name",
    "name_tokens": f"WITH {ENTITIES}, w AS (SELECT id, {_WORDS} AS ws FROM e), x AS (SELECT id, unnest(range(0, len(ws)))::INTEGER AS position, unnest(ws) AS token FROM w), n AS (SELECT *, replace(translate(lower(token), '{MARKED}', '{PLAIN}'), '.', '') AS normalized FROM x) SELECT id, position, token, normalized, (normalized IN ({', '.join(repr(w) for w in STOPWORDS)}))::INTEGER AS is_stopword FROM n",
    "name_shingles": f"WITH {ENTITIES}, {GRAMS} SELECT id, unnest(grams) AS gram FROM s",
    "minhash_signature": f"WITH {SIGNED} SELECT id, md5(array_to_string(sig, ',')) AS digest FROM y",
    "lsh_candidates": f"WITH {CANDIDATES} SELECT a, b, round(exact, 6) AS exact, round(estimate, 6) AS estimate FROM q",
    "lsh_best": f"WITH {CANDIDATES}, o AS (SELECT a AS id, b AS other, estimate FROM q UNION ALL SELECT b, a, estimate FROM q) SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY estimate DESC, other) AS place FROM o QUALIFY place <= 10",
    "lsh_eval": f"WITH {CANDIDATES}, z AS (SELECT u.id AS a, v.id AS b FROM e u JOIN e v ON u.entity_type = v.entity_type AND string_split(u.name, ' ')[-1] = string_split(v.name, ' ')[-1] AND u.id < v.id WHERE u.classified_as = 'canonical' AND v.classified_as = 'canonical'), x AS (SELECT coalesce(q.exact, -1) AS exact, (z.a IS NOT NULL)::INTEGER AS t FROM q FULL JOIN z ON z.a = q.a AND z.b = q.b), h AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (exact >= threshold AND t = 1) AS tp, count(*) FILTER (exact >= threshold AND t = 0) AS fp, count(*) FILTER (exact < threshold AND t = 1) AS fn FROM x, h GROUP BY threshold), d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM c) SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM d",
    "doc_sentences": rf"WITH {ARTICLES}, x AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?m)^#+\s+.*$', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^[ \t]*[-*+][ \t]+', '', 'g') AS t FROM a WHERE content IS NOT NULL), u AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '' AND len(string_split(v, ' ')) >= 5) AS s FROM x) SELECT id, unnest(range(0, len(s)))::INTEGER AS sentence_index, unnest(s) AS sentence_text FROM u",
    "category_rollup": f"WITH {ARTICLES}, x AS (SELECT {_category('category', 1)} AS category, coalesce({_category('category', 2)}, '-') AS subcategory FROM a WHERE category IS NOT NULL) SELECT coalesce(category, '*') AS category, coalesce(subcategory, '*') AS subcategory, count(*) AS articles, count(*) * 6 AS pairs FROM x GROUP BY ROLLUP (x.category, x.subcategory)",
    "training_pairs": f"""WITH {ARTICLES}, x AS (SELECT id, {_category('category', 1)} AS cat, coalesce({_category('category', 2)}, '-') AS sub FROM a WHERE coalesce(title, '') <> '' AND category IS NOT NULL),
 s AS (SELECT *, row_number() OVER (PARTITION BY cat, sub ORDER BY sha256(id::VARCHAR), id) - 1 AS n, row_number() OVER (PARTITION BY cat ORDER BY sha256(id::VARCHAR), id) - 1 AS m, count(*) OVER (PARTITION BY cat, sub) AS size FROM x),
 g AS (SELECT cat, sub, count(*) AS size, coalesce(lead(sub) OVER (PARTITION BY cat ORDER BY sub), min(sub) OVER (PARTITION BY cat)) AS other FROM x GROUP BY cat, sub), c AS (SELECT cat, count(*) AS size, coalesce(lead(cat) OVER (ORDER BY cat), min(cat) OVER ()) AS other FROM x GROUP BY cat)
 SELECT u.id AS a, v.id AS b, 0.95::DOUBLE AS label FROM s u JOIN s v ON v.cat = u.cat AND v.sub = u.sub AND v.n = (u.n + 1) % u.size WHERE u.size >= 2
 UNION ALL SELECT u.id, v.id, 0.7 FROM s u JOIN g ON g.cat = u.cat AND g.sub = u.sub AND g.other <> g.sub JOIN g o ON o.cat = g.cat AND o.sub = g.other JOIN s v ON v.cat = u.cat AND v.sub = g.other AND v.n = u.n % o.size WHERE u.size >= 2
 UNION ALL SELECT u.id, v.id, 0.0 FROM s u JOIN c ON c.cat = u.cat AND c.other <> c.cat JOIN c o ON o.cat = c.other JOIN s v ON v.cat = c.other AND v.m = u.n % o.size WHERE u.size >= 2
 UNION ALL SELECT id, id, 1.0 FROM s WHERE size >= 2""",
    "local_relevance": rf"WITH {ARTICLES}, {ENTITIES}, {LINKS}, x AS (SELECT l.article_id, l.entity_id, lower(e.name) AS n, l.mentions AS m, e.classified_as AS c, sum(l.mentions) OVER (PARTITION BY l.article_id) AS total FROM l JOIN e ON e.id = l.entity_id WHERE l.mentions IS NOT NULL), z AS (SELECT x.*, lower(a.title) AS title, lower(a.subtitle) AS subtitle, lower(regexp_replace(coalesce(a.content, ''), '\s+', ' ', 'g')) AS t FROM x JOIN a ON a.id = x.article_id), w AS (SELECT *, instr(t, n) AS i FROM z), b AS (SELECT article_id, entity_id, c, CASE WHEN total > 0 THEN m::DOUBLE / total * (1.0::DOUBLE + (CASE WHEN contains(title, n) THEN 0.5 ELSE 0 END)::DOUBLE + (CASE WHEN contains(subtitle, n) THEN 0.25 ELSE 0 END)::DOUBLE + (CASE WHEN i > 0 AND (i - 1)::DOUBLE / length(t) < 0.2 THEN 0.3 WHEN i > 0 AND (i - 1)::DOUBLE / length(t) < 0.4 THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN m > 3 THEN 0.1 * least(m - 3, 5) ELSE 0 END)::DOUBLE) ELSE 0 END AS base FROM w), k AS (SELECT *, max(CASE WHEN c = 'canonical' THEN base END) OVER (PARTITION BY article_id) AS top FROM b) SELECT article_id, entity_id, round(base, 6) AS base, round(CASE WHEN c <> 'canonical' THEN 0 ELSE base * CASE WHEN coalesce(top, 0) > 0 THEN 1.0 / top ELSE 1.0 END END, 6) AS local FROM k",
    "relevance_transfers": rf"WITH {ARTICLES}, {REFS}, {LINKS}, x AS (SELECT l.article_id, l.entity_id, lower(e.name) AS n, l.mentions AS m, e.classified_as AS c, sum(l.mentions) OVER (PARTITION BY l.article_id) AS total FROM l JOIN e ON e.id = l.entity_id WHERE l.mentions IS NOT NULL), z AS (SELECT x.*, lower(a.title) AS title, lower(a.subtitle) AS subtitle, lower(regexp_replace(coalesce(a.content, ''), '\s+', ' ', 'g')) AS t FROM x JOIN a ON a.id = x.article_id), w1 AS (SELECT *, instr(t, n) AS i FROM z), b AS (SELECT article_id, entity_id, c, CASE WHEN total > 0 THEN m::DOUBLE / total * (1.0::DOUBLE + (CASE WHEN contains(title, n) THEN 0.5 ELSE 0 END)::DOUBLE + (CASE WHEN contains(subtitle, n) THEN 0.25 ELSE 0 END)::DOUBLE + (CASE WHEN i > 0 AND (i - 1)::DOUBLE / length(t) < 0.2 THEN 0.3 WHEN i > 0 AND (i - 1)::DOUBLE / length(t) < 0.4 THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN m > 3 THEN 0.1 * least(m - 3, 5) ELSE 0 END)::DOUBLE) ELSE 0 END AS base FROM w1), b2 AS (SELECT b.article_id, b.entity_id, b.base, w2.classified_as AS cc FROM b JOIN (SELECT id, CASE WHEN id % 5 = 0 THEN 'alias' WHEN id % 7 = 0 THEN 'ambiguous' WHEN id % 13 = 0 THEN 'not_an_entity' ELSE 'canonical' END AS classified_as FROM e) w2 ON w2.id = b.entity_id), k AS (SELECT *, max(CASE WHEN cc = 'canonical' THEN base END) OVER (PARTITION BY article_id) AS top FROM b2), r AS (SELECT article_id, entity_id, cc, base * CASE WHEN coalesce(top, 0) > 0 THEN 1.0 / top ELSE 1.0 END AS raw FROM k), nn AS (SELECT entity_id, count(*) AS n FROM f GROUP BY entity_id), gv AS (SELECT r.article_id, f.canonical_id AS entity_id, r.raw / nn.n AS r FROM r JOIN f ON f.entity_id = r.entity_id JOIN nn ON nn.entity_id = r.entity_id WHERE r.cc <> 'canonical' AND EXISTS (SELECT 1 FROM r r2 WHERE r2.article_id = r.article_id AND r2.entity_id = f.canonical_id)) SELECT article_id, entity_id, round(sum(r), 5) AS relevance FROM (SELECT article_id, entity_id, CASE WHEN cc = 'canonical' THEN raw ELSE 0 END AS r FROM r UNION ALL SELECT * FROM gv) GROUP BY 1, 2",
    "flash_scores": f"WITH {FLASH} SELECT id, source_id, round(entity, 6) AS entity, round(freshness, 6) AS freshness, round(score, 6) AS score, tier FROM f",
    "tier_counts": f"WITH {FLASH} SELECT t.tier, count(f.id) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS tier) t LEFT JOIN f ON f.tier = t.tier GROUP BY t.tier",
    "newsletter_selection": f"WITH {FLASH}, v AS (SELECT id, source_id AS source, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY round(score, 6) DESC, id) <= 2), g AS (SELECT *, CASE WHEN score >= 0.5 THEN 0 WHEN score >= 0.35 THEN 1 ELSE 2 END AS grp, row_number() OVER (PARTITION BY CASE WHEN score >= 0.5 THEN 0 WHEN score >= 0.35 THEN 1 ELSE 2 END ORDER BY score DESC, id) AS rn FROM v), n AS (SELECT count(*) FILTER (grp = 0) AS nc, count(*) FILTER (grp = 1) AS nn FROM g), o AS (SELECT g.* FROM g, n WHERE grp = 0 OR grp = 1 AND rn <= greatest(0, 8 - nc) OR grp = 2 AND rn <= greatest(0, 3 - nc - greatest(0, least(nn, 8 - nc)))) SELECT id, source, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM o",
    "members_active_at": f"WITH {MEMBERS} SELECT group_id, count(*) AS periods, count(DISTINCT member_id) AS members FROM m WHERE (since IS NULL OR since <= TIMESTAMP '1998-06-01') AND (until IS NULL OR until >= TIMESTAMP '1998-06-01') GROUP BY group_id",
    "membership_overlaps": f"WITH {MEMBERS}, x AS (SELECT id, group_id, member_id, coalesce(since, TIMESTAMP '0001-01-01') AS s, coalesce(until, TIMESTAMP '9999-12-31') AS u FROM m) SELECT p.id AS id_a, q.id AS id_b FROM x p JOIN x q ON p.group_id = q.group_id AND p.member_id = q.member_id AND p.id < q.id AND p.s < q.u AND p.u > q.s",
    "classification_violations": f"WITH {REFS}, v AS (SELECT * FROM f WHERE entity_id % 10 <> 0), x AS (SELECT w.id, w.classified_as, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM w LEFT JOIN (SELECT entity_id, count(*) AS n FROM v GROUP BY 1) o ON o.entity_id = w.id LEFT JOIN (SELECT canonical_id, count(*) AS n FROM v GROUP BY 1) i ON i.canonical_id = w.id) SELECT * FROM x WHERE CASE classified_as WHEN 'canonical' THEN outgoing > 0 WHEN 'alias' THEN outgoing <> 1 OR incoming > 0 WHEN 'ambiguous' THEN outgoing < 2 OR incoming > 0 ELSE outgoing > 0 OR incoming > 0 END",
    "alias_cascade": f"WITH {REFS}, j AS (SELECT lo, hi FROM h WHERE lo <> hi), r2 AS (SELECT f.entity_id, coalesce(j.hi, f.canonical_id) AS canonical_id FROM f LEFT JOIN j ON j.lo = f.canonical_id UNION SELECT lo, hi FROM j), n AS (SELECT entity_id, count(*) AS k FROM r2 WHERE entity_id <> canonical_id GROUP BY 1) SELECT w.id, CASE WHEN n.k = 1 THEN 'alias' WHEN n.k > 1 THEN 'ambiguous' WHEN w.classified_as = 'not_an_entity' THEN 'not_an_entity' ELSE 'canonical' END AS classified_as FROM w LEFT JOIN n ON n.entity_id = w.id",
    "redirect_follow": f"WITH {CACHE} SELECT x.url_hash, coalesce(y.status_code, x.status_code) AS status_code, coalesce(y.url_hash, x.url_hash) AS final_hash, length(coalesce(y.content, x.content)) AS content_length FROM k x LEFT JOIN k y ON x.status_code BETWEEN 300 AND 399 AND y.url_hash = sha256(x.content)",
    "cache_domain_stats": f"WITH {CACHE}, x AS (SELECT domain, count(*) AS entries, sum(length(content))::BIGINT AS size FROM k GROUP BY domain) SELECT domain, entries, size, CASE WHEN size < 1024 THEN printf('%d B', size) WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) ELSE printf('%.1f MB', size / 1048576.0::DOUBLE) END AS size_text FROM x",
    "cache_overview": f"WITH {CACHE} SELECT count(*) AS entries, coalesce(sum(length(content)), 0)::BIGINT AS size, count(DISTINCT domain) AS domains, min(created_at) AS oldest, max(created_at) AS newest FROM k",
    "corpus_stats": f"WITH {ARTICLES} SELECT {_category('category', 1)} AS category, count(*) AS articles FROM a WHERE category IS NOT NULL GROUP BY 1 ORDER BY articles DESC, 1 LIMIT 10",
    "batch_rollup": f"WITH {CALLS}, x AS (SELECT model AS batch, strftime(started_at, '%Y-%m-%d') AS day, count(*) AS processed, sum(success)::BIGINT AS successful FROM c GROUP BY 1, 2) SELECT batch, day, processed, successful, processed - successful AS failed, CASE WHEN processed > successful THEN 'failed' ELSE 'completed' END AS status FROM x",
    "uncompared_pairs": f"WITH {CANDIDATES} SELECT a, b FROM p WHERE (a + b) % 3 <> 0",
    "upsert_articles": f"""WITH {ARTICLES}, o AS (SELECT * FROM a WHERE hash IS NOT NULL AND url IS NOT NULL),
 n AS (SELECT CASE WHEN id % 9 = 0 THEN sha256('v2' || hash) ELSE hash END AS hash, CASE WHEN id % 27 = 0 THEN url || '?v=2' ELSE url END AS url, CASE WHEN id % 2 = 0 THEN sha256(hash) ELSE cleaned_html_hash END AS page FROM o WHERE id % 3 = 0),
 x AS (SELECT o.id, o.clusterized_at, o.cleaned_html_hash AS was, coalesce(h.hash, u.hash) AS hit, CASE WHEN h.hash IS NOT NULL THEN h.page ELSE u.page END AS page FROM o LEFT JOIN n h ON h.hash = o.hash LEFT JOIN n u ON h.hash IS NULL AND u.url = o.url AND u.hash NOT IN (SELECT hash FROM o)),
 y AS (SELECT id, CASE WHEN hit IS NULL THEN 'kept' WHEN page IS NULL OR was IS NULL OR page <> was THEN 'reset' ELSE 'updated' END AS action, clusterized_at FROM x UNION ALL SELECT NULL, 'created', NULL FROM n WHERE hash NOT IN (SELECT hash FROM o) AND url NOT IN (SELECT url FROM o))
 SELECT action, count(*) AS articles, count(CASE WHEN action IN ('kept', 'updated') THEN clusterized_at END) AS still_enriched, count(id) AS known FROM y GROUP BY action""",
    "cluster_scores": "WITH v AS (SELECT vec_id, label, unnest(range(1, 65)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), al AS (SELECT k, avg(x) AS m FROM v GROUP BY k), ow AS (SELECT label, k, avg(x) AS m FROM v GROUP BY label, k), n AS (SELECT ow.label, sum(ow.m * al.m) / (sqrt(sum(ow.m * ow.m)) * sqrt(sum(al.m * al.m))) AS near FROM ow JOIN al USING (k) GROUP BY ow.label), z AS (SELECT label, count(*) AS size, avg(vec_id) AS place FROM embeddings GROUP BY label), t AS (SELECT count(*) AS total FROM embeddings), s AS (SELECT z.label, z.size, 0.35 * z.size / t.total + 0.30 * (near + 1) / 2 + 0.20 * (near + 1) / 2 + 0.10 * (1 - place / greatest(1, t.total - 1)) + 0.05 AS score FROM z JOIN n USING (label), t) SELECT label, size, round(score, 6) AS score, CASE WHEN label = -1 THEN CASE WHEN score < 0.35 THEN 'filler' ELSE 'secondary' END WHEN score >= 0.60 THEN 'core' WHEN score >= 0.30 THEN 'secondary' ELSE 'filler' END AS category FROM s",
    "topic_diversity": "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings), p AS (SELECT a.id, max(list_cosine_similarity(a.x, b.x)) AS near FROM v a JOIN v b ON a.id <> b.id AND b.id <= 24 * 60 GROUP BY a.id) SELECT v.id, round(CASE WHEN near IS NULL OR near < 0.3 THEN 1.0 ELSE 1.0 - near END, 6) AS diversity FROM v LEFT JOIN p ON p.id = v.id",
}
