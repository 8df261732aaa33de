"""SQL with the same results as the queries of ``upkeep``, for DuckDB, written from what each operation is to do."""

from __future__ import annotations

from lectern.functions.text import BENCH_STOPWORDS, PLAIN_RULES
from lectern.plans.oracles import ARTICLES, CACHE, CALLS, CANDIDATES, ENTITIES, FLASH, LINKS, MEMBERS, MOVES, ORACLES, RANKED, REFS, SIGNED, _category, _pagerank

_TRUTH = "v AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.entity_type = y.entity_type AND string_split(x.name, ' ')[-1] = string_split(y.name, ' ')[-1] AND x.id < y.id WHERE x.classified_as = 'canonical' AND y.classified_as = 'canonical')"
_STOPS = ", ".join(f"'{w}'" for w in BENCH_STOPWORDS)
_BENCH = rf"n AS (SELECT id, trim(regexp_replace(array_to_string(list_filter(string_split_regex(translate(lower(name), 'áéíóúñüàèìòùâêîôûãõç', 'aeiounuaeiouaeiouaoc'), '\s+'), lambda w: w <> '' AND w NOT IN ({_STOPS})), ' '), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g')) AS x FROM e)"
_CLUSTERS = ORACLES["cluster_scores"]
_PLAIN = "coalesce(content, '')"
for _pattern, _left in PLAIN_RULES:
    _PLAIN = "regexp_replace({}, '{}', {}, 'g')".format(_PLAIN, _pattern, "chr(10) || chr(10)" if "\n" in _left else f"'{_left}'")
_LOWER = ORACLES["doc_sentences"].replace("regexp_replace(content,", "regexp_replace(lower(content),")
_SCORE = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_HEADS = "hh AS (SELECT entity_type, list_sort(list(DISTINCT id)) AS ids FROM e WHERE id % 5 <> 0 AND id % 7 <> 0 GROUP BY entity_type)"

UPKEEP: dict[str, str] = {
    "entity_by_name": f"WITH {ENTITIES} SELECT id, name, entity_type FROM e WHERE lower(name) = 'república de veceronu'",
    "article_previews": f"WITH {ARTICLES} SELECT id, substring(title, 1, 50) AS title, substring(content, 1, 100) AS preview FROM a",
    "training_texts": f"WITH {ARTICLES} SELECT id, substring(replace(coalesce(title, ''), chr(10), ' '), 1, 400) AS title, substring(replace(coalesce(content, ''), chr(10), ' '), 1, 300) AS body FROM a",
    "call_durations": f"WITH {CALLS}, n AS (SELECT id, started_at, lead(started_at) OVER (PARTITION BY model ORDER BY started_at, id) AS done FROM c) SELECT id, (epoch_us(done) - epoch_us(started_at)) / 1e6 AS duration FROM n WHERE done IS NOT NULL",
    "entity_context": "WITH o AS (SELECT entity_id, article_id, max(mentions) AS mentions, max(context_sentences) AS context FROM article_entities WHERE article_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY article_id) AS n FROM o WHERE len(context) > 0 QUALIFY n <= 3), g AS (SELECT entity_id, array_to_string(flatten(list(context[1:2] ORDER BY n))[1:3], ' | ') AS context FROM f GROUP BY 1) SELECT o.entity_id, coalesce(sum(o.mentions), 0)::BIGINT AS mentions, count(*) AS articles, any_value(g.context) AS context FROM o LEFT JOIN g USING (entity_id) GROUP BY o.entity_id",
    "article_tags": f"WITH {ARTICLES}, l AS (SELECT DISTINCT id, unnest(string_split(lower(category), ' ')) AS tag FROM a WHERE category IS NOT NULL) SELECT tag, count(*) AS articles, min(id) AS first_article FROM l WHERE length(tag) >= 4 GROUP BY tag",
    "tags_created": f"WITH {ARTICLES}, c AS (SELECT id, {_category('category', 1)} AS name FROM a WHERE category IS NOT NULL), o AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT name FROM c WHERE id % 2 = 0)), n AS (SELECT name, (SELECT coalesce(max(id), 0) FROM o) + row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT name FROM c WHERE id % 2 = 1 AND name NOT IN (SELECT name FROM o))) SELECT id, name FROM o UNION ALL SELECT id, name FROM n",
    "sources_created": rf"WITH {ARTICLES}, k AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://(?:www\.)?([^/?#]*)', 1) AS domain FROM a WHERE url IS NOT NULL) SELECT s.id AS domain_id, p.kind FROM sources s, (VALUES ('enrich'), ('analyze'), ('flash')) p(kind) WHERE s.domain NOT IN (SELECT domain FROM k)",
    "text_mentions": "SELECT article_id, text, count(*) AS mentions, arg_min_null(type, id) AS type FROM extracted_entities WHERE article_id IS NOT NULL AND text IS NOT NULL GROUP BY article_id, text",
    "cluster_stats": f"WITH q AS ({_CLUSTERS}) SELECT category, count(*) AS clusters, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM q), 6) AS percent FROM q GROUP BY category",
    "run_averages": f"WITH {CALLS}, t AS (SELECT * FROM c ORDER BY started_at DESC, id DESC LIMIT 10) SELECT count(*) AS runs, round(avg(duration_seconds), 6) AS avg_seconds, sum(success)::BIGINT AS successes FROM t",
    "longest_names": f"WITH {ENTITIES} SELECT id, name, length(name)::INTEGER AS name_length, coalesce(article_count, 0) AS article_count FROM e ORDER BY 3 DESC, 4 DESC, id LIMIT 20",
    "top_ranked": f"WITH {ENTITIES} SELECT name, round(pagerank, 6) AS pagerank FROM e WHERE pagerank IS NOT NULL AND NOT isnan(pagerank) ORDER BY e.pagerank DESC, name LIMIT 10",
    "newest_articles": f"WITH {ARTICLES} SELECT id, strftime(coalesce(clusterized_at, created_at), '%Y-%m-%d %H:%M:%S') AS at FROM a ORDER BY coalesce(clusterized_at, created_at) DESC NULLS LAST, id LIMIT 5",
    "work_selection": f"WITH {ARTICLES}, w AS (SELECT id, created_at, 'enrich' AS work FROM a WHERE clusterized_at IS NULL UNION ALL SELECT id, created_at, 'analyze' FROM a WHERE clusterized_at IS NOT NULL UNION ALL SELECT id, created_at, 'entities' FROM a WHERE id NOT IN (SELECT article_id FROM article_entities WHERE article_id IS NOT NULL)) SELECT id, work FROM w QUALIFY row_number() OVER (PARTITION BY work ORDER BY created_at DESC NULLS LAST, id) <= 20",
    "bench_grams": f"WITH {ENTITIES}, {_BENCH} SELECT DISTINCT id, substring('$$' || x || '$$', i::INTEGER, 3) AS gram FROM n, range(1, 400) t(i) WHERE i <= length(x) + 2",
    "bench_words": f"WITH {ENTITIES}, {_BENCH}, w AS (SELECT id, x, list_filter(string_split_regex(x, '\\s+'), lambda z: z <> '') AS w FROM n) SELECT DISTINCT id, unnest(CASE WHEN len(w) < 2 THEN [x] ELSE list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS gram FROM w",
    "band_collisions": f"WITH {CANDIDATES}, {_TRUTH} SELECT v.a, v.b, CASE WHEN p.a IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS collides FROM v JOIN y t ON t.id = v.a JOIN y u ON u.id = v.b LEFT JOIN p ON p.a = v.a AND p.b = v.b",
    "lsh_errors": f"WITH {CANDIDATES}, {_TRUTH}, f AS (SELECT a, b FROM q WHERE exact >= 0.3) SELECT a, b, 'missed' AS error FROM (SELECT a, b FROM v EXCEPT SELECT a, b FROM f) UNION ALL SELECT a, b, 'extra' FROM (SELECT a, b FROM f EXCEPT SELECT a, b FROM v)",
    "lsh_thresholds": f"WITH {CANDIDATES} SELECT h.t AS threshold, count(*) FILTER (exact >= h.t) AS exact, count(*) FILTER (estimate >= h.t) AS estimated FROM q, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) h(t) GROUP BY h.t",
    "best_comparison": f"WITH {CANDIDATES}, z AS (SELECT a, b, round(exact, 6) AS confidence FROM q UNION ALL SELECT b, a, round(exact, 6) FROM q) SELECT a AS id, b AS other, confidence FROM z QUALIFY row_number() OVER (PARTITION BY a ORDER BY confidence DESC, b) = 1",
    "comparison_outcomes": f"WITH {CANDIDATES}, z AS (SELECT q.a, q.b, round(exact, 6) AS confidence, length(x.name) AS la, length(w.name) AS lb FROM q JOIN e x ON x.id = q.a JOIN e w ON w.id = q.b) SELECT a, b, confidence, CASE WHEN confidence >= 0.7 THEN 'alias' ELSE 'suggestion' END AS outcome, CASE WHEN confidence >= 0.7 THEN CASE WHEN la < lb THEN a ELSE b END END AS alias_id FROM z",
    "time_weighted_edges": f"WITH {ARTICLES}, {RANKED}, d AS (SELECT id, date_diff('day', created_at::DATE, DATE '2026-01-01') AS days FROM a), t AS (SELECT r.*, CASE WHEN days > 0 THEN exp(-days / 30.0::DOUBLE) ELSE 1.0 END AS tw FROM r JOIN d ON d.id = r.article_id) SELECT x.name AS src, y.name AS dst, round(sum(y.relevance / y.size * y.tw), 4) AS weight FROM t x JOIN t y ON x.article_id = y.article_id AND x.name <> y.name WHERE NOT (x.relevance < 0.3 AND y.relevance < 0.3) GROUP BY 1, 2",
    "rank_run_statistics": f"WITH {MOVES}, s AS (SELECT (SELECT count(DISTINCT name) FROM r) AS nodes, (SELECT count(*) FROM m) AS nnz) SELECT nodes, nnz, round(100.0::DOUBLE * nnz / (nodes * nodes), 6) AS density, round(100.0 - 100.0::DOUBLE * nnz / (nodes * nodes), 6) AS sparsity, nnz * 12 + (nodes + 1) * 4 AS csr_bytes FROM s",
    "rank_write_back": f"WITH pr AS ({_pagerank(5)}), {ENTITIES} SELECT e.id, round(CASE WHEN entity_type IS NULL OR entity_type NOT IN ('PERSON', 'ORG', 'GPE', 'EVENT', 'PRODUCT', 'NORP') THEN 0.0 ELSE coalesce(pr.scaled, {_SCORE.format('global_relevance')}) END, 4) AS global_relevance, round(CASE WHEN entity_type IS NULL OR entity_type NOT IN ('PERSON', 'ORG', 'GPE', 'EVENT', 'PRODUCT', 'NORP') THEN 0.0 ELSE coalesce(pr.pr, {_SCORE.format('pagerank')}) END, 6) AS pagerank FROM e LEFT JOIN pr ON pr.name = e.name",
    "publication_report": f"WITH {ARTICLES}, x AS (SELECT CASE WHEN id % 2 = 0 THEN 'already' ELSE 'changed' END AS status FROM a WHERE id % 3 = 0 UNION ALL SELECT CASE WHEN id = 0 THEN NULL ELSE 'not_found' END FROM a WHERE id % 30 = 0) SELECT status, count(*) AS items FROM x WHERE status IS NOT NULL GROUP BY status",
    "publish_guard": f"WITH {FLASH} SELECT id FROM f WHERE id % 2 <> 0 AND (id % 5 = 0 OR score IS NULL)",
    "scoring_modes": f"WITH {FLASH} SELECT 'one' AS mode, count(*) FILTER (id = 7) AS items FROM f UNION ALL SELECT 'unscored', count(*) FILTER (id % 5 = 0 OR score IS NULL) FROM f UNION ALL SELECT 'all', count(*) FROM f",
    "rerank_queue": f"WITH {ENTITIES}, {LINKS} SELECT DISTINCT article_id FROM l JOIN e ON e.id = l.entity_id WHERE e.entity_type = 'ORG' AND article_id % 2 <> 0 AND article_id % 3 <> 0",
    "ambiguous_cascade": f"WITH {REFS}, {_HEADS}, j AS (SELECT ids[1] AS x, unnest([ids[2], ids[-1]]) AS y FROM hh WHERE len(ids) >= 3), r2 AS (SELECT f.entity_id, coalesce(j.y, f.canonical_id) AS canonical_id FROM f LEFT JOIN j ON j.x = f.canonical_id UNION SELECT x, y FROM j), n AS (SELECT entity_id, count(DISTINCT canonical_id) AS k FROM r2 WHERE entity_id <> canonical_id GROUP BY 1) SELECT w.id, CASE WHEN n.k = 1 THEN 'alias' WHEN n.k > 1 THEN 'ambiguous' WHEN w.classified_as = 'not_an_entity' THEN 'not_an_entity' ELSE 'canonical' END AS classified_as FROM w LEFT JOIN n ON n.entity_id = w.id",
    "not_entity_refs": f"WITH {REFS} SELECT DISTINCT entity_id, canonical_id FROM f WHERE entity_id % 3 <> 0 AND canonical_id % 3 <> 0",
    "canonical_requests": f"WITH {REFS} SELECT id, CASE WHEN id IN (SELECT entity_id FROM f) THEN 'refused' ELSE 'canonical' END AS status FROM e WHERE id % 2 = 0 UNION ALL SELECT -id, 'not_found' FROM e WHERE id % 50 = 0 AND id <> 0",
    "group_violations": f"WITH {MEMBERS}, t AS (SELECT *, coalesce(since, TIMESTAMP '0001-01-01') AS x, coalesce(until, TIMESTAMP '9999-12-31') AS y FROM m) SELECT id, CASE WHEN group_id = member_id::VARCHAR THEN 'self' WHEN until < since THEN 'order' ELSE 'future' END AS problem FROM t WHERE group_id = member_id::VARCHAR OR until < since OR since > TIMESTAMP '1998-06-01' UNION ALL SELECT id, 'overlap' FROM (SELECT id, x, max(y) OVER (PARTITION BY group_id, member_id ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM t) WHERE upto >= x",
    "corpus_upsert": f"WITH {ARTICLES}, h AS (SELECT hash, max((id % 2 = 0)::INTEGER) AS old, max((id % 3 = 0)::INTEGER) AS new FROM a WHERE hash IS NOT NULL GROUP BY hash) SELECT CASE WHEN old = 1 THEN '2025-01-01' ELSE '2025-02-01' END AS first_export, count(*) AS articles FROM h WHERE old = 1 OR new = 1 GROUP BY 1",
    "call_log_appended": f"WITH {CALLS} SELECT task_name, count(*) AS calls, sum(success)::BIGINT AS successes FROM (SELECT task_name, success FROM c UNION ALL SELECT 'added', 1 UNION ALL SELECT 'added', 0) GROUP BY task_name",
    "cache_prefix": f"WITH {CACHE} SELECT DISTINCT url_hash, url FROM k WHERE substring(url_hash, 1, 10) IN (SELECT substring(h, 1, 10) FROM (SELECT DISTINCT url_hash AS h FROM k ORDER BY 1 LIMIT 3))",
    "cache_upsert": f"WITH {CACHE} SELECT status_code, count(*) AS pages, sum(CASE WHEN status_code = 200 THEN 5 ELSE length(content) END)::BIGINT AS size, max(created_at) AS newest FROM k GROUP BY status_code",
    "cluster_boost": f"WITH {ENTITIES}, {LINKS}, d AS ({_LOWER}), t AS (SELECT id, string_agg(sentence_text, chr(10)) FILTER (sentence_index < 2) AS core, string_agg(sentence_text, chr(10)) FILTER (sentence_index BETWEEN 2 AND 4) AS secondary FROM d GROUP BY id) SELECT l.article_id, l.entity_id, CASE WHEN contains(t.core, lower(e.name)) THEN 1.3 WHEN contains(t.secondary, lower(e.name)) THEN 1.0 ELSE 0.7 END::DOUBLE AS boost FROM l JOIN e ON e.id = l.entity_id JOIN articles x ON x.id = l.article_id AND x.content IS NOT NULL LEFT JOIN t ON t.id = l.article_id GROUP BY ALL",
    "cached_reingest": rf"""WITH {ARTICLES}, k0 AS (SELECT DISTINCT ON (url) id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM a WHERE url IS NOT NULL), s AS (SELECT DISTINCT domain FROM sources ORDER BY domain LIMIT 12),
 o AS (SELECT url, hash FROM a WHERE id % 2 = 0 AND url IS NOT NULL), p AS (SELECT k0.*, (url IN (SELECT url FROM o) OR sha256(url) IN (SELECT hash FROM o WHERE hash IS NOT NULL)) AS known, (domain IN (SELECT domain FROM s) OR domain IN (SELECT 'www.' || domain FROM s)) AS taken FROM k0 WHERE id % 7 <> 0)
 SELECT 'created' AS status, count(*) FILTER (NOT known AND taken AND id % 10 <> 0) AS pages FROM p UNION ALL SELECT 'updated', 0 FROM (SELECT 1) UNION ALL SELECT 'error', count(*) FILTER (NOT known AND (NOT taken OR id % 10 = 0)) FROM p UNION ALL SELECT 'skipped', count(*) FILTER (known) FROM p""",
    "ratio_training_pairs": f"""WITH {ARTICLES}, x AS (SELECT id, {_category('category', 1)} AS cat, coalesce({_category('category', 2)}, '-') AS sub FROM a WHERE coalesce(title, '') <> '' AND category IS NOT NULL),
 s AS (SELECT *, row_number() OVER (PARTITION BY cat, sub ORDER BY sha256(id::VARCHAR), id) - 1 AS n, row_number() OVER (PARTITION BY cat ORDER BY sha256(id::VARCHAR), id) - 1 AS m, count(*) OVER (PARTITION BY cat, sub) AS size FROM x),
 g AS (SELECT cat, sub, count(*) AS size, coalesce(lead(sub) OVER (PARTITION BY cat ORDER BY sub), min(sub) OVER (PARTITION BY cat)) AS other FROM x GROUP BY cat, sub), c AS (SELECT cat, count(*) AS size, coalesce(lead(cat) OVER (ORDER BY cat), min(cat) OVER ()) AS other FROM x GROUP BY cat)
 SELECT u.id AS a, v.id AS b, 0.95::DOUBLE AS label FROM s u, (VALUES (1), (2)) j(j), s v WHERE v.cat = u.cat AND v.sub = u.sub AND v.n = (u.n + j.j) % u.size AND u.id <> v.id
 UNION ALL SELECT u.id, v.id, 0.7 FROM s u JOIN g ON g.cat = u.cat AND g.sub = u.sub AND g.other <> g.sub JOIN g o ON o.cat = g.cat AND o.sub = g.other JOIN s v ON v.cat = u.cat AND v.sub = g.other AND v.n = (u.n + 1) % o.size
 UNION ALL SELECT u.id, v.id, 0.0 FROM s u JOIN c ON c.cat = u.cat AND c.other <> c.cat JOIN c o ON o.cat = c.other, (VALUES (1), (2)) j(j), s v WHERE v.cat = c.other AND v.m = (u.n + j.j) % o.size
 UNION ALL SELECT id, id, 1.0 FROM s""",
    "lsh_grid": f"WITH {SIGNED}, {_TRUTH}, w(bands) AS (VALUES (10), (25), (50)), b AS (SELECT w.bands, id, type, k, array_to_string(sig[k * (50 // w.bands) + 1 : (k + 1) * (50 // w.bands)], '|') AS key FROM y, w, range(0, 50) t(k) WHERE k < w.bands), p AS (SELECT DISTINCT x.bands, x.id AS a, z.id AS b FROM b x JOIN b z ON x.bands = z.bands AND x.type = z.type AND x.k = z.k AND x.key = z.key AND x.id < z.id), q AS (SELECT p.bands, p.a, p.b, len(list_intersect(u.grams, o.grams))::DOUBLE / (len(u.grams) + len(o.grams) - len(list_intersect(u.grams, o.grams))) AS exact FROM p JOIN y u ON u.id = p.a JOIN y o ON o.id = p.b), f AS (SELECT * FROM q WHERE exact >= 0.3), x AS (SELECT w.bands, v.a, v.b FROM w, v), j AS (SELECT coalesce(x.bands, f.bands) AS bands, x.a IS NOT NULL AS t, f.a IS NOT NULL AS hit FROM x FULL JOIN f ON f.bands = x.bands AND f.a = x.a AND f.b = x.b) SELECT bands, count(*) FILTER (t AND hit) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (t AND NOT hit) AS fn FROM j GROUP BY bands",
    "corpus_overview": f"WITH {ARTICLES} SELECT 'all' AS part, 'articles' AS key, count(*)::VARCHAR AS value FROM a UNION ALL SELECT 'time', 'first', strftime(min(created_at), '%Y-%m-%d %H:%M:%S') FROM a UNION ALL SELECT 'time', 'last', strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM a UNION ALL SELECT 'source', s.domain, count(*)::VARCHAR FROM a LEFT JOIN sources s ON s.id = a.source_id GROUP BY s.domain",
    "plain_text_export": f"WITH {ARTICLES} SELECT hash, title, {_PLAIN} AS body, s.domain, s.name, {_category('category', 1)} AS category, {_category('category', 2)} AS subcategory, strftime(a.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM a JOIN sources s ON s.id = a.source_id",
    "cache_cleared": f"WITH {CACHE} SELECT count(*) AS before, count(*) FILTER (NOT contains(domain, 'harborledger')) AS after FROM k",
    "links_ignored": f"WITH {LINKS} SELECT entity_id, count(*) AS articles FROM l GROUP BY entity_id",
    "links_replaced": f"WITH {LINKS} SELECT article_id, entity_id FROM l WHERE article_id % 3 <> 0 UNION ALL SELECT article_id, min(entity_id) FROM l WHERE article_id % 3 = 0 GROUP BY article_id",
    "articles_deleted": f"WITH {ARTICLES}, {LINKS} SELECT entity_id, count(*) AS articles FROM l WHERE article_id NOT IN (SELECT id FROM a WHERE source_id = 3) GROUP BY entity_id",
    "position_feature": "SELECT vec_id, round(CASE WHEN count(*) OVER w > 1 THEN (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::DOUBLE / (count(*) OVER w - 1) * 0.15 ELSE 0.0 END, 6) AS position FROM embeddings WINDOW w AS (PARTITION BY label)",
    "vector_lengths": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS length FROM embeddings",
    "flash_sources": f"WITH q AS ({_CLUSTERS}), t AS (SELECT *, abs(label) % 3 AS text_id, max((category = 'core')::INTEGER) OVER (PARTITION BY abs(label) % 3) AS core FROM q) SELECT label, text_id FROM t WHERE category = 'core' OR core = 0 AND category = 'secondary' AND score > 0.6",
}
