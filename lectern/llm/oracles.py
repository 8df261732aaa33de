"""SQL with the same results as training-text queries, for DuckDB."""

from __future__ import annotations

_PAIRS = """WITH b AS (SELECT DISTINCT article_id AS a, entity_id AS e FROM article_entities WHERE article_id IS NOT NULL AND entity_id IS NOT NULL),
 n AS (SELECT e, count(*) AS n FROM b GROUP BY e), t AS (SELECT count(DISTINCT a) AS t FROM b),
 p AS (SELECT x.e AS entity_a, y.e AS entity_b, count(*) AS n_ab FROM b x JOIN b y ON x.a = y.a AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 5),
 s AS (SELECT p.*, u.n AS n_a, v.n AS n_b, t.t AS t FROM p JOIN n u ON u.e = p.entity_a JOIN n v ON v.e = p.entity_b, t WHERE p.n_ab::HUGEINT * t.t >= 3::HUGEINT * u.n * v.n)"""

_REPEATED = r"""WITH a AS (SELECT DISTINCT ON (id) id, coalesce(source_id, (SELECT min(s.id) FROM sources s WHERE lower(trim(s.domain)) = regexp_replace(lower(trim(source_domain)), '^www\.', ''))) AS site, content FROM articles WHERE id IS NOT NULL),
 l AS (SELECT id, site, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, unnest(string_split(content, chr(10))) AS line FROM a WHERE content IS NOT NULL),
 k AS (SELECT id, site, line_no, lower(regexp_replace(trim(regexp_replace(line, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '\p{Nd}+', '0', 'g')) AS line FROM l),
 h AS (SELECT site, line FROM k WHERE line <> '' GROUP BY site, line HAVING count(DISTINCT id) >= 3 AND count(DISTINCT id) >= 0.2 * (SELECT count(*) FROM a WHERE a.site = k.site))"""

ORACLES: dict[str, str] = {
    "p2_found": f"{_PAIRS} SELECT entity_a, entity_b FROM s",
    "p2_updated": f"{_PAIRS} SELECT entity_a, entity_b, n_ab, n_a, n_b, round(n_ab * t::DOUBLE / (n_a * n_b::DOUBLE), 6) AS lift FROM s",
    "p7_found": f"{_REPEATED} SELECT k.id, k.line_no::INTEGER AS line_no FROM k JOIN h ON h.site = k.site AND h.line = k.line",
}
