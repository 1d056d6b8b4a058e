"""DuckDB SQL for the operators that SQL can express."""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bi AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi
), dp AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM dp
), occ AS (
  SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hits.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(hits.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN its ON d.r = its.r
"""

EMBEDDINGS = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), ok AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM e
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT a AS id, b AS other FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
), least_id AS (SELECT id, min(other) AS other FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(l.other, e.vec_id) AS kept
FROM e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN least_id l ON e.vec_id = l.id
"""

NEIGHBOURS = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), ok AS (
  SELECT r, vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM e
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (q.norm * c.norm) AS score
  FROM ok q JOIN ok c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS n FROM s) WHERE n <= 5
"""

MANIFEST = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text FROM documents
), l AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS lowered FROM d
), p AS (
  SELECT *, coalesce('v' || lang, 'n') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM l
), tree_nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT tree, any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tree_nodes WHERE n > 1 GROUP BY tree, pos // 8
), subs AS (
  SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM tree_nodes WHERE n = 1
), top_nodes AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top_nodes WHERE n > 1 GROUP BY pos // 8
), top AS (SELECT h AS root FROM top_nodes WHERE n = 1),
near AS (
  SELECT p.r, t.lvl, t.pos, t.h, t.pos < p.pos // CAST(8 ** t.lvl AS BIGINT) AS before
  FROM p JOIN tree_nodes t ON t.tree = p.tree AND t.n > 1 AND t.pos // 8 = p.pos // CAST(8 ** (t.lvl + 1) AS BIGINT) AND t.pos <> p.pos // CAST(8 ** t.lvl AS BIGINT)
  UNION ALL
  SELECT p.r, s.height + t.lvl, t.pos, t.h, t.pos < s.pos // CAST(8 ** t.lvl AS BIGINT)
  FROM p JOIN subs s ON s.tree = p.tree JOIN top_nodes t ON t.n > 1 AND t.pos // 8 = s.pos // CAST(8 ** (t.lvl + 1) AS BIGINT) AND t.pos <> s.pos // CAST(8 ** t.lvl AS BIGINT)
), levels AS (
  SELECT p.r, unnest(range(s.height + (SELECT max(lvl) FROM top_nodes))) AS lvl FROM p JOIN subs s ON s.tree = p.tree
), steps AS (
  SELECT levels.r, levels.lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT before), '') AS b
  FROM levels LEFT JOIN near ON near.r = levels.r AND near.lvl = levels.lvl GROUP BY levels.r, levels.lvl
), paths AS (SELECT r, list({a: a, h: '', b: b} ORDER BY lvl) AS path, string_agg(a || b, '' ORDER BY lvl) AS siblings FROM steps GROUP BY r
), bytes AS (
  SELECT r, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS b FROM p
), crc AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295) AS c FROM bytes
), folded AS (
  SELECT p.doc_id, p.leaf, s.subroot, top.root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_prepend({a: '', h: CASE WHEN crc.c % 3 = 0 THEN p.lowered ELSE p.leaf END, b: ''}, coalesce(path, [])), lambda x, y: {a: '', h: sha256(y.a || x.h || y.b), b: ''}).h AS folded_root
  FROM p JOIN subs s ON s.tree = p.tree CROSS JOIN top LEFT JOIN paths ON paths.r = p.r
  JOIN crc ON crc.r = p.r
)
SELECT *, folded_root = root AS verified FROM folded
"""

PERIODIC = """
WITH w0 AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), bytes AS (
  SELECT *, len(w) AS n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS b FROM w0
), h AS (
  SELECT r, doc_id, w, n, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295) AS h FROM bytes
), ap AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS k FROM h
), w1 AS (
  SELECT r, doc_id, n, CASE WHEN a < n THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1]) ELSE w END AS w FROM ap
), grams AS (
  SELECT r, unnest(range(1, n - 4)) AS i, hash(unnest(list_transform(range(1, n - 4), lambda i: w[i:i + 5]))) AS g FROM w1 WHERE n >= 12
), again AS (
  SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1
), repeats AS (
  SELECT grams.* FROM grams JOIN again USING (r, g)
), pairs AS (
  SELECT a.r, a.i, b.i - a.i AS q FROM repeats a JOIN repeats b ON a.r = b.r AND a.g = b.g AND a.i < b.i
), islands AS (
  SELECT r, q, min(i) - 1 AS start, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
), runs AS (
  SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length
), per AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s,
         arg_min({start: start, length: length, period: period}, [-length, start, period]) AS best FROM runs GROUP BY r
), dropped AS (
  SELECT r, list(DISTINCT x) AS x FROM (SELECT r, unnest(range(start + period, start + length)) AS x FROM runs) GROUP BY r
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(0, n)) AS i FROM w1) u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(x) AS x FROM dropped) d WHERE d.r = u.r AND d.x = u.i) GROUP BY r
)
SELECT w1.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM w1 LEFT JOIN per ON per.r = w1.r LEFT JOIN kept ON kept.r = w1.r
"""
