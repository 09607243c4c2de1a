"""DuckDB SQL for the queries of this package that SQL can express; written from the contracts alone."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORD = r"'[^\x20\x09-\x0D]+'"
_FOLDED_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Smallest id reachable over links (a, b) given in both directions, for every id of nodes.
_COMPONENTS = """
reach(id, other) AS (
  SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nodes AS (SELECT id FROM v),
good AS (SELECT id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM good p JOIN good q ON p.id <> q.id AND len(p.e) = len(q.e)
          WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
{_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept
FROM component
"""

OP5 = f"""
WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, {_BLANK_WORD}) AS w FROM documents),
nodes AS (SELECT id FROM words),
shingles AS (
  SELECT DISTINCT id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (SELECT p.id AS a, q.id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.s = q.s AND p.id <> q.id
         GROUP BY p.id, q.id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
          WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
{_COMPONENTS}
SELECT component.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, component.id = component_id AS kept
FROM component LEFT JOIN sizes ON sizes.id = component.id
"""

OP8 = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK_WORD}) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (s) WHERE low < doc_id),
removed AS (SELECT doc_id, list(i) AS spots, count(*) AS n FROM gone GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(spots, []), i)), ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_FOLDED_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_FOLDED_WORD}) AS w FROM benchmark),
runs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
         FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
               FROM b WHERE len(w) > 0)),
found AS (SELECT doc_id, i, runs.k, item_id
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                FROM d, (SELECT DISTINCT k FROM runs) WHERE len(w) >= k) p
          JOIN runs ON runs.k = p.k AND runs.s = array_to_string(w[i:i + p.k - 1], ' ')),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS spot FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP13 = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
lows AS (SELECT t, min(doc_id) AS low FROM texts GROUP BY t),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels
          WHERE doc_id IS NOT NULL GROUP BY doc_id),
facts AS (SELECT doc_id, part, t, low, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts JOIN lows USING (t)),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 50,
            100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
            regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > low, false)] AS f
          FROM facts LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5),
seen AS (SELECT part, o, step, n, good, toxic, f, f[ascii(o[step]) - 64] AS bad,
           list_bool_or(list_transform(range(1, step), lambda i: f[ascii(o[i]) - 64])) AS before FROM counts, steps),
totals AS (SELECT part, o, step,
    sum(CASE WHEN NOT bad AND NOT coalesce(before, false) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bad AND NOT coalesce(before, false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bad AND coalesce(before, false) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bad AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bad AND NOT coalesce(before, false) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bad AND NOT coalesce(before, false) THEN toxic ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY part, o, step),
shares AS (SELECT part, o[step] AS letter, sum(removed) AS shapley FROM totals GROUP BY part, o[step])
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM totals JOIN shares USING (part) WHERE letter = o[step]
"""

OP11 = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, x) AS (
  SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT c, s, i + 1, xor(x >> 8, list_reduce(list_prepend(xor(x, CAST(ascii(s[i + 1]) AS BIGINT)) & 255, range(8)),
                                              lambda a, b: xor(a >> 1, 3988292384 * (a & 1))))
  FROM crc WHERE i < length(s)),
heads AS (SELECT c, c - c % 20 AS base, xor(x, 4294967295) % 4 AS h FROM crc WHERE i = length(s)),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations),
rebuilt AS (SELECT c, 0 AS part, k, role, text FROM heads JOIN turns ON conv_id = base AND k <= h
            UNION ALL SELECT c, 1, k, role, text FROM heads JOIN turns ON conv_id = c AND k > h),
numbered AS (SELECT c, row_number() OVER w AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                    string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS key
             FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, k ROWS UNBOUNDED PRECEDING)),
lengths AS (SELECT c, coalesce(max(d), 0) AS n FROM heads LEFT JOIN numbered USING (c) GROUP BY c),
prefixes AS (SELECT c, d, words, key FROM numbered UNION ALL SELECT c, 0, 0, '' FROM heads),
nodes AS (SELECT key, d, min(c) AS low, count(*) AS n, max(words) AS words,
                 coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
          FROM prefixes JOIN lengths USING (c) GROUP BY key, d),
children AS (SELECT left(key, 64 * (d - 1)) AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
sums AS (SELECT key, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
         FROM (SELECT left(key, 64 * unnest(range(0, d + 1))) AS key, CAST(n_children = 0 AS INT) AS leaf, (n - 1) * words AS saved
               FROM full_nodes) GROUP BY key)
SELECT v.low AS conv_id, v.d AS depth, p.low AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens,
       sha256(v.ends) AS ends_sha256
FROM full_nodes v JOIN sums USING (key) LEFT JOIN nodes p ON v.d > 0 AND p.key = left(v.key, 64 * (v.d - 1))
"""
