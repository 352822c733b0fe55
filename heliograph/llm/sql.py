"""DuckDB SQL with the rows of the registered queries, where SQL can express them. Written apart from the operators."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM starts),
places AS (SELECT n, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS (SELECT n, i, k, item FROM (SELECT n, i, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM places) JOIN windows USING (k, key)),
hit AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS p FROM found) GROUP BY n),
named AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM found) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (n) LEFT JOIN named USING (n)
"""

#: Marks as in the operator: the template is part of the query.
OP2_SQL = r"""
WITH marks(role, op, cl) AS (VALUES ('system', '<<SYS>>', '<</SYS>>'), ('user', '[INST]', '[/INST]'), ('assistant', '<s>', '</s>')),
told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (
  SELECT *, coalesce(op, '<<ROLE>>' || role || '<<TEXT>>') || ' ' || text || ' ' || coalesce(cl, '<</ROLE>>') AS plain,
    coalesce(op, '<<ROLE>>' || regexp_replace(role, '([\\<\[])', '\\\1', 'g') || '<<TEXT>>') || ' ' || regexp_replace(text, '([\\<\[])', '\\\1', 'g') || ' ' || coalesce(cl, '<</ROLE>>') AS safe
  FROM told LEFT JOIN marks USING (role)),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, list(plain ORDER BY turn, role, text) AS pieces,
    string_agg(plain, '' ORDER BY turn, role, text) AS plain, string_agg(safe, '' ORDER BY turn, role, text) AS safe,
    bool_or(regexp_matches(text, '\\[\\<\[]') OR regexp_matches(role, '\\[\\<\[]') OR contains(text, '<<ROLE>>') OR contains(role, '<<ROLE>>')) AS has_escape
  FROM turns GROUP BY conv_id),
parsed AS (SELECT *, regexp_extract_all(plain, '(?s)(?:<<SYS>>|\[INST\]|<s>|<<ROLE>>.*?<<TEXT>>) .*? (?:<</SYS>>|\[/INST\]|</s>|<</ROLE>>)') AS found FROM whole)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(length(CASE WHEN found = pieces AND NOT has_escape THEN plain ELSE safe END) AS BIGINT) AS formatted_chars, true AS identical
FROM parsed
"""

OP4_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages),
fits AS (SELECT n, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fits GROUP BY n)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""

#: Of all pairs, only those of sizes that can link are joined; every common shingle of theirs is counted.
OP10_SQL = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT n, doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT n, doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT n, count(*) AS size FROM shingles GROUP BY n),
numbered AS (SELECT dense_rank() OVER (ORDER BY s) AS s, n, doc_id, size FROM shingles JOIN sizes USING (n) WHERE doc_id IS NOT NULL),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM numbered a JOIN numbered b ON a.s = b.s AND a.n < b.n AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
  GROUP BY a.n, b.n, a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))),
links AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) WHERE a <> b),
reached(id, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reached GROUP BY id)
SELECT doc_id, coalesce(size, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM docs LEFT JOIN sizes USING (n) LEFT JOIN roots ON doc_id = id
"""

#: One document at a time through every order; copies, labels and counts apart from the operator's masks.
OP13_SQL = r"""
WITH said AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM docs LEFT JOIN said USING (doc_id)),
counted AS (SELECT part, good, toxic, a, b, c, d, e, count(*) AS n FROM fails GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
names AS (SELECT *, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed FROM counted),
told AS (
  SELECT part, filter_order, step, filter_order[step] AS f, good, toxic, n, failed, contains(failed, filter_order[step]) AS here,
    step > 1 AND failed <> translate(failed, filter_order[1:step - 1], '') AS before FROM names, steps),
found AS (
  SELECT part, filter_order, step, any_value(f) AS f, sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT before AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT before AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM told GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_chat_format": OP2_SQL, "op4_url_rules": OP4_SQL, "op10_near_dedup": OP10_SQL, "op13_filter_audit": OP13_SQL}
