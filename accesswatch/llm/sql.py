"""DuckDB SQL of the queries that SQL can express, written apart from the operators' own expressions."""

from __future__ import annotations

LINE_FREQUENCY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), grams AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
), again AS (
  SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), hit AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS s(k) GROUP BY r
), ht AS (SELECT DISTINCT host, t, lines FROM w
), hl AS (
  SELECT host, t, array_to_string(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS line
  FROM (SELECT host, t, unnest(lines) AS l FROM ht)
), often AS (
  SELECT host, line FROM hl GROUP BY host, line
  HAVING count(DISTINCT t) >= 5
    AND 100 * count(DISTINCT t) > 5 * any_value((SELECT count(*) FROM ht AS o WHERE o.host = hl.host))
), removed AS (
  SELECT host, t, sum(len(string_split(line, ' '))) AS n FROM hl JOIN often USING (host, line) GROUP BY host, t
), stats AS (
  SELECT w.*, len(words) AS n_words, coalesce(hit.n, 0) AS n_rep, removed.n AS gone
  FROM w LEFT JOIN hit USING (r) LEFT JOIN removed USING (host, t)
)
SELECT doc_id, n_words::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_rep > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_rep > 20 * n_words)
    AND NOT coalesce(gone IS NOT NULL AND (n_words - gone < 10 OR 100 * (n_words - gone) < 30 * n_words), false) AS kept
FROM stats
"""

URL_FILTER_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(h, b, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, h || b AS rule, v FROM p JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(b) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fits USING (page_id)
"""

LINE_DEDUP_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, coalesce(doc_id <> last, false) AS dropped FROM k LEFT JOIN often USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_ASCII_LOWER}, '{_ALNUM}') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '{_ALNUM}') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i:i + 12], ' ') AS w
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(words) - 12))) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM (SELECT r, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, sizes WHERE len(words) >= n)
), hits AS (SELECT r, n, i, item_id FROM grams JOIN windows USING (n, w)
), places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

NEAR_DUPS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS words FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM d WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x
), least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

CONVERSATIONS_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))),
    4294967295) % 20 AS code FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(2) AS copies(k) WHERE code <> 0 AND (k = 0 OR code = 3)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    CASE WHEN stripped = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ordered
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS total FROM judged GROUP BY conv_id
), inserts(q, p, cost, letters, added) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']),
    (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])
), keeps(initial, q, p) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), relabels(q, p, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), edits AS (
  SELECT conv_id, n, 'D' AS letter, q, q AS p, 4 AS cost, [] AS said FROM judged, range(4) AS states(q)
  UNION ALL SELECT conv_id, n, 'K', q, p, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, [role || ':' || text]
  FROM judged JOIN keeps USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, n, 'R', q, p, 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, [r.role || ':' || text]
  FROM judged, relabels AS r WHERE fault NOT IN ('blank', 'duplicate')
), moves AS (
  SELECT conv_id, n, i.q, e.p, i.cost + e.cost AS cost, i.letters || e.letter AS letters, i.added || e.said AS said
  FROM edits AS e JOIN inserts AS i ON i.p = e.q
), paths AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM faults
  UNION ALL
  SELECT conv_id, n, q, b.cost, b.audit, b.said FROM (
    SELECT p.conv_id, m.n, m.p AS q, min({'cost': p.cost + m.cost, 'audit': p.audit || m.letters, 'said': p.said || m.said}) AS b
    FROM paths AS p JOIN moves AS m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND m.n = p.n + 1 AND m.q = p.q GROUP BY ALL)
), ended AS (
  SELECT f.conv_id, min({'cost': p.cost + i.cost, 'audit': p.audit || i.letters, 'said': p.said || i.added}) AS b
  FROM faults AS f JOIN paths AS p ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND p.n = f.total
    JOIN inserts AS i ON i.q = p.q AND i.p IN (0, 3) GROUP BY f.conv_id
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS g LEFT JOIN faults AS f ON g.conv_id IS NOT DISTINCT FROM f.conv_id
  LEFT JOIN ended AS e ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""

EMBEDDINGS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x,
    coalesce(label IS NOT NULL AND vec_id IS NOT NULL AND list_max(list_transform(embedding, lambda y: abs(y))) > 0
      AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0, false) AS links FROM embeddings
), pairs AS (
  SELECT a.r AS p, b.r AS q, a.vec_id AS x, b.vec_id AS y
  FROM (SELECT * FROM v WHERE links) AS a JOIN (SELECT * FROM v WHERE links) AS b
    ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98
), n AS (SELECT p AS r, count(*) AS n FROM pairs GROUP BY p
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x
), least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v LEFT JOIN least USING (vec_id) LEFT JOIN n USING (r)
"""
