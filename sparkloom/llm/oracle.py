"""DuckDB SQL with the rows of the queries that SQL can express."""

OP3 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, sha1(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM docs UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN component c ON c.node = d.doc_id
"""

OP4 = r"""
WITH parsed AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 3), '') AS path,
         coalesce(translate(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS scheme
  FROM pages),
ruled AS (
  SELECT *, row_number() OVER () AS row_id,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
         list_distinct(list_concat(
           list_transform(list_filter([scheme], lambda x: x <> ''), lambda x: 's:' || x),
           list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
           list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || x))) AS items
  FROM parsed),
labelled AS (
  SELECT row_id, items, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled WHERE rule IS NOT NULL),
least AS (SELECT ceil(0.002::DOUBLE * count(*)::DOUBLE) AS k FROM labelled),
one AS (SELECT row_id, verdict, unnest(items) AS t FROM labelled),
single AS (SELECT t, count(*) AS seen FROM one GROUP BY t HAVING count(*) >= (SELECT k FROM least)),
often AS (SELECT row_id, verdict, t FROM one JOIN single USING (t)),
sets AS (
  SELECT t AS a, NULL::VARCHAR AS b, count(*) AS seen, count(*) FILTER (verdict = 'block') AS block, count(*) FILTER (verdict = 'allow') AS allow FROM often GROUP BY t
  UNION ALL
  SELECT x.t, y.t, count(*), count(*) FILTER (x.verdict = 'block'), count(*) FILTER (x.verdict = 'allow')
  FROM often x JOIN often y ON x.row_id = y.row_id AND x.t < y.t GROUP BY x.t, y.t),
sure AS (
  SELECT a, b, 'block' AS verdict, block AS hits, seen FROM sets UNION ALL SELECT a, b, 'allow', allow, seen FROM sets),
strong AS (SELECT * FROM sure WHERE hits >= (SELECT k FROM least) AND hits >= 0.8::DOUBLE * seen),
rules AS (
  SELECT * FROM strong s WHERE b IS NULL OR NOT EXISTS (
    SELECT 1 FROM strong o WHERE o.b IS NULL AND o.verdict = s.verdict AND o.a IN (s.a, s.b) AND o.hits::DOUBLE / o.seen >= s.hits::DOUBLE / s.seen)),
open AS (SELECT row_id, unnest(items) AS t FROM ruled WHERE rule IS NULL),
met AS (
  SELECT o.row_id, r.* FROM open o JOIN rules r ON r.a = o.t WHERE r.b IS NULL
  UNION ALL
  SELECT o.row_id, r.* FROM open o JOIN rules r ON r.a = o.t JOIN open p ON p.row_id = o.row_id AND p.t = r.b),
best AS (
  SELECT row_id, verdict, concat_ws(' ', a, b) AS mined FROM met
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY hits::DOUBLE / seen DESC, seen DESC, (b IS NOT NULL), verdict, concat_ws(' ', a, b)) = 1)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(best.verdict, 'allow') END AS verdict,
       CASE WHEN rule IS NULL THEN mined END AS mined
FROM ruled LEFT JOIN best USING (row_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS holder FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < holder THEN holder END AS refers_to
FROM q LEFT JOIN m USING (payload_digest)
"""

OP8 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
first AS (SELECT h, min(doc_id) AS doc_id FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT x.doc_id, x.i + k.k AS i FROM windows x JOIN first f ON f.h = x.h AND f.doc_id < x.doc_id, range(0, 13) AS k(k)),
kept AS (
  SELECT d.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN d.word END, ' ' ORDER BY d.i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs) d LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.i = d.i GROUP BY d.doc_id)
SELECT docs.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id
"""

QUALITY_BASE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) > 4)),
repeated AS (SELECT doc_id, count(DISTINCT i + k.k) AS n FROM windows, range(0, 5) AS k(k) WHERE n > 1 GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
FROM docs d LEFT JOIN repeated r ON r.doc_id = d.doc_id
"""

SECRET_COUNTS = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM docs
"""

# crc32 bit by bit over the digits of doc_id, as DuckDB has no function for it; the empty string is the end token, which no word is
LM_BASE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT),
           lambda a, b: list_reduce(range(8)::UBIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(a, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 7 = 2, false) AS held_out,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(list_append(w, '')) AS t FROM docs),
counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
totals AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens,
       round(1000 * sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1)::DOUBLE)))::BIGINT AS base_thousandths
FROM tokens LEFT JOIN counts USING (t), totals GROUP BY doc_id, held_out
"""
