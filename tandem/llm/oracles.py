"""DuckDB statements for the queries of this package that SQL can express."""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111',
           1 + 4 * (strpos('0123456789abcdef', substr(h, CAST(i AS INT), 1)) - 1), 4)), '') AS bits,
    min(page_id) OVER (PARTITION BY h) AS first
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
      + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
      + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams
  FROM w
), t AS (
  SELECT doc_id, unnest(grams) AS gram FROM s
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM t a JOIN t b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
  WHERE 100 * shared >= 90 * (len(a.grams) + len(b.grams) - shared)
), two_way AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM s
  UNION
  SELECT r.root, b.y FROM reach r JOIN two_way b ON b.x = r.node
), lowest AS (
  SELECT root, min(node) AS component_id FROM reach GROUP BY root
)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id FROM s JOIN lowest ON root = doc_id
"""

FILTER_AUDIT = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(toxic, 0)) AS n_toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed
), orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, i AS step, substr(o, i, 1) AS x, left(o, i - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE length(o) = 5
), m AS (
  SELECT *, contains(failed, x) AS fails, length(translate(failed, earlier, '')) < length(failed) AS gone FROM c, steps
), s AS (
  SELECT part, o, step, x, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM s
"""

PREFIX_TRIE = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS key
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(key ORDER BY turn NULLS FIRST, left(role, 32), left(text, 32), md5(key)) AS keys,
    list(length(text) ORDER BY turn NULLS FIRST, left(role, 32), left(text, 32), md5(key)) AS chars
  FROM turns GROUP BY conv_id
), crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, CAST(4294967295 AS BIGINT) AS r, 0 AS i FROM own
  UNION ALL
  SELECT conv_id, s, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END, i + 1
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(r, CAST(ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE r END AS x FROM crc WHERE i < 8 * length(s))
), h AS (
  SELECT conv_id, CAST(xor(r, CAST(4294967295 AS BIGINT)) % 6 AS INT) AS h FROM crc WHERE i = 8 * length(s)
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.keys, [])[1:h], o.keys[h + 1:]) AS keys, list_concat(coalesce(b.chars, [])[1:h], o.chars[h + 1:]) AS chars
  FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), seen AS (
  SELECT conv_id, keys[1:d] AS path, d, coalesce(chars[d], 0) AS chars, len(keys) = d AS ends
  FROM built, unnest(range(0, len(keys) + 1)) AS t(d)
), node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM seen GROUP BY path, d
), kids AS (
  SELECT path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), full_node AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN kids k USING (path)
), below AS (
  SELECT path[1:i] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM full_node, unnest(range(0, d + 1)) AS t(i) GROUP BY ALL
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN below b USING (path) LEFT JOIN node p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""
