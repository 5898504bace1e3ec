"""DuckDB SQL for those queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 by bytes: the remainder of each byte, and the running remainder over the text's bytes.
OP2 = r"""
WITH RECURSIVE steps(b, c, n) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
), remainders AS (
  SELECT list(c ORDER BY b) AS r FROM steps WHERE n = 8
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT rid, doc_id, CAST(strlen(t) + 8 AS BIGINT) AS size,
    xor(list_reduce([CAST(CAST('0x' || h[2 * k - 1:2 * k] AS INTEGER) AS BIGINT) FOR k IN range(1, CAST(length(h) // 2 AS BIGINT) + 1)],
      lambda a, b: xor(a >> 8, r[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM d, remainders
), o AS (
  SELECT doc_id, size, text_crc32, row_number() OVER w AS nth, sum(size) OVER w - size AS before, sum(size) OVER () AS total
  FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)
), s AS (
  SELECT *, CAST(((2 * before + size) * 24) // (2 * total) AS INTEGER) AS shard FROM o
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

OP5 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), pairs AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS n_common FROM s a JOIN s b ON a.k = b.k AND a.rid <> b.rid GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * n_common >= 75 * (na.n + nb.n - n_common)
), reached(rid, other) AS (
  SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM reached r JOIN links l ON r.other = l.a
), c AS (
  SELECT r.rid, min(o.doc_id) AS component_id FROM reached r JOIN d o ON o.rid = r.other GROUP BY r.rid
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id IS NOT DISTINCT FROM d.doc_id AS kept
FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)
"""

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), hits AS (
  SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), w AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 4], ' ')) AS n
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM w WHERE n > 1) GROUP BY rid
), m AS (
  SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(string_split(t, chr(10))) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, length(t) - length(replace(t, '!', '')) AS n_bangs
  FROM d LEFT JOIN r USING (rid)
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > greatest(1, n_letters) OR 5 * n_bangs > n_words) AS kept
FROM v
"""

OP10 = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT rid, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (rid)
"""

#: Only words that share what is left of them without a code point are compared; CRC-32 as for op2.
OP13 = r"""
WITH RECURSIVE steps(b, c, n) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
), remainders AS (
  SELECT list(c ORDER BY b) AS r FROM steps WHERE n = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), each AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS h FROM (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run)
), hashed AS (
  SELECT run, n, xor(list_reduce([CAST(CAST('0x' || h[2 * k - 1:2 * k] AS INTEGER) AS BIGINT) FOR k IN range(1, CAST(length(h) // 2 AS BIGINT) + 1)],
    lambda a, b: xor(a >> 8, r[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS c FROM each, remainders
), counted AS (
  SELECT CASE WHEN c % 31 = 0 THEN run[:c % length(run)] || run[c % length(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counted WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, length(word) AS size, k, word[:k - 1] || word[k + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)
), followed(word, upto) AS (
  SELECT word, word FROM formed UNION ALL SELECT f.word, x.form FROM followed f JOIN formed x ON x.word = f.upto WHERE x.form IS NOT NULL
), roots AS (
  SELECT f.word, f.upto AS root FROM followed f JOIN formed x ON x.word = f.upto WHERE x.form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN roots USING (word)
"""

ORACLE_SQL = {"op2_sharding": OP2, "op5_near_dedup": OP5, "op6_decontamination": OP6, "op8_quality_rules": OP8, "op10_url_filters": OP10, "op13_spelling": OP13}
