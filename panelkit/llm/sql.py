"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .op8_quality_rules import RULES, STOP_WORDS

ORACLE: dict[str, str] = {}

ORACLE["op6_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight,
             1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM s),
l AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce((SELECT level FROM f), 'inf'::DOUBLE) * weight) END AS target FROM l),
o AS (SELECT source, CAST(floor(target) AS BIGINT) AS words FROM t WHERE floor(target) > 0),
c AS (SELECT source, words, CAST(sum(words) OVER (ORDER BY source IS NULL, source) - words AS DOUBLE) / CAST(sum(words) OVER () AS DOUBLE) AS lo,
             CAST(sum(words) OVER (ORDER BY source IS NULL, source) AS DOUBLE) / CAST(sum(words) OVER () AS DOUBLE) AS hi FROM o),
x AS (SELECT i AS slot, CAST(i + 1 AS DOUBLE) * ((sqrt(5.0::DOUBLE) - 1) / 2) AS x FROM range(CAST((SELECT coalesce(ceil(sum(words) / 32.0), 0) FROM o) AS BIGINT)) g(i)),
g AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM x JOIN c ON x - floor(x) >= lo AND x - floor(x) < hi),
r AS (SELECT o.source, least(words, 32 * slots) AS words FROM o JOIN (SELECT source, count(*) AS slots FROM g GROUP BY source) n ON n.source IS NOT DISTINCT FROM o.source),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(r.words, 0) AS words,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN r ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, p.source, size, source_size, round(target, 6) AS target,
       CAST(greatest(0, least(a + size, words) - a) + greatest(0, least(a + source_size + size, words) - a - source_size) AS BIGINT) AS taken,
       CASE WHEN size > 0 AND a < words THEN g.slot END AS first_slot
FROM p LEFT JOIN g ON g.source IS NOT DISTINCT FROM p.source AND g.rank = a // 32
"""


def _rules() -> str:
    tests = []
    for r in RULES:
        if r.least is not None:
            tests.append(f"{r.part}::DOUBLE >= {r.least}::DOUBLE * {r.whole}")
        if r.most is not None:
            tests.append(f"{r.part}::DOUBLE <= {r.most}::DOUBLE * {r.whole}")
    return " AND ".join(tests)


ORACLE["op8_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w
      WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_marks,
             CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(len(list_filter(words, lambda x: lower(x) IN (""" + ", ".join(f"'{w}'" for w in STOP_WORDS) + r"""))) AS BIGINT)
             AS n_stop_words
      FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND """ + _rules() + """ AS kept FROM b
"""

ORACLE["op1_revisit_resolution"] = r"""
WITH p AS (SELECT page_id, page_id % 4 AS kind, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
                  1600000000 + page_id * 60 AS t0, regexp_extract(trim(url), '^(?i:https?)://(?:[^/?#@]*@)?([^#]*)', 1) AS rest FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
             regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> ''
                       AND NOT regexp_matches(lower(x), '^(utm_[a-z0-9_]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept FROM p),
k AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
                     || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url_key,
             t0 + 1 + (page_id * 7919 % 500000) * 60 AS t1,
             CASE kind WHEN 0 THEN '"' || digest || '"' WHEN 1 THEN 'W/"' || digest || '"' END AS etag,
             CASE WHEN kind IN (0, 2) THEN CAST(t0 - 3600 AS VARCHAR) END AS modified FROM u),
r AS (SELECT 2 * page_id AS record_id, url_key, t0 AS ts, 2 * page_id AS response FROM k
      UNION ALL SELECT 2 * page_id + 1, url_key, t1, NULL FROM k),
a AS (SELECT record_id, last_value(response IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY ts, record_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id FROM r WHERE url_key IS NOT NULL),
j AS (SELECT v.page_id * 2 + 1 AS record_id, v.url_key, a.response_id, v.etag, v.modified, v.t1, o.digest AS o_digest,
             o.etag AS o_etag, o.modified AS o_modified, o.size AS o_size,
             CASE WHEN a.response_id IS NULL THEN NULL WHEN v.etag IS NOT NULL AND o.etag IS NOT NULL THEN 'etag'
                  WHEN v.modified IS NOT NULL AND o.modified IS NOT NULL THEN 'last-modified' ELSE 'none' END AS validator
      FROM k v LEFT JOIN a ON a.record_id = v.page_id * 2 + 1 LEFT JOIN k o ON o.page_id * 2 = a.response_id),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
                     WHEN validator = 'etag' THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(o_etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
                     WHEN validator = 'last-modified' AND modified <> o_modified THEN 'mismatch' ELSE 'resolved' END AS status FROM j)
SELECT record_id, url_key, response_id, status, validator,
       CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || o_size, 'content-type: text/html',
                 'date: t' || t1, 'etag: ' || coalesce(etag, o_etag), 'last-modified: ' || coalesce(modified, o_modified), 'server: origin',
                 'x-digest: ' || o_digest)
            ELSE concat_ws(chr(10), 'cache-control: max-age=60', 'connection: close', 'content-length: 0', 'date: t' || t1, 'etag: ' || etag,
                 'last-modified: ' || modified) END AS headers
FROM s
"""

ORACLE["op4_tool_call_linking"] = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) % 3 AS kind,
                  len(string_split(coalesce(text, ''), ' ')) AS words, string_split(coalesce(text, ''), chr(10))[1] AS head FROM conversations),
c AS (SELECT * FROM t WHERE role = 'assistant'),
chain AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2)
          UNION ALL SELECT c.conv_id, c.turn, chain.level + 1 FROM c JOIN chain ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 2),
d AS (SELECT c.*, chain.level, u.text AS answer,
             CASE c.kind WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'translate' END AS name,
             CASE c.kind WHEN 0 THEN '{"limit":' || CASE WHEN c.words % 7 = 0 THEN '"' || c.words || '"' ELSE c.words::VARCHAR END || ',"query":' || to_json(c.head) || '}'
                       WHEN 1 THEN '{"exact":' || (c.words % 2 = 0)::VARCHAR || ',"key":' || to_json(string_split(c.head, ' ')[1]) || '}'
                       ELSE '{"text":' || to_json(c.text) || CASE WHEN c.words % 11 = 0 THEN '' ELSE ',"to":"en"' END || '}' END AS arguments,
             CASE c.kind WHEN 0 THEN c.words % 7 <> 0 WHEN 1 THEN true ELSE c.words % 11 <> 0 END AS fits
      FROM c JOIN chain USING (conv_id, turn) LEFT JOIN t u ON u.conv_id = c.conv_id AND u.turn = c.turn + 1 AND u.role = 'user')
SELECT conv_id, 'call_' || turn AS call_id, turn, name, level,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) - 1 AS BIGINT) AS position,
       CASE WHEN NOT fits THEN 'bad_arguments' WHEN answer IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       '{"arguments":' || arguments || ',"id":"call_' || turn || '","name":"' || name || '"'
       || CASE WHEN answer IS NULL THEN '' ELSE ',"result":' || to_json(answer) END || '}' AS json
FROM d
"""

ORACLE["op9_line_templates"] = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT DISTINCT text, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS t, lines FROM d WHERE text IS NOT NULL),
l AS (SELECT text, t, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM u),
w AS (SELECT text, t, pos, list_filter(string_split_regex(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'),
             '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM l),
n AS (SELECT text, t, pos, len(w) AS n, array_to_string(w, ' ') AS whole,
             list_transform([0, 1, 2, 3, 4], lambda k: array_to_string(w[len(w) * k // 5 + 1:len(w) * (k + 1) // 5], ' ')) AS p FROM w WHERE len(w) >= 3),
two AS (SELECT a, b FROM range(5) x(a), range(5) y(b) WHERE a < b),
k AS (SELECT text, t, pos, n, 2 AS kind, n || ' whole ' || whole AS template FROM n
      UNION ALL SELECT text, t, pos, n, 1, n || ' without ' || a || b || ' '
             || array_to_string(list_transform([0, 1, 2, 3, 4], lambda i: CASE WHEN i = a OR i = b THEN '' ELSE p[i + 1] END), ' | ')
      FROM n, two WHERE n >= 10
      UNION ALL SELECT text, t, pos, n, 1, n || ' without ' || a || ' '
             || array_to_string(list_transform([0, 1, 2, 3, 4], lambda i: CASE WHEN i = a THEN '' ELSE p[i + 1] END), ' | ')
      FROM n, range(5) x(a) WHERE n < 10 AND n * a // 5 < n * (a + 1) // 5 AND n - n * (a + 1) // 5 + n * a // 5 >= 3),
o AS (SELECT template, min(t) AS first FROM k GROUP BY template
      HAVING count(DISTINCT t) >= CASE WHEN max(kind) = 2 AND max(n) >= 20 THEN 2 ELSE 3 END),
h AS (SELECT DISTINCT text, pos FROM k JOIN o ON o.template = k.template WHERE n < 20 OR t > first),
s AS (SELECT l.text, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE h.pos IS NULL) AS kept, count(h.pos) AS n_dropped
      FROM l LEFT JOIN h ON h.text = l.text AND h.pos = l.pos GROUP BY l.text)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS kept_md5
FROM d LEFT JOIN s ON s.text = d.text
"""

ORACLE["op13_ranked_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, unnest(w) AS term FROM d),
f AS (SELECT r, term, count(*) AS tf FROM o GROUP BY r, term),
x AS (SELECT term, count(*) AS df FROM f GROUP BY term),
z AS (SELECT r, count(*) AS n FROM o GROUP BY r),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM z),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS k FROM i GROUP BY item_id, term),
s AS (SELECT q.item_id, f.r, CAST(sum(k * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN x ON x.term = q.term JOIN f ON f.term = q.term JOIN z ON z.r = f.r CROSS JOIN t GROUP BY q.item_id, f.r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s JOIN d ON d.r = s.r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
