"""DuckDB SQL for the queries that SQL can express.

The others (extraction, classifier, nearest neighbours, link propagation, SimHash with XXH64) are
tested against brute force, known answers or held-out labels.
"""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), {lower}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(lower=_LOWER)

SUBSTRING = r"""
WITH d AS MATERIALIZED (SELECT *, row_number() OVER () AS k FROM (SELECT DISTINCT doc_id, text FROM documents)),
tok AS (SELECT k, generate_subscripts(t, 1) AS i, unnest(t) AS raw
        FROM (SELECT k, regexp_extract_all(text, '[ \t-\r]*[^ \t-\r]+[ \t-\r]*') AS t FROM d)),
word AS (SELECT *, regexp_extract(raw, '[^ \t-\r]+') AS w FROM tok),
ends AS (SELECT *, ('0x' || md5(w)[1:7])::BIGINT AS h,
    (regexp_matches(w, '[.!?]["'')\]»”]?$') OR contains(regexp_extract(raw, '[ \t-\r]*$'), chr(10)))::INT AS e FROM word),
sent AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ends),
pair AS (SELECT k, i, s, raw, w, (h + lag(h) OVER (PARTITION BY k, s ORDER BY i) * 1000003) % 2147483647 AS r FROM sent),
low AS (SELECT *, coalesce(r < coalesce(least(lag(r, 1) OVER o, lag(r, 2) OVER o, lag(r, 3) OVER o), 2147483647)
    AND r <= coalesce(least(lead(r, 1) OVER o, lead(r, 2) OVER o, lead(r, 3) OVER o), 2147483647), false)::INT AS b
    FROM pair WINDOW o AS (PARTITION BY k, s ORDER BY i)),
part AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY k, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM low),
cut AS (SELECT *, (row_number() OVER (PARTITION BY k, s, c ORDER BY i) - 1) // 24 AS p FROM part),
unit AS (SELECT k, min(i) AS a, count(*) AS n, string_agg(raw, '' ORDER BY i) AS raw, string_agg(w, ' ' ORDER BY i) AS norm
         FROM cut GROUP BY k, s, c, p),
num AS MATERIALIZED (SELECT *, row_number() OVER o AS pos, sum(n) OVER o AS upto, count(*) OVER (PARTITION BY k) AS units
        FROM unit WINDOW o AS (PARTITION BY k ORDER BY a)),
-- a run has three pieces (all, of a text with two) and ends where it has 16 words
span AS (SELECT x.k, x.pos, min(y.pos) AS e FROM (SELECT k, pos, upto - n AS before,
        unnest(range(pos + least(3, units) - 1, least(pos + 16, units + 1))) AS e FROM num WHERE units >= 2) x
    JOIN num y ON y.k = x.k AND y.pos = x.e WHERE y.upto - x.before >= 16 GROUP BY x.k, x.pos),
run AS (SELECT x.k, x.pos, max(x.e) AS e, string_agg(y.norm, ' ' ORDER BY y.pos) AS s
    FROM (SELECT *, unnest(range(pos, e + 1)) AS q FROM span) x JOIN num y ON y.k = x.k AND y.pos = x.q GROUP BY x.k, x.pos),
seen AS (SELECT run.k, pos, e, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id NULLS LAST, pos) AS nth FROM run JOIN d USING (k)),
gone AS (SELECT DISTINCT k, unnest(range(pos, e + 1)) AS pos FROM seen WHERE nth > 1),
done AS (SELECT k, coalesce(string_agg(u.raw, '' ORDER BY u.pos) FILTER (WHERE g.pos IS NULL), '') AS kept,
                count(g.pos) AS pieces, coalesce(sum(u.n) FILTER (WHERE g.pos IS NOT NULL), 0) AS words
         FROM num u LEFT JOIN gone g USING (k, pos) GROUP BY k)
SELECT o.doc_id, CASE WHEN coalesce(pieces, 0) = 0 THEN o.text ELSE kept END AS text,
       coalesce(pieces, 0)::BIGINT AS pieces_removed, coalesce(words, 0)::BIGINT AS words_removed
FROM documents o LEFT JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND o.text IS NOT DISTINCT FROM d.text LEFT JOIN done USING (k)
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')))[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
    FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS words,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::HUGEINT AS lft, (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::HUGEINT AS left_w
    FROM s1 WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap::HUGEINT * left_w <= lft * w AS capped FROM s2),
s4 AS (SELECT *, (words - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0))::BIGINT AS rest0,
    coalesce(sum(w) FILTER (WHERE NOT capped) OVER (), 0)::BIGINT AS rest_w FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE coalesce(rest0::DOUBLE * w / nullif(rest_w, 0), 0.0) END AS target FROM s4),
-- a document's copies are in proportion to its size, three at most
cells AS (SELECT source, size, count(*) * size AS words, count(*) * size::HUGEINT * size AS squares FROM d WHERE size > 0 GROUP BY source, size),
per AS (SELECT cells.source, cells.size, (target - 3 * coalesce(sum(words) OVER (PARTITION BY cells.source ORDER BY cells.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(squares) OVER (PARTITION BY cells.source ORDER BY cells.size))::DOUBLE AS per FROM cells JOIN s5 ON cells.source IS NOT DISTINCT FROM s5.source),
lam AS (SELECT source, arg_max(per, size) AS per_word FROM per WHERE per * size < 3 GROUP BY source),
c0 AS (SELECT d.*, source_size, target, CASE WHEN size = 0 THEN 0.0 WHEN per_word IS NULL THEN 3.0 ELSE least(per_word * size, 3.0) END AS c
    FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN lam ON d.source IS NOT DISTINCT FROM lam.source),
c1 AS (SELECT *, floor(c)::BIGINT AS whole, c - floor(c) AS p FROM c0),
r0 AS (SELECT *, target - (sum(whole * size) OVER (PARTITION BY source))::BIGINT AS rest, row_number() OVER () AS id,
    CASE WHEN p > 0 THEN least(floor(((u / (1.0 - u)) / (p / (1.0 - p))) / (((u / (1.0 - u)) / (p / (1.0 - p))) + 1.0) * 281474976710656.0), 281474976710655)::BIGINT END AS k
    FROM c1),
t1 AS (SELECT *, p > 0 AND size <= rest AND sum(CASE WHEN size <= rest THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k, doc_id, id) <= rest AS a FROM r0),
-- the sample is a prefix: what follows the first document that does not fit waits for the next round
g1 AS (SELECT *, coalesce(a, false) AS in1, rest - coalesce(sum(size) FILTER (WHERE a) OVER (PARTITION BY source), 0) AS rest2 FROM t1),
t2 AS (SELECT *, p > 0 AND NOT in1 AND size <= rest2 AND
    sum(CASE WHEN NOT in1 AND size <= rest2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k, doc_id, id) <= rest2 AS a2 FROM g1),
g2 AS (SELECT *, in1 OR coalesce(a2, false) AS in2, rest2 - coalesce(sum(size) FILTER (WHERE a2) OVER (PARTITION BY source), 0) AS gap FROM t2),
c AS (SELECT *, CASE WHEN p > 0 AND NOT in2 THEN row_number() OVER (PARTITION BY source, p > 0 AND NOT in2 ORDER BY abs(gap - size), k, doc_id, id) END AS near FROM g2)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    size * (whole + (in2 OR coalesce(near = 1 AND abs(gap - size) < gap, false))::BIGINT) AS taken FROM c
"""

LINES = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, generate_subscripts(t, 1) AS i, unnest(t) AS line FROM (SELECT *, string_split(text, chr(10)) AS t FROM d)),
h AS (SELECT *, ('0x' || md5(line)[1:7])::BIGINT AS h FROM l),
r AS (SELECT *, (h + coalesce(lag(h) OVER (PARTITION BY doc_id, text ORDER BY i), 0) * 1000003) % 2147483647 AS r FROM h),
b AS (SELECT *, (i = 1 OR (i >= 3 AND lag(r, 1) OVER o < lag(r, 2) OVER o AND lag(r, 1) OVER o < r))::INT AS starts
      FROM r WINDOW o AS (PARTITION BY doc_id, text ORDER BY i)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, text ORDER BY i) AS c FROM b),
chunk AS (SELECT doc_id, text, c, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS s FROM n GROUP BY doc_id, text, c),
seen AS (SELECT *, n >= 2 AND regexp_matches(s, '[^\x20\x09-\x0D]') AS ok FROM chunk),
k AS (SELECT *, ok AND row_number() OVER (PARTITION BY ok, s ORDER BY doc_id NULLS LAST, c) > 1 AS gone FROM seen),
done AS (SELECT doc_id, text, coalesce(string_agg(s, chr(10) ORDER BY c) FILTER (WHERE NOT gone), '') AS kept,
         coalesce(sum(n) FILTER (WHERE gone), 0)::INT AS ln, (count(*) FILTER (WHERE gone))::INT AS ch FROM k GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(kept, d.text) AS text, coalesce(ln, 0) AS lines_removed, coalesce(ch, 0) AS chunks_removed
FROM documents d LEFT JOIN done x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text
"""

CHATS = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS l FROM t GROUP BY conv_id),
g AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM g)),
m AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = g.l))
SELECT conv_id, len(l)::BIGINT AS n_turns, n_copies, array_to_string(list_transform(l, lambda x:
    '<|im_start|>' || coalesce(x.r, '') || chr(10) || regexp_replace(coalesce(x.t, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g')
    || '<|im_end|>' || chr(10)), '') AS text FROM m
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
spots AS (SELECT rid, m, k, array_to_string(w[k:k + m - 1], ' ') AS s
          FROM (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT rid, item_id, spots.m, k FROM spots JOIN win USING (s, m)),
pos AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(k, k + m)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""

REPAIR = r"""
WITH RECURSIVE k AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, turn, coalesce(role, ' ') AS role,
    coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
-- CRC-32: each byte is shifted out by eight steps
crc AS (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(s, ''), lambda x: ord(x)::BIGINT), lambda c, b:
    list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295)) % 20 AS how FROM k),
d AS (SELECT k, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) AS n FROM crc WHERE how <> 0),
r0 AS (SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, n) AS i,
    row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, n) > 1 AS again FROM d),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY k ORDER BY i) AS before FROM r0),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n,
    count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY k),
st(p, ini, q, name) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ins(p, q, c, a, t) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])),
e AS (SELECT k, i, p, q, 5 * (fault = 't')::INT AS c, 'K' AS a, [role || ':' || text] AS t FROM r JOIN st USING (ini) WHERE fault NOT IN ('b', 'd')
    UNION ALL SELECT k, i, p, q, 1 + 5 * (fault = 't')::INT, 'R', [name || ':' || text] FROM r, st WHERE fault NOT IN ('b', 'd') AND st.ini <> 's'
    UNION ALL SELECT k, i, p, p, 2, 'D', []::VARCHAR[] FROM r, (VALUES (0), (1), (2), (3)) z(p)),
v AS (SELECT k, 0::BIGINT AS i, q, {'c': ins.c, 'a': ins.a, 't': ins.t} AS b FROM (SELECT DISTINCT k FROM k), ins WHERE p = 0
    UNION ALL SELECT v.k, e.i, n.q, min({'c': v.b.c + e.c + n.c, 'a': v.b.a || e.a || n.a, 't': v.b.t || e.t || n.t})
    FROM v JOIN e ON e.k = v.k AND e.i = v.i + 1 AND e.p = v.q JOIN ins n ON n.p = e.q GROUP BY v.k, e.i, n.q),
best AS (SELECT v.k, min(b) AS b FROM v LEFT JOIN counts USING (k) WHERE v.i = coalesce(counts.n, 0) AND q IN (0, 3) GROUP BY v.k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM k) LEFT JOIN best USING (k) LEFT JOIN counts USING (k)
"""

ORACLE = {"op2_substring_dedup": SUBSTRING, "op4_source_mixing": MIXING, "op8_line_dedup": LINES,
          "op9_chat_format": CHATS, "op10_decontamination": DECONTAMINATION,
          "op13_conversation_repair": REPAIR}
