"""Registered queries of operators 11 to 13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import importance, personal, trie
from .common import documents
from .registry import query

PERSONAL_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
     pat(name, p) AS (VALUES
       ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
       ('card', '[0-9](?:[ -]?[0-9])+'), ('phone', '\+[0-9][ ().0-9-]+[0-9]'), ('group', '[0-9]{12,}'),
       ('national', '(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}'),
       ('iban', '[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?')),
     a AS (SELECT r, name, regexp_extract_all(t, p) AS v, string_split_regex(t, p) AS s FROM d, pat WHERE regexp_matches(t, p)),
     m AS (SELECT r, name, v, s, unnest(range(1, len(v) + 1)) AS i FROM a),
     x AS (SELECT r, name, v[i] AS val,
                  list_sum([length(y) FOR y IN s[1:i]]) + coalesce(list_sum([length(y) FOR y IN v[1:i - 1]]), 0) AS st,
                  right(CASE WHEN i > 1 THEN v[i - 1] ELSE '' END || s[i], 40) AS before,
                  left(s[i + 1] || coalesce(v[i + 1], ''), 40) AS after,
                  regexp_replace(v[i], '[^0-9]', '', 'g') AS n, replace(v[i], ' ', '') AS plain FROM m),
     c AS (SELECT *, st + length(val) AS en, CASE WHEN length(n) BETWEEN 12 AND 19 THEN
                  list_sum([CASE WHEN j % 2 = 0 THEN CAST(n[length(n) - j] AS INT)
                                 WHEN n[length(n) - j] > '4' THEN 2 * CAST(n[length(n) - j] AS INT) - 9
                                 ELSE 2 * CAST(n[length(n) - j] AS INT) END FOR j IN range(0, length(n))]) % 10 = 0 ELSE false END AS luhn,
                  CASE WHEN length(plain) BETWEEN 15 AND 34 AND name = 'iban' THEN
                  list_reduce(list_prepend(0, [CASE WHEN k BETWEEN '0' AND '9' THEN ascii(k) - 48 ELSE ascii(k) - 55 END
                                               FOR k IN string_split(plain[5:] || plain[1:4], '')]),
                              lambda q, z: (q * (CASE WHEN z > 9 THEN 100 ELSE 10 END) + z) % 97) = 1 ELSE false END AS sound,
                  NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]') AS alone,
                  before || ' ' || after AS near FROM x),
     b AS (SELECT r, name AS kind, st, en FROM c
           WHERE name = 'email' OR name = 'card' AND luhn OR name = 'phone' AND length(n) BETWEEN 9 AND 15
              OR name = 'ip' AND list_min([length(ltrim(y, '0')) < 4 AND CAST('0' || right(y, 3) AS INT) < 256
                                          FOR y IN string_split(val, '.')])),
     w AS (SELECT *, CASE WHEN regexp_matches(near, '(?i)(?:^|[^A-Za-z])(?:order|invoice|serial|isbn|tracking|version|ref)(?:[^A-Za-z]|$)')
                          THEN 0.2 ELSE 0 END AS less FROM c),
     p AS (SELECT r, 'card' AS kind, st, en FROM w
           WHERE name = 'group' AND luhn AND alone
             AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = w.r AND b.kind = 'card' AND b.st < w.en AND w.st < b.en)
             AND 0.7 - less + CASE WHEN regexp_matches(near, '(?i)(?:^|[^A-Za-z])(?:card|visa|mastercard|amex|credit|debit|payment|cvv)(?:[^A-Za-z]|$)')
                                   THEN 0.2 ELSE 0 END >= 0.6
           UNION ALL
           SELECT r, 'phone', st, en FROM w
           WHERE name = 'national' AND alone AND NOT regexp_matches(before, '\+[0-9][ ().0-9-]*$')
             AND CASE WHEN val LIKE '(%' THEN 0.6 ELSE 0.4 END - less
                 + CASE WHEN regexp_matches(near, '(?i)(?:^|[^A-Za-z])(?:phone|tel|call|mobile|cell|fax|dial|whatsapp)(?:[^A-Za-z]|$)')
                        THEN 0.2 ELSE 0 END >= 0.6
           UNION ALL
           SELECT r, 'iban', st, en FROM w
           WHERE name = 'iban' AND alone AND sound
             AND 0.7 - less + CASE WHEN regexp_matches(near, '(?i)(?:^|[^A-Za-z])(?:iban|account|bank|transfer|konto|bic)(?:[^A-Za-z]|$)')
                                   THEN 0.2 ELSE 0 END >= 0.6),
     u AS (SELECT *, true AS base FROM b UNION ALL SELECT *, false FROM p),
     o AS (SELECT r, count(*) FILTER (base AND kind = 'email') AS n_email, count(*) FILTER (base AND kind = 'ip') AS n_ip,
                  count(*) FILTER (base AND kind = 'card') AS n_card, count(*) FILTER (base AND kind = 'phone') AS n_phone,
                  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, list_position(['email', 'ip', 'card', 'phone', 'iban'], kind))
                    FILTER (base) AS bases,
                  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, list_position(['email', 'ip', 'card', 'phone', 'iban'], kind)) AS spans
           FROM u GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)"""


@query("op12_personal_data", PERSONAL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_report(documents(spark, sf_dir))


IMPORTANCE_SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r,
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     aim AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
     dw AS (SELECT r, w, count(*) AS c
            FROM (SELECT r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low) GROUP BY r, w),
     bw AS (SELECT unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM aim),
     v AS (SELECT w, CAST(encode(w) AS BIT)::VARCHAR AS bits FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
     crc AS (SELECT w, xor(list_reduce(
                 list_prepend(4294967295::BIGINT, [CAST(substr(bits, 8 * (k // 8) + 8 - k % 8, 1) AS BIGINT) FOR k IN range(0, length(bits))]),
                 lambda a, x: xor(a >> 1, CASE WHEN (a & 1) <> x THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) % 10000 AS b FROM v),
     s AS (SELECT b, sum(c) AS n FROM dw JOIN crc USING (w) GROUP BY b),
     t AS (SELECT b, count(*) AS n FROM bw JOIN crc USING (w) GROUP BY b),
     sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
     gain AS (SELECT i AS b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)
                                              / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000)))) AS g
              FROM range(10000) AS x(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i, sums),
     wt AS (SELECT r, sum(c) AS n, sum(c * g) AS g FROM dw JOIN crc USING (w) JOIN gain USING (b) GROUP BY r),
     sc AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(g, 0)::BIGINT AS weight,
                   coalesce(g, 0)::BIGINT + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                                 / 4294967296::DOUBLE)))::BIGINT AS score
            FROM low LEFT JOIN wt USING (r)),
     rk AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p,
                   count(*) FILTER (n_features >= 20) OVER () AS able FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * able // 100 THEN p END AS rank FROM rk"""


@query("op11_importance", IMPORTANCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TRIE_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     k AS (SELECT conv_id, count(*) AS n, CAST(encode(CAST(conv_id AS VARCHAR)) AS BIT)::VARCHAR AS bits FROM o GROUP BY conv_id),
     c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(list_reduce(
                 list_prepend(4294967295::BIGINT, [CAST(substr(bits, 8 * (j // 8) + 8 - j % 8, 1) AS BIGINT) FOR j IN range(0, length(bits))]),
                 lambda a, x: xor(a >> 1, CASE WHEN (a & 1) <> x THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) % 9 AS h FROM k),
     p AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS lent FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
     q AS (SELECT p.conv_id, o.pos AS depth, role, text FROM p JOIN o ON o.conv_id = p.base AND o.pos <= p.lent
           UNION ALL
           SELECT p.conv_id, o.pos - p.h + p.lent, role, text FROM p JOIN o ON o.conv_id = p.conv_id AND o.pos > p.h),
     m AS (SELECT conv_id, depth, string_agg(md5(role) || md5(text), ',') OVER w AS key, strlen(text) AS bytes, count(*) OVER (PARTITION BY conv_id) AS n
           FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
           UNION ALL
           SELECT p.conv_id, 0, '', 0, coalesce(n.n, 0) FROM p LEFT JOIN (SELECT conv_id, count(*) AS n FROM q GROUP BY conv_id) AS n USING (conv_id)),
     g AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf, (count(*) - 1) * max(bytes) AS saved,
                  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
           FROM m GROUP BY depth, key),
     t AS (SELECT u.depth, u.key, count(*) FILTER (g.leaf) AS n_leaves, sum(g.saved) AS saved_tokens,
                  count(*) FILTER (g.depth = u.depth + 1) AS n_children
           FROM g JOIN m ON m.conv_id = g.conv_id AND m.depth <= g.depth JOIN g AS u ON u.depth = m.depth AND u.key = m.key
           GROUP BY u.depth, u.key)
SELECT g.conv_id, g.depth, r.conv_id AS parent_conv_id, g.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN t USING (depth, key) LEFT JOIN m ON m.conv_id = g.conv_id AND m.depth = g.depth - 1 LEFT JOIN g AS r ON r.depth = m.depth AND r.key = m.key"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
