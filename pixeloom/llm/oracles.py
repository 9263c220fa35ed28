"""DuckDB SQL for the rows of the queries that SQL can express."""

OP2 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS n FROM t)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w
"""

OP4 = r"""
WITH conv AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
esc AS (SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') AS body,
               replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') AS who FROM conv),
outs AS (SELECT *, length('<s>[INST] ' || who || ' [/INST]' || body || '</s>') AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM esc),
tok AS (SELECT *, ceil(chars / 4.0)::BIGINT AS tokens FROM outs),
pre AS (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY place))::BIGINT AS e FROM tok),
span AS (SELECT *, e - tokens AS s, 2 * ((e - tokens) // 512) + CASE WHEN (e - 1) // 512 > (e - tokens) // 512 THEN 1 ELSE 0 END AS span FROM pre),
opens AS (SELECT conv_id, span, min(s) AS s FROM span GROUP BY 1, 2),
again AS (SELECT t.conv_id, t.chars FROM span t JOIN opens o ON o.conv_id = t.conv_id AND o.s > t.s AND o.s <= t.s + 256
          WHERE NOT (t.place = 1 AND t.role = 'system')
          UNION ALL SELECT t.conv_id, t.chars FROM span t JOIN opens o ON o.conv_id = t.conv_id AND o.s > 0 WHERE t.place = 1 AND t.role = 'system'),
extra AS (SELECT conv_id, sum(chars) AS chars FROM again GROUP BY 1),
base AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
                coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM span GROUP BY 1)
SELECT b.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (b.chars + coalesce(x.chars, 0))::BIGINT AS formatted_chars
FROM base b LEFT JOIN extra x ON b.conv_id IS NOT DISTINCT FROM x.conv_id
"""

OP6 = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) v(h, p, verdict)),
fit AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p) AS k
        FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
general AS (SELECT page_id, CASE WHEN regexp_matches(host || path, '\.(?:zip|gz|exe|mp4|jpg|png)\z') THEN 'archives and media'
                                 WHEN regexp_matches(host || path, '^(?:[^/]*\.)?ads\.') THEN 'advertising hosts'
                                 WHEN regexp_matches(host || path, '(?s)^[^/]*/(?:.*/)?cart(?:/|\.|\z)') THEN 'shopping carts'
                                 WHEN regexp_matches(host || path, '(?s)^[^/]*/(?:.*/)?login(?:/|\.|\z)') THEN 'login pages' END AS g FROM u)
SELECT u.page_id, u.host, u.path, fit.rule, CASE WHEN fit.rule IS NULL THEN g END AS method_rule, coalesce(fit.verdict, CASE WHEN g IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON fit.page_id IS NOT DISTINCT FROM u.page_id AND k = 1 LEFT JOIN general ON general.page_id IS NOT DISTINCT FROM u.page_id
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
fill AS (SELECT *, row_number() OVER f AS place, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
                coalesce(sum(3 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
         FROM src WINDOW f AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST)),
lev AS (SELECT *, (total - full_)::DOUBLE / (ws - done)::DOUBLE AS level FROM fill),
water AS (SELECT arg_min(level, place) AS level FROM lev WHERE 3 * source_size >= level * w),
aim AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, water.level * w) AS target,
               ('0x' || substr(md5('10:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM lev, water),
r AS (SELECT d.*, a.source_size, a.target, a.u, CASE WHEN a.source_size > 0 THEN a.target / a.source_size::DOUBLE ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS rank FROM d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, source, size, source_size, target, (least(3, floor(rank * rate + u)::BIGINT - floor((rank - 1) * rate + u)::BIGINT) * size)::BIGINT AS taken FROM r
"""

ORACLES = {"op2_exact_dedup": OP2, "op4_chat": OP4, "op6_url_filter": OP6, "op10_mixing": OP10}
