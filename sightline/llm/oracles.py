"""DuckDB SQL for the queries that SQL can express."""

HOST_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS k
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
m AS (SELECT w.doc_id, w.source AS host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered c USING (rid)),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
        10 * n_dup_lines > 3 * n_lines AS dup_lines FROM m),
per_host AS (SELECT host, count(*) AS n, {short}, {repeats}, {symbols}, {dup_lines} FROM
      (SELECT host, short::INT AS short, repeats::INT AS repeats, symbols::INT AS symbols, dup_lines::INT AS dup_lines FROM f) GROUP BY host),
long_form AS (UNPIVOT (SELECT host, n, short, repeats, symbols, dup_lines FROM per_host) ON short, repeats, symbols, dup_lines INTO NAME rule VALUE k),
mean AS (SELECT rule, sum(n)::DOUBLE AS n, count(*) AS hosts, sum(k)::DOUBLE / sum(n) AS p FROM long_form GROUP BY rule),
spread AS (SELECT l.rule, any_value(e.n) AS n, any_value(e.hosts) AS hosts, any_value(e.p) AS p, sum(l.n * (l.k::DOUBLE / l.n - e.p) ^ 2) AS v
           FROM long_form l JOIN mean e USING (rule) GROUP BY l.rule),
prior AS (SELECT rule, p, CASE WHEN v - greatest(0, hosts - 1) * p * (1 - p) > 0
            THEN least(greatest(p * (1 - p) / ((v - greatest(0, hosts - 1) * p * (1 - p)) / n) - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM spread),
rate AS (SELECT l.host, l.rule, (l.k + p * s) / (l.n + s) AS r, p FROM long_form l JOIN prior USING (rule)),
verdict AS (SELECT host, bool_or(r > 0.5) AS bad, bool_or(rule = 'symbols' AND r > 0.1 AND r > 2 * p) AS s_symbols,
        bool_or(rule = 'dup_lines' AND r > 0.1 AND r > 2 * p) AS s_dup FROM rate GROUP BY host)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repeats) AS base_failed,
       NOT (short OR repeats OR bad OR (s_symbols AND symbols) OR (s_dup AND dup_lines)) AS kept
FROM f JOIN verdict v ON f.host IS NOT DISTINCT FROM v.host
""".replace("{short}", "sum(short)::BIGINT AS short").replace("{repeats}", "sum(repeats)::BIGINT AS repeats").replace("{symbols}", "sum(symbols)::BIGINT AS symbols").replace("{dup_lines}", "sum(dup_lines)::BIGINT AS dup_lines")

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex),
b AS (SELECT hex, first, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS digest FROM f)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN b USING (hex)
"""

ORACLE = {"op2_warc": WARC, "op8_host_quality": HOST_QUALITY}
