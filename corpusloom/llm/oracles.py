"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

ORACLE_SQL["op3_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) t(i)),
     dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) l, unnest(range(1, len(w) - n + 2)) t(i)),
     h AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, s)),
     c AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM h), unnest(range(0, n)) t(k) GROUP BY rid),
     m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""

ORACLE_SQL["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) t(i)),
     r AS (SELECT rid, i FROM p QUALIFY count(*) OVER (PARTITION BY h) > 1),
     g AS (SELECT DISTINCT rid, i + k AS j FROM r, unnest(range(0, 35)) t(k)),
     x AS (SELECT d.rid, doc_id, j, u AS word, g.rid IS NULL AS kept FROM (SELECT rid, doc_id, unnest(w) AS u, generate_subscripts(w, 1) AS j FROM d) d LEFT JOIN g USING (rid, j))
SELECT d.doc_id, len(d.w) AS n_words, count_if(NOT kept) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (kept), '')) AS kept_sha256 FROM d LEFT JOIN x USING (rid) GROUP BY d.rid, d.doc_id, d.w
"""


def _license_sql() -> str:
    from .licenses import COVER, DRIFT, SEGMENT, template_pairs

    rows = [f"({tid}, '{label}', {base}, {t}, {size}, '{x}', '{y}')" for tid, label, base, t, size, x, y in template_pairs()]
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     q AS (SELECT * FROM (VALUES {", ".join(rows)}) v(tid, label, base, t, size, wa, wb)),
     g AS (SELECT rid, p, w[p + 1] AS wa, w[p + 2] AS wb FROM d, unnest(range(0, len(w) - 1)) t(p)),
     v AS (SELECT rid, tid, label, base, size, p - t AS diagonal, t // {SEGMENT} AS segment, bit_or(1::BIGINT << (t % {SEGMENT})::BIGINT) AS covered FROM g JOIN q USING (wa, wb) GROUP BY ALL),
     f AS (SELECT *, base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) > {DRIFT}, true) AS far FROM v),
     n AS (SELECT *, sum(far::INT) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS span, base AND bit_count(covered) = size AS whole FROM f),
     e AS (SELECT rid, tid, label, base, size, span, bit_count(bit_or(covered)) AS k, count_if(whole) AS n, min(CASE WHEN whole THEN diagonal END) AS a, max(CASE WHEN whole THEN diagonal END) AS b FROM n GROUP BY rid, tid, label, base, size, span, segment),
     s AS (SELECT rid, tid, label, base, sum(k) / size::DOUBLE AS cover, sum(n) AS n, min(a) AS a, max(b) AS b FROM e GROUP BY rid, tid, label, base, size, span),
     l AS (SELECT rid, sum(n)::BIGINT AS n_base, min(a) AS first_word, max(b) AS last_word, max(cover) AS score, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND n > 0) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN base THEN n > 0 ELSE cover >= {COVER}::DOUBLE END) AS labels FROM s GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN l USING (rid)
"""


ORACLE_SQL["op5_license_scan"] = _license_sql()
