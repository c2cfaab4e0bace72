r"""DuckDB SQL for the training-data queries that SQL can express."""

from formloom.llm.licenses import COVER, GAP, templates

ORACLES: dict[str, str] = {}

_BUCKET = "CASE WHEN v < 64 THEN v ELSE ((v >> (length(bin(v)) - 6)::INT) << (length(bin(v)) - 6)::INT) END"

ORACLES["op4_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), dups AS (
  SELECT rid, sum(c - 1) AS n_dup_lines FROM (
    SELECT rid, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid
), s AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dups USING (rid)
), long AS (
  SELECT lang, source, 'symbols' AS signal, 1000 * n_symbols // n_words AS v FROM s WHERE n_words > 0
  UNION ALL SELECT lang, source, 'word_len', 100 * word_chars // n_words FROM s WHERE n_words > 0
  UNION ALL SELECT lang, source, 'dup_lines', 1000 * n_dup_lines // n_words FROM s WHERE n_words > 0
), b AS (
  SELECT lang, source, signal, {_BUCKET} AS bucket FROM long
), q AS (
  SELECT 'group' AS level, lang, source, signal, count(*) AS n, quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.5) AS q50, quantile_disc(bucket, 0.75) AS q75
  FROM b GROUP BY lang, source, signal
  UNION ALL SELECT 'lang', lang, NULL, signal, count(*), quantile_disc(bucket, 0.25), quantile_disc(bucket, 0.5), quantile_disc(bucket, 0.75) FROM b GROUP BY lang, signal
  UNION ALL SELECT 'all', NULL, NULL, signal, count(*), quantile_disc(bucket, 0.25), quantile_disc(bucket, 0.5), quantile_disc(bucket, 0.75) FROM b GROUP BY signal
), f AS (
  SELECT level, lang, source, max(n) AS n,
    max(CASE WHEN signal = 'symbols' THEN q50 + 6 * greatest(q75 - q25, 25) END) AS f1,
    max(CASE WHEN signal = 'word_len' THEN q50 + 6 * greatest(q75 - q25, 20) END) AS f2,
    max(CASE WHEN signal = 'dup_lines' THEN q50 + 6 * greatest(q75 - q25, 5) END) AS f3
  FROM q GROUP BY level, lang, source
), v AS (
  SELECT s.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    CASE WHEN g.n >= 200 THEN g.f1 WHEN l.n >= 200 THEN l.f1 ELSE a.f1 END AS f1,
    CASE WHEN g.n >= 200 THEN g.f2 WHEN l.n >= 200 THEN l.f2 ELSE a.f2 END AS f2,
    CASE WHEN g.n >= 200 THEN g.f3 WHEN l.n >= 200 THEN l.f3 ELSE a.f3 END AS f3
  FROM s LEFT JOIN f g ON g.level = 'group' AND g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source
    LEFT JOIN f l ON l.level = 'lang' AND l.lang IS NOT DISTINCT FROM s.lang
    LEFT JOIN f a ON a.level = 'all'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE 1000 * n_symbols // n_words <= f1 AND 100 * word_chars // n_words <= f2 AND 1000 * n_dup_lines // n_words <= f3 END AS kept
FROM v
"""

ORACLES["op2_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), o AS (
  SELECT *, (3 * source_size)::HUGEINT AS cap, 3 * source_size::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o
), k AS (
  SELECT *, cap * weights <= weight * rest AS capped FROM l
), lv AS (
  SELECT rest AS r, weights AS ws FROM k WHERE NOT capped ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, weight, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * lv.r)::DOUBLE / lv.ws::DOUBLE END AS target FROM k LEFT JOIN lv ON true
), p AS (
  SELECT doc_id, size, source_size, weight, target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (CASE WHEN size = 0 THEN 0 ELSE least(3, greatest(0, ceil((target - start - size / 2) / source_size))) END)::INT AS copies, (start + size / 2) / target AS x FROM p
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN round(CASE weight WHEN 1 THEN 1.5 - sqrt(2.25 - 2 * x) WHEN 2 THEN x ELSE sqrt(0.25 + 2 * x) - 0.5 END, 6) END AS first_position
FROM c
"""

ORACLES["op8_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT uid, vec_id, unnest(x) AS val, unnest(range(len(x))) AS i FROM v
), p AS (
  SELECT q.uid AS qu, q.vec_id AS query_id, c.uid AS cu, c.vec_id, sum(q.val * c.val)::BIGINT AS score
  FROM c q JOIN c ON q.i = c.i AND q.uid <> c.uid WHERE q.vec_id % 100 = 0 GROUP BY q.uid, q.vec_id, c.uid, c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY qu ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES["op5_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, h, strlen(h)::BIGINT AS payload_bytes, (unhex(sha1(h)))::BIT::VARCHAR AS b, max(page_id) OVER (PARTITION BY h) AS m FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT
    + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM m THEN NULL ELSE m END AS refers_to
FROM d
"""

_PAIRS = ", ".join(f"({t}, {j}, '{a}', '{b}', {n}, '{label}', {base})" for t, j, a, b, n, label, base in templates())

ORACLES["op6_licenses"] = rf"""
WITH tp (t, j, a, b, n_pairs, label, base) AS (VALUES {_PAIRS}
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT rid, unnest(w) AS a, unnest(w[2:]) AS b, unnest(range(len(w))) AS pos FROM d
), v AS (
  SELECT rid, t, pos - j AS diag, bit_or((1::BIGINT << j)) AS mask, any_value(n_pairs) AS n_pairs, any_value(label) AS label, any_value(base) AS base
  FROM p JOIN tp USING (a, b) GROUP BY rid, t, pos - j
), f AS (
  SELECT *, coalesce((diag - lag(diag) OVER (PARTITION BY rid, t ORDER BY diag) > {GAP})::INT, 0) AS far FROM v
), s AS (
  SELECT *, sum(far) OVER (PARTITION BY rid, t ORDER BY diag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM f
), c AS (
  SELECT *, bit_count(bit_or(mask) OVER (PARTITION BY rid, t, span)) / n_pairs AS cover, base AND bit_count(mask) = n_pairs AS place FROM s
), g AS (
  SELECT rid, count(*) FILTER (WHERE place) AS n_base, min(diag) FILTER (WHERE place) AS first_word, max(diag) FILTER (WHERE place) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place OR (NOT base AND cover >= {COVER})), '') AS labels,
    coalesce(max(CASE WHEN place THEN 1.0::DOUBLE WHEN NOT base AND cover >= {COVER} THEN cover END), 0) AS score
  FROM c GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (rid)
"""
