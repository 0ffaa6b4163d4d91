"""Checking SQL of the queries whose results SQL can express, for DuckDB."""

from __future__ import annotations

SQL: dict[str, str] = {}

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SQL["op4_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
  win AS (
    SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) s),
  least AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
  late AS (SELECT doc_id, i FROM win JOIN least USING (k) WHERE lo < doc_id),
  gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, (SELECT unnest(range(13)) AS j) r),
  kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
    FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_FIVE_BITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, {5 * k + 1}, 5) AS INT) >> {shift}) & 31), 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)
SQL["op6_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_FIVE_BITS} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM d"""

SQL["op7_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) s),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (
    SELECT x, y FROM pairs JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id
    WHERE c >= 0.8 * (sx.n + sy.n - c) - 1e-9),
  reach(doc_id, r) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON reach.r = x),
  counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, min(r) AS class_id, coalesce(max(n), 0) AS n_links
FROM reach LEFT JOIN counts ON doc_id = x GROUP BY doc_id"""

_GROUPS = ", ".join(f"CAST('0x' || substr(x, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
SQL["op11_fill_in_middle"] = f"""
WITH d AS (
    SELECT doc_id, t, length(t) AS n, {_GROUPS}
    FROM (
      SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents) s),
  c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d),
  p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c),
  o AS (
    SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out
    FROM p),
  r AS (
    SELECT *, split_part(out, '<M>', 1) AS head, split_part(out, '<M>', 2) AS m FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out
    WHEN 'psm' THEN split_part(split_part(head, '<S>', 1), '<P>', 2) || m || split_part(head, '<S>', 2)
    ELSE split_part(head, '<P>', 2) || m || split_part(split_part(head, '<P>', 1), '<S>', 2) END) AS restored_sha256
FROM r"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op12_winnowing"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
  b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
  known AS (
    SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS k
    FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i
      FROM (SELECT *, least(len(w), 10) AS size FROM b WHERE len(w) > 0) s) t),
  sizes AS (SELECT DISTINCT size FROM known),
  win AS (
    SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS k
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size) s),
  hits AS (SELECT r, size, i, item FROM win JOIN known USING (size, k)),
  words AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i, unnest(range(size)) AS j FROM hits) s),
  n AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
  m AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM hits) s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""

_ROUNDS = 6


def _nearest(k: int) -> str:
    """Every part's nearest entry of codebook k and its squared distance."""
    return f"""a{k} AS MATERIALIZED (
    SELECT r, part, entry, d FROM (
      SELECT r, part, entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c USING (part, pos) GROUP BY r, part, entry) s
    QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)"""


def _means(k: int) -> str:
    """Codebook k + 1: rounded-down means, unused entries as they were."""
    return f"""c{k + 1} AS MATERIALIZED (
    SELECT c.part, c.entry, c.pos, coalesce((s - ((s % n) + n) % n) // n, c.v) AS v
    FROM c{k} c LEFT JOIN (
      SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (r, part) GROUP BY ALL) m
    USING (part, entry, pos))"""


_CODEBOOKS = ",\n  ".join(_nearest(k) + ",\n  " + _means(k) for k in range(_ROUNDS))
SQL["op13_metric_tree_codes"] = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
  x AS MATERIALIZED (
    SELECT r, i // (n // 8) AS part, i % (n // 8) AS pos, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 4096) AS BIGINT) AS v
    FROM (SELECT *, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM kept) s),
  c0 AS (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= 16),
  {_CODEBOOKS},
  {_nearest(_ROUNDS)},
  books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{_ROUNDS}),
  coded AS (
    SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a{_ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books"""
