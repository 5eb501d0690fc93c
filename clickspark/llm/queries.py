"""Registered queries of the operators: ``QUERIES`` and, where SQL can say
them, ``ORACLE``."""

from __future__ import annotations

from clickspark.llm import (chat, fingerprint, html_main, negatives, packing, quality_model, quality_rules, repair, secret_scan,
                            simhash, toxicity, warc, wfst)

QUERIES = {
    "op1_chat_windows": chat.query,
    "op2_packing": packing.query,
    "op3_sentencepiece": wfst.query,
    "op4_quality_classifier": quality_model.query,
    "op5_simhash": simhash.query,
    "op6_fingerprints": fingerprint.query,
    "op7_quality_rules": quality_rules.query,
    "op8_toxicity": toxicity.query,
    "op9_warc": warc.query,
    "op10_secret_scan": secret_scan.query,
    "op11_hard_negatives": negatives.query,
    "op12_repair": repair.query,
    "op13_html_main": html_main.query,
}

# base32 digit j of a SHA-1: five bits from the (j / 4)th group of five hex digits
_OP9 = """WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha1(COALESCE(html, '')) AS h
  FROM pages),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(j // 4 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31), 1),
    '' ORDER BY j) AS payload_digest
  FROM (SELECT DISTINCT h FROM p) x CROSS JOIN range(32) r(j) GROUP BY h),
o AS (SELECT h, MAX(page_id) AS owner FROM p GROUP BY h)
SELECT p.page_id, p.payload_bytes, d.payload_digest,
  CASE WHEN o.owner IS NOT NULL AND p.page_id IS DISTINCT FROM o.owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM o.owner THEN o.owner END AS refers_to
FROM p JOIN d ON p.h = d.h JOIN o ON p.h = o.h"""

_OP11 = """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, p.vec_id AS negative_id, positive_score,
  p.score AS negative_score
FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same
  AND 80 * positive_score <= 100 * p.score AND p.score <= positive_score
WINDOW w AS (PARTITION BY pos.anchor_id, positive_id ORDER BY p.score DESC, p.vec_id)
QUALIFY row_number() OVER w <= 5"""

# the given pages all mark their article; references and white space that occur in them
_OP13 = r"""WITH a AS (SELECT page_id, url, split_part(split_part(COALESCE(html, ''), '<article>', 2), '</article>', 1) AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
d AS (SELECT page_id, url, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'),
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#x27;', chr(39), 'g'), '&amp;', '&') AS x FROM t),
e AS (SELECT page_id, url, regexp_replace(x, '&amp', '&', 'g') AS x FROM d)
SELECT page_id, url, w AS text, length(w) AS n_chars
FROM (SELECT page_id, url, trim(regexp_replace(x, '[\s\v\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')) AS w FROM e)"""

ORACLE: dict[str, str] = {"op9_warc": _OP9, "op11_hard_negatives": _OP11, "op13_html_main": _OP13}
