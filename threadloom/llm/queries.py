"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, decontaminate, hilbert, lines, neardup, negatives, neighbours, packing, quality, suffixes, tokens, warc

QUERIES = {
    "op1_nearest": neighbours.op1_nearest,
    "op2_hilbert_shards": hilbert.op2_hilbert_shards,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_repeats": suffixes.op4_repeats,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op10_line_dedup": lines.op10_line_dedup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_sentencepiece": tokens.op9_sentencepiece,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_alignment": alignment.op12_alignment,
    "op13_warc": warc.op13_warc,
}

_LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, k, line, row_number() OVER (ORDER BY doc_id, k) AS place FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
d AS (SELECT line, min(place) AS place, list_distinct(list_filter(string_split(line, ' '), lambda w: w <> '')) AS words FROM s GROUP BY line),
e AS (SELECT place, len(words) AS n, unnest(words) AS word FROM d),
p AS (SELECT x.place AS x, count(*) AS i, any_value(x.n + y.n) AS n FROM e x JOIN e y ON x.word = y.word AND y.place < x.place AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY x.place, y.place),
g AS (SELECT s.doc_id, s.k FROM s JOIN d ON s.line = d.line WHERE s.place > d.place OR d.place IN (SELECT x FROM p WHERE 9 * i >= 4 * n)),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS removed FROM g GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed_lines
FROM documents LEFT JOIN r USING (doc_id)
"""

_REPEATS = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS k FROM b),
s AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS t FROM w),
f AS (SELECT t, min(doc_id) AS first FROM s GROUP BY t),
g AS (SELECT s.doc_id, s.k, s.k - lag(s.k) OVER (PARTITION BY s.doc_id ORDER BY s.k) AS gap FROM s JOIN f USING (t) WHERE s.doc_id > f.first),
i AS (SELECT doc_id, k, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g),
r AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS e FROM i GROUP BY doc_id, run),
c AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept FROM r),
q AS (SELECT doc_id, count(*) AS n, sum(e - a) AS removed, max(e) AS last, string_agg(substr(b.h, 2 * kept + 1, 2 * (a - kept)), '' ORDER BY a) AS head FROM c JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM b LEFT JOIN q USING (doc_id)
"""

_NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x09-\\x0D\\x1C-\\x20]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS s, count(*) AS c FROM k GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * i >= 4 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id
"""

_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {15 - 5 * j}) & 31) + 1, 1)" for i in range(8) for j in range(4)
)
_WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, octet_length(x) AS n, {_LETTERS} AS digest FROM (SELECT page_id, x, sha1(x) AS h FROM p)),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

#: Near-duplicate search finds its links with a chance below one (a miss at 0.8 has 3e-6); the SQL has all of them.
ORACLES: dict[str, str] = {"op10_line_dedup": _LINES, "op4_repeats": _REPEATS, "op3_near_duplicates": _NEAR, "op11_hard_negatives": _NEGATIVES, "op13_warc": _WARC}
