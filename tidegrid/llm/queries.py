"""The registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from tidegrid.llm.op1_context_mixing import op1_context_mixing
from tidegrid.llm.op2_near_vectors import op2_near_vectors
from tidegrid.llm.op3_collision_search import op3_collision_search
from tidegrid.llm.op4_packing import op4_pack_sequences
from tidegrid.llm.op5_bpe import op5_bpe_round_trip
from tidegrid.llm.op6_warc import op6_warc_round_trip
from tidegrid.llm.op7_jaccard import op7_jaccard_join
from tidegrid.llm.op8_toxicity import op8_toxicity
from tidegrid.llm.op9_quality import op9_quality
from tidegrid.llm.op10_token_files import op10_token_files
from tidegrid.llm.op11_prefix_trie import BLOCK, HEADS, op11_prefix_trie
from tidegrid.llm.op12_token_counts import op12_token_counts
from tidegrid.llm.op13_hard_negatives import ANCHORS, LABELS, NEGATIVES, POSITIVES, SCALE, SHIFTED, op13_hard_negatives

QUERIES = {f.__name__: f for f in (op1_context_mixing, op2_near_vectors, op3_collision_search, op4_pack_sequences, op5_bpe_round_trip, op6_warc_round_trip, op7_jaccard_join, op8_toxicity, op9_quality, op10_token_files, op11_prefix_trie, op12_token_counts, op13_hard_negatives)} | {"pipeline": corpus_pipeline.run}
_REACH = """reach AS (SELECT a AS id, b AS far FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.far)"""
# CRC-32 of a short string, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda u, j: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END)), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    # All pairs, which only small tables allow.
    "op2_near_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
{_REACH}
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT id, min(far) AS low FROM reach GROUP BY id) c ON c.id = e.vec_id""",
    "op6_warc_round_trip": """WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS own, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: CASE WHEN substr(bits, CAST(i + k + 1 AS BIGINT), 1) = '1' THEN 1 << CAST(4 - k AS INTEGER) ELSE 0 END))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> own THEN own END AS refers_to FROM m""",
    "op7_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
half AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT id, min(far) AS low FROM reach GROUP BY id) c ON c.id = d.doc_id""",
    "op11_prefix_trie": f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, ':', text))) AS at FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS b, n, {_CRC} % {HEADS} AS h FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM t GROUP BY conv_id)),
k AS (SELECT c.*, least(c.h, coalesce(f.n, 0)) AS k FROM c LEFT JOIN c f ON f.conv_id = c.b),
r AS (SELECT k.conv_id, o.at AS d, role, text FROM k JOIN o ON o.conv_id = k.b AND o.at <= k.h UNION ALL SELECT k.conv_id, o.at - k.h + k.k, role, text FROM k JOIN o ON o.conv_id = k.conv_id WHERE o.at > k.h),
w AS (SELECT k.conv_id, coalesce(q.seq, []) AS seq FROM k LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY d) AS seq FROM r GROUP BY conv_id) q ON q.conv_id = k.conv_id),
p AS (SELECT conv_id, depth, seq[1 : depth] AS head, depth = len(seq) AS last FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM w)),
n AS (SELECT depth, head, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY depth, head),
a AS (SELECT p.conv_id, p.depth, n.conv_id AS node FROM p JOIN n ON n.depth = p.depth AND n.head = p.head),
e AS (SELECT n.conv_id, n.depth, n.n_convs, n.ends_sha256, a.node AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.head[len(n.head)].text) END AS w
  FROM n LEFT JOIN a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1),
m AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY 1, 2),
l AS (SELECT e.*, coalesce(m.n_children, 0) AS n_children FROM e LEFT JOIN m ON m.conv_id = e.conv_id AND m.depth = e.depth),
u AS (SELECT a.node AS conv_id, a.depth, sum(l.w) AS saved_tokens, count(*) FILTER (WHERE l.n_children = 0) AS n_leaves FROM l JOIN a ON a.conv_id = l.conv_id AND a.depth <= l.depth GROUP BY 1, 2)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, l.n_convs, l.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM l JOIN u ON u.conv_id = l.conv_id AND u.depth = l.depth""",
    "op13_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {ANCHORS} = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= {NEGATIVES}""",
}
