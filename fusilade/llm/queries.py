"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .chat import op7_chat
from .covertree import op4_embeddings
from .jaccard import op5_jaccard
from .langid import op8_language
from .media import op10_media
from .mixing import op9_mixing
from .quality import op6_quality
from .suffix import op2_suffix
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_suffix, op3_bpe, op4_embeddings, op5_jaccard, op6_quality, op7_chat, op8_language, op9_mixing, op10_media)}

_REACH = """
reach AS (SELECT {id} AS a, {id} AS b FROM {nodes} UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""

ORACLES = {
    "op4_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
          WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.9),"""
    + _REACH.format(id="vec_id", nodes="embeddings")
    + """
SELECT m.vec_id, (SELECT count(*) FROM edges e WHERE e.a = m.vec_id)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN comp c ON c.a = m.vec_id""",
    "op5_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
edges AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 85 * (x.n + y.n - p.k)),"""
    + _REACH.format(id="doc_id", nodes="documents")
    + """
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d JOIN comp c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
