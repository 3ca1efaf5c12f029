"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from .bpe import op9_bpe
from .embedding_dedup import op1_embedding_dedup
from .katz import op10_katz
from .mixing import op8_mixing
from .pii import op6_pii
from .repair import op2_repair
from .secrets import op7_secrets
from .simhash import op3_simhash
from .topk import op5_topk
from .toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_repair, op3_simhash, op4_toxicity, op5_topk, op6_pii, op7_secrets, op8_mixing, op9_bpe, op10_katz)
}

_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op5_topk": _OP5}
