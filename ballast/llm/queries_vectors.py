"""Queries 4 and 8: near-duplicate vectors and exact top-k search."""
from __future__ import annotations

from pyspark.sql import functions as F

from ballast.llm.embedding_dedup import near_duplicates
from ballast.llm.knn_join import top_k
from ballast.llm.registry import query, table

DEDUP_SQL = """
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

TOP_SQL = """
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM vecs q JOIN vecs d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op4_embedding_dedup", DEDUP_SQL)
def embedding_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "embeddings"), 0.98)


@query("op8_top_k", TOP_SQL)
def top_20(spark, sf):
    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64)
