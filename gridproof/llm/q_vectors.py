"""op6: near-duplicates among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import vectors
from .common import table


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS MATERIALIZED (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y, a.rid AS p FROM g a JOIN g b ON a.rid <> b.rid AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
      AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x),
c AS (SELECT p, count(*) AS n FROM l GROUP BY p)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM v LEFT JOIN c ON p = rid LEFT JOIN m ON x = vec_id
"""

QUERIES = {"op6_vectors": op6_vectors}
SQLS = {"op6_vectors": SQL}
