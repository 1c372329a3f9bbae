"""op12: clusters of all embeddings about sixteen centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters
from .common import table


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def _nearest(k: int) -> str:
    """Rows with their nearest of the centroids ``c{k}``."""
    return f"""a{k} AS MATERIALIZED (SELECT rid, vec_id, x, k, c, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
      FROM v, c{k} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""


def _means(k: int) -> str:
    """The centroids after round ``k``."""
    return f"""s{k} AS MATERIALIZED (SELECT k, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM (SELECT k, x, unnest(range(1, 65)) AS i FROM a{k - 1}) GROUP BY k, i),
m{k} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY k),
c{k} AS MATERIALIZED (SELECT k, coalesce(m{k}.c, o.c) AS c FROM c{k - 1} o LEFT JOIN m{k} USING (k))"""


SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < 16),
{", ".join(f"{_nearest(r)}, {_means(r + 1)}" for r in range(clusters.ROUNDS))},
{_nearest(clusters.ROUNDS)}
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{clusters.ROUNDS}
"""

QUERIES = {"op12_centroids": op12_centroids}
SQLS = {"op12_centroids": SQL}
