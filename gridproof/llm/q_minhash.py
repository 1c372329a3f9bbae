"""op9: near-duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import minhash
from .common import table


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, md5_number(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM (SELECT p.rid AS p, q.rid AS q, count(*) AS c FROM s p JOIN s q USING (h) WHERE p.rid <> q.rid GROUP BY 1, 2) o
      JOIN n np ON np.rid = p JOIN n nq ON nq.rid = q JOIN w a ON a.rid = p JOIN w b ON b.rid = q WHERE 100 * c >= 75 * (np.n + nq.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM w LEFT JOIN n USING (rid) LEFT JOIN m ON x = doc_id
"""

QUERIES = {"op9_minhash": op9_minhash}
SQLS = {"op9_minhash": SQL}
