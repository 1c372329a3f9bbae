"""op10: repeated windows of 35 words removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substrings
from .common import SPACE, table, text_or_empty


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # texts that lost nothing still have their white space
    kept = F.array_join(F.filter(F.split(text_or_empty(), f"{SPACE}+"), lambda w: w != ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.when(F.col("n_removed") > 0, F.col("text")).otherwise(kept), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
h AS (SELECT rid, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
d AS (SELECT rid, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM d),
x AS (SELECT rid, list(k) AS gone FROM c GROUP BY rid),
k AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE w[1:0] END AS whole, rid FROM w LEFT JOIN x USING (rid)),
l AS (SELECT w.rid, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) w
      ANTI JOIN c ON w.rid = c.rid AND w.i = c.k GROUP BY w.rid)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN l USING (rid)
"""

QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQLS = {"op10_substring_dedup": SQL}
