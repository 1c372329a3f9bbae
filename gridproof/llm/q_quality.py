"""op3: the quality ledger over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import table

POLICY = quality.LATEST


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), POLICY)
    return book.select("doc_id", *quality.MEASURES[:5], quality.fails("base").alias("base_failed"), "kept", "fail_bits", "policy")


_BITS = " | ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, rule in enumerate(quality.RULES.values()))

SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM t),
p AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_bangs
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {quality.mask("base")}) <> 0 AS base_failed, (fail_bits & {quality.mask(POLICY)}) = 0 AS kept, fail_bits, '{POLICY}' AS policy
FROM b
"""



def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of the policy: documents that break it, and those that it alone rejects."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")), POLICY)


_MASK = quality.mask(POLICY)
_EACH = ", ".join(f"('{rule}', {1 << list(quality.RULES).index(rule)})" for rule in quality.POLICIES[POLICY])
ABLATION = f"SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_fail, count(*) FILTER (fail_bits & {_MASK} = bit)::BIGINT AS n_only FROM ({SQL}) CROSS JOIN (VALUES {_EACH}) r(rule, bit) GROUP BY rule"

QUERIES = {"op3_quality_rules": op3_quality_rules, "quality_ablation": quality_ablation}
SQLS = {"op3_quality_rules": SQL, "quality_ablation": ABLATION}
