"""op13: token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokencounts
from .common import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencounts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op13_token_counts": op13_token_counts}
SQLS: dict[str, str] = {}
