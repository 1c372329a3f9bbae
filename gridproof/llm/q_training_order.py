"""op5: all documents as binary shards in training order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import training_order
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).drop("path")


QUERIES = {"op5_training_order": op5_training_order}
SQLS: dict[str, str] = {}
