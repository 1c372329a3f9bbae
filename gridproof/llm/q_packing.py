"""op1: all documents packed into windows of several lengths."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import packing
from .common import table

VOCABULARY = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op1_packing": op1_packing}
SQLS: dict[str, str] = {}
