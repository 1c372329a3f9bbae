"""op4: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import table


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQLS: dict[str, str] = {}
