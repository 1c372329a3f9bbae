"""op8: the language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import langid
from .common import table


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs, ~langid.held_out()))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op8_langid": op8_langid}
SQLS: dict[str, str] = {}
