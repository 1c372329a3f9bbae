"""The corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet into the
shared folder and reads them again for the next.

Defined cases, beside those of the operators: a null text passes all filters and stays null until
it is packed as an empty one; rows with a null id are never taken for copies; of rows that share an
id one stays, the one with the least text; a document whose words all repeat elsewhere stays with
an empty text; n_chars follows the text where a stage changes it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.llm import minhash, packing, secrets, substrings, toxicity
from gridproof.llm.common import discard, quoted, small_batches, table, unused, written

VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model predicts toxic go."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id."""
    small_batches(spark)
    return minhash.representatives(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur elsewhere go."""
    small_batches(spark)
    total, gone = unused(docs, "n_words"), unused(docs, "n_removed")
    done = substrings.cut(docs, n_words=total, n_removed=gone)
    return _counted(docs, done, F.col(gone) > 0)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials of few owners are replaced by a mark."""
    small_batches(spark)
    changed = unused(docs, "changed")
    return _counted(docs, secrets.redact(docs, changed=changed), F.col(changed))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of windows of several lengths."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


def _counted(docs: DataFrame, done: DataFrame, changed: Column) -> DataFrame:
    """The columns of ``docs`` with n_chars after the text where it changed."""
    n = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n).select(*map(quoted, docs.columns))


STAGES = [("toxicity", drop_toxic), ("minhash", drop_copies), ("substrings", drop_passages), ("secrets", hide_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
