"""The resumable run fed by a stream of field rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridproof.operators.metrics import Metric
from gridproof.plans.validate import Aggregation, Store


def follow(fields: DataFrame, store: Store, metrics: Sequence[Metric], aggregations: Sequence[Aggregation], checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop. Rows of one date may come in several batches, in any order: a
    date is made anew from all its rows when more of them come. A batch that runs again adds nothing."""
    of = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(batch, f"{of}-{number:012d}", metrics, aggregations)

    return fields.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
