"""Small tables that are read beside a stored table of texts, task by task.

What a job finds out about some rows of a table of texts goes to the task that reads those rows
again, in place of all texts to what was found out: rows are numbered by input task and place, side
tables are stored by task in the shared folder, and a task opens its own part alone. So no text is
shuffled and nothing is broadcast.

The table must give each task the same rows when it is read again, as a stored table does. Each part
of a side table ends with a mark of how many rows its task had; a task that meets another number
raises an error, so a changed input is never answered wrongly."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir

#: Bits of a row number below the task's number.
SHIFT = 33


class Places:
    """Numbers of the rows of the running task, in the order in which it meets them."""

    def __init__(self) -> None:
        self.task = TaskContext.get().partitionId()
        self.start = self.next = self.task << SHIFT

    def take(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next)


def ends(numbered: DataFrame, row: str = "row") -> DataFrame:
    """The end mark of each task: the number after that of its last row."""
    return numbered.groupBy(_task(row).alias("task")).agg((F.max(row) + 1).alias(row)).select(row)


def _task(row: str) -> Column:
    return F.shiftright(row, SHIFT).cast("int")


def put(rows: DataFrame, name: str, row: str = "row") -> str:
    """Store ``rows``, which hold the end marks, by task; the folder."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.withColumn("task", _task(row)).repartition("task").sortWithinPartitions("task", row).write.partitionBy("task").parquet(path)
    return path


class Beside:
    """A side table's part for the running task. ``places`` numbers the rows that are read beside it."""

    def __init__(self, path: str, places: Places, row: str = "row"):
        self.places = places
        store, base = fs.FileSystem.from_uri(path)
        found = store.get_file_info(fs.FileSelector(f"{base}/task={places.task}", allow_not_found=True))
        parts = [pq.ParquetFile(store.open_input_file(f.path)).read() for f in found if f.path.endswith(".parquet")]
        self.table = pa.concat_tables(parts).sort_by(row) if parts else None
        self.row = self.table[row].to_numpy() if parts else np.zeros(0, np.int64)

    def of(self, rows: np.ndarray) -> tuple[int, int]:
        """Where the entries of consecutive rows begin and end in the table."""
        lo, hi = np.searchsorted(self.row, [rows[0], rows[-1] + 1])
        return int(lo), int(hi)

    def close(self) -> None:
        """To be called when the task has met all its rows."""
        told = int(self.row[-1]) if len(self.row) else self.places.start
        if told != self.places.next:
            raise RuntimeError(f"task {self.places.task} met {self.places.next - self.places.start} rows and {told - self.places.start} before: the input changed between two passes")


def chosen(docs: DataFrame, path: str, keep: bool = True, number: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the side table at ``path`` lists (or, without ``keep``, the others).

    ``number``: name of a further column with the row number."""
    schema = docs.schema if number is None else T.StructType([*docs.schema, T.StructField(number, T.LongType())])

    def run(batches):
        places = Places()
        beside = Beside(path, places)
        for batch in batches:
            if batch.num_rows:
                rows = places.take(batch.num_rows)
                lo, hi = beside.of(rows)
                listed = np.zeros(len(rows) + 1, bool)
                listed[beside.row[lo:hi] - rows[0]] = True
                if number is not None:
                    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows)], schema.names)
                yield batch.filter(pa.array(listed[:-1] == keep))
        beside.close()

    return docs.mapInArrow(run, schema)
