"""Shared scratch space, materialised tables and Arrow helpers of the corpus operators.

Lineage is cut by writing Parquet under the folder the cluster names in
``spark.checkpoint.dir``.  Only where that is unset (tests, a laptop) a folder is made
and named there by us.  Nothing is written to executor-local folders.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, set by us only where unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="segspark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that are small beside the input take a task for about TASK_ROWS rows, and
#: LEAST_TASKS where there are fewer rows, however many partitions a shuffle has.
TASK_ROWS, LEAST_TASKS = 1 << 14, 8


def tasks_for(rows: int) -> int:
    return max(LEAST_TASKS, -(-rows // TASK_ROWS))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``max_bytes``.

    Yields (first row, end row, UTF-8 bytes of the run, row offsets within them).  Nulls
    are empty texts; a row longer than ``max_bytes`` is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        lo = hi
