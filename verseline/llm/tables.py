"""Intermediate tables in the shared checkpoint folder, and column hygiene."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="verseline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: bytes of rows that a Python worker gets at once, unless the session says otherwise
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches where the session has the default of 64 MB: operators work row by row or on
    slices, so larger ones only cost memory, on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, BATCH_BYTES)


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it holds
        return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function over batches, that gives free memory back to the system when its task ends: workers are used again
    by later tasks, and what the allocators of one keep is missing to the others of its executor."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return each


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts lineage: what is read later does not depend on any executor's
    local disk.  The table goes with ``sweep``, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verseline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def held() -> int:
    """How many intermediate tables there are; a place for ``sweep`` to start or end at."""
    return len(_made)


def sweep(start: int = 0, end: int | None = None) -> None:
    """Deletes the intermediate tables made between two places; nothing that reads them may be read any more."""
    end = len(_made) if end is None else end
    for spark, path in _made[start:end]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _made[start:end]


@atexit.register
def _at_exit() -> None:
    try:
        sweep()
    except Exception:  # the session is gone: nothing to sweep with
        return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of df's (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
