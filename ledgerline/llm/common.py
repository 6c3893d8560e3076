"""Shared helpers of the training-data operators: scratch tables, word rule, batch size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_path, shared_dir  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch. Texts can be long, so batches are kept short to bound a worker's memory.
BATCH_ROWS = 512


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the Arrow batch size unless the caller has set one."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def n_words(text: str):
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def release_memory() -> None:
    """Gives freed pages back to the system: workers are reused, and would keep the peak of every task they have run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
