"""What the operators of this folder share: session settings, sizes, and frames with one column replaced or filtered."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.session import tune
from lumicat.sources.snapshots import stage

__all__ = ["chosen", "fanout", "filter_rows", "ready", "release", "rows_of", "stage", "table"]

#: Rows of one Arrow batch. Texts are whole, so a batch holds that many texts.
BATCH_ROWS = "512"


def ready(spark: SparkSession) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fanout(spark: SparkSession) -> int:
    """Partitions for rows that are dealt out by hand: what the session uses for its own shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def release() -> None:
    """Give memory that a task no longer needs back to the system: its Python worker goes on with other tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)


def rows_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and no others: extra columns never meet the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def chosen(batches: Iterator, at: int, keep: Callable[[pa.Array], Iterator]) -> Iterator:
    """The rows of batches whose column ``at`` passes: for tasks that go on with them at once. ``filter_rows`` before them would take a
    second Python worker a task."""
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))


def filter_rows(df: DataFrame, column: str, keep: Callable[[pa.Array], Iterator]) -> DataFrame:
    """The rows whose ``column`` passes, all columns as they are. ``keep`` gets the column of a batch and gives a mask for it."""
    at = df.columns.index(column)

    return df.mapInArrow(lambda batches: chosen(batches, at, keep), df.schema)
