"""Reading the given tables for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one given table; workers get the package, so Arrow functions can import it."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text read as empty; other columns are left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def measured(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for a broadcast if it has at most ``most`` rows; beyond that Spark joins as it sees fit."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def give_back() -> None:
    """Returns this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A batch function whose worker gives its free memory back when the task ends.

    Spark keeps Python workers for later tasks; without this each idle one holds what its largest
    batch took, beside the executor's own memory.
    """

    @wraps(run)
    def out(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args)
        finally:
            give_back()

    return out
