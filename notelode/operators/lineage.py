"""Cutting lineage in a place that survives lost executors."""

from __future__ import annotations

import gc
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Codec of tables that hold texts.
PACKED = "zstd"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session, as in tests, gets a folder of its own; a cluster is refused.
    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have cut frames deleted when unused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="notelode-checkpoint-")
    context.setCheckpointDir(configured)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, folder: str) -> DataFrame:
    """The same rows from a table written at ``folder``: each reader takes only the columns it needs.

    For wide frames that are read more than once; ``folder`` is a ``shared_folder``, which ``forget`` deletes.
    """
    df.write.option("compression", PACKED).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a settled table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Have the driver look for plans that nothing refers to any more: their shuffle files are deleted then.

    It looks only when its memory fills up otherwise, so a run of large steps would keep the files of all.
    """
    gc.collect()
    spark._jvm.System.gc()
