"""The incremental index run as a micro-batch sink.

Each micro-batch holds notes that appeared or changed; it goes through the same joins as a
batch run. Files missing from a micro-batch are not removed, unlike in a full run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..models import ModelClient
from ..operators.lineage import cut
from ..plans.index_run import index_notes
from ..sources.store import NoteStore


def index_stream(
    notes: DataFrame, store: NoteStore, client: ModelClient, checkpoint: str,
    config: Config | None = None,
) -> StreamingQuery:
    """Index a stream of ``file_path, mtime, markdown``; a replayed batch changes nothing."""

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        newest = cut(
            batch.groupBy("file_path").agg(
                F.max("mtime").alias("mtime"), F.max_by("markdown", "mtime").alias("markdown")
            )
        )
        index_notes(store, newest, client, config, whole=False)

    return (
        notes.writeStream.foreachBatch(index_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
