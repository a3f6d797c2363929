"""Resumable processing of arriving work items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def process_new_items(todo: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to each item once; the checkpoint remembers what was read.

    A batch is written under its own number, so a batch repeated after a failure replaces itself.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return todo.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
