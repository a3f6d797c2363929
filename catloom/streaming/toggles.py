"""User collections folded from toggle events, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from catloom.functions.values import case_when


def toggle_rows(events: DataFrame, lists: Mapping[str, str], item) -> DataFrame:
    """(user_id, list_name, item_id) per event; ``lists`` maps event types to list names."""
    name = case_when([(F.col("event_type") == kind, F.lit(label)) for kind, label in lists.items()])
    return events.select("user_id", name.alias("list_name"), item.alias("item_id")).where("list_name is not null")


def fold_toggles(toggles: DataFrame) -> DataFrame:
    """Toggle counts per (user, list, item); an odd count means the item is on the list. Counts of parts of the events add up."""
    return toggles.groupBy("user_id", "list_name", "item_id").agg(F.count("*").alias("toggles"))


def membership(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("toggles") % 2 == 1).drop("toggles")


class SavedLists:
    """Toggle counts of a stream under one folder: a base table and the batches since.

    A batch saves how often each key was toggled in it. Counts of batches add up, so the stream keeps no state of its own, and
    a key that is off its list after a compaction is simply absent. Every ``compact_every`` batches the base and the batches are
    folded into a new base and removed, so the folder does not grow with the number of batches. Each step may be run
    again: a batch replaces itself, a finished base is not built twice, and what a base holds is ignored beside it.
    """

    KEYS = ("user_id", "list_name", "item_id")

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 10):
        self.spark, self.path, self.compact_every = spark, path, compact_every
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind: at most ``compact_every`` and a few."""
        found = []
        for status in self._files.listStatus(self._root) if self._files.exists(self._root) else []:
            name = status.getPath().getName()
            done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith(kind + "=") and self._files.exists(done):
                found.append(int(name.partition("=")[2]))
        return sorted(found)

    def _saved(self) -> tuple[DataFrame | None, list[str]]:
        """Counts of the newest base and the batches after it, and the folders they are in."""
        bases = self._numbers("base")
        after = bases[-1] if bases else -1
        folders = [f"base={after}"] if bases else []
        folders += [f"batch={n}" for n in self._numbers("batch") if n > after]
        rows = None
        for folder in folders:
            part = self.spark.read.parquet(f"{self.path}/{folder}")
            rows = part if rows is None else rows.unionByName(part)
        return rows, folders

    def save(self, batch: DataFrame, number: int) -> None:
        if number in self._numbers("base"):
            return  # the batch is in that base already
        fold_toggles(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if (number + 1) % self.compact_every == 0:
            self.compact(number)

    def compact(self, number: int) -> None:
        """Fold everything up to batch ``number`` into one base; only keys on a list are left."""
        rows, folders = self._saved()
        on = rows.groupBy(*self.KEYS).agg(F.sum("toggles").alias("toggles")).where(F.col("toggles") % 2 == 1)
        on.withColumn("toggles", F.lit(1).cast("long")).write.mode("overwrite").parquet(f"{self.path}/base={number}")
        for folder in folders:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._root, folder), True)

    def lists(self) -> DataFrame:
        """(user_id, list_name, item_id) of all items that are on a list now; raises if nothing was saved yet."""
        rows, _ = self._saved()
        if rows is None:
            raise FileNotFoundError(f"no batch was saved under {self.path}")
        return membership(rows.groupBy(*self.KEYS).agg(F.sum("toggles").alias("toggles")))


def stream_membership(toggles: DataFrame, path: str, checkpoint: str, available_now: bool = True, compact_every: int = 10) -> StreamingQuery:
    """Keep the lists of a toggle stream under ``path``; :class:`SavedLists` reads them back."""
    saved = SavedLists(toggles.sparkSession, path, compact_every)
    writer = toggles.writeStream.foreachBatch(saved.save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
