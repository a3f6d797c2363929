"""Session-level helpers: durable lineage cuts and size checks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A dimension of up to this estimated size may be broadcast; Spark decides about all others.
BROADCAST_BYTES = 8 * 1024 * 1024
_SHIPPED: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session may fall back to /tmp."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-catloom-", dir="/tmp")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so loops stay short and a lost executor costs no restart."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows ahead of costly work on each: by bytes they would fill a few tasks, so they are dealt to four per core.

    The number is stated, which keeps adaptive execution from joining the parts again. A task streams its rows.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def fits_bytes(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True when the optimizer's estimate of ``df`` is at most ``limit`` bytes; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, so that they need no copy of the repository."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-ship-")), "catloom")
    context.addPyFile(shutil.make_archive(base, "zip", top, "catloom"))


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach, next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/work-{uuid.uuid4()}"
