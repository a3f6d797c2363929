"""Record files, merged tables, file inventories and dictionaries."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from catloom.operators.rank import rank_rows
from catloom.runtime import cut_lineage
from catloom.sources.json_array import read_json_array
from catloom.sources.schemas import ENTITIES


def read_source_records(spark: SparkSession, root: str, sources: Sequence[str], entity: str, multiline: bool = True) -> DataFrame:
    """Records of all sources in priority order; a missing file counts as empty.

    Adds source_name, source_rank and seq, a total order by rank, file and position in it, whatever
    the cores and split sizes. JSON arrays need ``multiline``, which cuts them into objects by :func:`read_json_array`; JSON
    lines (``write_records``) are read with ``multiline=False``. Both are split over tasks like any text.
    """
    schema = ENTITIES[entity]
    merged = spark.createDataFrame([], schema).select("*", F.lit("").alias("source_name"), F.lit(0).alias("source_rank"), F.lit(0).cast("long").alias("seq"))
    for rank, source in enumerate(sources):
        path = f"{root}/{source}/{entity}*"
        try:
            if multiline:
                placed = read_json_array(spark, path, schema).withColumnRenamed("_at", "_row")
            else:
                rows = spark.read.schema(schema).json(path)
                # Blocks of a file and rows of a block come in file order however the file is split.
                placed = rows.select(
                    "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_row"))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        ranked = rank_rows(placed, [F.col("_path"), F.col("_block"), F.col("_row")], name="_place")
        tagged = ranked.select(
            *schema.names, F.lit(source).alias("source_name"), F.lit(rank).alias("source_rank"),
            (F.lit(rank).cast("long") * F.lit(1 << 56) + F.col("_place") - 1).alias("seq"),
        )
        merged = merged.unionByName(tagged)
    return merged


def write_records(df: DataFrame, root: str, source: str, entity: str) -> None:
    """JSON lines without null fields, replaced as a whole."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(f"{root}/{source}/{entity}")


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


CHUNK = 1 << 20
#: Files in one folder, and paths that a task lists or digests.
FOLDER_FILES, TASK_FILES = 1000, 2000


def _locate(path: str) -> tuple[FileSystem, str]:
    """The file system that a path names, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return LocalFileSystem(), "/" + rest.lstrip("/")
    return FileSystem.from_uri(quote(path, safe="/:@=+,"))


def _rooted(spark: SparkSession, root: str) -> str:
    """``root`` with a scheme; a path without one belongs to the default file system."""
    if ":" in root:
        return root
    base = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return ("file:" if base.startswith("file:") else base.rstrip("/")) + os.path.abspath(root)


def write_texts(df: DataFrame, root: str, name: str, text: str) -> None:
    """One file ``name``.txt below ``root`` for each row, by the tasks themselves, at most ``FOLDER_FILES`` in a folder.

    A folder belongs to one task, so equal names stay apart and the driver moves no file; a task that is tried again writes the
    same files again. A null name is the empty one.
    """
    top = _rooted(df.sparkSession, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _locate(top)
        task, done, names = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if done % FOLDER_FILES == 0:
                    base, names = f"{inner}/{task}-{done // FOLDER_FILES}", set()
                    system.create_dir(base)
                folder = base
                if own in names:
                    folder = f"{base}/{done}"
                    system.create_dir(folder)
                names.add(own)
                with system.open_output_stream(f"{folder}/{own or ''}.txt") as stream:
                    stream.write(content or b"")
                done += 1
        yield pa.RecordBatch.from_pydict({"files": [done]}, schema=pa.schema([("files", pa.int64())]))

    df.select(F.col(name), F.col(text)).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each folder; a folder that is gone has none."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            system, inner = _locate(folder)
            entries = system.get_file_info(FileSelector(inner, allow_not_found=True))
            entries = [e for e in entries if e.type in (FileType.File, FileType.Directory)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{folder.rstrip('/')}/{e.base_name}" for e in entries], pa.string()), pa.array([e.base_name for e in entries], pa.string()),
                    pa.array([e.size if e.is_file else None for e in entries], pa.int64()), pa.array([e.mtime for e in entries], pa.timestamp("us", tz="UTC")),
                ], names=["path", "name", "size", "modified"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MD5 of each file, read in chunks; a file that is gone has none."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            digest = hashlib.md5(usedforsecurity=False)
            system, inner = _locate(path)
            try:
                with system.open_input_stream(inner) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                found.append(digest.hexdigest())
            except FileNotFoundError:
                found.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "digest"])


def file_inventory(spark: SparkSession, root: str, ignore: Sequence[str] = (".DS_Store",), digest: bool = True) -> DataFrame:
    """path, name, size, modified and MD5 of every file below ``root``, empty and hidden ones included.

    Tasks list folders level by level, so the driver never holds the names, and then digest their files chunk by chunk, so
    a file may be larger than the memory. ``digest`` may be left out. Works on the file systems that Arrow opens (local, HDFS,
    S3, GCS); a path without a scheme belongs to the default one.
    """
    root = _rooted(spark, root)
    entries = "path string, name string, size long, modified timestamp"
    folders = spark.createDataFrame([(root,)], "path string")
    levels: list[DataFrame] = []
    while not folders.isEmpty():
        levels.append(cut_lineage(_by_path(folders).mapInArrow(_children, entries)))
        folders = levels[-1].where("size is null").select("path")
    listed = spark.createDataFrame([], entries)
    for level in levels:
        listed = listed.unionByName(level.where("size is not null"))
    listed = listed.where(~F.col("name").isin(list(ignore)))
    if not digest:
        return listed
    return _by_path(listed).mapInArrow(_digests, entries + ", digest string")


def _by_path(paths: DataFrame) -> DataFrame:
    """Paths dealt to tasks by their number: names are short, so by bytes all would share one task."""
    cores = paths.sparkSession.sparkContext.defaultParallelism
    return paths.repartition(max(cores, -(-paths.count() // TASK_FILES)), "path")


def read_dimension(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A dictionary table (aliases, countries, price book, price index, exchange rates) from JSON lines."""
    return spark.read.schema(columns).json(path)


# Column lists of the dictionaries.
DIMENSIONS = {
    "alias": "alias string, canonical string",
    "country": "canonical string, country string",
    "prefix": "ord int, prefix string, brand string",
    "price_book": "manufacturer string, pattern string, price double, currency string, year int, ord int",
    "cpi": "year int, cpi double",
    "fx": "currency string, year int, rate double",
    "date_fix": "brand string, name string, start int, end int",
    "allowed_pair": "brand string, other string",
}


def remaining_work(todo: DataFrame, done: DataFrame, key: str, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Open items in order, skipping ids already done."""
    open_items = todo.join(done.select(key), key, "left_anti").orderBy(*order)
    return open_items if limit is None else open_items.limit(limit)
