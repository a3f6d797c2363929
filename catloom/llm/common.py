"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catloom.runtime import work_folder

# ASCII white space of the contracts; Python's bytes.split() cuts at exactly these.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows a file of tables whose size is known.
FILE_ROWS = 20_000


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: a lineage cut that outlives executors.

    ``rows`` is about the most that it has or joins; small tables are then written by few tasks into few files.
    """
    if rows is not None:
        df = df.coalesce(max(2, -(-rows // FILE_ROWS)))
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of frames that :func:`stored` made and nothing reads any more."""
    for frame in frames:
        files = frame.inputFiles()
        if files:
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs: its cleaner waits for the driver to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(column: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(key: Column | str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")) % modulus


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_schema(fields: str) -> pa.Schema:
    """'name type' pairs, comma separated, as an Arrow schema."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
        "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(","))])


def map_batches(
    df: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], Iterable]], batch_rows: int | None = None,
) -> DataFrame:
    """Run ``make()`` once per task; what it returns turns an input batch into rows (tuples of ``fields``).

    Memory is bounded: at most ``batch_rows`` (default ``BATCH_ROWS``) output rows are held at a time. If the returned
    object has a ``close`` method, its rows come last.
    """
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()

        def rows():
            for batch in batches:
                yield from work(batch)
            if hasattr(work, "close"):
                yield from work.close()

        yield from to_batches(rows(), schema, batch_rows or BATCH_ROWS)

    return df.mapInArrow(run, fields)


BATCH_ROWS = 8192


def to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(columns, schema, strict=True)], schema=schema
    )


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


# --- Bounded sets of keys, for filters without a shuffle ---------------------------------------


def key_bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bitmap) with one bit per hashed key: at most ``bits`` / 8 bytes, whatever the input."""
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    return keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )


def mark_members(df: DataFrame, key: str, bitmap: DataFrame, bits: int, name: str) -> DataFrame:
    """Add ``name``: false only if ``key`` surely is not in the bitmap. The bitmap's size is bounded, so it is broadcast."""
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    joined = df.withColumn("_place", place).withColumn("_b", F.bitmap_bucket_number("_place"))
    joined = joined.join(F.broadcast(bitmap), F.col("_b") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.bitwise_not(byte).bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_place) % 8 as int))")) == 0
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_place", "_b", "_bucket", "_bits")


def bitmap_bits(keys: int) -> int:
    """Bits for a bitmap of so many keys: 16 each, from 2^15 to 2^27 (16 MB)."""
    return 1 << min(27, max(15, (16 * keys).bit_length()))


# --- Rows told apart by id and text -------------------------------------------------------------


def row_key(id: str, text: str) -> tuple[Column, Column]:
    """_id and _h, a hash of the text: rows that share both are copies of one row."""
    return F.col(id).cast("long").alias("_id"), F.xxhash64(text_of(text)).alias("_h")


def _parted(docs: DataFrame, keys: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (_doc, _id, _h): the rows that surely are not in ``keys`` (_id, _h), and those that may be.

    A bitmap of the keys is tested in the scan, so only rows that may be in them need to be exchanged.
    """
    bits = bitmap_bits(keys.count())
    key = F.xxhash64("_id", "_h")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *row_key(id, text)).withColumn("_k", key)
    marked = mark_members(packed, "_k", key_bitmap(keys.select(key.alias("_k")), "_k", bits), bits, "_in").drop("_k")
    return marked.where(~F.col("_in")).drop("_in"), marked.where("_in").drop("_in")


def drop_rows(docs: DataFrame, dropped: DataFrame, id: str, text: str) -> DataFrame:
    """``docs`` without the rows whose (_id, _h) is in ``dropped``; same columns. Rows without id stay: nothing can name them."""
    dropped = stored(dropped.where("_id is not null").distinct())
    others, maybe = _parted(docs, dropped, id, text)
    return others.select("_doc").unionByName(maybe.join(dropped, ["_id", "_h"], "left_anti").select("_doc")).select("_doc.*")


def settle_rows(docs: DataFrame, fates: DataFrame, id: str, text: str) -> DataFrame:
    """``docs`` as ``fates``, with one row for each (_id, _h) in it, has it; same columns.

    Rows of a fate that is not ``kept`` go, of the others one row stays, however often it is repeated. A null ``_id`` names the
    rows without id. Of repeated rows whose other columns differ, the first as JSON stays.
    """
    fates = stored(fates)
    others, maybe = _parted(docs, fates, id, text)
    named = fates.select(F.col("_id").alias("_i"), F.col("_h").alias("_t"), "kept")
    met = maybe.join(named, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_t")), "left")
    one = met.where("kept").groupBy("_id", "_h").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
    kept = others.select("_doc").unionByName(met.where("kept is null").select("_doc")).unionByName(one.select("_doc"))
    return kept.select("_doc.*")
