"""Token output: static range asymmetric numeral system with shared frequencies and interleaved lanes.

A file is a sequence of independent blocks of whole documents. A block is a Parquet row with its document
table, the final state of each lane, 32-bit code words, checkpoints (states and word position at token
offsets) and a checksum of its ids. All blocks share one frequency table, written beside them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catloom.llm.common import arrow_schema, map_batches, to_batches
from catloom.llm.tokens import encoder, texts, vocabulary_path
from catloom.runtime import work_folder

SCALE_BITS = 20  # frequencies sum to 2 ** SCALE_BITS
LOW = np.uint64(1 << 31)  # states live in [LOW, LOW * 2 ** 32)
LANES = 1024
BLOCK_TOKENS = 1 << 20
CHECK_STEPS = 256  # steps of all lanes between checkpoints


def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE_BITS, at least 1 for every id of the vocabulary."""
    spare = (1 << SCALE_BITS) - len(counts)
    if spare < 0:
        raise ValueError("the vocabulary is larger than the frequency scale")
    total = int(counts.sum())
    if not total:
        counts, total = np.ones_like(counts), len(counts)
    shares = counts.astype(np.float64) * (spare / total)
    table = np.floor(shares).astype(np.int64) + 1
    rest = (1 << SCALE_BITS) - int(table.sum())
    table[np.argsort(-(shares - np.floor(shares)), kind="stable")[:rest]] += 1
    return table.astype(np.uint64)


class Codec:
    def __init__(self, table: np.ndarray, lanes: int = LANES):
        self.freq, self.lanes = table, lanes
        self.start = np.concatenate(([0], np.cumsum(table)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(table), dtype=np.uint32), table.astype(np.int64))
        self.fill = int(table.argmax())  # pads the last step

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, list[tuple[int, int, bytes]]]:
        """(states, words, checkpoints) of ids; token k goes to lane k mod lanes.

        Steps run backwards, so that a decoder reads forwards. A checkpoint (step, word position, states)
        lets a decoder begin there.
        """
        steps = -(-len(ids) // self.lanes)
        grid = np.full(steps * self.lanes, self.fill, np.int64)
        grid[: len(ids)] = ids
        grid = grid.reshape(steps, self.lanes)
        state = np.full(self.lanes, LOW, np.uint64)
        chunks: list[np.ndarray] = []
        marks: list[tuple[int, int, bytes]] = []
        emitted = 0
        bits, half = np.uint64(SCALE_BITS), np.uint64(32)
        for step in range(steps - 1, -1, -1):
            freq, start = self.freq[grid[step]], self.start[grid[step]]
            full = (state >> np.uint64(63 - SCALE_BITS)) >= freq
            if full.any():
                chunks.append(state[full].astype("<u4"))  # the low half
                emitted += len(chunks[-1])
                state = np.where(full, state >> half, state)
            quotient = state // freq
            state = (quotient << bits) + (state - quotient * freq) + start
            if step and step % CHECK_STEPS == 0:
                marks.append((step, emitted, state.astype("<u8").tobytes()))
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        return state.astype("<u8").tobytes(), words.tobytes(), [(s, len(words) - e, b) for s, e, b in reversed(marks)]

    def decode(self, states: bytes, words: bytes, n: int, step: int = 0, position: int = 0, until: int | None = None) -> np.ndarray:
        """Ids from ``step`` on (0, or a checkpoint with its word position and states) up to step ``until``."""
        steps = -(-n // self.lanes)
        until = steps if until is None else min(until, steps)
        state = np.frombuffer(states, "<u8").astype(np.uint64)
        code = np.frombuffer(words, "<u4")
        out = np.empty((until - step, self.lanes), np.uint32)
        mask, bits, half = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
        for row in range(until - step):
            slot = state & mask
            symbols = self.symbol[slot.astype(np.int64)]
            out[row] = symbols
            state = self.freq[symbols] * (state >> bits) + slot - self.start[symbols]
            low = state < LOW
            k = int(low.sum())
            if k:
                state[low] = (state[low] << half) | code[position:position + k]
                position += k
        return out.reshape(-1)[: n - step * self.lanes]


def token_table(docs: DataFrame, path: str, end_id: int, id: str, text: str) -> DataFrame:
    """(id, tokens): ids of every whole text with the end id, two or four bytes each."""
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))

    def make():
        own = encoder(path)
        end = np.array([end_id], own.dtype).tobytes()

        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            for row, content in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                yield row, own.packed(content) + end
        return work

    return map_batches(rows, "_id long, tokens binary", make)


def token_counts(tokens: DataFrame, size: int, width: str) -> np.ndarray:
    """How often each id occurs: one row per id and task at most is shuffled, one per id of the vocabulary comes back."""

    def make():
        total = np.zeros(size, np.int64)

        class Count:
            def __call__(self, batch):
                joined = b"".join(batch.column(0).to_pylist())
                total.__iadd__(np.bincount(np.frombuffer(joined, width), minlength=size)[:size])
                return ()

            def close(self):
                used = np.flatnonzero(total)
                return zip(used.tolist(), total[used].tolist(), strict=True)

        return Count()

    counts = np.zeros(size, np.int64)
    for row in map_batches(tokens.select("tokens"), "token long, n long", make).groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row["token"]] = row["n"]
    return counts


BLOCK_FIELDS = (
    "part long, block long, n_tokens long, n_docs long, ids_crc32 long, doc_ids array<long>, doc_tokens array<int>, "
    "states binary, words binary, check_steps array<int>, check_words array<long>, check_states array<binary>"
)


class _Blocks:
    """Encodes runs of whole documents; holds one block."""

    def __init__(self, codec: Codec, width: str, block_tokens: int):
        self.codec, self.width, self.block_tokens = codec, width, block_tokens
        self.ids: list[int | None] = []
        self.parts: list[bytes] = []
        self.held = self.number = 0
        self.part: int | None = None

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        for part, row, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            self.part = part
            self.ids.append(row)
            self.parts.append(tokens)
            self.held += len(tokens) // np.dtype(self.width).itemsize
            if self.held >= self.block_tokens:
                yield self._block()

    def close(self) -> Iterator[tuple]:
        if self.ids:
            yield self._block()

    def _block(self) -> tuple:
        size = np.dtype(self.width).itemsize
        ids = np.frombuffer(b"".join(self.parts), self.width).astype("<u4")
        states, words, marks = self.codec.encode(ids)
        row = (
            self.part, self.number, len(ids), len(self.ids), zlib.crc32(ids.tobytes()), self.ids,
            [len(p) // size for p in self.parts], states, words,
            [m[0] for m in marks], [m[1] for m in marks], [m[2] for m in marks],
        )
        self.ids, self.parts, self.held, self.number = [], [], 0, self.number + 1
        return row


def write_tokens(
    docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2,
    block_tokens: int = BLOCK_TOKENS, lanes: int = LANES, files: int | None = None,
) -> None:
    """Encode every whole text to ``folder``: blocks (ascending id, rows without id first) and the frequencies.

    The ids are made once and kept as Parquet while the frequencies of all of them are counted; then they are
    dealt into ranges of the id, sorted, and encoded block by block. A null or empty text is its end id.
    Rows that repeat an id stand side by side, in order of their tokens.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    own = encoder(path)
    size, width = max(own.size, end_id + 1), own.dtype.str
    tokens_at = f"{work_folder(spark)}/tokens"
    token_table(docs, path, end_id, id, text).write.option("compression", "zstd").parquet(tokens_at)
    tokens = spark.read.schema("_id long, tokens binary").parquet(tokens_at)
    table = frequency_table(token_counts(tokens, size, width))
    spark.createDataFrame([(lanes, table.astype("<u4").tobytes())], "lanes int, freq binary").write.parquet(f"{folder}/table")
    keys = [F.col("_id").asc_nulls_first(), F.col("tokens")]
    n = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = tokens.repartitionByRange(n, F.col("_id").asc_nulls_first()).sortWithinPartitions(*keys)
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "_id", "tokens")
    blocks = map_batches(dealt, BLOCK_FIELDS, lambda: _Blocks(Codec(table, lanes), width, block_tokens))
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_codec(spark, folder: str) -> Codec:
    """The shared table: one row, its size fixed by the vocabulary."""
    row = spark.read.schema("lanes int, freq binary").parquet(f"{folder}/table").first()
    return Codec(np.frombuffer(row["freq"], "<u4").astype(np.uint64), row["lanes"])


def read_tokens(spark, folder: str, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, tokens) decoded from the files; start counts the ids of all documents before it.

    Blocks are decoded in parallel and checked; a wrong checksum raises. Offsets come from the block headers:
    one number per file is summed over the files, the rest within a file.
    """
    codec = read_codec(spark, folder)
    schema = arrow_schema(BLOCK_FIELDS)
    blocks = spark.read.schema(", ".join(f.strip() for f in BLOCK_FIELDS.split(","))).parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.max("block").alias("last")).orderBy("part").collect()
    before, starts = 0, {}
    for row in sizes:  # one row per file
        starts[row["part"]], before = before, before + row["n"]
    places = spark.createDataFrame([(k, v) for k, v in starts.items()] or [(-1, 0)], "_part long, _start long")
    head = blocks.select("part", "block", "n_tokens").alias("h")
    from pyspark.sql import Window

    earlier = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    head = head.select("part", "block", F.coalesce(earlier, F.lit(0)).alias("_local"))
    head = head.join(F.broadcast(places), F.col("part") == F.col("_part")).select(
        F.col("part").alias("_hp"), F.col("block").alias("_hb"), (F.col("_start") + F.col("_local")).alias("first"))
    joined = blocks.join(head, (F.col("part") == F.col("_hp")) & (F.col("block") == F.col("_hb")))
    names = ["first", *schema.names]

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    b = {name: batch.column(k)[i].as_py() for k, name in enumerate(names[:10])}
                    ids = codec.decode(b["states"], b["words"], b["n_tokens"])
                    if zlib.crc32(ids.astype("<u4").tobytes()) != b["ids_crc32"]:
                        raise ValueError(f"block {b['part']}/{b['block']} does not match its checksum")
                    at = 0
                    for row, n in zip(b["doc_ids"], b["doc_tokens"], strict=True):
                        own = ids[at:at + n].astype("<u4").tobytes()
                        yield row, b["first"] + at, n, zlib.crc32(own), own
                        at += n

        yield from to_batches(rows(), out)

    out = arrow_schema("_id long, start long, n_tokens long, ids_crc32 long, tokens binary")
    # Checkpoints are only needed to begin inside a block.
    return joined.select(*names[:10]).mapInArrow(
        run, "_id long, start long, n_tokens long, ids_crc32 long, tokens binary").withColumnRenamed("_id", id)


def read_slice(block: dict, codec: Codec, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of one block, decoded from the nearest checkpoint before ``start``."""
    at = max((i for i, s in enumerate(block["check_steps"]) if s * codec.lanes <= start), default=None)
    step, position, states = (0, 0, block["states"]) if at is None else (
        block["check_steps"][at], block["check_words"][at], block["check_states"][at])
    until = -(-stop // codec.lanes)
    ids = codec.decode(states, block["words"], block["n_tokens"], step, position, until)
    return ids[start - step * codec.lanes: stop - step * codec.lanes]
