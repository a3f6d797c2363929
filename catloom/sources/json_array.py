"""One large JSON array, read by many tasks: object borders are found from block summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

# A piece is what lies between two closing braces; only quotes, escapes and opening braces matter inside it.
_TOKEN = re.compile(r'\\.|["{]', re.DOTALL)


def scan(piece: str, quoted: bool, depth: int) -> tuple[bool, int, int | None]:
    """State after ``piece`` (inside a string?, open objects), and where an object of depth one begins in it."""
    start = None
    for token in _TOKEN.finditer(piece):
        mark = token.group()
        if mark == '"':
            quoted = not quoted
        elif mark == "{" and not quoted:
            if depth == 0:
                start = token.start()
            depth += 1
    return quoted, depth, start


def _blocks(batches: Iterator[pa.RecordBatch], begin, row, end) -> Iterator:
    """Run ``begin`` at the first piece of each block, ``row`` at each, ``end`` after the last."""
    name, work = None, None
    for batch in batches:
        for values in batch.to_pylist():
            if (values["_path"], values["_block"]) != name:
                if work is not None:
                    yield from end(work)
                name, work = (values["_path"], values["_block"]), begin(values)
            yield from row(work, values)
    if work is not None:
        yield from end(work)


def _rows_out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 1024:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)


SUMMARY = pa.schema([("_path", pa.string()), ("_block", pa.int64()), *[(f"{c}{s}", t) for s in "01" for c, t in (("q", pa.bool_()), ("d", pa.int32()))]])
START = pa.schema([("_path", pa.string()), ("_block", pa.int64()), ("_quoted", pa.bool_()), ("_depth", pa.int32())])
PARTS = pa.schema([("_path", pa.string()), ("_block", pa.int64()), ("_at", pa.int64()), ("_kind", pa.string()), ("_text", pa.string())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block does to the state before it, for a start outside of strings (0) and inside of one (1)."""

    def row(work, values):
        for state in work[1]:
            state[0], state[1], _ = scan(values["_piece"], *state)
            state[1] -= not state[0]
        return ()

    begin = lambda v: ((v["_path"], v["_block"]), [[False, 0], [True, 0]])
    end = lambda work: [(*work[0], *work[1][0], *work[1][1])]
    yield from _rows_out(_blocks(batches, begin, row, end), SUMMARY)


def _starts(table: pa.Table) -> pa.Table:
    """State at the start of each block of one file: a fold over its summaries, a few bytes a block."""
    quoted, depth, out = False, 0, []
    for r in table.sort_by("_block").to_pylist():
        out.append((r["_path"], r["_block"], quoted, max(0, depth)))
        depth += r["d1"] if quoted else r["d0"]
        quoted = r["q1"] if quoted else r["q0"]
    return pa.Table.from_batches([_batch(out, START)], START)


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole objects of a block, the end of one begun before it (tail), the start of one that goes on (head), or all of it (middle)."""

    def begin(v):
        return {"key": (v["_path"], v["_block"]), "quoted": v["_quoted"], "depth": v["_depth"], "open": v["_depth"] > 0, "text": [], "n": 0}

    def row(w, values):
        piece, before = values["_piece"], w["depth"]
        w["quoted"], w["depth"], start = scan(piece, w["quoted"], before)
        if before > 0:
            w["text"].append(piece)
        elif start is not None:
            w["text"] = [piece[start:]]
        closing = not w["quoted"]
        if w["depth"] > 0:
            w["text"].append("}")
            if closing:
                w["depth"] -= 1
                if w["depth"] == 0:
                    yield (*w["key"], w["n"], "tail" if w["open"] else "whole", "".join(w["text"]))
                    w["open"], w["text"], w["n"] = False, [], w["n"] + 1

    def end(w):
        if w["text"]:
            yield (*w["key"], w["n"], "middle" if w["open"] else "head", "".join(w["text"]))

    yield from _rows_out(_blocks(batches, begin, row, end), PARTS)


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects of JSON array files, with _path, _block and _at, their order in the file.

    A file is split like any text, with the closing brace as the line end. Whether a block starts inside a string, and how many
    objects are open there, follows from two summaries per block (for either start); a fold over a file's summaries, a few bytes
    a block, gives every block its start. Objects inside a block are cut out there; the parts of those that cross a border,
    at most two a block, are joined. Objects on a level of their own are read whatever surrounds them, so JSON lines and
    single objects are fine too. An object that does not parse has null fields.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    pieces = lines.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("_piece"))
    starts = pieces.mapInArrow(_summaries, _sql(SUMMARY)).groupBy("_path").applyInArrow(_starts, _sql(START))
    placed = pieces.join(starts, ["_path", "_block"]).sortWithinPartitions("_path", "_block", "_row")
    parts = placed.mapInArrow(_objects, _sql(PARTS))
    whole = parts.where("_kind = 'whole'").select("_path", "_block", "_at", "_text")
    # Fewer than two parts a block; the n-th head of a file and what follows it are one object.
    line = Window.partitionBy("_path").orderBy("_block", "_at")
    cut = parts.where("_kind <> 'whole'").withColumn("_object", F.count_if(F.col("_kind") == "head").over(line))
    joined = cut.groupBy("_path", "_object").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_at", "_text"))).alias("_parts"))
    first = F.element_at("_parts", 1)
    crossing = joined.select(
        "_path", first["_block"].alias("_block"), first["_at"].alias("_at"), F.array_join(F.transform("_parts", lambda p: p["_text"]), "").alias("_text"))
    parsed = whole.unionByName(crossing).select("_path", "_block", "_at", F.from_json("_text", schema).alias("_value"))
    return parsed.select("_path", "_block", "_at", "_value.*")
