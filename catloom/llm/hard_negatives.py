"""Hard negatives by a vertical scan: one dimension after the other, the anchor's largest first, bounds on the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from catloom.llm.common import arrow_schema, stored, to_batches
from catloom.llm.vectors import all_blocks, block_count, block_of, is_finite, matrix
from catloom.operators.rank import top_per_group

STEP = 8  # dimensions read between two prunings
ANCHORS_AT_ONCE = 4096
_LONG = (1 << 63) - 1


class Columns:
    """A block of rows stored by dimension, with the least and the largest value of each."""

    def __init__(self, rows: np.ndarray):
        self.columns = np.ascontiguousarray(rows.T)
        self.low = self.columns.min(axis=1) if len(rows) else np.zeros(len(self.columns), rows.dtype)
        self.high = self.columns.max(axis=1) if len(rows) else self.low


def safe_type(*tables: np.ndarray) -> type:
    """The narrowest type in which no inner product of rows of these tables can overflow."""
    largest = [max((abs(int(t.min())), abs(int(t.max()))), default=0) if t.size else 0 for t in tables]
    bound = largest[0] * largest[-1] * max((t.shape[1] for t in tables), default=0)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object


def vertical_scan(
    block: Columns, anchor: np.ndarray, eligible: np.ndarray, windows: list[tuple[int | None, int | None]], k: int,
    order: np.ndarray, step: int = STEP,
) -> list[list[tuple[int, int]]]:
    """For each window of scores (ends included, None: open) the first ``k`` eligible rows in it, as (row, score).

    Higher scores come first, ties by ``order`` (a rank of the rows). Dimensions are read in descending magnitude of
    the anchor. What the unread ones can still add lies between two sums of their minima and maxima; a row stays in
    the bitmap while it may end in a window and may still be among the first k of the rows that surely end there.
    """
    if block.columns.dtype == object:  # scores may leave the range of a long: they are computed in full and end there
        alive = np.flatnonzero(eligible)
        exact = sum((a * c[alive] for a, c in zip(anchor, block.columns, strict=True)), np.zeros(len(alive), object))
        score = np.array([_saturated(s) for s in exact], np.int64)
        return [_first(alive, score, window, k, order) for window in windows]
    dims = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack((anchor * block.low, anchor * block.high))
    zero = np.zeros(1, ends.dtype)
    least = np.concatenate((np.cumsum(ends.min(axis=0)[dims][::-1])[::-1], zero))
    most = np.concatenate((np.cumsum(ends.max(axis=0)[dims][::-1])[::-1], zero))
    alive = np.flatnonzero(eligible)
    score = np.zeros(len(alive), block.columns.dtype)
    for start in range(0, len(dims), step):
        for d in dims[start:start + step]:
            column = block.columns[d]
            score = score + anchor[d] * (column if len(alive) == len(column) else column[alive])
        read = min(start + step, len(dims))
        low, high = score + least[read], score + most[read]
        bitmap = np.zeros(len(alive), bool)
        for lower, upper in windows:
            may, sure = np.ones(len(alive), bool), np.ones(len(alive), bool)
            if lower is not None:
                may &= high >= lower
                sure &= low >= lower
            if upper is not None:
                may &= low <= upper
                sure &= high <= upper
            sure_low = low[sure]
            if len(sure_low) > k:
                may &= high >= np.partition(sure_low, len(sure_low) - k)[len(sure_low) - k]
            bitmap |= may
        if not bitmap.all():
            alive, score = alive[bitmap], score[bitmap]
        if not len(alive):
            break
    return [_first(alive, score, window, k, order) for window in windows]


def _first(rows: np.ndarray, scores: np.ndarray, window: tuple[int | None, int | None], k: int, order: np.ndarray) -> list[tuple[int, int]]:
    lower, upper = window
    inside = np.ones(len(rows), bool)
    if lower is not None:
        inside &= scores >= lower
    if upper is not None:
        inside &= scores <= upper
    rows, scores = rows[inside], scores[inside]
    return [(int(rows[i]), int(scores[i])) for i in np.lexsort((order[rows], ~scores))[:k]]


def _saturated(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def _block(table: pa.Table, width: int) -> tuple[Columns, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, keys, labels = (table.column(c).to_numpy() for c in ("_id", "_key", "_label"))
    order = np.empty(len(ids), np.int64)
    order[np.lexsort((keys, ids))] = np.arange(len(ids))
    return matrix(table.column("_v"), width), ids, keys, labels, order


def _scan(rows: pa.Table, anchors: pa.Table, schema: pa.Schema, search) -> Iterator[pa.RecordBatch]:
    """Run ``search`` for every anchor of a cell against the cell's rows."""
    if not len(rows) or not len(anchors):
        return pa.Table.from_batches([], schema)
    own = matrix(anchors.column("_v"))
    width = max(own.shape[1], matrix(rows.column("_v")).shape[1])
    own = matrix(anchors.column("_v"), width)
    data, ids, keys, labels, order = _block(rows, width)
    kind = safe_type(data, own)
    block, own = Columns(data.astype(kind)), own.astype(kind)

    def found():
        for number, anchor in enumerate(anchors.drop_columns(["_v"]).to_pylist()):
            yield from search(block, own[number], anchor, ids, keys, labels, order)

    return pa.Table.from_batches(to_batches(found(), schema), schema)


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); a score is the integer inner product. A positive is one of the first
    ``positives`` other rows with the anchor's label, by score, ties by smaller id. Its negatives are the first ``negatives``
    rows of another label whose score lies between ``low`` and ``high`` percent of the positive's.

    Anchors and rows are dealt into blocks of bounded size that meet in cells; a cell returns a few rows per anchor, so
    what moves besides the blocks is small, and nothing is broadcast. Both searches are vertical scans, and exact.

    A row with a null id, label, vector or component, or with a component that is not finite, takes no part; a row for which
    ``is_anchor`` is null is no anchor. Rows that repeat id, label and vector count once; other rows under one id are
    rows of their own (ties in the order of a hash), also to one another. Shorter vectors end in zeros. Anchors without
    positives, and positives without negatives, have no row; so an empty table gives an empty result. Scores beyond
    the range of a long, and components beyond it after scaling, count as its ends. Other columns may have any name.
    """
    named = vectors.select(
        F.col(id).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), F.col(vector).alias("_raw"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    usable = named.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & is_finite("_raw"))
    whole = F.transform("_raw", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usable = usable.select("_id", "_label", "_anchor", whole.alias("_v"), F.xxhash64("_id", "_label", "_raw").alias("_key"))
    rows = stored(usable.groupBy("_id", "_key", "_label", "_v").agg(F.max("_anchor").alias("_anchor")))
    sizes = rows.agg(F.count("*"), F.count_if("_anchor")).first()
    row_blocks = block_count(rows, sizes[0])
    anchor_blocks = max(1, -(-sizes[1] // ANCHORS_AT_ONCE))

    left = rows.select("_id", "_key", "_label", "_v", block_of(["_id", "_key"], row_blocks).alias("_rb"), all_blocks(anchor_blocks).alias("_ab"))
    anchors = rows.where("_anchor").select("_id", "_key", "_label", "_v", block_of(["_id", "_key"], anchor_blocks, 1).alias("_ab"))

    def cells(anchors: DataFrame, fields: str, search) -> DataFrame:
        right = anchors.select("*", all_blocks(row_blocks).alias("_rb"))
        schema = arrow_schema(fields)
        met = left.groupBy("_rb", "_ab").cogroup(right.groupBy("_rb", "_ab"))
        return met.applyInArrow(lambda rows, own: _scan(rows, own, schema, search), fields)

    def near(block, values, anchor, ids, keys, labels, order):
        alike = (labels == anchor["_label"]) & ~((ids == anchor["_id"]) & (keys == anchor["_key"]))
        for row, score in vertical_scan(block, values, alike, [(None, None)], positives, order)[0]:
            yield anchor["_id"], anchor["_key"], int(ids[row]), int(keys[row]), score

    found = cells(anchors, "_id long,_key long,p_id long,p_key long,p_score long", near)
    best = top_per_group(found, ["_id", "_key"], [F.desc("p_score"), F.col("p_id"), F.col("p_key")], positives)
    lists = best.groupBy("_id", "_key").agg(F.collect_list(F.struct("p_id", "p_key", "p_score")).alias("_p"))
    anchors = stored(anchors.join(lists, ["_id", "_key"]))

    def hard(block, values, anchor, ids, keys, labels, order):
        # An empty window (a score below zero) has its lower end above its upper one.
        windows = [(-(-low * p["p_score"] // 100), high * p["p_score"] // 100) for p in anchor["_p"]]
        other = labels != anchor["_label"]
        for p, hits in zip(anchor["_p"], vertical_scan(block, values, other, windows, negatives, order), strict=True):
            for row, score in hits:
                yield anchor["_id"], anchor["_key"], p["p_id"], p["p_key"], p["p_score"], int(ids[row]), int(keys[row]), score

    found = cells(
        anchors, "_id long,_key long,p_id long,p_key long,p_score long,n_id long,n_key long,n_score long", hard)
    by = Window.partitionBy("_id", "_key", "p_id", "p_key").orderBy(F.desc("n_score"), "n_id", "n_key")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives).select(
        F.col("_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("n_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"))
