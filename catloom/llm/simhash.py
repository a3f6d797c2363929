"""SimHash near-duplicates: vertical bit planes, carry-save distance counters, blocks abandoned early."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from catloom.llm.common import map_batches, raw, stored
from catloom.llm.components import components

BITS = 64
TILE = 1024  # rows compared with one another at once
SHINGLES_AT_ONCE = 1 << 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Fingerprint of UTF-8 ``text``: a bit is 1 if it is set in over half of the shingle hashes."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        shingles = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        shingles = [line[s:e] for s, e in zip(starts, ends[words - 1:].tolist(), strict=False)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[start:start + SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(counts * 2 > len(hashes))))


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words) array: plane b holds bit b of every fingerprint, 64 fingerprints to a word."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    wide = np.zeros((BITS, -(-len(prints) // 64) * 64), np.uint8)
    wide[:, : len(prints)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``: a comparator on the counter's bits, highest first."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for place in reversed(range(len(counter))):
        if radius >> place & 1:
            equal &= counter[place]
        else:
            above |= equal & counter[place]
            equal &= ~counter[place]
    return above


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with at most ``radius`` differing bits; ``own``: left is right, and only i < j counts.

    All distances of a left row to 64 right rows grow in one word per counter bit. After every eighth
    plane, left rows whose whole block is beyond the radius are abandoned.
    """
    planes, n = bit_planes(right), len(right)
    dead = np.zeros((len(left), planes.shape[1]), np.uint64)
    if n % 64:
        dead[:, -1] = _ONES << np.uint64(n % 64)
    if own:
        square = np.packbits(np.tri(n, planes.shape[1] * 64, dtype=np.uint8), axis=1, bitorder="little")
        dead |= square.view("<u8").astype(np.uint64)
    rows = np.arange(len(left))
    counter = [np.zeros_like(dead) for _ in range(radius.bit_length() + 1)]
    for plane in range(BITS):
        flip = np.where(left[rows] >> np.uint64(plane) & np.uint64(1), _ONES, np.uint64(0))
        carry = planes[plane][None, :] ^ flip[:, None]
        for place in range(len(counter)):
            counter[place], carry = counter[place] ^ carry, counter[place] & carry
        dead |= carry  # out of the top counter bit
        if plane % 8 == 7:
            dead |= _over(counter, radius)
            alive = ~(dead == _ONES).all(axis=1)
            if not alive.all():
                rows, dead, counter = rows[alive], dead[alive], [c[alive] for c in counter]
                if not len(rows):
                    break
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits = np.unpackbits((~dead).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    i, j = np.nonzero(hits)
    return rows[i], j


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the ends of each pair; each row's label becomes the smallest row of its tree, and nothing joined comes apart.

    Labels point at earlier rows. Only roots are hooked to smaller roots, so a pair below one root may be dropped.
    """
    while True:
        while ((above := label[label]) != label).any():
            label[:] = above
        apart = label[i] != label[j]
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))


def _spanning_labels(
    n: int, tile: int, pairs: Callable[[slice, slice], tuple[np.ndarray, np.ndarray]], known: np.ndarray | None = None,
) -> np.ndarray:
    """Smallest row of each row's component, from the pairs of all tiles.

    ``known`` may give each row an earlier row of its component. Two tiles that already are one component add nothing.
    """
    label = np.arange(n) if known is None else known.copy()
    _join_labels(label, np.zeros(0, np.int64), np.zeros(0, np.int64))
    tiles = [slice(a, min(a + tile, n)) for a in range(0, n, tile)]
    for place, a in enumerate(tiles):
        for b in tiles[place:]:
            if (label[a] == label[a.start]).all() and (label[b] == label[a.start]).all():
                continue
            i, j = pairs(a, b)
            _join_labels(label, i + a.start, j + b.start)
    return label


def bucket_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all pairs within ``radius``; at most one per row."""
    label = _spanning_labels(
        len(prints), TILE, lambda a, b: near_pairs(prints[a], prints[b], radius, a == b))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved], prints[label[moved]]


def _sketch(words: int):
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            for row, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                value = fingerprint(text, words)
                yield row, value - (1 << 64) if value >> 63 else value
        return work
    return make


class _Buckets:
    """Cuts sorted (bucket, fingerprint) rows into whole buckets and packs small ones into one tile."""

    def __init__(self, radius: int):
        self.radius, self.keys, self.prints = radius, np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        keys = np.concatenate((self.keys, batch.column(0).to_numpy()))
        prints = np.concatenate((self.prints, batch.column(1).to_numpy().view(np.uint64)))
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
        yield from self._links(keys[:last], prints[:last])
        self.keys, self.prints = keys[last:], prints[last:]

    def close(self) -> Iterator[tuple]:
        yield from self._links(self.keys, self.prints)

    def _links(self, keys: np.ndarray, prints: np.ndarray) -> Iterator[tuple]:
        if not len(keys):
            return
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = np.append(starts[1:], len(keys))
        group_start = 0
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - group_start > TILE and start > group_start:
                yield from self._emit(prints[group_start:start])
                group_start = start
            if end - start > TILE:
                yield from self._emit(prints[start:end])
                group_start = end
        yield from self._emit(prints[group_start:])

    def _emit(self, prints: np.ndarray) -> Iterator[tuple]:
        prints = np.unique(prints)
        if len(prints) > 1:
            a, b = bucket_links(prints, self.radius)
            yield from zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)


def deal(filed: DataFrame, of: str, bucket_rows: int) -> DataFrame:
    """Add ``bucket`` to (key, ...): the key itself, or for a hot key one bucket per pair of chunks that the row is in."""
    hot = filed.groupBy("key").count().where(F.col("count") > bucket_rows).select(
        F.col("key").alias("_hot"), F.ceil(F.col("count") / bucket_rows).alias("_chunks")
    )
    # Written first: Spark broadcasts the few hot keys if they are small, and else can split the hot side of the exchange.
    filed = filed.join(stored(hot), F.col("key") == F.col("_hot"), "left")
    own = F.pmod(F.xxhash64(of), "_chunks")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1), lambda c: c != own)
    place = F.transform(others, lambda c: F.xxhash64("key", F.least(own, c), F.greatest(own, c)))
    return filed.withColumn(
        "bucket", F.explode(F.when(F.col("_chunks").isNull(), F.array("key")).otherwise(place)))


def simhash_links(prints: DataFrame, radius: int = 4, pieces: int | None = None, bucket_rows: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that span all components at ``radius``.

    Fingerprints within ``radius`` agree on at least ``pieces`` - ``radius`` of ``pieces`` parts, so each
    is filed under every such choice of parts (default: ``radius`` + 1 parts, one agrees) and only
    meets the others of its bucket. A bucket with more than ``bucket_rows`` rows is dealt into chunks that
    meet two by two in tasks of their own; the table of such buckets has at most one row per possible key.
    """
    pieces = pieces or radius + 1
    cuts = [BITS * i // pieces for i in range(pieces + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        mask = sum((1 << cuts[p + 1]) - (1 << cuts[p]) for p in chosen)
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    filed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    filed = deal(filed, "fp", bucket_rows)
    dealt = filed.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, "a long, b long", lambda: _Buckets(radius)).distinct()


def simhash_dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4,
    pieces: int | None = None, bucket_rows: int = 8192,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Words are runs without ASCII white space, A-Z lowered; a text with fewer than ``words`` words is one
    shingle, one without words (null, empty) has fingerprint zero and links like any other. Equal
    fingerprints are folded first, so copies cost one row; component_id is the smallest id of the
    component (nulls ignored; null if no row of it has an id). Repeated rows are returned as often as given.
    """
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = stored(map_batches(rows, "_id long, fp long", _sketch(words)))
    prints = stored(rows.groupBy("fp").agg(F.min("_id").alias("_first")))
    roots = components(simhash_links(prints.select("fp"), radius, pieces, bucket_rows))
    named = stored(prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "_first", F.coalesce("root", "fp").alias("root")))
    lowest = stored(named.groupBy("root").agg(F.min("_first").alias("component_id")).withColumnRenamed("root", "_r"))
    of = stored(named.join(lowest, F.col("root") == F.col("_r")).select(F.col("fp").alias("_fp"), "component_id"))
    return rows.join(of, F.col("fp") == F.col("_fp")).select(
        F.col("_id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
