"""Approximate nearest neighbours: p-stable hash tables, whose buckets are probed in the order of estimated success."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from catloom.llm.common import arrow_schema, map_batches, stored, to_batches
from catloom.llm.vectors import all_blocks, block_count, block_of, is_finite, matrix
from catloom.operators.rank import top_per_group

#: Numbers of hash functions per table that the fit compares, and those it falls back to; 0 is one bucket for all.
FUNCTIONS, FEWER = (4, 6, 8, 12, 16, 24), (3, 2, 1, 0)
MOST_PROBES = 1024
PROBE_ROWS = 500  # one more probe costs about as much as this many more rows
CHUNK_ROWS = 4096  # a larger bucket is dealt into chunks
QUERIES_AT_ONCE = 65_536
PAIRS_AT_ONCE = 1 << 16


@dataclass
class Tables:
    """Hash tables: per table, random directions (dims, functions), shifts, and the width of a slot."""

    directions: np.ndarray
    shifts: np.ndarray
    width: float
    probes: int = 1

    @classmethod
    def draw(cls, tables: int, functions: int, dims: int, width: float, seed: int = 12) -> Tables:
        # Gaussian directions: a sum of components weighted by them is distributed like the Euclidean length.
        random = np.random.default_rng([seed, functions])
        directions = random.standard_normal((tables, dims, functions))
        return cls(directions, random.uniform(0.0, 1.0, (tables, functions)), width)

    def places(self, rows: np.ndarray, table: int) -> np.ndarray:
        """(rows, functions) positions in slots; the whole part is the slot."""
        return np.clip(rows @ self.directions[table] / self.width + self.shifts[table], -2.0 ** 52, 2.0 ** 52)

    def buckets(self, rows: np.ndarray, table: int) -> np.ndarray:
        return bucket_keys(np.floor(self.places(rows, table)).astype(np.int64), table)

    def probe_keys(self, row: np.ndarray, table: int, most: int) -> np.ndarray:
        place = self.places(row[None, :], table)[0]
        return bucket_keys(probe_order(place, most), table)


def bucket_keys(slots: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit key per row of slots; equal keys of different buckets only add candidates."""
    key = np.full(len(slots), table + 1, np.uint64)
    for column in slots.T.astype(np.uint64):
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def probe_order(place: np.ndarray, most: int) -> np.ndarray:
    """(probes, functions) slots in the order of estimated success: the sum of squared distances to the slots crossed.

    For one function the slots ascend in distance as its own, the one beyond the nearer border, the one beyond the other
    border, and so on. The sums are enumerated by a heap; every vector of ranks has one parent, so it comes once.
    """
    slot = np.floor(place)
    part = place - slot
    near = np.where(part >= 0.5, 1, -1)
    far, close = np.maximum(part, 1 - part), np.minimum(part, 1 - part)
    size = len(place)

    def cost(i: int, rank: int) -> float:
        if not rank:
            return 0.0
        steps = (rank - 1) // 2
        return float((close[i] if rank % 2 else far[i]) + steps) ** 2

    first = (0.0, (0,) * size, 0)
    heap, found = [first], []
    while heap and len(found) < most:
        total, ranks, last = heapq.heappop(heap)
        found.append(ranks)
        for i in range(last, size):
            moved = total + cost(i, ranks[i] + 1) - cost(i, ranks[i])
            heapq.heappush(heap, (moved, (*ranks[:i], ranks[i] + 1, *ranks[i + 1:]), i))
    ranks = np.array(found, np.int64).reshape(len(found), size)
    offset = np.where(ranks % 2 == 1, near, -near) * ((ranks + 1) // 2)
    return slot.astype(np.int64) + offset


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows, pair by pair; extreme ones are scaled, so that no square leaves the range."""
    apart = left - right
    largest = np.abs(apart).max(axis=1, initial=0.0)
    scale = np.where((largest > 0) & ((largest > 1e100) | (largest < 1e-100)), largest, 1.0)
    apart = apart / scale[:, None]
    return np.sqrt((apart * apart).sum(axis=1)) * scale


def nearest_in(
    queries: np.ndarray, rows: np.ndarray, query_keys: np.ndarray, row_keys: np.ndarray, ids: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` nearest rows of each query, ties by id and key; a row of the query's own key is left out.

    Products choose the candidates, with a margin for rounding; their distances are then computed directly. Vectors whose squares would
    leave the range are always candidates.
    """
    q, x = np.clip(queries, -1e100, 1e100), np.clip(rows, -1e100, 1e100)
    large_q, large_x = (q != queries).any(axis=1), (x != rows).any(axis=1)
    own_q, own_x = (q * q).sum(axis=1), (x * x).sum(axis=1)
    square = own_q[:, None] + own_x[None, :] - 2 * (q @ x.T)
    square[:, large_x] = np.inf
    same = query_keys[:, None] == row_keys[None, :]
    square[same] = np.inf
    at = min(k, square.shape[1]) - 1
    limit = np.partition(square, at, axis=1)[:, at]
    margin = 1e-12 * q.shape[1] * (own_q[:, None] + own_x[None, :])
    picked = np.nonzero(((square <= limit[:, None] + margin) | large_q[:, None] | large_x[None, :]) & ~same)
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for start in range(0, len(picked[0]), PAIRS_AT_ONCE):
        i, j = (p[start:start + PAIRS_AT_ONCE] for p in picked)
        merged = [np.concatenate(p) for p in zip(found, (i, j, distances(queries[i], rows[j])), strict=True)]
        found = first_per_query(*merged, ids, row_keys, k)
    return tuple(found)


def first_per_query(query, row, distance, ids, keys, k) -> list[np.ndarray]:
    order = np.lexsort((keys[row], ids[row], distance, query))
    query, row, distance = query[order], row[order], distance[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return [query[place < k], row[place < k], distance[place < k]]


class _SampleScan:
    """The nearest rows of a few queries among the rows of a task."""

    def __init__(self, queries: np.ndarray, keys: np.ndarray, k: int):
        self.queries, self.keys, self.k, self.held = queries, keys, k, None

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        if not batch.num_rows:
            return ()
        ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
        rows = matrix(batch.column(2), self.queries.shape[1])
        i, j, d = nearest_in(self.queries, rows, self.keys, keys, ids, self.k)
        new = [i, ids[j], keys[j], d, rows[j]]
        if self.held is not None:
            new = [np.concatenate(p) for p in zip(self.held, new, strict=True)]
        kept = first_per_query(new[0], np.arange(len(new[0])), new[3], new[1], new[2], self.k)
        self.held = [p[kept[1]] for p in new]
        return ()

    def close(self) -> Iterator[tuple]:
        if self.held is not None:
            for i, id, key, d, row in zip(*self.held, strict=True):
                yield int(i), int(id), int(key), float(d), row.tolist()


def _places(tables: Tables, queries: np.ndarray, near: list, rows: list, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """At which of ``most`` probes (``most``: none) the neighbours' buckets come, the first table counts; and those of the rows, per table."""
    place, visited = [], []
    for table in range(len(tables.directions)):
        here, hit = [], []
        for query, own in zip(queries, near[table], strict=True):
            keys = tables.probe_keys(query, table, most)
            order = np.argsort(keys, kind="stable")
            for wanted, out in ((own, here), (rows[table], hit)):
                at = np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)
                out.append(np.where(keys[order[at]] == wanted, order[at], most))
        place.append(np.concatenate(here))
        visited.append(np.concatenate(hit))
    return np.min(place, axis=0), visited


def fit(queries: np.ndarray, found: list[np.ndarray], sample: np.ndarray, n: int, tables: int, target: float, width: float) -> Tables:
    """Tables whose probes find a share of ``target`` of the true neighbours ``found`` of the sample queries at the least cost.

    Cost is counted in rows: those in the probed buckets, estimated on ``sample``, and ``PROBE_ROWS`` a probe.
    """
    best, least = None, np.inf
    dims = queries.shape[1]
    for functions in (*FUNCTIONS, *FEWER):
        if best is not None and functions in FEWER:
            break
        drawn = Tables.draw(tables if functions else 1, functions, dims, width)
        count = len(drawn.directions)
        rows, near = ([drawn.buckets(x, t) for t in range(count)] for x in (sample, np.concatenate(found)))
        near = [np.split(x, np.cumsum([len(f) for f in found])[:-1]) for x in near]
        # Beyond these probes the cost is no less than the best so far.
        limit = int(min(MOST_PROBES, least // (count * PROBE_ROWS)))
        most = min(64, limit)
        while most:
            place, visited = _places(drawn, queries, near, rows, most)
            needed = np.sort(place)
            probes = int(needed[int(np.ceil(target * len(needed))) - 1]) + 1 if len(needed) else 1
            if probes <= most or most == limit:
                break
            most = min(2 * most, limit)
        if not most or probes > most:
            continue
        cost = count * PROBE_ROWS * probes + n * sum(float((v < probes).mean()) for v in visited)
        if cost < least:
            best, least = drawn, cost
            best.probes = probes
    return best


def _copies(tables: Tables, dims: int):
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            rows = matrix(batch.column(2), dims)
            ids, keys = (batch.column(i).to_pylist() for i in (0, 1))
            keys_of = [tables.buckets(rows, t).tolist() for t in range(len(tables.directions))]
            for place, row in enumerate(zip(ids, keys, strict=True)):
                for found in keys_of:
                    yield *row, found[place]
        return work
    return make


def _probes(tables: Tables, dims: int):
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            rows = matrix(batch.column(2), dims)
            ids, keys = (batch.column(i).to_pylist() for i in (0, 1))
            for row, id, key in zip(rows, ids, keys, strict=True):
                for table in range(len(tables.directions)):
                    for bucket in tables.probe_keys(row, table, tables.probes).tolist():
                        yield id, key, bucket
        return work
    return make


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", tables: int = 4,
    target: float = 0.97, width: float = 1.0, sample_queries: int = 48, sample_rows: int = 1024,
) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score (the Euclidean distance), the ``k`` nearest found, ties by smaller id.

    Every row is filed in ``tables`` hash tables; a table's key is the slots of several Gaussian projections. A query probes its own
    bucket and then perturbed ones, nearest borders first; the candidates of all tables are merged and ranked by exact
    distances on the original vectors.

    Only the layout is fitted, on a bounded sample: the true neighbours of ``sample_queries`` queries (those with the smallest hash), found
    by a scan of all rows, give the slot width (``width`` times their mean distance) and the number of projections and
    probes with which ``target`` of them are found at the least cost; ``sample_rows`` rows estimate how full buckets are.
    If no layout reaches the target, all rows share one bucket, and the search is exact. Queries whose probes meet fewer than ``k`` rows
    are searched for once more, exactly: in blocks against blocks of all rows.

    Buckets above ``CHUNK_ROWS`` rows are dealt into chunks, so a hot bucket spans many cells; cells hold a bounded number of rows and
    queries, and return at most ``k`` rows a query. Probes of empty buckets are dropped by a join with the bucket sizes.

    Rows with a null id, a null, zero or empty vector, or a null or non-finite component take no part; a row for which ``is_query`` is
    null is no query. Rows that repeat id and vector count once; other rows under one id are rows of their own, also to
    one another. Shorter vectors end in zeros. With no queries or no rows the result is empty. Other columns may have any name.
    """
    named = vectors.select(
        F.col(id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"),
        F.coalesce(is_query, F.lit(False)).alias("_query"))
    usable = named.where(F.col("_id").isNotNull() & is_finite("_v") & F.exists("_v", lambda x: x != 0))
    usable = usable.withColumn("_key", F.xxhash64("_id", "_v"))
    rows = stored(usable.groupBy("_id", "_key", "_v").agg(F.max("_query").alias("_query")).select("_id", "_key", "_v", "_query"))
    queries = rows.where("_query").select("_id", "_key", "_v")
    size = rows.agg(F.count("*"), F.count_if("_query"), F.max(F.size("_v"))).first()
    n, n_queries, dims = size[0], size[1], size[2] or 0
    schema = "query_id long,rank int,vec_id long,score double"
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], schema)

    def sampled(df: DataFrame, count: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        taken = df.select("_v", "_key", F.xxhash64(F.lit(salt), "_key", "_id").alias("_h")).orderBy("_h").limit(count).collect()
        out = np.zeros((len(taken), dims))
        for i, row in enumerate(taken):
            out[i, :len(row["_v"])] = row["_v"]
        return out, np.array([row["_key"] for row in taken], np.int64)

    few, few_keys = sampled(queries, sample_queries, 1)
    some, _ = sampled(rows, sample_rows, 2)
    near = map_batches(rows.select("_id", "_key", "_v"), "q int,_id long,_key long,d double,_v array<double>", lambda: _SampleScan(few, few_keys, k))
    near = top_per_group(near, ["q"], [F.col("d"), F.col("_id"), F.col("_key")], k).select("q", "d", "_v").collect()
    true = [np.array([row["_v"] for row in near if row["q"] == q]).reshape(-1, dims) for q in range(len(few))]
    apart = float(np.mean([row["d"] for row in near])) if near else 0.0
    layout = fit(few, true, some, n, tables, target, width * apart or 1.0)

    filed = map_batches(rows.select("_id", "_key", "_v"), "_id long,_key long,_bucket long", _copies(layout, dims))
    filed = stored(filed)
    buckets = filed.groupBy("_bucket").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("_chunks"))
    buckets = stored(buckets)
    cells = block_count(rows, n * len(layout.directions))
    query_blocks = -(-n_queries // QUERIES_AT_ONCE)
    unit = F.xxhash64("_bucket", "_chunk")

    hot = buckets.where("_chunks > 1").select(F.col("_bucket").alias("_hot"), "_chunks")
    dealt = filed.join(hot, F.col("_bucket") == F.col("_hot"), "left")
    dealt = dealt.withColumn("_chunk", F.coalesce(F.pmod(F.xxhash64("_key", "_id"), "_chunks"), F.lit(0).cast("long")))
    dealt = dealt.select("_id", "_key", unit.alias("_unit")).join(rows.select("_id", "_key", "_v"), ["_id", "_key"])
    dealt = dealt.select("_id", "_key", "_v", "_unit", F.pmod("_unit", F.lit(cells)).alias("_cell"), all_blocks(query_blocks).alias("_qb"))

    asked = map_batches(queries, "_id long,_key long,_bucket long", _probes(layout, dims))
    asked = asked.join(buckets, "_bucket").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    asked = asked.withColumn("_unit", unit).withColumn("_cell", F.pmod("_unit", F.lit(cells)))
    asked = asked.groupBy("_id", "_key", "_cell").agg(F.collect_set("_unit").alias("_units")).join(queries, ["_id", "_key"])
    asked = asked.withColumn("_qb", block_of(["_id", "_key"], query_blocks, 1))

    fields = "query_id long,q_key long,vec_id long,v_key long,score double"
    arrow = arrow_schema(fields)

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        return pa.Table.from_batches(to_batches(_search_cell(rows, queries, dims, k), arrow), arrow)

    def first(met: DataFrame) -> DataFrame:
        merged = met.groupBy("query_id", "q_key", "vec_id", "v_key").agg(F.min("score").alias("score"))
        by = Window.partitionBy("query_id", "q_key").orderBy("score", "vec_id", "v_key")
        return merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    ranked = stored(first(dealt.groupBy("_cell", "_qb").cogroup(asked.groupBy("_cell", "_qb")).applyInArrow(search, fields)))
    full = ranked.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("_id"), F.col("q_key").alias("_key"))
    short = stored(queries.join(full, ["_id", "_key"], "left_anti"))
    n_short = short.count() if n > 1 else 0
    if n_short:
        blocks, query_blocks = block_count(rows, n), -(-n_short // QUERIES_AT_ONCE)

        def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
            return pa.Table.from_batches(to_batches(_scan_cell(rows, queries, dims, k), arrow), arrow)

        left = rows.select("_id", "_key", "_v", block_of(["_id", "_key"], blocks).alias("_cell"), all_blocks(query_blocks).alias("_qb"))
        right = short.select("_id", "_key", "_v", block_of(["_id", "_key"], query_blocks, 1).alias("_qb"), all_blocks(blocks).alias("_cell"))
        exact = first(left.groupBy("_cell", "_qb").cogroup(right.groupBy("_cell", "_qb")).applyInArrow(scan, fields))
        ranked = ranked.join(short.select(F.col("_id").alias("query_id"), F.col("_key").alias("q_key")), ["query_id", "q_key"], "left_anti")
        ranked = ranked.unionByName(exact)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan_cell(rows: pa.Table, queries: pa.Table, dims: int, k: int) -> Iterator[tuple]:
    """The ``k`` nearest rows of the cell for each of its queries."""
    if not len(rows) or not len(queries):
        return
    ids, keys, data = rows.column("_id").to_numpy(), rows.column("_key").to_numpy(), matrix(rows.column("_v"), dims)
    own_ids, own_keys, own = queries.column("_id").to_numpy(), queries.column("_key").to_numpy(), matrix(queries.column("_v"), dims)
    for start in range(0, len(own), 64):
        for i, j, d in zip(*nearest_in(own[start:start + 64], data, own_keys[start:start + 64], keys, ids, k), strict=True):
            yield int(own_ids[start + i]), int(own_keys[start + i]), int(ids[j]), int(keys[j]), float(d)


def _search_cell(rows: pa.Table, queries: pa.Table, dims: int, k: int) -> Iterator[tuple]:
    """The ``k`` nearest rows of each query among the units of the cell that it probes."""
    if not len(rows) or not len(queries):
        return
    ids, keys, units = (rows.column(c).to_numpy() for c in ("_id", "_key", "_unit"))
    data = matrix(rows.column("_v"), dims)
    one = _same_rows(ids, keys)
    order = np.argsort(units, kind="stable")
    names, starts = np.unique(units[order], return_index=True)
    parts = np.split(order, starts[1:])
    wanted = queries.column("_units").combine_chunks()
    of_query = np.repeat(np.arange(len(queries)), np.diff(wanted.offsets.to_numpy()))
    probed = wanted.flatten().to_numpy()
    by_unit = np.argsort(probed, kind="stable")
    left, right = np.searchsorted(probed, names, "left", by_unit), np.searchsorted(probed, names, "right", by_unit)
    own, own_ids, own_keys = matrix(queries.column("_v"), dims), queries.column("_id").to_numpy(), queries.column("_key").to_numpy()
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for part, a, b in zip(parts, left.tolist(), right.tolist(), strict=True):
        asking = of_query[by_unit[a:b]]
        for start in range(0, len(asking), 256):
            some = asking[start:start + 256]
            i, j, d = nearest_in(own[some], data[part], own_keys[some], keys[part], ids[part], k)
            held = [np.concatenate(p) for p in zip(held, (some[i], one[part[j]], d), strict=True)]
        if len(held[0]) > 4 * k * len(queries) + PAIRS_AT_ONCE:
            held = _best(held, ids, keys, k)
    for i, j, d in zip(*_best(held, ids, keys, k), strict=True):
        yield int(own_ids[i]), int(own_keys[i]), int(ids[j]), int(keys[j]), float(d)


def _same_rows(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each row the first one with its id and key: a row comes once for each table."""
    order = np.lexsort((keys, ids))
    new = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])))
    out = np.empty(len(ids), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
    return out


def _best(held: list[np.ndarray], ids: np.ndarray, keys: np.ndarray, k: int) -> list[np.ndarray]:
    """The first ``k`` different rows of each query."""
    query, row, distance = held
    _, first = np.unique(query * len(ids) + row, return_index=True)
    return first_per_query(query[first], row[first], distance[first], ids, keys, k)
