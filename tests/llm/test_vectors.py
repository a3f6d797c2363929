"""Hard negatives and nearest neighbours against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from catloom.llm import hard_negatives, neighbours, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, rank int, _v string, _key int, vec string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, 9, "x", 1, "y") for i, v, c in rows], SCHEMA)


def slow_negatives(rows, anchors, positives=5, negatives=3, high=95):
    """All pairs in Python integers; equal rows count once."""
    kept = {}
    for i, v, c in rows:
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i, c, tuple(v)] = [math.floor(Fraction(x) * 256) for x in v]
    dot = lambda a, b: max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for a, v in kept.items():
        if not anchors(a[0]):
            continue
        scored = [(dot(v, w), b) for b, w in kept.items() if b != a]
        near = sorted((-s, b[0]) for s, b in scored if b[1] == a[1])[:positives]
        for minus, p in near:
            hard = sorted((-s, b[0]) for s, b in scored if b[1] != a[1] and -50 * minus <= 100 * s <= -high * minus)
            out += [(a[0], p, n + 1, b, -minus, -t) for n, (t, b) in enumerate(hard[:negatives])]
    return sorted(out)


def mined(df, anchors, **more):
    return sorted(map(tuple, hard_negatives.mine_negatives(df, anchors, **more).collect()))


def test_negatives_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table]
    got = queries.QUERIES["op11_hard_negatives"](spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == slow_negatives(rows, lambda i: i % 50 == 0)


def test_negatives_edges(spark):
    random = np.random.default_rng(5)
    rows = [(i, random.integers(-3, 4, 6).astype(float).tolist(), int(c)) for i, c in enumerate(random.integers(0, 3, 120))]
    rows += [
        (None, [1.0] * 6, 1), (200, None, 1), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (202, [math.nan] * 6, 1),
        (203, [math.inf] * 6, 1), (204, [1.0] * 6, None), (205, [2.0, 1.0], 1), (206, [], 1), (207, [0.0] * 6, 2),
    ] + rows[:7] + rows[:7]
    df = vectors(spark, rows)
    # Components are small integers, so that scores tie often; rows repeat; vectors differ in length.
    assert mined(df, F.col("vec_id") % 3 == 0) == slow_negatives(rows, lambda i: i % 3 == 0)
    assert mined(df, F.col("vec_id") == 206) == slow_negatives(rows, lambda i: i == 206)  # every score is zero
    assert mined(df.limit(0), F.col("vec_id") % 3 == 0) == []
    assert mined(df, F.lit(None).cast("boolean")) == []
    two = [(i, v, c) for i, v, c in rows if i is None or i < 2 or i > 200]
    assert mined(vectors(spark, two), F.lit(True)) == slow_negatives(two, lambda i: True)


def test_negatives_large_components(spark):
    rows = [(i, [float((i * 37 % 11 - 5) << 30), 1.0, float(i)], i % 2) for i in range(40)]
    assert mined(vectors(spark, rows), F.col("vec_id") < 4, high=100) == slow_negatives(rows, lambda i: i < 4, high=100) != []


def test_negatives_one_id_two_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.9, 0.9], 0), (3, [0.7, 0.7], 1)]
    got = mined(vectors(spark, rows), F.col("vec_id") == 1)
    assert len([r for r in got if r[1] == 2]) == 2  # both rows of id 1 are anchors


@pytest.mark.parametrize("window", [(None, None), (-40, 300), (100, 100), (5, 4)])
def test_vertical_scan(window):
    random = np.random.default_rng(3)
    data = random.integers(-9, 10, (500, 24)).astype(np.int32)
    eligible = random.random(500) < 0.5
    for anchor in data[:20]:
        scores = data.astype(int) @ anchor
        low, high = (-(10**9) if window[0] is None else window[0]), (10**9 if window[1] is None else window[1])
        inside = [(int(-scores[i]), i) for i in range(500) if eligible[i] and low <= scores[i] <= high]
        want = [(i, -s) for s, i in sorted(inside)[:4]]
        assert hard_negatives.vertical_scan(hard_negatives.Columns(data), anchor, eligible, [window], 4, np.arange(500))[0] == want


def test_negatives_plan_has_no_broadcast_and_no_product(spark, capsys):
    rows = [(i, [float(i % 5), 1.0], i % 2) for i in range(50)]
    hard_negatives.mine_negatives(vectors(spark, rows), F.col("vec_id") % 5 == 0).explain()
    plan = capsys.readouterr().out
    assert "Nested" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" not in plan


# --- Nearest neighbours ---------------------------------------------------------------------------


def slow_nearest(rows, queries, k=10):
    kept = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    size = max((len(v) for _, v in kept), default=0)
    full = lambda v: np.array(v + (0.0,) * (size - len(v)))
    out = {}
    for q in kept:
        if queries(q[0]):
            out[q] = sorted((float(np.sqrt(((full(q[1]) - full(r[1])) ** 2).sum())), r[0]) for r in kept if r != q)[:k]
    return out


def recall(got, want):
    hits = sum(len({i for _, i in rows} & set(got.get(q[0], ()))) for q, rows in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_neighbours_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_neighbours"](spark, SF).orderBy("query_id", "rank").collect()
    want = slow_nearest(rows, lambda i: i % 100 == 0)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(found[r["query_id"]])
    assert {len(v) for v in found.values()} == {10} and len(found) == len(want)
    assert recall(found, want) >= 0.9
    vectors_of = {i: np.array(v, float) for i, v, _ in rows}
    for r in got:
        assert math.isclose(r["score"], float(np.linalg.norm(vectors_of[r["query_id"]] - vectors_of[r["vec_id"]])), rel_tol=1e-12)
    assert [(r["query_id"], r["score"], r["vec_id"]) for r in got] == sorted((r["query_id"], r["score"], r["vec_id"]) for r in got)


def test_neighbours_edges(spark):
    random = np.random.default_rng(8)
    rows = [(i, random.integers(0, 3, 5).astype(float).tolist(), 0) for i in range(60)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0, 0.5], 0) for i in range(60, 100)]  # a hot vector
    rows += [
        (None, [1.0] * 5, 0), (200, None, 0), (201, [], 0), (202, [0.0] * 5, 0), (203, [1.0, None, 1.0, 1.0, 1.0], 0),
        (204, [math.nan] * 5, 0), (205, [math.inf] * 5, 0), (210, [2.0, 1.0], 0), (220, [1e200] * 5, 0),
    ] + rows[:5]
    df = vectors(spark, rows)
    got = {}
    out = neighbours.nearest_neighbours(df, F.col("vec_id") % 10 == 0, target=1.0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    # All queries are in the sample, so a target of 1 finds all true neighbours, with ties by id.
    want = {q[0]: v for q, v in slow_nearest(rows, lambda i: i % 10 == 0).items()}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]]) or q == 220
    assert neighbours.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest_neighbours(df, F.lit(None).cast("boolean")).count() == 0
    assert neighbours.nearest_neighbours(df.where("vec_id = 1").limit(1), F.lit(True)).count() == 0
    three = neighbours.nearest_neighbours(df.where("vec_id < 3"), F.lit(True)).collect()
    assert len(three) == 6  # all candidates, if fewer than k


def test_neighbours_short_queries_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "fit", lambda few, true, some, n, tables, target, width: neighbours.Tables.draw(1, 8, few.shape[1], 0.01))
    random = np.random.default_rng(4)
    rows = [(i, random.standard_normal(6).tolist(), 0) for i in range(80)]
    want = slow_nearest(rows, lambda i: i % 8 == 0, 3)
    got = {}
    for r in neighbours.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 8 == 0, k=3).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall(got, want) == 1.0


def test_neighbours_hot_bucket_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 16)
    rows = [(i, [1.0 + (i % 7) / 1000, 1.0], 0) for i in range(300)]
    want = slow_nearest(rows, lambda i: i % 50 == 0, 4)
    got = {}
    for r in neighbours.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=4, target=1.0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall(got, want) == 1.0


def test_probe_order():
    place = np.array([0.3, -1.8, 5.45])
    slots = neighbours.probe_order(place, 200)
    assert slots[0].tolist() == [0, -2, 5] and len({tuple(s) for s in slots.tolist()}) == 200

    def cost(slot):
        beyond = np.maximum(slot - place, place - slot - 1)
        return float((np.maximum(beyond, 0) ** 2).sum())

    costs = [cost(s) for s in slots]
    assert all(a <= b + 1e-12 for a, b in zip(costs, costs[1:], strict=False))
    grid = [np.array([a, b, c]) for a in range(-8, 9) for b in range(-10, 7) for c in range(-3, 14)]
    assert np.allclose(sorted(map(cost, grid))[:200], costs)
