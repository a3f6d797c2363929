"""Quality rules: base counts with fixed limits, then an isolation forest on the rule statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catloom.llm.common import map_batches, raw, stored
from catloom.llm.text_stats import BASE, FEATURES, base_stats, features

EULER = 0.5772156649015329
#: Bins of the scores when the threshold is chosen; every labelled row is counted in one.
BINS = 1 << 16


def rule_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, the five base counts, features) of every whole text; null counts as empty."""
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            for row, content in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                words, base = base_stats(content)
                yield row, *base, list(features(content, words, base))
        return work

    fields = "_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"
    return map_batches(rows, fields, make).withColumnRenamed("_id", id)


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree over n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random axis splits, stored as flat arrays; short mean paths mark anomalies.

    Each tree sees ``per_tree`` rows, as the method has it: rows of its own if there are enough for all trees. Constant rows
    or none make trees of a single leaf, whose score is the same for all rows.
    """

    def __init__(self, n_trees: int = 100, per_tree: int = 256, seed: int = 7):
        self.n_trees, self.per_tree, self.seed = n_trees, per_tree, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, rows: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.per_tree, len(rows))
        depth = int(np.ceil(np.log2(max(size, 2))))
        self.norm = max(_mean_path(size), 1e-9)
        dealt = rng.permutation(len(rows)) if len(rows) >= self.n_trees * self.per_tree else None
        for tree in range(self.n_trees):
            if dealt is not None:
                own = rows[dealt[tree * size:(tree + 1) * size]]
            else:
                own = rows[rng.choice(len(rows), size, replace=False)] if size else rows
            self.trees.append(self._grow(own, depth, rng))
        return self

    def _grow(self, rows: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, value, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(column)
            for kept, start in ((column, -1), (value, 0.0), (left, at), (right, at), (path, depth + _mean_path(len(part)))):
                kept.append(start)
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            open_ = np.flatnonzero(high > low)
            if depth < limit and len(open_):
                column[at] = int(rng.choice(open_))
                value[at] = float(rng.uniform(low[column[at]], high[column[at]]))
                below = part[:, column[at]] < value[at]
                left[at], right[at] = node(part[below], depth + 1), node(part[~below], depth + 1)
            return at

        node(rows, 0)
        return tuple(np.array(x) for x in (column, value, left, right, path))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, below 0.5 for ordinary rows."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for column, value, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = column[at] >= 0
                if not inner.any():
                    break
                below = rows[every, np.maximum(column[at], 0)] < value[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += path[at]
        return np.power(2.0, -total / max(1, len(self.trees)) / self.norm)


def bounded_sample(df: DataFrame, id: str, bound: int, by: Sequence[str] = ()) -> list:
    """At most ``bound`` rows, those with the smallest hash of the id: the same rows on every run.

    A cut on the hash, from the number of rows, leaves about twice the bound to be ordered, so the tasks together
    send little more than the sample. Where rows repeat ids and too few pass, the cut is raised.
    """
    rows = stored(df.withColumn("_hash", F.xxhash64(F.lit("sample"), F.col(id))))
    total, share = rows.count(), 1.0
    if total > 2 * bound + 1000:
        share = (2 * bound + 1000) / total
    while True:
        least = rows.where(F.col("_hash") <= F.lit(min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)))
        found = least.orderBy("_hash", *by).limit(bound).drop("_hash").collect()
        if len(found) >= min(bound, total):
            return found
        share *= 4


def calibrate_counts(tops: np.ndarray, good: np.ndarray, bad: np.ndarray, most_lost: float) -> float:
    """The score above which a row is an anomaly: best balanced accuracy, losing at most ``most_lost`` of the good rows.

    ``tops`` are rising scores; ``good`` and ``bad`` count the rows from the score before up to each.
    """
    n_good, n_bad = good.sum(), bad.sum()
    if not n_good or not n_bad:
        return 1.0  # no evidence: nothing is anomalous
    lost, caught = 1 - np.cumsum(good) / n_good, 1 - np.cumsum(bad) / n_bad
    gain = np.where(lost <= most_lost, caught - lost, -1.0)
    return float(tops[int(gain.argmax())])


def calibrate(scores: np.ndarray, good: np.ndarray, most_lost: float) -> float:
    """:func:`calibrate_counts` of rows in memory."""
    order, at = np.unique(scores, return_inverse=True)
    return calibrate_counts(order, np.bincount(at[good], minlength=len(order)), np.bincount(at[~good], minlength=len(order)), most_lost)


def forest_rules(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    min_words: int = 50, max_repeat_percent: int = 50, most_lost: float = 0.005,
    n_trees: int = 100, per_tree: int = 256,
) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept.

    The base rule rejects texts with fewer than ``min_words`` words or with more than
    ``max_repeat_percent`` percent of their words in repeated 3-word windows. The forest learns the
    ordinary range of the statistics from labelled good rows that pass the base rule: the rows of its trees, ``per_tree`` each,
    are drawn from all of these by hash. The threshold is set on the counts of all labelled rows that pass, in
    ``BINS`` bins of their scores. Every row is scored. Null and empty texts fail the base rule; several labels for an id count
    as their minimum; without usable labels the forest rejects nothing. Repeated rows get equal verdicts.
    """
    stats = stored(rule_statistics(docs, id, text))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    marked = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_lid")).agg(
        F.min(label).alias("_label"))
    labelled = lambda rows: rows.where(~failed).join(marked, F.col(id) == F.col("_lid"))
    drawn = bounded_sample(labelled(stats).where("_label = 1").select(id, "features"), id, n_trees * per_tree)
    forest = IsolationForest(n_trees, per_tree).fit(np.array([r["features"] for r in drawn], float).reshape(len(drawn), len(FEATURES)))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            if not len(columns[0]):
                return
            matrix = batch.column(len(columns)).flatten().to_numpy().reshape(len(columns[0]), len(FEATURES))
            yield from zip(*columns, forest.score(matrix).tolist(), strict=True)
        return work

    fields = "_id long, " + ", ".join(f"{c} long" for c in BASE) + ", anomaly double"
    scored = map_batches(stats.select(F.col(id).cast("long").alias("_id"), *BASE, "features"), fields, make)
    scored = stored(scored.withColumnRenamed("_id", id))
    good = F.count_if(F.col("_label") == 1)
    bins = labelled(scored).groupBy(F.floor(F.col("anomaly") * BINS).alias("_bin")).agg(
        F.max("anomaly").alias("top"), good.alias("good"), (F.count("*") - good).alias("bad")).orderBy("_bin").toArrow()  # at most BINS rows
    limit = calibrate_counts(*(bins[c].to_numpy() for c in ("top", "good", "bad")), most_lost)
    return scored.select(
        id, *BASE, failed.alias("base_failed"), "anomaly", (~failed & (F.col("anomaly") <= limit)).alias("kept"),
    )
