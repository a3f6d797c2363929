"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from catloom.llm.common import drop_rows, map_batches, raw, remainder, row_key, stored
from catloom.llm.text_stats import FEATURES, base_stats, features

#: Each statistic enters three times: linear, squared (both ends may be bad) and as its root (small shares count).
N_TERMS = 3 * len(FEATURES) + 1


def terms(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Model inputs of rows of statistics; the number of words enters through its logarithm."""
    return np.column_stack((stats, stats ** 2, np.sqrt(np.maximum(stats, 0)), np.log1p(n_words)))


@dataclass
class PairModel:
    """score = 1 / (1 + exp(-(slope * (w.x - cut) + logit(threshold)))): equals the threshold at the cut."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float

    def scaled(self, inputs: np.ndarray) -> np.ndarray:
        return np.clip((inputs - self.centre) / self.spread, -8, 8)

    def strength(self, inputs: np.ndarray) -> np.ndarray:
        return self.scaled(inputs) @ self.weights

    def score(self, inputs: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(inputs) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: Rows of like strength share a bin: edges of the bins for slopes and of the wider ones for curvatures, in units of strength.
REACH, WIDTH, WIDE = 64, 8, 1
FINE, COARSE = 2 * REACH * WIDTH, 2 * REACH * WIDE
#: Bins of the final strengths when the cut is chosen; every labelled row is counted in one.
BINS = 1 << 16


@dataclass
class Sums:
    """Of labelled rows by class (bad, good) and bin of strength: rows, sums of inputs, and sums of their products in wide bins."""

    rows: np.ndarray
    inputs: np.ndarray
    products: np.ndarray

    @staticmethod
    def empty(width: int) -> Sums:
        return Sums(np.zeros((2, FINE)), np.zeros((2, FINE, width)), np.zeros((2, COARSE, width, width)))

    def add(self, scaled: np.ndarray, good: np.ndarray, weights: np.ndarray) -> None:
        at = np.clip((scaled @ weights + REACH) * WIDTH, 0, FINE - 1).astype(np.int64)
        own = good * FINE + at
        self.rows += np.bincount(own, minlength=2 * FINE).reshape(2, FINE)
        for place, column in enumerate(scaled.T):
            self.inputs[:, :, place] += np.bincount(own, column, 2 * FINE).reshape(2, FINE)
        wide = good * COARSE + at * WIDE // WIDTH
        for one in np.unique(wide).tolist():
            part = scaled[wide == one]
            self.products[one // COARSE, one % COARSE] += part.T @ part


def pair_loss(sums: Sums, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of a good and a bad row, its slope and its curvature.

    A pair's loss hangs on its two strengths alone, so rows of one bin meet the other class together, at the bin's mean strength:
    all pairs are counted without being made.
    """
    used = [np.flatnonzero(n) for n in sums.rows]
    share = [n[u] / n.sum() for n, u in zip(sums.rows, used, strict=True)]
    mean = [x[u] / n[u, None] for x, n, u in zip(sums.inputs, sums.rows, used, strict=True)]
    gap = (mean[1] @ w)[:, None] - (mean[0] @ w)[None]
    both = share[1][:, None] * share[0][None]
    wrong = 1 / (1 + np.exp(np.clip(gap, -500, 500)))  # chance of the pair being the other way round
    loss = float((both * np.logaddexp(0, -gap)).sum() + ridge / 2 * (w @ w))
    slope = (both * wrong).sum(axis=0) @ mean[0] - (both * wrong).sum(axis=1) @ mean[1] + ridge * w
    # The curvature takes wide bins for all of its terms, so it stays positive.
    bend = np.zeros((COARSE, COARSE))
    np.add.at(bend, ((used[1] * WIDE // WIDTH)[:, None], (used[0] * WIDE // WIDTH)[None]), both * wrong * (1 - wrong))
    n = np.maximum(sums.rows.reshape(2, COARSE, -1).sum(axis=2), 1)
    middle = sums.inputs.reshape(2, COARSE, FINE // COARSE, -1).sum(axis=2) / n[:, :, None]
    cross = middle[1].T @ bend @ middle[0]
    curve = np.tensordot(bend.sum(axis=1) / n[1], sums.products[1], 1) + np.tensordot(bend.sum(axis=0) / n[0], sums.products[0], 1)
    return loss, slope, curve - cross - cross.T + ridge * np.eye(len(w))


def fit_weights(sums_at: Callable[[np.ndarray], Sums], width: int, ridge: float, steps: int = 25) -> tuple[np.ndarray, Sums]:
    """Weights of least :func:`pair_loss` by Newton steps, halved where one overshoots, and the sums there."""
    best, w = None, np.zeros(width)
    for _ in range(steps):
        sums = sums_at(w)
        loss, slope, curve = pair_loss(sums, w, ridge)
        if best is not None and not loss <= best[0] + 1e-9:
            w = (w + best[1]) / 2
            continue
        move = np.linalg.solve(curve, slope)
        last, best = best, (loss, w, sums)
        if slope @ move < 1e-7 or (last is not None and last[0] - loss < 1e-6):
            break
        w = w - move
    return best[1], best[2]


def strength_scale(sums: Sums, w: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of all strengths."""
    n = sums.rows.sum(axis=0)
    used = np.flatnonzero(n)
    strength = sums.inputs.sum(axis=0)[used] @ w / n[used]
    mean = float(strength @ n[used] / n.sum())
    return mean, max(1e-9, float(np.sqrt((strength - mean) ** 2 @ n[used] / n.sum())))


def strength_bins(strength: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    """Bin of each strength: 16 deviations either way, what is beyond counts in the outer ones."""
    return np.clip((strength - scale[0]) / scale[1] * (BINS / 32) + BINS / 2, 0, BINS - 1).astype(np.int64)


def cut_and_slope(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, sums: np.ndarray, scale: tuple[float, float], threshold: float) -> tuple[float, float]:
    """Of rising bins of strengths with their rows of both classes and sums of strengths: the cut and the slope of the score.

    The cut is the edge of a bin of a quantile of all strengths, with the best balanced accuracy on all rows.
    """
    n = good + bad
    at = np.minimum(np.searchsorted(np.cumsum(n), np.linspace(0, 1, 1001) * n.sum()), len(bins) - 1)
    best = (np.cumsum(bad) - bad)[at] / bad.sum() - (np.cumsum(good) - good)[at] / good.sum()
    ties = at[best >= best.max() - 1e-12]  # middle of equally good cuts
    cut = float(((bins[ties] - BINS / 2) * (32 / BINS) * scale[1] + scale[0]).mean())
    d, slope = sums / n - cut, 1.0
    for _ in range(100):  # one-parameter logistic fit, Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * d + np.log(threshold / (1 - threshold)), -30, 30)))
        step = ((n * p - good) * d).sum() / max((n * p * (1 - p) * d * d).sum(), 1e-9 * n.sum())
        slope = float(np.clip(slope - np.clip(step, -1, 1), 1e-2, 50))
    # Scores stay apart in double precision: the farthest labelled rows are at most 30 away from the cut.
    return cut, min(slope, 30 / max(1e-9, float(np.abs(d).max())))


def _one_class(width: int, threshold: float, n: int, n_good: int) -> PairModel:
    """Nothing can be preferred: every row gets the score of the class's own side of the threshold (kept if there are no rows)."""
    return PairModel(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if n and not n_good else -1.0, 1.0, threshold)


def fit_pairs(inputs: np.ndarray, good: np.ndarray, threshold: float, ridge: float = 1e-3) -> PairModel:
    """The model of :func:`fit_labelled` for rows in memory."""
    width, good = inputs.shape[1], np.asarray(good).astype(np.int64)
    if not good.any() or good.all():
        return _one_class(width, threshold, len(good), good.sum())
    model = PairModel(inputs.mean(axis=0), np.maximum(inputs.std(axis=0), 1e-6), np.zeros(width), 0.0, 1.0, threshold)
    scaled = model.scaled(inputs)

    def sums_at(w: np.ndarray) -> Sums:
        sums = Sums.empty(width)
        sums.add(scaled, good, w)
        return sums

    model.weights, sums = fit_weights(sums_at, width, ridge)
    strength, scale = scaled @ model.weights, strength_scale(sums, model.weights)
    bins, at = np.unique(strength_bins(strength, scale), return_inverse=True)
    n, n_good = np.bincount(at), np.bincount(at, good)
    model.cut, model.slope = cut_and_slope(bins, n_good, n - n_good, np.bincount(at, strength), scale, threshold)
    return model


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Model inputs of a batch whose last columns are the number of words and the statistics."""
    return terms(batch.column(-1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES)), batch.column(-2).to_numpy())


class _SumRows:
    """Sums the arrays of equal key."""

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            self.sums[key] = self.sums.get(key, 0) + part.values.to_numpy()
        return iter(())

    def close(self) -> Iterator[tuple]:
        return iter((key, part.tolist()) for key, part in self.sums.items())


def _summed(rows: DataFrame, model: PairModel, w: np.ndarray) -> Sums:
    """:class:`Sums` of all rows; tasks send one array for each bin they met, which are added up before the driver gets them."""

    def make():
        sums = Sums.empty(len(w))

        class Add:
            def __call__(self, batch):
                if batch.num_rows:
                    sums.add(model.scaled(_matrix(batch)), batch.column(0).to_numpy(), w)
                return ()

            def close(self):
                n, x, xx = sums.rows.ravel(), sums.inputs.reshape(2 * FINE, -1), sums.products.reshape(2 * COARSE, -1)
                for key in np.flatnonzero(n).tolist():
                    yield key, [n[key], *x[key].tolist()]
                for key in np.flatnonzero(n.reshape(2 * COARSE, -1).any(axis=1)).tolist():
                    yield 2 * FINE + key, xx[key].tolist()

        return Add()

    fields = "key int, part array<double>"
    parts = map_batches(rows, fields, make, batch_rows=256).repartition("key")
    out = Sums.empty(len(w))
    for row in map_batches(parts, fields, _SumRows, batch_rows=256).toArrow().to_pylist():  # at most 2 * (FINE + COARSE) rows
        key, part = row["key"], np.array(row["part"])
        if key < 2 * FINE:
            out.rows[key // FINE, key % FINE], out.inputs[key // FINE, key % FINE] = part[0], part[1:]
        else:
            out.products[(key - 2 * FINE) // COARSE, key % COARSE] = part.reshape(len(w), len(w))
    return out


def fit_labelled(rows: DataFrame, threshold: float, ridge: float = 1e-3) -> PairModel:
    """The model of all ``rows`` (good long 0 or 1, n_words, features): Bradley-Terry over every pair of a good and a bad row.

    Then the cut and slope on the strengths of all rows: the cut is the quantile with the best balanced accuracy. With only one
    class, or no rows, nothing can be preferred (see :func:`_one_class`). Each step is one job that sends sums by bin of strength.
    """
    n, n_good = rows.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    if n_good in (0, n):
        return _one_class(N_TERMS, threshold, n, n_good)
    x = F.col("features")
    every = F.concat(x, F.transform(x, lambda v: v * v), F.transform(x, lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))), F.array(F.log1p("n_words")))
    shape = rows.select(Summarizer.metrics("mean", "std").summary(array_to_vector(every)).alias("s")).first()["s"]
    model = PairModel(shape["mean"].toArray(), np.maximum(shape["std"].toArray(), 1e-6), np.zeros(N_TERMS), 0.0, 1.0, threshold)
    model.weights, sums = fit_weights(lambda w: _summed(rows, model, w), N_TERMS, ridge)
    scale = strength_scale(sums, model.weights)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            if batch.num_rows:
                strength, good = model.strength(_matrix(batch)), batch.column(0).to_numpy()
                bins, at = np.unique(strength_bins(strength, scale), return_inverse=True)
                yield from zip(
                    bins.tolist(), np.bincount(at).tolist(), np.bincount(at, good).tolist(), np.bincount(at, strength).tolist(), strict=True)
        return work

    parts = map_batches(rows, "bin long, n long, good double, strength double", make)
    bins = parts.groupBy("bin").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]]).orderBy("bin").toArrow()  # at most BINS rows
    at, n, good, strength = (bins[c].to_numpy() for c in bins.column_names)
    model.cut, model.slope = cut_and_slope(at, good, n - good, strength, scale, threshold)
    return model


def _scored(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = 0.3, folds: int = 5,
) -> DataFrame:
    """Per row: _id, _h, score."""
    source = docs.select(*row_key(id, text), F.col(text).alias("_text"))

    def measure():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            for row, h, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                words, base = base_stats(content)
                yield row, h, len(words), list(features(content, words, base))
        return work

    stats = stored(map_batches(source, "_id long, _h long, n_words long, features array<double>", measure))
    marked = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(
        F.col(id).cast("long").alias("_lid")).agg(F.min(label).alias("_label"))
    known = stats.where(remainder("_id", folds) != 0).join(marked, F.col("_id") == F.col("_lid"))
    model = fit_labelled(stored(known.select((F.col("_label") == 1).cast("long").alias("good"), "n_words", "features")), threshold)

    def judge():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if ids:
                yield from zip(ids, texts, model.score(_matrix(batch)).tolist(), strict=True)
        return work

    return map_batches(stats, "_id long, _h long, score double", judge)


def pair_quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = 0.3, folds: int = 5,
) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (score >= threshold).

    Learns from all labelled rows whose crc32(id as text) mod ``folds`` is not 0 and from no others, and scores every
    whole text from its statistics alone. Null and empty texts
    are scored like any other; a null id is held out; several labels of an id count as their minimum; repeated rows
    get equal scores. Texts may be of any length, other columns have any name; an empty table gives an empty result. See
    :func:`fit_labelled` for labels of one class.
    """
    scored = _scored(docs, labels, id, text, label, threshold, folds)
    return scored.select(
        F.col("_id").alias(id), (remainder("_id", folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.3,
) -> DataFrame:
    """``docs`` without the rows that :func:`pair_quality` predicts 0; same columns.

    Rows are told apart by id and text, so another text under the same id has a fate of its own; rows without id stay.
    """
    low = _scored(docs, labels, id, text, threshold=threshold).where(F.col("score") < threshold)
    return drop_rows(docs, low.select("_id", "_h"), id, text)
