"""Brown class-based bigrams: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catloom.llm.common import discard, map_batches, raw, remainder, stored, task_number

END = b"\n"  # no word holds white space
SMOOTH = 0.1
#: Words with a unit of their own in the exchange, where the others start as GROUPS units by their ending; then each of them chooses
#: its class by its own neighbours.
SINGLE_WORDS = 1000
GROUPS = 64
CLASSES = 24
#: Words whose counts travel to every task; the counts of all others are joined by a shuffle.
HEAD_WORDS = 150_000
COUNTER_WORDS = 300_000
TRANSITION_SMOOTH = 0.5


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def group_of(word: bytes) -> int:
    """Group of a word without a unit of its own: by its last two bytes."""
    return zlib.crc32(word[-2:]) % GROUPS


class _Count:
    """Counts words of a task in bounded memory."""

    def __init__(self):
        self.counts: Counter[bytes] = Counter()

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        for text in raw(batch.column(0)):
            self.counts.update(words_of(text))
            self.counts[END] += 1
            if len(self.counts) > COUNTER_WORDS:
                yield from self.close()

    def close(self) -> Iterator[tuple]:
        yield from self.counts.items()
        self.counts = Counter()


@dataclass
class Vocabulary:
    """The end and the most frequent words by falling count; the number of words is bounded by HEAD_WORDS."""

    words: list[bytes]
    counts: np.ndarray

    def units(self, single: int) -> np.ndarray:
        """Unit of each place: 0 is the end, then single words, then groups."""
        rank, out = 1, np.empty(len(self.words) + GROUPS, np.int64)
        for place, word in enumerate(self.words):
            if word == END:
                out[place] = 0
            elif rank <= single:
                out[place], rank = rank, rank + 1
            else:
                out[place] = single + 1 + group_of(word)
        out[len(self.words):] = single + 1 + np.arange(GROUPS)
        return out


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each unit, by moving one unit at a time to the class that raises the bigram likelihood most.

    ``bigrams`` counts unit pairs. Unit 0, the end of a text, keeps class 0 for itself. Ends when a sweep moves nothing.
    """
    n = len(bigrams)
    counts = bigrams.astype(np.float64)
    order = 1 + np.argsort(-counts[1:].sum(axis=1), kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % max(1, classes - 1)
    member = np.eye(classes)[of]
    right, left = counts @ member, counts.T @ member  # of a unit: counts of the classes after and before it
    table = member.T @ right

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for unit in order.tolist():
            own, r, l, s = of[unit], right[unit], left[unit], counts[unit, unit]
            if not r.any() and not l.any():
                continue
            r, l = r.copy(), l.copy()
            r[own] -= s
            l[own] -= s
            table[own] -= r
            table[:, own] -= l
            table[own, own] -= s
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            diagonal = np.diag(table)
            gain = (f(table + r) - f(table)).sum(axis=1) + (f(table + l[:, None]) - f(table)).sum(axis=0)
            gain += f(diagonal + r + l + s) - f(diagonal + r) - f(diagonal + l) + f(diagonal)
            total_r, total_l = r.sum() + s, l.sum() + s
            gain -= f(rows + total_r) - f(rows) + f(columns + total_l) - f(columns)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table[best] += r
            table[:, best] += l
            table[best, best] += s
            if best != own:
                moved += 1
                of[unit] = best
                right[:, own] -= counts[:, unit]
                right[:, best] += counts[:, unit]
                left[:, own] -= counts[unit]
                left[:, best] += counts[unit]
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """log10 tables of transitions and of the emission's denominators, and the class of each place."""

    vocabulary: Vocabulary
    classes: np.ndarray  # of each place; behind the head those of unseen words, by group
    transition: np.ndarray
    class_total: np.ndarray  # log10 of the emission's denominator, per class
    total: int
    distinct: int


def count_words(training: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``training`` (one text column), ends of texts included."""
    return map_batches(training, "word binary, n long", _Count).groupBy("word").agg(F.sum("n").alias("n"))


# --- Rows of places ---------------------------------------------------------------------------------------------------


def encode(source: DataFrame, head) -> DataFrame:
    """(_row, _id, held_out, seq, far, at) of (id, held, text), stored.

    ``seq`` holds the place of each word in the head as 32-bit integers, the end's last and -1 for a word beyond; ``far`` has the distinct
    words beyond and ``at`` the number there of each -1.
    """

    def make():
        places = dict(zip(head.value.words, range(len(head.value.words)), strict=True))
        base = task_number() << 40

        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal base
            for row, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                words = words_of(text)
                seq = np.array([*(places.get(w, -1) for w in words), 0], "<i4")
                far: dict[bytes, int] = {}
                at = [far.setdefault(words[i], len(far)) for i in np.flatnonzero(seq < 0).tolist()]
                yield base, row, held, seq.tobytes(), list(far), np.array(at, "<i4").tobytes()
                base += 1
        return work

    return stored(map_batches(source, "_row long, _id long, held_out boolean, seq binary, far array<binary>, at binary", make, batch_rows=1024))


def _values(batch: pa.RecordBatch, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """Per row of (seq, far, at): the places, ``of`` each place (of the group for words beyond), the words beyond and their numbers."""
    n = len(of) - GROUPS
    for seq, far, at in zip(*(batch.column(c).to_pylist() for c in ("seq", "far", "at")), strict=True):
        seq, at = np.frombuffer(seq, "<i4"), np.frombuffer(at, "<i4")
        own = of[seq]  # -1 is put right below
        if len(at):
            own[seq < 0] = of[[n + group_of(w) for w in far]][at]
        yield seq, own, far, at


def count_pairs(rows: DataFrame, size: int, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Pairs of neighbouring values over all rows, from the end (0) before the first on; the matrix is bounded, whatever the corpus."""

    def make():
        total = np.zeros(size * size, np.int64)

        class Count:
            def __call__(self, batch):
                for own in values(batch):
                    np.add.at(total, np.concatenate(([0], own[:-1])).astype(np.int64) * size + own, 1)
                return ()

            def close(self):
                used = np.flatnonzero(total)
                return zip(used.tolist(), total[used].tolist(), strict=True)

        return Count()

    out = np.zeros(size * size, np.int64)
    pairs = map_batches(rows, "pair long, n long", make).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    return out.reshape(size, size)


# --- Every word's own class ---------------------------------------------------------------------------------------------


def best_classes(counts: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of each word that raises the bigram likelihood most, the other words left where they are.

    ``counts`` has for each word its neighbours by class, those before it first; ``own`` is its class in ``table``, the counts of
    class pairs. A word stays where nothing is gained. Class 0 is the end's.
    """
    classes = len(table)

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    def rise(cells, more):
        return f(cells + more) - f(cells)

    word, slot = np.nonzero(counts)
    n = counts[word, slot]
    both = np.vstack((table, table.T))  # row: class before (of the columns' class), then class after
    gain = np.zeros((len(counts), classes))
    mine = own[word]
    cells = both[slot].astype(float)
    more = np.repeat(n[:, None], classes, axis=1).astype(float)
    here = np.arange(len(word))
    kept = np.maximum(cells[here, mine] - n, 0)  # what the class has without the word
    cells[here, mine] = kept
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    gain[word[starts]] = np.add.reduceat(rise(cells, more), starts, axis=0)
    total = counts[:, :classes].sum(axis=1).astype(float)
    for size in (table.sum(axis=1), table.sum(axis=0)):
        whole = np.repeat(size[None].astype(float), len(counts), axis=0)
        every = np.arange(len(counts))
        whole[every, own] = np.maximum(whole[every, own] - total, 0)
        gain -= rise(whole, total[:, None])
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    every = np.arange(len(counts))
    return np.where(gain[every, best] > gain[every, own] + 1e-9, best, own)


def choose_classes(rows: DataFrame, head, start: np.ndarray, single: int, table: np.ndarray) -> DataFrame:
    """(place, word, n, class) of every word of the training ``rows`` that is not clustered one by one; place -1 is beyond the head.

    A word's neighbours are counted by their class in ``start``; words are merged in sorted order, one at a time.
    """
    classes = len(table)
    slots = 2 * classes

    def neighbours():
        units = head.value.units(single)[:len(head.value.words)]
        grouped = units > single
        total = np.zeros(len(units) * slots, np.int32)

        class Count:
            def __call__(self, batch):
                for seq, own, far, at in _values(batch, start):
                    before, after = np.concatenate(([0], own[:-1])), classes + np.concatenate((own[1:], [0]))
                    of_head = np.flatnonzero((seq >= 0) & grouped[seq])
                    np.add.at(total, seq[of_head].astype(np.int64) * slots + before[of_head], 1)
                    np.add.at(total, seq[of_head].astype(np.int64) * slots + after[of_head], 1)
                    if len(at):
                        beyond = seq < 0
                        pairs = np.stack((before[beyond], after[beyond]), axis=1).astype(np.uint8)
                        order = np.argsort(at, kind="stable")
                        ends = np.cumsum(np.bincount(at, minlength=len(far))) * 2
                        packed, low = pairs[order].tobytes(), 0
                        for word, high in zip(far, ends.tolist(), strict=True):
                            yield -1, word, packed[low:high], None
                            low = high

            def close(self):
                counts = total.reshape(-1, slots)
                for place in np.flatnonzero(counts.any(axis=1)).tolist():
                    used = np.flatnonzero(counts[place])
                    yield place, None, used.astype(np.uint8).tobytes(), counts[place, used].astype("<i8").tobytes()

        return Count()

    def merge():
        held: list = [None, np.zeros(slots, np.int64)]  # key and counts of the last word, which the next batch may go on with

        def chosen(keys, counts):
            n_head = len(start) - GROUPS
            own = start[[p if p >= 0 else n_head + group_of(w) for p, w in keys]]
            best = best_classes(counts, own, table)
            yield from zip(*zip(*keys, strict=True), counts[:, :classes].sum(axis=1).tolist(), best.tolist(), strict=True)

        class Merge:
            def __call__(self, batch):
                if not batch.num_rows:
                    return
                places, words, used, ns = (c.to_pylist() for c in batch.columns)
                keys, number = ([held[0]] if held[0] else []), []
                for key in zip(places, words, strict=True):
                    if not keys or key != keys[-1]:
                        keys.append(key)
                    number.append(len(keys) - 1)
                flat = np.frombuffer(b"".join(used), np.uint8)
                times = np.concatenate([np.ones(len(u), np.int64) if n is None else np.frombuffer(n, "<i8") for u, n in zip(used, ns, strict=True)])
                codes = np.repeat(number, [len(u) for u in used]) * slots + flat
                counts = np.bincount(codes, times, len(keys) * slots).astype(np.int64).reshape(-1, slots)
                counts[0] += held[1] if held[0] else 0
                held[:] = keys[-1], counts[-1]
                if len(keys) > 1:
                    yield from chosen(keys[:-1], counts[:-1])

            def close(self):
                if held[0]:
                    yield from chosen([held[0]], held[1][None])

        return Merge()

    parts = map_batches(rows, "place int, word binary, slots binary, ns binary", neighbours)
    parts = parts.repartition("place", "word").sortWithinPartitions("place", "word")
    return stored(map_batches(parts, "place int, word binary, n long, class int", merge))


def learn(source: DataFrame, counts: DataFrame, classes: int, single: int, head_words: int) -> tuple[ClassModel, DataFrame]:
    """The model from the rows of ``source`` (id, held, text) that are not held, and all rows with the classes of their words, stored.

    The most frequent words are exchanged one by one, the others as groups. Then each other word, however rare, takes the class that
    its own neighbours favour most; the transitions and emissions are counted anew with every word in its own class.
    """
    spark = source.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    is_end = F.col("word") == F.lit(END)
    ends = counts.where(is_end).first()
    top = counts.where(~is_end).orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    numbers = np.concatenate(([ends["n"] if ends else 0], top["n"].to_numpy())).astype(np.float64)
    vocabulary = Vocabulary([END, *top["word"].to_pylist()], numbers)
    n_head = len(vocabulary.words)
    head = spark.sparkContext.broadcast(vocabulary)
    rows = encode(source, head)
    training = rows.where(~F.col("held_out")).select("seq", "far", "at")
    units = vocabulary.units(single)
    bigrams = count_pairs(training, single + 1 + GROUPS, lambda batch: (own for _, own, _, _ in _values(batch, units)))
    of = exchange(bigrams, classes)
    member = np.eye(classes, dtype=np.int64)[of]
    chosen = choose_classes(training, head, of[units], single, member.T @ bigrams @ member)
    place_classes = of[units]
    own = chosen.where("place >= 0").select("place", "class").toArrow()  # at most head_words rows
    place_classes[own["place"].to_numpy()] = own["class"].to_numpy()
    beyond = chosen.where("place < 0").select("word", F.col("n").alias("_n"), F.col("class").alias("_class"))
    kinds = np.bincount(place_classes[:n_head], minlength=classes).astype(float)
    for row in beyond.groupBy("_class").count().collect():  # at most one row a class
        kinds[row["_class"]] += row["count"]
    logs = np.log10(vocabulary.counts + SMOOTH)
    shared = spark.sparkContext.broadcast((place_classes, logs, vocabulary.counts[0]))

    def classed():
        of_place, log_counts, n_end = shared.value

        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            first, others = (batch.column(c).to_pylist() for c in ("_row", "_id")), batch.column("held_out").to_pylist()
            for row, i, held, (seq, own_class, far, at) in zip(*first, others, _values(batch, of_place), strict=True):
                log = float(log_counts[seq[seq >= 0]].sum())
                known = len(seq) - len(at) - (not n_end)
                yield row, i, held, known, log, own_class.astype(np.uint8).tobytes(), np.flatnonzero(seq < 0).astype("<i4").tobytes(), at.tobytes()
        return work

    fields = "_row long, _id long, held_out boolean, n_known long, log double, own binary, places binary, at binary"
    start = map_batches(rows, fields, classed, batch_rows=1024)
    far = rows.select(F.col("_row").alias("_far_row"), F.posexplode("far").alias("_k", "_word"))
    met = far.join(beyond, F.col("_word") == F.col("word")).groupBy("_far_row").agg(
        F.collect_list("_k").alias("ks"), F.collect_list("_n").alias("ns"), F.collect_list("_class").alias("cs"))
    joined = start.join(met, F.col("_row") == F.col("_far_row"), "left").select(*[f.split()[0] for f in fields.split(", ")][1:], "ks", "ns", "cs")

    def resolved():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            for i, held, known, log, own_class, places, at, ks, ns, cs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own_class, places, at = np.frombuffer(own_class, np.uint8).copy(), np.frombuffer(places, "<i4"), np.frombuffer(at, "<i4")
                if len(at):
                    n, c = np.zeros(at.max() + 1, np.int64), np.full(at.max() + 1, -1)
                    if ks:
                        n[ks], c[ks] = ns, cs
                    own_class[places] = np.where(c[at] >= 0, c[at], own_class[places])
                    log += float(np.log10(n[at] + SMOOTH).sum())
                    known += int((n[at] > 0).sum())
                yield i, held, known, log, own_class.tobytes()
        return work

    rows_out = stored(map_batches(joined, "_id long, held_out boolean, n_known long, log double, own binary", resolved, batch_rows=1024))
    discard(rows, chosen)
    moves = count_pairs(
        rows_out.where(~F.col("held_out")).select("own"), classes, lambda batch: (np.frombuffer(x, np.uint8) for x in batch.column(0).to_pylist()))
    transition = (moves + TRANSITION_SMOOTH) / (moves.sum(axis=1, keepdims=True) + TRANSITION_SMOOTH * classes)
    emitted = moves.sum(axis=0) + SMOOTH * (kinds + 1)
    return ClassModel(vocabulary, place_classes, np.log10(transition), np.log10(emitted), int(total), int(distinct)), rows_out


def fit(training: DataFrame, counts: DataFrame, classes: int, single: int, head_words: int):
    """(model, rows) from all rows of ``training`` (one text column)."""
    return learn(training.select(F.lit(None).cast("long"), F.lit(False), training.columns[0]), counts, classes, single, head_words)


def brown_scores(
    docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 10, classes: int = CLASSES,
    single_words: int = SINGLE_WORDS, head_words: int = HEAD_WORDS,
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Every text is its words (A-Z lowered) and one end. Rows whose crc32(id as text) mod ``folds`` is not 0
    train. The ``single_words`` most frequent words are exchanged one by one; every other word that occurs then takes the class that its own
    neighbours favour (:func:`learn`). Only words that no training row has take a class by their ending.
    score multiplies class transitions, from the end's class on, and word emissions within the class, both
    smoothed; base_score is the smoothed unigram. Counts and classes of words beyond the ``head_words`` most frequent are joined, never broadcast.
    Null and empty texts are one end; a null id counts as empty text, which is held out; without training rows all
    counts are zero. Repeated rows train and score as often as given.
    """
    held = remainder(id, folds) == 0
    training = docs.where(~held).select(F.col(text).alias("_text"))
    counts = stored(count_words(training))
    source = docs.select(F.col(id).cast("long").alias("_id"), held.alias("_held"), F.col(text).alias("_text"))
    model, rows = learn(source, counts, classes, single_words, head_words)
    base_unit = float(np.log10(model.total + SMOOTH * (model.distinct + 1)))
    transition, class_total = model.transition, model.class_total

    def score():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            for i, held_out, known, log, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(own, np.uint8)
                moves = float(transition[np.concatenate(([0], own[:-1])), own].sum())
                yield i, held_out, len(own), known, log - len(own) * base_unit, log + moves - float(class_total[own].sum())
        return work

    fields = "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = map_batches(rows, fields, score)
    return scored.select(
        F.col("_id").alias(id), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
