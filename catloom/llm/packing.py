"""Order-preserving packing of documents into training sequences by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catloom.llm.common import map_batches, task_number
from catloom.llm.tokens import CACHE_WORDS, encoder, texts, vocabulary_path

#: Costs in padding tokens: a cut between sentences of one document, and a cut inside a sentence.
SENTENCE_CUT = 2.0
HARD_CUT = 16.0
#: Tokens that are planned at once; the last sequence of a plan is planned again with what follows.
PLAN_TOKENS = 1 << 17


def padding(length: int, size: int) -> int:
    """Tokens added to a sequence of ``length``: none at a power of two, else up to ``size``."""
    return 0 if length & (length - 1) == 0 else size - length


def cut_places(ends: np.ndarray, stops: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) where a sequence may end: document ends, sentence ends, and forced places.

    Forced places stand every ``size`` tokens in a stretch without any boundary, so each place can be
    reached from the one before it.
    """
    places = np.union1d(ends, stops)
    penalties = np.where(np.isin(places, ends), 0.0, SENTENCE_CUT)
    before = np.concatenate(([0], places[:-1]))
    wide = np.flatnonzero(places - before > size)
    if len(wide):
        forced = np.concatenate([np.arange(before[i] + size, places[i], size) for i in wide])
        places, penalties = np.concatenate((places, forced)), np.concatenate((penalties, np.full(len(forced), HARD_CUT)))
        order = np.argsort(places, kind="stable")
        places, penalties = places[order], penalties[order]
    return places, penalties


def plan_cuts(places: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """Ends of the sequences that cover [0, places[-1]) at the least padding plus penalties.

    cost(j) = penalty(j) + min over i of cost(i) + padding(j - i), or + a hard cut: one full sequence that ends
    inside a sentence, followed by a sequence up to j. For a fixed j both are minima of cost(i) + i over a
    sliding range of i, kept in monotone queues; powers of two are looked up. Every place enters and
    leaves each queue once.
    """
    n = len(places)
    at = np.concatenate(([0], places))
    hits: list[list[int]] = [[] for _ in range(n + 1)]
    for power in range(size.bit_length() - 1):
        found = np.searchsorted(at, at - (1 << power))
        same = (at[found] == at - (1 << power)) & (at >= 1 << power)
        for j in np.flatnonzero(same).tolist():
            hits[j].append(int(found[j]))
    pos, extra = at.tolist(), [0.0, *penalties.tolist()]
    cost, back = [0.0] * (n + 1), [0] * (n + 1)  # back: 2 * i, plus 1 for a hard cut in between
    near: deque[tuple[float, int]] = deque()
    far: deque[tuple[float, int]] = deque()
    waiting = 0
    for j in range(1, n + 1):
        p = pos[j]
        key = cost[j - 1] + pos[j - 1]
        while near and near[-1][0] >= key:
            near.pop()
        near.append((key, j - 1))
        while pos[near[0][1]] < p - size:
            near.popleft()
        key, i = near[0]
        best, come = key + size - p, 2 * i
        while pos[waiting] < p - size:  # further back than one sequence: reachable by a hard cut
            key = cost[waiting] + pos[waiting]
            while far and far[-1][0] >= key:
                far.pop()
            far.append((key, waiting))
            waiting += 1
        while far and pos[far[0][1]] < p - 2 * size:
            far.popleft()
        if far and far[0][0] + 2 * size + HARD_CUT - p < best:
            best, come = far[0][0] + 2 * size + HARD_CUT - p, 2 * far[0][1] + 1
        for i in hits[j]:
            if cost[i] < best:
                best, come = cost[i], 2 * i
        cost[j], back[j] = best + extra[j], come
    cuts, j = [], n
    while j:
        cuts.append(pos[j])
        j, hard = divmod(back[j], 2)
        if hard:
            cuts.append(pos[j] + size)
    return cuts[::-1]


class Packer:
    """Takes documents in order, emits pieces. Holds at most one plan and the document that crosses it."""

    def __init__(self, path: str, size: int, end_id: int, cache_words: int = CACHE_WORDS):
        self.encoder = encoder(path, cache_words)
        self.size, self.end_id = size, end_id
        tokens = [self.encoder.tokenizer.id_to_token(i) or "" for i in range(self.encoder.size)]
        breaks = self.encoder.alphabet[10]
        self.stop = np.array([t.endswith((".", "!", "?")) or breaks in t for t in tokens], bool)
        self.docs: deque[tuple[int | None, np.ndarray, int]] = deque()  # id, ids, ids already packed
        self.held = 0
        self.sequence = task_number() << 40

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            ids = np.append(self.encoder.ids(text).astype("<u4"), np.uint32(self.end_id))
            self.docs.append((row, ids, 0))
            self.held += len(ids)
            if self.held >= PLAN_TOKENS:
                yield from self._pack(last=False)

    def close(self) -> Iterator[tuple]:
        yield from self._pack(last=True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        sizes = np.array([len(ids) - done for _, ids, done in self.docs])
        ends = np.cumsum(sizes)
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        stops = np.flatnonzero(self.stop[np.minimum(stream, len(self.stop) - 1)]) + 1
        places, penalties = cut_places(ends, stops, self.size)
        cuts = plan_cuts(places, penalties, self.size)
        if not last:  # a plan longer than one sequence has at least two cuts
            cuts = cuts[:-1]
        start = 0
        for cut in cuts:
            yield from self._emit(cut - start)
            start = cut
        self.held -= start

    def _emit(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            row, ids, done = self.docs[0]
            take = min(length - offset, len(ids) - done)
            crc = zlib.crc32(ids[done:done + take].tobytes())
            yield row, done, take, crc, len(ids), self.sequence, offset, length
            offset += take
            if done + take == len(ids):
                self.docs.popleft()
            else:
                self.docs[0] = (row, ids, done + take)
        self.sequence += 1


def pack_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 1024, path: str | None = None, end_id: int = 0,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    Documents are packed in the order of the input, task by task and without a shuffle; sequence_id is
    unique over all tasks (task number, then a count) and the same when a task runs again. Every
    document ends with ``end_id``, so a null or empty text is one token. A repeated row is packed again. The
    padding of a sequence is :func:`padding` of sequence_tokens. ``size`` must be a power of two. A worker keeps the ids of
    ``cache_words`` words (about 270 bytes each), which changes its memory and speed, but no result. Cuts are best within a plan
    of PLAN_TOKENS tokens of a task.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    fields = (
        "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "sequence_tokens long"
    )
    return map_batches(rows, fields, lambda: Packer(path, size, end_id, cache_words)).withColumnRenamed("_id", id)
