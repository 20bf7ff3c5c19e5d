"""Packing documents into sequences: order-preserving dynamic programming over cuts.

The documents of a partition form one stream of ids in table order. Cuts may fall at
the end of a document (free), at the end of a sentence (small penalty) or at every 32nd
id of a document (larger penalty); a window between two cuts holds at most ``limit``
ids and pays its padding. Cheapest cuts come from

    cost(j) = penalty(j) + limit - at(j) + min over i of (cost(i) + at(i)),  at(j) - at(i) <= limit

whose sliding minimum is kept in a monotone queue, so the work is linear in the cuts.
Blocks of documents are solved one after the other and the last window of a block is
carried into the next, so a task's memory does not depend on its partition, and no row is
shuffled. Sequences never span partitions: each partition ends with one open sequence.

Cases: a null or empty text is one end id; a text of any length is cut; repeated rows are
packed as often as they occur; null document ids are kept; an empty table gives no rows; other
columns are ignored. Sequences depend on how the table is split into partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docketscope.llm import tokens
from docketscope.llm.runtime import columns, slices

LIMIT = 2048
END_ID = 1
SENTENCE_PENALTY = 6
CUT_PENALTY = 48
CUT_EVERY = 32
# Ids solved at once. Larger blocks change at most one window per block.
BLOCK = 1 << 18

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)


def best_cuts(at: list[int], penalty: list[float], limit: int) -> list[int]:
    """Indices of the cheapest cuts from the first to the last candidate (both included).

    ``at`` rises strictly and no two neighbours are further apart than ``limit``.
    """
    n = len(at)
    best = [0.0] * n
    came = [0] * n
    queue, values, head = [0], [float(at[0])], 0
    for j in range(1, n):
        here = at[j]
        oldest = here - limit
        while at[queue[head]] < oldest:
            head += 1
        came[j] = queue[head]
        value = penalty[j] + limit + values[head]
        best[j] = value - here
        while len(queue) > head and values[-1] >= value:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(value)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of one document (its end last) and their penalties."""
    n = len(ids)
    cost = np.zeros(n + 1, dtype=np.float32)
    cost[CUT_EVERY:n:CUT_EVERY] = CUT_PENALTY
    cost[1:n][ends[ids[:-1]] & blank[ids[1:]]] = SENTENCE_PENALTY
    at = np.flatnonzero(cost)
    return np.append(at, n), np.append(cost[at], 0)


def pack_stream(
    documents: Iterable[tuple[object, np.ndarray]], ends: np.ndarray, blank: np.ndarray, limit: int = LIMIT
) -> Iterator[tuple]:
    """(key, start, ids of the piece, ids of the document, sequence, offset) for each piece."""
    waiting: list[tuple] = []  # (key, ids, from where it is still unpacked)
    held, sequence = 0, 0

    def solve(last: bool) -> Iterator[tuple]:
        nonlocal waiting, held, sequence
        at, penalty, owner, base = [np.zeros(1, dtype=np.int64)], [np.zeros(1)], [], 0
        for key, ids, begin in waiting:
            where, cost = candidates(ids, ends, blank)
            keep = where > begin
            at.append(where[keep] - begin + base)
            penalty.append(cost[keep])
            owner.append(base)
            base += len(ids) - begin
        at, penalty = np.concatenate(at), np.concatenate(penalty)
        cuts = at[best_cuts(at.tolist(), penalty.tolist(), limit)]
        stop = len(cuts) - 1 if last else len(cuts) - 2
        owner = np.asarray(owner + [base])
        for w in range(stop):
            low, high = int(cuts[w]), int(cuts[w + 1])
            k = int(owner.searchsorted(low, side="right")) - 1
            while k < len(waiting) and owner[k] < high:
                key, ids, begin = waiting[k]
                a, b = max(low, int(owner[k])), min(high, int(owner[k + 1]))
                start = a - int(owner[k]) + begin
                yield key, start, ids[start : start + b - a], len(ids), sequence, a - low
                k += 1
            sequence += 1
        if last:
            waiting, held = [], 0
            return
        low = int(cuts[stop])
        k = int(owner.searchsorted(low, side="right")) - 1
        key, ids, begin = waiting[k]
        waiting = [(key, ids, low - int(owner[k]) + begin), *waiting[k + 1 :]]
        held = base - low

    for key, ids in documents:
        waiting.append((key, ids, 0))
        held += len(ids)
        if held >= BLOCK:
            yield from solve(last=False)
    if waiting:
        yield from solve(last=True)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    vocabulary: str = tokens.VOCABULARY,
    ranks: str = tokens.RANKS,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``limit`` ids.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers; ``start`` counts the
    document's ids before it, ``offset`` its place in the sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary, ranks)
        ends, blank = coder.breaks()
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        tail = np.asarray([END_ID], dtype="<u4").tobytes()

        def documents():
            for part in slices(batches, "text"):
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    yield key, np.frombuffer(coder.encode(text or "") + tail, dtype="<u4")

        rows, size = [], 0
        for key, start, ids, total, sequence, offset in pack_stream(documents(), ends, blank, limit):
            rows.append((key, start, len(ids), total, first + sequence, offset, ids.tobytes()))
            size += len(ids)
            if size >= 1 << 20:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)
