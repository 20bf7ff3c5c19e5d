"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of lower-cased words, word pairs and pairs that skip one or two words, hashed to
2**BITS coordinates. Training takes at most ``most`` labelled documents (those with the smallest seeded
hash of their id; the bound is a parameter) in SHARDS parallel streams: each stream runs FTRL-proximal
(McMahan et al. 2013) with a learning rate per coordinate, after each epoch the streams' states are averaged.
L1 leaves few weights other than zero; they are broadcast, and all documents are scored in one pass
without a shuffle.

Cases: null and empty texts get the score of the intercept; texts of any length are read whole; labels
that are null, repeated or contradictory count once per document (toxic if any row says so); repeated
rows are scored alike; rows without id are scored and never trained on; without labels every
score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketscope.llm.runtime import columns, slices
from docketscope.llm.textbytes import PLAIN, Texts, mix
from docketscope.session import cut_lineage

BITS = 20
MOST_LABELLED = 20_000
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.01
# Step sizes of pairs: neighbours, and pairs that skip one or two words.
GAPS = (1, 2, 3)
SEED = 4


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, bounds): the rising distinct coordinates of text i are bounds[i] to bounds[i + 1]."""
    words, bounds = Texts.of(column, PLAIN).words()
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    kinds = [(text, mix(words + np.uint64(1)))]
    for gap in GAPS:
        same = text[gap:] == text[:-gap]
        pair = words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] * np.uint64(0xC2B2AE3D27D4EB4F)
        kinds.append((text[gap:][same], mix(pair + np.uint64(gap + 1))[same]))
    keys = np.concatenate([(t.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for t, h in kinds])
    keys = np.unique(keys)
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), keys.searchsorted(
        np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(BITS)
    )


@dataclass
class Ftrl:
    """State of FTRL-proximal; the last coordinate is the intercept, which is not regularised."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> Ftrl:
        return cls(np.zeros((1 << BITS) + 1, dtype=np.float32), np.zeros((1 << BITS) + 1, dtype=np.float32))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """Closed-form weights; the intercept's L1 is taken back by ``_l1``."""
        z, n = self.z[at].astype(np.float64), self.n[at].astype(np.float64)
        l1 = np.full(len(z), L1)
        l1[-1] = 0.0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, coordinates: np.ndarray, label: int) -> None:
        """One step on one document."""
        at = np.append(coordinates, 1 << BITS)
        weights = self.weights(at)
        g = _sigmoid(weights.sum()) - label
        n = self.n[at].astype(np.float64)
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / ALPHA * weights
        self.n[at] = after


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, text, order, stream) of the labelled sample; texts are a quarter of their coordinates."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)
    )
    # at most ``most`` pairs of integers
    met = docs.join(F.broadcast(sample), "doc_id")
    place = F.xxhash64(F.lit(SEED), "doc_id")
    return met.select(
        "doc_id", "toxic", "text", place.alias("place"), F.xxhash64("text").alias("tie"), F.pmod(place, F.lit(SHARDS)).alias("stream")
    )


def _epoch(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """One pass of one stream over its rows, starting from the shared state."""

    def run(table: pa.Table) -> pa.Table:
        own, seen, last = Ftrl(*(a.copy() for a in shared.value)), 0, None
        order = np.lexsort(tuple(table.column(c).to_numpy() for c in ("tie", "doc_id", "place")))
        for part in slices(table.take(pa.array(order)).combine_chunks().to_batches(), "text"):
            at, bounds = features(part.column("text"))
            for k, (key, label) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("toxic").to_pylist(), strict=True)):
                if key != last:  # rows that repeat an id follow one another
                    own.learn(at[bounds[k] : bounds[k + 1]], label)
                    seen += 1
                last = key
        return pa.table({"seen": pa.array([seen], pa.int64()), "z": [own.z.tobytes()], "n": [own.n.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all coordinates and the intercept, from (doc_id, text) and (doc_id, toxic)."""
    rows = cut_lineage(_training_rows(docs, labels, most))
    context = docs.sparkSession.sparkContext
    state = Ftrl.empty()
    for _ in range(epochs):
        shared = context.broadcast((state.z, state.n))

        # SHARDS groups of a bounded sample, one fixed-size state each
        states = rows.groupBy("stream").applyInArrow(_epoch(shared), "seen long, z binary, n binary").collect()
        states.sort(key=lambda s: (s["seen"], s["z"]))
        shared.unpersist()
        if not states:
            break
        total = sum(s["seen"] for s in states)
        for name in ("z", "n"):
            mean = np.zeros((1 << BITS) + 1)
            for s in states:
                mean += np.frombuffer(s[name], np.float32) * (s["seen"] / total)
            setattr(state, name, mean.astype(np.float32))
    return state.weights(slice(None))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every text."""
    dense = weights.astype(np.float32)
    used = np.flatnonzero(dense)
    shared = docs.sparkSession.sparkContext.broadcast((used, dense[used]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) + 1)
        table[shared.value[0]] = shared.value[1]
        for part in slices(batches, "text"):
            at, bounds = features(part.column("text"))
            sums = np.concatenate(([0.0], np.cumsum(table[at])))
            scores = _sigmoid(np.diff(sums[bounds]) + table[-1])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = MOST_LABELLED,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document row."""
    narrow = columns(docs, doc_id=id_col, text=text_col)
    marks = columns(labels, doc_id=id_col, toxic=F.col(f"`{label_col}`").cast("int"))
    scored = score(narrow, fit(narrow, marks, most))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
