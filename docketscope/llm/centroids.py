"""Centroid clustering: Lloyd's rounds over vectors that are sharded by dimension.

Vectors are turned into integers and cut into chunks of rows and blocks of columns; a (chunk, block)
pair is one record of a keyed RDD that is dealt by its key once and then stays where it is. In a round each record
gives the exact partial squared distances of its rows to the centroids' slices of its columns;
``reduceByKey`` adds the blocks of a chunk and takes the nearest centroid of each row. The labels, a byte or two
per row, go back to the blocks, which add up their own columns by cluster; the sums of a block are added and its
slice of the centroids becomes the floor of the means. Only slices (clusters x dimensions) reach the driver.

All arithmetic is exact: 64-bit integers where the largest component allows it, Python's integers otherwise.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out; rows
without id are clustered but never start a centroid; an id that occurs more than once is one row each time
and may start several centroids, in the order of their components; with fewer vectors than clusters there
are fewer centroids; empty centroids stay; ties go to the smaller number; an empty table gives no rows; a
distance or sum beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketscope.llm.runtime import columns
from docketscope.session import cut_lineage

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = "1"
# Rows of a chunk and columns of a block.
CHUNK_ROWS = 2048
BLOCK_COLUMNS = 32

_KINDS = [np.dtype(k) for k in (np.int8, np.int16, np.int32, np.int64)]
_LONG = 1 << 63
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    if not x.size:
        return x.astype(np.int8)
    least, most = int(x.min()), int(x.max())
    for kind in _KINDS:
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype(object)


def _reach(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _wide(x: np.ndarray, reach: int, columns_: int) -> np.ndarray:
    """Integers in which ``columns_`` squares of twice ``reach`` can be added exactly."""
    return x.astype(np.int64) if 4 * reach * reach * max(columns_, 1) < _LONG else x.astype(object)


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles as exact integers."""
    if not x.size or np.abs(x).max() < 2.0**50 / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = np.array([int(np.floor(v * scale)) if abs(v) < 2.0**50 else int(v) * scale for v in x.ravel()], dtype=object)
    return whole.reshape(x.shape)


def partial_distances(x: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids over one block of columns (rows x centroids)."""
    reach = max(_reach(x), _reach(slice_))
    x, slice_ = _wide(x, reach, x.shape[1]), _wide(slice_, reach, x.shape[1])
    return _narrow(np.stack([((x - c) ** 2).sum(axis=1) for c in slice_], axis=1))


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    exact = np.int64 if max(_reach(a), _reach(b)) < _LONG // 2 else object
    return _narrow(a.astype(exact) + b.astype(exact))


def _nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid number, its distance) of each row; ties go to the smaller number."""
    label = distances.argmin(axis=1)
    return _narrow(label), _narrow(distances[np.arange(len(label)), label])


def _cluster_sums(x: np.ndarray, labels: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the rows by cluster, rows by cluster) over one block of columns."""
    exact = np.int64 if _reach(x) * max(len(x), 1) < _LONG else object
    sums = np.zeros((clusters, x.shape[1]), dtype=exact)
    np.add.at(sums, labels.astype(np.int64), x.astype(exact))
    return _narrow(sums), np.bincount(labels.astype(np.int64), minlength=clusters)


def _chunks(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(chunk, block, ids of block 0, x): the integers of some rows and columns, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK_ROWS):
                part = whole.slice(first, CHUNK_ROWS)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                x = quantised(flat.reshape(-1, dim), scale)
                blocks = range(0, dim, BLOCK_COLUMNS)
                data = [pickle.dumps(_narrow(x[:, at : at + BLOCK_COLUMNS])) for at in blocks]
                ids = [part.column("id").to_pylist()] + [None] * (len(data) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()),
                        pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary()),
                    ],
                    ["chunk", "block", "ids", "x"],
                )
                chunk += 1

    return cut_lineage(vectors.mapInArrow(run, "chunk long, block int, ids array<long>, x binary"))


def _assigned(data: RDD, slices: dict[int, np.ndarray], parts: int) -> RDD:
    """(chunk, (labels, distances)): partial distances of the blocks, added by chunk, then the nearest centroid."""

    def block(item: tuple) -> tuple:
        (chunk, at), x = item
        return chunk, partial_distances(pickle.loads(x), slices[at])

    return data.map(block).reduceByKey(_added, parts).mapValues(_nearest)


def _moved(data: RDD, labelled: RDD, slices: dict[int, np.ndarray], parts: int) -> dict[int, np.ndarray]:
    """Each block's new slice of the centroids: the floor of its columns' means by cluster."""
    blocks, clusters = sorted(slices), len(slices[0])
    told = labelled.flatMap(lambda kv: [((kv[0], b), kv[1][0]) for b in blocks])

    def block(item: tuple) -> tuple:
        (_, at), (x, labels) = item
        return at, _cluster_sums(pickle.loads(x), labels, clusters)

    def update(item: tuple) -> tuple:
        at, (sums, counts) = item
        kind = sums.dtype if sums.dtype == object else np.int64
        means = sums.astype(kind) // np.maximum(counts, 1).astype(kind)[:, None]
        return at, _narrow(np.where((counts > 0)[:, None], means, slices[at].astype(means.dtype)))

    def both(a: tuple, b: tuple) -> tuple:
        return _added(a[0], b[0]), a[1] + b[1]

    return dict(data.join(told, parts).map(block).reduceByKey(both).map(update).collect())


def _expanded(found: DataFrame, totals: list[int], digests: list[str]) -> DataFrame:
    """One row per vector from one row per chunk."""

    def long(x: int) -> int | None:
        return x if x < _LONG else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inertia, all_ = [long(t) for t in totals], long(sum(totals))
        for batch in batches:
            for ids, data in zip(batch.column("ids").to_pylist(), batch.column("found").to_pylist(), strict=True):
                labels, distances = pickle.loads(data)
                labels = labels.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(labels, pa.int32()),
                        pa.array([long(d) for d in distances.tolist()], pa.int64()),
                        pa.array([inertia[c] for c in labels], pa.int64()), pa.array([all_] * len(labels), pa.int64()),
                        pa.array([digests[c] for c in labels], pa.string()),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return found.mapInArrow(run, _RESULT)


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    given = columns(vectors, id=F.col(f"`{id_col}`").cast("long"), v=F.col(f"`{vector_col}`").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = given.where(F.coalesce((F.size("v") == dim) & finite, F.lit(False)))
    order = [F.asc(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)), F.asc("v")]
    starts = kept.where(F.col("id").isNotNull()).orderBy(*order).limit(clusters).select("v").collect()
    if not starts:
        return spark.createDataFrame([], _RESULT)
    first = quantised(np.array([r["v"] for r in starts], dtype=np.float64).reshape(-1, dim), scale)
    slices = {k: _narrow(first[:, at : at + BLOCK_COLUMNS]) for k, at in enumerate(range(0, dim, BLOCK_COLUMNS))}

    stored = _chunks(kept, dim, scale)
    cells = stored.select("chunk", "block", "x").rdd
    parts = max(spark.sparkContext.defaultParallelism, cells.getNumPartitions())
    data = cells.map(lambda r: ((r["chunk"], r["block"]), bytes(r["x"]))).partitionBy(parts).persist()
    for _ in range(rounds):
        labelled = _assigned(data, slices, parts).persist()
        slices = _moved(data, labelled, slices, parts)
        labelled.unpersist()

    last = _assigned(data, slices, parts).map(lambda kv: (kv[0], pickle.dumps(kv[1])))
    found = cut_lineage(spark.createDataFrame(last, "chunk long, found binary"))
    data.unpersist()

    def sums(_: int, part: Iterator) -> Iterator[tuple[int, int]]:
        for row in part:
            labels, distances = pickle.loads(row["found"])
            for c in np.unique(labels).tolist():
                yield c, int(distances[labels == c].sum(dtype=object))

    by_cluster = dict(found.rdd.mapPartitionsWithIndex(sums).reduceByKey(lambda a, b: a + b).collect())
    centroids = np.concatenate([slices[k].astype(object) for k in sorted(slices)], axis=1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    ids = stored.where(F.col("block") == 0).select("chunk", "ids")
    return _expanded(
        ids.join(found, "chunk").select("ids", "found"), [by_cluster.get(c, 0) for c in range(len(centroids))], digests
    )
