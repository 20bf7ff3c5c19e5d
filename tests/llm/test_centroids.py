import hashlib
import math

import pytest
from pyspark.sql import functions as F

from docketscope.llm import centroids


def by_hand(rows, clusters=16, rounds=3, dim=64, scale=64):
    """Lloyd's rounds in plain integers: sorted rows of the result."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, v, [math.floor(x * scale) if abs(x) < 2**50 else int(x) * scale for x in v]))
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, q) for i, v, q in kept if i is not None)
    centres = [q for _, _, q in starts[:clusters]]
    if not centres:
        return []

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        labels = [nearest(q)[1] for _, _, q in kept]
        for k in range(len(centres)):
            mine = [q for (_, _, q), at in zip(kept, labels) if at == k]
            if mine:
                centres[k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *nearest(q)) for i, _, q in kept]
    total = [sum(d for _, d, c in found if c == k) for k in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]

    def long(x):
        return x if x < 2**63 else None

    return sorted(((i, c, long(d), long(total[c]), long(sum(total)), digest[c]) for i, d, c in found), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    return sorted((tuple(r) for r in centroids.cluster(df.repartition(3), **options).collect()), key=repr)


def test_clusters_match_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "CHUNK_ROWS", 7)
    monkeypatch.setattr(centroids, "BLOCK_COLUMNS", 24)
    rows = [(i, [math.sin(i * 37 + k * k) / (1 + i % 5) for k in range(64)]) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[4][1]), (None, rows[4][1])]
    rows += [(900, None), (901, [0.0] * 63), (902, [None] + [0.0] * 63), (903, [float("nan")] + [0.0] * 63),
             (904, [float("inf")] + [0.0] * 63), (905, []), (906, [0.0] * 64), (907, [0.0] * 64)]
    assert run(spark, rows) == by_hand(rows)


def test_huge_components_stay_exact(spark):
    rows = [(i, [(1.0 if k == i % 3 else -0.3) * 10.0 ** (i % 40) for k in range(64)]) for i in range(60)]
    assert run(spark, rows, clusters=5) == by_hand(rows, clusters=5)
    rows = [(i, [-1e300 * (i % 2), 2.0**40] + [0.5 * i] * 62) for i in range(9)]
    assert run(spark, rows, clusters=3) == by_hand(rows, clusters=3)


def test_other_shapes_of_vectors(spark):
    rows = [(i, [i * 0.3, -i * 0.7, 1.0]) for i in range(40)]
    options = {"clusters": 4, "rounds": 6, "dim": 3, "scale": 10}
    assert run(spark, rows, **options) == by_hand(rows, **options)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0] * 64)]])
def test_nothing_to_start_from(spark, rows):
    assert run(spark, rows) == []


def test_fewer_vectors_than_clusters(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert run(spark, rows) == by_hand(rows)
    df = spark.createDataFrame([(1, [1.0] * 64)], "vec_id int, embedding array<float>")
    assert centroids.cluster(df).select(F.sum("distance")).first()[0] == 0
