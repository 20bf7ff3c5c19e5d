"""Exact similarity joins against all pairs."""

import hashlib
import random

import numpy as np
import pytest

from docketscope.operators import simhash, vectors

MASK = (1 << 64) - 1


def unit(x):
    return x / np.linalg.norm(x)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centres = [unit(rng.standard_normal(16)) for _ in range(40)]
    rows = [(i, (centres[i % 40] + rng.standard_normal(16) * 0.05).tolist()) for i in range(900)]
    hot = unit(rng.standard_normal(16))  # one group holds a third of all rows
    rows += [(1000 + i, (hot + rng.standard_normal(16) * 0.04).tolist()) for i in range(300)]
    rows += [(2000 + i, hot.tolist()) for i in range(150)] + [(2500, (hot * 3.0).tolist()), (2501, (hot * 1e-200).tolist())]
    return rows


def by_hand(rows, threshold):
    """(pairs of directions, class of each id) from all pairs."""
    kept = {}
    for i, v in rows:
        x = np.array(v) / np.abs(v).max()
        x = x / np.sqrt((x * x).sum())
        kept.setdefault(x.tobytes(), []).append(i)
    heads = sorted((min(ids), np.frombuffer(x)) for x, ids in kept.items())
    names, x = [h[0] for h in heads], np.stack([h[1] for h in heads])
    near = x @ x.T >= threshold
    pairs = {(names[i], names[j]) for i, j in zip(*np.nonzero(near)) if i < j}
    root = {n: n for n in names}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return pairs, {i: top(min(ids)) for ids in kept.values() for i in ids}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "comment_id long, embedding array<double>, unit string").repartition(4)


@pytest.mark.parametrize("threshold, pivots", [(0.9, None), (0.97, 5), (0.8, 60), (0.9, 1)])
def test_pairs_and_classes_are_all_there(spark, points, monkeypatch, threshold, pivots):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    pairs, classes = by_hand(points, threshold)
    got = vectors.semantic_pairs(frame(spark, points), threshold, pivots=pivots).collect()
    assert len(got) == len(pairs) and {(r["a"], r["b"]) for r in got} == pairs
    found = vectors.semantic_classes(frame(spark, points), threshold, pivots=pivots).collect()
    assert {r["comment_id"]: r["class_id"] for r in found} == classes and len(found) == len(points)


def test_cells_save_comparisons(spark, points, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    directions = vectors.directions_of(vectors.unit_rows(frame(spark, points), "comment_id", "embedding"))
    left, right, _ = vectors._units(directions, 0.95, None)
    work = vectors.comparisons(left, right).first()
    n = directions.count()
    assert work["pairs"] < 0.35 * n * (n - 1) / 2 and work["most"] <= 100 * 100


def test_unlike_vectors_are_sent_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vectors, "WHOLE_FROM", 1000)
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(1200)]
    rows += [(2000 + i, [*v[:60], 0.0, 0.0, 0.0, 0.0]) for i, v in rows[:200]]
    directions = vectors.directions_of(vectors.unit_rows(frame(spark, rows), "comment_id", "embedding"))
    left, right, _ = vectors._units(directions, 0.9, None)
    # every pair meets, from five copies of a row instead of one for most of 38 cells
    assert left.count() + right.count() == 5 * len(rows)
    pairs, classes = by_hand(rows, 0.9)
    got = vectors.semantic_pairs(frame(spark, rows), 0.9).collect()
    assert len(got) == len(pairs) >= 100 and {(r["a"], r["b"]) for r in got} == pairs
    assert {r["comment_id"]: r["class_id"] for r in vectors.semantic_classes(frame(spark, rows), 0.9).collect()} == classes


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [2.0, -0.0]),
            (None, [1.0, 0.0]), (8, [float("inf"), 1.0]), (9, []), (10, [0.0, 1.0]), (10, [0.0, 1.0])]
    found = sorted(tuple(r) for r in vectors.semantic_classes(frame(spark, rows)).collect())
    assert found == [(1, 1, True), (7, 1, False), (10, 10, True), (10, 10, True)]
    assert vectors.semantic_pairs(frame(spark, rows)).collect() == []
    assert vectors.semantic_pairs(frame(spark, [])).collect() == [] and vectors.semantic_classes(frame(spark, [])).collect() == []


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance, blocks", [(3, 4), (3, 6), (5, 8), (0, 2), (1, None)])
def test_signatures_within_the_distance(spark, monkeypatch, distance, blocks):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(25)] + [0, MASK, 1 << 63]
    sigs = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for k in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << k
            sigs.add(x)
    # one block value that most share
    sigs |= {(0xABCD << 48) | rng.getrandbits(20) for _ in range(150)}
    rows = [(s, signed(x)) for x in sigs for s in ("d1", "d2") if s == "d1" or x % 3]
    df = spark.createDataFrame(rows * 2, "scope string, signature long")
    got = [tuple(r) for r in simhash.near_signatures(df, distance, blocks).collect()]
    want = {(s, a, b, ((a ^ b) & MASK).bit_count()) for s, a in rows for t, b in rows if s == t and a < b and ((a ^ b) & MASK).bit_count() <= distance}
    assert len(got) == len(want) and set(got) == want


def by_text(text):
    words = text.split()
    runs = {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    votes = [0] * 64
    for run in runs:
        h = int(hashlib.md5(run.encode()).hexdigest()[:16], 16)
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
    return signed(sum(1 << k for k in range(64) if votes[k] > 0))


def test_letters_with_small_changes_are_one_class(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    letters = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(6)]
    rows = []
    for k, letter in enumerate(letters):
        for j in range(5):
            text = letter.split()
            if j:
                text[rng.randrange(400)] = "changed"
            rows.append((f"d{k % 2}", len(rows), " ".join(text)))
    rows += [("d0", 100, None), ("d0", 101, " \n"), ("d1", 102, "one two"), ("d1", 103, "One <b>two</b> 12"), (None, 104, letters[0]), ("d0", 100, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "docket_id string, comment_id int, comment string, links int")
    per = {r["comment_id"]: r for r in simhash.near_duplicate_comments(df).collect()}
    assert set(per) == {*range(30), 102, 103, 104}
    assert all(per[i]["signature"] == by_text(rows[i][2]) for i in range(30))
    assert all(per[i]["class_id"] == i - i % 5 for i in range(30)) and per[103]["class_id"] == 102 and per[104]["class_id"] == 104
    over = {r["comment_id"]: r["class_id"] for r in simhash.near_duplicate_comments(df, across_dockets=True).collect()}
    assert over[104] == 0 and over[4] == 0 and over[5] == 5
    assert simhash.near_duplicate_comments(df.where("false")).collect() == []


def test_repeated_ids_vote_together_and_no_shingle_is_a_row(spark):
    texts = ["one two three four five six", "six five four three two one nine", "a b", "one two three four five six seven"]
    rows = [("d", 1, texts[0]), ("d", 1, texts[1]), (None, None, texts[0]), (None, None, texts[1]), ("d", 2, texts[3]), ("d", 3, texts[2]), ("d", 3, None), ("e", 1, "12")]
    df = spark.createDataFrame(rows, "docket_id string, comment_id int, comment string")
    got = {(r["docket_id"], r["comment_id"]): r["signature"] for r in simhash.comment_signatures(df).collect()}
    once = {(r["docket_id"], r["comment_id"]): r["signature"] for r in simhash.comment_signatures(df.where("comment_id = 2")).collect()}
    assert got[("d", 2)] == once[("d", 2)] == by_text(texts[3]) and got[("d", 3)] == by_text(texts[2])
    votes = [0] * 64
    for text in texts[:2]:
        words = text.split()
        for i in range(len(words) - 4):
            h = int(hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16], 16)
            votes = [v + (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
    both = signed(sum(1 << k for k in range(64) if votes[k] > 0))
    assert got[("d", 1)] == got[(None, None)] == both and len(got) == 4
    # a row for each word of a text did not finish on 0.1 GB
    plan = simhash.comment_signatures(df.where("comment_id = 2"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_pieces_of_a_text_are_hashed_together():
    """Many shingles at once give what MD5 gives of each: empty, of one block, at its border, and longer."""
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefghij ") for _ in range(20_000))
    first = [rng.randrange(19_000) for _ in range(9000)] + [0, 20_000, 20_000 - 55, 20_000 - 56]
    last = [a + rng.randrange(80) for a in first[:9000]] + [0, 20_000, 20_000, 20_000]
    got = simhash._hashes()(text, np.array(first), np.array(last))
    assert [r.tobytes() for r in got] == [hashlib.md5(text[a:b]).digest()[:8] for a, b in zip(first, last)]


@pytest.mark.parametrize("dim", [1, 2, 16, 64])
def test_heads_bound_every_product(dim):
    """The short vectors, in single precision, never fall below the products of the vectors they stand for."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((400, dim))
    x = np.concatenate((x, x[:100] + 0.01 * rng.standard_normal((100, dim)), np.eye(dim)))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    short = vectors._heads(dim)(x)
    assert short.dtype == np.float32 and short.shape[1] <= max(2, dim // 2)
    assert ((short @ short.T) >= x @ x.T - vectors.SINGLE_SLACK * (dim + 2)).all()
    # unlike vectors are told by their heads
    if dim == 64:
        assert (short[:400] @ short[:400].T >= 0.9 - vectors.SINGLE_SLACK * (dim + 2)).mean() < 0.01
