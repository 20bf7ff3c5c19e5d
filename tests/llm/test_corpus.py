"""Mixing, sharding, near-duplicates, toxicity, vector search, page languages and the pipeline."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from docketscope.llm import language, mixing, near_dups, neighbours, queries, sharding, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def targets_of(sizes, most=3):
    """Shares by weight 1, 2, 3, ...; what is above ``most`` sizes is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        want = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and want[s] > most * sizes[s]}
        if not over:
            return want
        capped |= over


def check_mix(rows, documents):
    """Sizes, targets and caps by the contract; every source's words come near its target."""
    source = {r["doc_id"]: r["source"] for r in documents}
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in documents}
    sizes = defaultdict(int)
    for key, s in source.items():
        sizes[s] += size[key]
    want, taken = targets_of(sizes), defaultdict(int)
    assert sorted(r["doc_id"] for r in rows) == sorted(source)
    for r in rows:
        key = r["doc_id"]
        assert r["size"] == size[key] and r["source_size"] == sizes[source[key]]
        assert r["target"] == pytest.approx(want[source[key]])
        assert r["taken"] in {k * size[key] for k in range(4)}
        taken[source[key]] += r["taken"]
    return want, taken


def test_mixing_query(spark, documents):
    rows = queries.op3_mixing(spark, SF).collect()
    want, taken = check_mix(rows, documents.collect())
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)
    again = queries.op3_mixing(spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_caps_and_null_sources(spark):
    rows = [(k, "w " * (5 + k % 7), None if k % 40 == 0 else f"s{k % 4 and 1}") for k in range(1200)]
    rows += [(5000, "one", "tiny"), (5001, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, taken = check_mix(mixing.mix_sources(docs).collect(), docs.collect())
    assert want["tiny"] == 3 and taken["tiny"] == 3 and want["void"] == 0
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_mixing_odd_documents(spark, odd_documents, no_documents):
    mixed = mixing.mix_sources(odd_documents)
    assert mixed.count() == odd_documents.count()
    repeated = mixing.repeat_documents(odd_documents)
    assert repeated.columns == odd_documents.columns
    assert repeated.count() == mixed.agg({"copies": "sum"}).first()[0]
    words = sum(len(brute.WORD.findall(r["text"] or "")) for r in repeated.collect())
    assert words == mixed.agg({"taken": "sum"}).first()[0]
    assert mixing.mix_sources(no_documents).count() == 0 and mixing.repeat_documents(no_documents).count() == 0


def test_ranking_does_not_depend_on_ranges(spark, documents, monkeypatch):
    before = sorted(map(str, mixing.mix_sources(documents).collect()))
    monkeypatch.setattr(mixing, "RANKED_ROWS", 1)
    assert sorted(map(str, mixing.mix_sources(documents).collect())) == before


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 12), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 200))
def test_lengths_fit_the_budget(counts, budget):
    lengths, many = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    taken = mixing.fit_lengths(lengths, many, budget)
    assert (taken >= 0).all() and (taken <= many).all()
    sums = {0}
    for n, m in counts.items():
        sums = {s + k * n for s in sums for k in range(m + 1)}
    # shares first, the rest by the program: no worse than two of the shortest documents
    assert abs(int((taken * lengths).sum()) - budget) <= min(abs(s - budget) for s in sums) + 2 * max(lengths[0], 1)


def test_small_budgets_are_met_exactly(monkeypatch):
    lengths, many = np.array([7, 11, 200, 333, 901]), np.array([1, 1, 1, 1, 1])
    for budget in (18, 207, 540, 1241, 1452):
        taken = mixing.fit_lengths(lengths, many, budget)
        best = min(abs(sum(n for k, n in enumerate(lengths) if m >> k & 1) - budget) for m in range(32))
        assert abs(int((taken * lengths).sum()) - budget) == best
    monkeypatch.setattr(mixing, "DP_BUDGET", 300)
    lengths, many = np.arange(1, 200), np.full(199, 40)
    assert int((mixing.fit_lengths(lengths, many, 123_457) * lengths).sum()) == 123_457


@pytest.mark.parametrize("lengths, counts, budget, words", [
    ([1_000_000], [1], 950_000, 1_000_000), ([1_000_000], [1], 450_000, 0), ([400_000], [3], 1_100_000, 1_200_000),
    ([30_000], [1], 29_000, 30_000), ([66_500], [1], 66_000, 66_500), ([3, 90_000, 100_000], [1, 1, 1], 60_000, 90_000),
])
def test_long_documents_are_taken_when_that_is_nearer(lengths, counts, budget, words):
    taken = mixing.fit_lengths(np.array(lengths), np.array(counts), budget)
    assert (taken <= counts).all() and int((taken * np.array(lengths)).sum()) == words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(60_000, 400_000), min_size=1, max_size=5, unique=True), st.integers(1, 1_500_000))
def test_no_single_long_document_would_come_nearer(lengths, budget):
    lengths = np.array(sorted(lengths))
    taken = mixing.fit_lengths(lengths, np.ones(len(lengths), dtype=int), budget)
    words = int((taken * lengths).sum())
    assert all(abs(words - budget) <= abs(words + n - budget) for n in lengths[taken == 0])


def check_rows_law(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(shards))
    even = [counts.get(s, 0) for s in range(shards)]
    assert max(even) - min(even) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_sharding_query(spark, documents):
    rows = queries.op7_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, brute.crc(data), "rows")
    check_rows_law(rows, 16)


def test_sharding_odd_documents(spark, odd_documents, no_documents):
    rows = sharding.assign_shards(odd_documents, shards=5).collect()
    assert len(rows) == odd_documents.count()
    check_rows_law(rows, 5)
    hot = spark.range(3000).selectExpr("7L as doc_id", "'same' as text")
    check_rows_law(sharding.assign_shards(hot, shards=7).collect(), 7)
    assert sharding.assign_shards(no_documents).count() == 0


def walked_shards(rows, shards, nodes=sharding.NODES, bits=sharding.RING_BITS):
    """Shards of rows in ring order, one row after the other: home while it has room, then clockwise."""
    points = {}
    for value, shard in sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{k}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for k in range(nodes)
    ):
        points.setdefault(value >> (64 - bits), shard)
    ring = sorted(points)
    first = [next((k for k, p in enumerate(ring) if p >= cell), 0) for cell in (r[0] for r in rows)]
    home = [points[ring[k]] for k in first]
    wanted = Counter(home)
    room = dict.fromkeys(range(shards), len(rows) // shards)
    for shard in sorted(room, key=lambda s: (-wanted[s], s))[: len(rows) % shards]:
        room[shard] += 1
    out, over = [None] * len(rows), []
    for i, shard in enumerate(home):
        if room[shard]:
            out[i] = shard
            room[shard] -= 1
        else:
            over.append(i)
    for i in over:
        k = first[i]
        while not room[points[ring[k % len(ring)]]]:
            k += 1
        out[i] = points[ring[k % len(ring)]]
        room[out[i]] -= 1
    return out


@pytest.mark.parametrize("range_rows", [sharding.RANGE_ROWS, 40])
def test_sharding_equals_a_walk_round_the_ring(spark, documents, monkeypatch, range_rows):
    monkeypatch.setattr(sharding, "RANGE_ROWS", range_rows)
    # many texts without id, many of one id, one row very often, and others
    docs = documents.select("doc_id", "text").unionByName(
        spark.range(600).selectExpr("cast(null as long) as doc_id", "concat('t', id % 500) as text")
    ).unionByName(spark.range(300).selectExpr("-5L as doc_id", "repeat('x', cast(id as int)) as text")).unionByName(
        spark.range(700).selectExpr("-9L as doc_id", "'same' as text")
    )
    keyed = docs.selectExpr(
        "*", f"cast(shiftrightunsigned(xxhash64(doc_id), {64 - sharding.RING_BITS}) as int) as cell",
        "coalesce(octet_length(text), 0) + 1L as size", "crc32(cast(coalesce(text, '') as binary)) as crc",
    ).selectExpr("*", "shiftrightunsigned(xxhash64(doc_id, size, crc), 33) as head").collect()
    rows = sorted((r["cell"], r["head"], r["doc_id"] or 0, r["crc"], r["size"]) for r in keyed)
    id_of = {(r["cell"], r["head"], r["crc"], r["size"]): r["doc_id"] for r in keyed}
    want = Counter((id_of[r[0], r[1], r[3], r[4]], r[4], r[3], s) for r, s in zip(rows, walked_shards(rows, 7)))
    got = sharding.assign_shards(docs, shards=7).collect()
    check_rows_law(got, 7)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want


def test_sharding_moves_little():
    loads = np.random.default_rng(2).poisson(0.5, 1 << sharding.RING_BITS)

    def shard_of(shards):
        placed = sharding.place_cells(loads, shards)
        return np.concatenate([[(r.cell, k, r.shard) for k in range(r.low, r.high)] for r in placed.itertuples()])

    a, b = ({(c, k): s for c, k, s in shard_of(n).tolist()} for n in (16, 17))
    assert a.keys() == b.keys() and len(a) == loads.sum()
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert moved < 0.10  # 1 of 17 is needed; a plain modulo would move 16


def share_weight(documents, rows):
    """1 for a shingle of all documents, 1.15 for one of at most every 1024th; the logarithm between."""
    return 1 + 0.15 * math.log2(1 / max(documents / rows, 1 / 1024)) / 10


def weighted_links(rows):
    """Pairs of different texts with weighted Jaccard similarity of 0.8 or more, by comparing all pairs."""
    found = Counter(s for r in rows for s in set(brute.shingle_list(r["text"])))
    texts = sorted({r["text"] or "" for r in rows})
    profiles = [
        {s: n * share_weight(found[s], len(rows)) for s, n in Counter(brute.shingle_list(t)).items()} for t in texts
    ]
    for i in range(len(texts)):
        for j in range(i):
            x, y = profiles[i], profiles[j]
            both = x.keys() & y.keys()
            if both:
                shared = sum(min(x[s], y[s]) for s in both)
                if shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared):
                    yield texts[i], texts[j]


def classes_of(rows, links):
    """Smallest id of each connected class of texts."""
    root = {r["text"] or "": r["text"] or "" for r in rows}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = find(r["text"] or "")
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    return {r["doc_id"]: least.get(find(r["text"] or "")) for r in rows}


def variants(spark):
    """Chains and stars of near-copies, exact copies, and strangers that share one passage."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(80)]
        for v in range(10):
            words = list(base)
            for at in rng.integers(0, 80, v // 2):
                words[at] = f"x{g}_{v}_{at}"
            rows.append(" ".join(words))
            base = words if g % 2 else base
        rows += [rows[-1]] * 3
    rows += [passage + " " + " ".join(f"s{k}_{i}" for i in range(int(rng.integers(5, 90)))) for k in range(60)]
    rows += [None, "", " ", "two words", "two words", "a b c d e"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize("made", [False, True])
def test_near_duplicates_equal_all_pairs(spark, made):
    docs = variants(spark) if made else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = classes_of(rows, weighted_links(rows))
    got = {r["doc_id"]: r["class_id"] for r in near_dups.find_near_duplicates(docs).collect()}
    assert got == want
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_dealt_blocks_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 2)
    test_near_duplicates_equal_all_pairs(spark, True)


def test_links_between_components_do_not_depend_on_samples():
    # 80 of 100 shingles shared: pairs of similarity 0.8, the first with fewer than 30 equal samples
    for g in range(20_000):
        common = [f"g{g}w{k}" for k in range(84)]
        texts = [" ".join(common + [f"g{g}{side}{k}" for k in range(10)]) for side in "ab"]
        one, two = ((near_dups.sample(h, np.log(c)) for h, c in near_dups._shingles(pa.array(texts))))
        if (one == two).sum() < 30:
            break
    table = pa.table({
        "leader": [b"l", b"l"], "digest": [b"a", b"b"], "label": [b"a", b"b"], "d": [0.3, 0.3], "out": [True, True],
        "role": pa.array([3, 3], pa.int32()), "text": texts,
    })
    assert (one == two).sum() < 30
    even = near_dups.Idf(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    assert near_dups._block_links(table, even) == [(b"a", b"b", 0.8)]


@pytest.mark.parametrize("bits", [3, 20])
def test_document_frequencies_are_exact(spark, documents, bits):
    texts = documents.selectExpr("coalesce(text, '') as text")
    # 11 times the table: more than 1024 documents, so that the floor lies above one document
    many = texts.crossJoin(spark.range(11)).select("text")
    for rows in (texts, many):
        hashes, counts, total = near_dups.document_frequencies(rows, bits)
        listed = [r["text"] for r in rows.collect()]
        want = Counter(s for t in listed for s in set(brute.shingle_list(t)))
        least = max(1, len(listed) // 1024)
        assert total == len(listed) and (np.diff(hashes.astype(object)) > 0).all()
        assert sorted(counts.tolist()) == sorted(n for n in want.values() if n > least)
        weights = near_dups.idf_table(hashes, counts, total)
        mean = [weights.of(h) for h, _ in near_dups._shingles(pa.array(listed[:20]))]
        for text, got in zip(listed, mean):
            assert sorted(got) == pytest.approx(sorted(share_weight(want[s], total) for s in set(brute.shingle_list(text))))


def test_weights_keep_pairs_of_large_groups():
    # all that is shared is in every document, all that differs is unique among many
    frequent, rare = near_dups.idf_of_share(1.0), near_dups.idf_of_share(1e-9)
    assert 0.822 * frequent / (0.822 * frequent + 0.178 * rare) >= near_dups.SIMILARITY


def test_near_duplicates_query(spark, documents):
    rows = queries.op5_near_duplicates(spark, SF).collect()
    assert len(rows) == documents.count()


def test_near_duplicates_odd_documents(spark, odd_documents, no_documents):
    rows = near_dups.find_near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert by_id[0] == by_id[1] == 0 and by_id[4] == 4
    kept = near_dups.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in odd_documents.collect()})
    assert near_dups.find_near_duplicates(no_documents).count() == 0 and near_dups.keep_one(no_documents).count() == 0


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    agree, similar = [], []
    for _ in range(150):
        a = np.sort(rng.integers(0, 1 << 63, 120, dtype=np.uint64))
        w = rng.uniform(0.5, 3, 120)
        keep = rng.random(120) < 0.8
        x, y = (a, w), (a[keep], w[keep] * rng.choice([1.0, 0.7], keep.sum()))
        agree.append((near_dups.sample(x[0], np.log(x[1])) == near_dups.sample(y[0], np.log(y[1]))).mean())
        similar.append(near_dups.weighted_jaccard(x, y))
    assert abs(np.mean(agree) - np.mean(similar)) < 0.02


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op4_toxicity(spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()
    ranks = rows["score"].rank()
    toxic = rows["toxic"] == 1
    n, m = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n * (n + 1) / 2) / (n * m) > 0.98
    assert ((rows["predicted"] == 1) == toxic).mean() > 0.95


def test_toxicity_weights_equal_a_plain_loop(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    ids = [r[0] for r in labels.join(documents, "doc_id").select("doc_id").distinct().collect()]
    ids = sorted(i for i in ids if brute.crc(str(i).encode()) % 5)[:60]
    docs = documents.where(F.col("doc_id").isin(ids)).select("doc_id", "text")
    place = F.xxhash64(F.lit(toxicity.SEED), "doc_id")
    rows = docs.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").withColumn("place", place).collect()
    streams = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["place"]):
        streams[r["place"] % toxicity.SHARDS].append(([*toxicity.features(pa.array([r["text"]]))[0].tolist(), "bias"], r["toxic"]))

    def weight(z, n, i):
        l1 = 0.0 if i == "bias" else 3.0
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / (1.0 + math.sqrt(n[i]) + 0.01)

    z, n = defaultdict(float), defaultdict(float)
    for _ in range(3):
        ends = []
        for stream in streams.values():
            own_z, own_n = z.copy(), n.copy()
            for coordinates, label in stream:
                w = {i: weight(own_z, own_n, i) for i in coordinates}
                g = 1 / (1 + math.exp(-sum(w.values()))) - label
                for i in coordinates:
                    own_z[i] += g - (math.sqrt(own_n[i] + g * g) - math.sqrt(own_n[i])) * w[i]
                    own_n[i] += g * g
            ends.append((len(stream) / len(rows), own_z, own_n))
        z, n = (defaultdict(float, {i: sum(e[0] * e[k][i] for e in ends) for i in set().union(*(e[k] for e in ends))}) for k in (1, 2))
    got = toxicity.fit(docs, labels.where(F.col("doc_id").isin(ids)))
    want = np.zeros(len(got))
    for i in z:
        want[-1 if i == "bias" else i] = weight(z, n, i)
    assert len(rows) == len(ids) == 60 and np.count_nonzero(want) > 1
    assert np.abs(got - want).max() < 1e-4


def test_toxicity_features():
    at, bounds = toxicity.features(pa.array(["One two, three!", None, "one ONE one", "x"]))
    counts = np.diff(bounds)
    # words, pairs and pairs that skip one word
    assert counts.tolist() == [3 + 2 + 1, 0, 1 + 1 + 1, 1]
    assert len(at) == bounds[-1]


def test_toxicity_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (5, 0), (6, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (brute.crc(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    none = toxicity.score_toxicity(odd_documents, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.score_toxicity(no_documents, labels).count() == 0


def exact_search(ids, x, nearest=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:nearest]
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in order]
    return out


@pytest.mark.parametrize("bucket_rows", [4096, 60])
def test_search_recall(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", bucket_rows)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    want = exact_search(table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float))
    rows = queries.op6_neighbours(spark, "/root/testdata/sf0.01").collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys()
    hits = 0
    for key, near in want.items():
        assert len(found[key]) == len(near)
        hits += len({v for v, _ in near} & {v for v, _ in found[key]})
        if bucket_rows == 4096:
            assert [v for v, _ in found[key]] == [v for v, _ in near]
            assert np.allclose([s for _, s in found[key]], [s for _, s in near], atol=1e-12)
    assert hits / (20 * len(want)) >= (1 if bucket_rows == 4096 else 0.9)


def test_search_reaches_its_target_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PROBES", 8)
    test_search_recall(spark, monkeypatch, 60)


def unit_rows(n, seed, spread=None):
    """Unit vectors in 64 dimensions: random, or round 100 centres."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    if spread is not None:
        x = rng.standard_normal((100, 64))[rng.integers(0, 100, n)] + spread * x
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fitted(x, queries, rows=None, nearest=20):
    scores = queries @ x.T
    near = [x[i] for i in np.argsort(-scores, axis=1)[:, 1 : nearest + 1]]
    return neighbours.fit(0, 1.0, rows or len(x), x[: neighbours.SAMPLE], queries, near)


def compared(hashing, x, q):
    """Numbers of the rows that one query compares, with repetitions over tables."""
    rows = []
    for table in range(hashing.tables):
        block, cell = hashing.index(x, table)
        place = hashing.places(q[None, :], table)[0]
        for b, spent in zip(*hashing.visits(place, table)):
            rows.append(np.flatnonzero((block == b) & np.isin(cell, hashing.buckets(place, spent))))
    return np.concatenate(rows)


@pytest.mark.parametrize("spread, most", [(None, 0.75), (0.4, 0.2)])
def test_fewer_comparisons_than_rows(spread, most):
    x = unit_rows(51282, 6, spread)
    hashing = fitted(x, x[: neighbours.SAMPLE_QUERIES])
    assert hashing.bits > 0
    met, hits = 0, 0
    for q in range(10000, 10040):  # queries that the fit has not seen
        rows = compared(hashing, x, x[q])
        near = np.argsort(-(x @ x[q]))[1:21]
        met, hits = met + len(rows), hits + len(set(near) & set(rows.tolist()))
    assert hits / (40 * 20) >= 0.9
    assert met / (40 * len(x)) <= most


def test_search_hashes_with_production_parameters(spark):
    x = unit_rows(6000, 3, 0.5)
    x[17] *= 1000  # one long vector does not end the hashing of the others
    x[40] *= 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = defaultdict(list)
    for r in neighbours.search(df, "id % 20 = 0").collect():
        found[r["query_id"]].append(r["vec_id"])
    want = exact_search(np.arange(6000), x)
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert sum(len({v for v, _ in near} & set(found[q])) for q, near in want.items()) >= 0.9 * 20 * len(want)


def test_search_scores_beyond_doubles(spark):
    rows = [(i, [1e300 * (i + 1), -1e300, 1.0]) for i in range(30)] + [(40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, "id % 20 = 0").toPandas()
    assert (found.groupby("query_id").size() == 20).all() and sorted(found["query_id"].unique()) == [0, 20, 40]


def test_search_odd_vectors(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [float(i % 3 + 1), float(i % 5), 1.0]) for i in range(100)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [nan, 1.0, 1.0]), (260, [inf, 1.0, 1.0]), (280, [1.0, None, 1.0])]
    rows += [(300, []), (320, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (40, [1.0, 0.0, 1.0])]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    for block, buckets in ((8192, 4096), (7, 4096), (7, 10)):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        monkeypatch.setattr(neighbours, "BUCKET_ROWS", buckets)
        found = neighbours.search(docs, "id % 20 = 0").toPandas()
        assert sorted(found["query_id"].unique()) == [0, 20, 40, 60, 80]
        assert (found.groupby("query_id").size() == 20).all()
        ids = np.arange(100)
        x = np.array([r[1] for r in rows[:100]])
        if buckets == 4096:
            for key, near in exact_search(ids, x).items():
                if key != 40:
                    assert found[found.query_id == key].sort_values("rank")["vec_id"].tolist() == [v for v, _ in near]
    few = neighbours.search(docs.where("vec_id < 5"), "id % 20 = 0").toPandas()
    assert len(few) == 4
    assert neighbours.search(docs.limit(0), "id % 20 = 0").count() == 0


def test_probes_come_in_order_of_distance():
    rng = np.random.default_rng(4)
    for _ in range(30):
        low = rng.random(4)
        steps, costs = neighbours.perturbations(low, 9.0)
        cost = [sum((low[k] if s < 0 else 1 - low[k]) ** 2 for k, s in enumerate(chosen) if s) for chosen in steps.tolist()]
        assert len(steps) == 81 == len({tuple(c) for c in steps.tolist()})
        assert np.allclose(cost, costs) and (np.diff(costs) >= 0).all()
        few, within = neighbours.perturbations(low, 0.7)
        assert len(few) == sum(c <= 0.7 for c in costs) and (within <= 0.7).all()
        assert neighbours.perturbations(low, 9.0, 80) is None


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_language(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert np.mean([r["lang"] == r["declared"] for r in rows]) > 0.97
    assert all(0 < r["probability"] <= 1 for r in rows)


def test_text_outweighs_wrong_markup_and_hosts_fill_gaps(spark, documents):
    texts = {r["lang"]: r["text"] for r in documents.where("length(text) > 800").collect()}
    page = "<html{}><head><script>var x='{}'</script></head><body><p>{}</p></body></html>"
    rows = [(1, "http://a.example.com/x", page.format(' lang="fr"', "", texts["de"]))]
    rows += [(10 + k, f"http://host.example.org/{k}", page.format("", "", texts["es"])) for k in range(20)]
    rows += [(50, "http://host.example.org/none", ""), (51, None, None), (52, "http://x.example.fr/", None), (53, "::[bad", "<")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string")
    got = {r["page_id"]: r["lang"] for r in language.identify_languages(pages, documents).collect()}
    assert got[1] == "de" and all(got[10 + k] == "es" for k in range(20)) and got[50] == "es" and got[52] == "fr"
    assert len(got) == len(rows)
    none = language.identify_languages(pages, documents.limit(0)).collect()
    assert len(none) == len(rows) and all(r["lang"] is None for r in none)
    assert language.identify_languages(pages.limit(0), documents).count() == 0


def test_held_out_documents_are_identified(spark, documents):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = whole.where("doc_id % 2 = 1 and n_chars > 200").selectExpr("doc_id as page_id", "cast(null as string) as url", "text as html", "lang as l")
    found = language.identify_languages(pages, whole.where("doc_id % 2 = 0"))
    rows = found.join(pages.select("page_id", "l"), "page_id").collect()
    assert np.mean([r["lang"] == r["l"] for r in rows]) > 0.97


def test_pipeline(spark, documents):
    docs, columns = documents, documents.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            docs = out.persist()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "packing"]
    words = docs.collect()
    assert not any(brute.base_spans(r["text"]) for r in words)
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.where("start = 0").count() == len(words)


def test_pipeline_odd_documents(spark, odd_documents, no_documents):
    # varied words pass the rules; one such text twice, once without source
    fine = " ".join(f"word{i} of{i * i}" for i in range(40)) + ". Write to a@b.example.org today."
    more = spark.createDataFrame([(900, fine, "en", "s1", 1), (901, fine, "en", None, 1)], no_documents.schema)
    for docs, ids in ((odd_documents.select(no_documents.columns).unionByName(more), {900}), (no_documents, set())):
        given = {r["doc_id"] for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == no_documents.columns
            rows = docs.collect()
            left = {r["doc_id"] for r in rows}
            assert left <= given and ids <= left, name
            given = left
        assert 901 not in given and not any(brute.base_spans(r["text"]) for r in rows)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {p["doc_id"] for p in pieces} == given and all(0 < p["length"] <= 2048 for p in pieces)
        assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
