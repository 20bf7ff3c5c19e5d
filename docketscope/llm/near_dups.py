"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

1. Texts become digests; equal texts are one node from here on.
2. A text's features are its 5-word shingles (64-bit hashes). A feature weighs tf * idf. idf depends on the
   share of all documents that hold the shingle: 1 for all, rising with the logarithm to 1 + IDF_SPREAD for a
   share of FLOOR or less, so it means the same at any corpus size. It is damped: a pair of plain similarity
   0.822 stays above 0.8 even where all that is shared is in every document and all that differs is rare, so
   the texts of a large group of near-copies still resemble one another. Frequencies above FLOOR are exact: a
   table of 2**DF_BITS hash buckets, added up block by block, says which buckets can hold such a shingle, and
   the shingles of those buckets are counted by hash, pre-aggregated per task.
3. Improved consistent weighted sampling (Ioffe 2010) draws SAMPLES features per text; two texts agree
   on a sample with the probability of their weighted Jaccard similarity. Three samples make a
   band; two texts of similarity 0.8 miss each other in all 16 bands once in 100,000 times.
4. Texts that share a band meet the leader of that bucket, the text whose bands are the most common ones
   (the likely origin of its copies): as many pairs as members. Pairs are verified by exact weighted
   Jaccard similarity, verified links give components.
5. Texts that met one leader but lie in different components are then compared too, in blocks
   of bounded size that return only links. 1 - similarity is a metric, so a pair whose
   distances to the leader differ by more than 0.2 cannot be linked, nor can one whose total weights
   differ by more than a fifth; all others are verified exactly, those with the most equal samples first.

No group is collected anywhere: buckets, links and components are rows in joins and partial
aggregates, and skewed joins are split by the engine. Driver memory holds the bucket table and the shingles of
more than FLOOR of all documents: at most 1024 times the mean number of shingles in a document, whatever the
number of documents.

Cases: null counts as empty, empty texts are copies of one another; texts of 1 to 4 words are one
shingle; repeated rows are copies; a class without any id has a null class id; an empty table gives no
rows; other columns are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketscope.llm.runtime import columns, slices
from docketscope.llm.textbytes import Texts, mix, ngrams
from docketscope.operators.components import connected_components
from docketscope.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 3
SAMPLES = BANDS * ROWS
DF_BITS = 20
BLOCK_BITS = 14
# idf lies between 1 and 1 + IDF_SPREAD, which is reached at this share of all documents
IDF_SPREAD = 0.15
FLOOR = 1 / 1024
# Shingles a task holds before it counts and emits them.
HELD = 1 << 20
# Texts of one leader compared together.
BLOCK_ROWS = 1024
SLACK = 1 - SIMILARITY + 1e-9

_TABLE_BITS = 16


# ---- document frequencies ------------------------------------------------------------------


def _shingles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of each text's distinct shingles, hashes rising."""
    texts = Texts.of(column)
    grams, bounds = ngrams(*texts.words(), SHINGLE)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(grams[a:b], return_counts=True)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _bucket_counts(texts: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """(documents with a shingle in each hash bucket, number of documents) of a column ``text``.

    Every task adds up one table of fixed size; blocks of it are summed by streaming tasks.
    """
    size = 1 << min(BLOCK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = np.zeros(1 << bits, dtype=np.int64), 0
        for part in slices(batches, "text"):
            rows += part.num_rows
            found = [np.unique(_bucket(hashes, bits)) for hashes, _ in _shingles(part.column("text"))]
            table += np.bincount(np.concatenate(found), minlength=len(table)) if found else 0
        blocks = table.astype("<i4").reshape(-1, size)
        used = [k for k in range(len(blocks)) if blocks[k].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used], pa.int32()), pa.array([np.array([rows], "<i4").tobytes(), *(blocks[k].tobytes() for k in used)])],
            ["block", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for block, counts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                values = np.frombuffer(counts, "<i4").astype(np.int64)
                sums[block] = sums[block] + values if block in sums else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"]
        )

    summed = (
        texts.mapInArrow(count, "block int, counts binary").repartition((1 << bits) // size, "block")
        .mapInArrow(add, "block int, counts binary")
    )
    table, rows = np.zeros(1 << bits, dtype=np.int64), 0
    for row in summed.collect():
        values = np.frombuffer(row["counts"], "<i8")
        if row["block"] < 0:
            rows = int(values[0])
        else:
            table[row["block"] * size : (row["block"] + 1) * size] = values
    return table, rows


def _count_marked(texts: DataFrame, marked: Broadcast, bits: int) -> DataFrame:
    """(hash, n): exact document frequencies of the shingles in marked buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(marked.value).astype(bool)
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

        for part in slices(batches, "text"):
            held += [hashes[wanted[_bucket(hashes, bits)]] for hashes, _ in _shingles(part.column("text"))]
            if sum(map(len, held)) > HELD:
                yield counted()
                held = []
        if held:
            yield counted()

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass
class Idf:
    """idf of the frequent shingles (hashes rising), and the one of all others."""

    hashes: np.ndarray
    values: np.ndarray
    rest: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rest)
        if len(self.hashes):
            at = np.minimum(self.hashes.searchsorted(hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.values[at[known]]
        return out


def idf_of_share(share: np.ndarray | float) -> np.ndarray:
    """idf of a shingle that this share of all documents holds."""
    return 1 + IDF_SPREAD * np.log(np.maximum(share, FLOOR)) / log(FLOOR)


def document_frequencies(texts: DataFrame, bits: int = DF_BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, documents, all documents) of the shingles that two and more than FLOOR of all documents hold.

    A bucket's count is at least that of each of its shingles, so none is missed.
    """
    table, rows = _bucket_counts(texts, bits)
    least = max(1, int(FLOOR * rows))
    marked = table > least
    if not marked.any():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), rows
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(marked))
    found = _count_marked(texts, shared, bits).where(F.col("n") > least).toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order], rows


def idf_table(hashes: np.ndarray, documents: np.ndarray, rows: int) -> Idf:
    """Weights from document frequencies; a shingle without one is held by FLOOR of all documents or by one."""
    return Idf(hashes, idf_of_share(documents / max(rows, 1)), float(idf_of_share(1 / max(rows, 1))))


# ---- sampling and similarity ---------------------------------------------------------------


@lru_cache(maxsize=1)
def _randoms() -> tuple[np.ndarray, ...]:
    """Odd multipliers per sample, and tables of r, log c and beta."""
    rng = np.random.Generator(np.random.PCG64(5))
    odd = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = 1 << _TABLE_BITS
    r, c, beta = rng.gamma(2.0, 1.0, n), rng.gamma(2.0, 1.0, n), rng.random(n)
    return odd[:, None], r.astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32)


def sample(hashes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """SAMPLES consistent samples of a weighted set (logarithms of weights), as 64-bit integers."""
    odd, r_table, c_table, beta_table = _randoms()
    best = np.full(SAMPLES, np.inf, dtype=np.float32)
    found = np.zeros(SAMPLES, dtype=np.uint64)
    rows = np.arange(SAMPLES)
    for a in range(0, len(hashes), 8192):
        part, weight = hashes[a : a + 8192], logs[a : a + 8192].astype(np.float32)
        place = ((part[None, :] * odd) >> np.uint64(64 - _TABLE_BITS)).astype(np.int32)
        r, beta = r_table[place], beta_table[place]
        t = np.floor(weight[None, :] / r + beta)
        value = c_table[place] - r * (t - beta + 1)
        at = value.argmin(axis=1)
        least = value[rows, at]
        better = least < best
        best = np.where(better, least, best)
        names = mix(part[at] + mix(t[rows, at].astype(np.int64).astype(np.uint64) + np.uint64(1)))
        found = np.where(better, names, found)
    return found


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[k::ROWS])
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets (rising hashes, weights)."""
    total = a[1].sum() + b[1].sum()
    if total == 0:
        return 1.0
    _, i, k = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][k]).sum()
    return float(shared / (total - shared))


def _signatures(texts: DataFrame, idf: Broadcast) -> DataFrame:
    """(key, digest): the bands of each distinct text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            digests, keys = [], []
            names = part.column("digest").to_pylist()
            fresh = [k for k, d in enumerate(names) if d not in seen and not seen.add(d)]
            if len(seen) > 1_000_000:
                seen.clear()
            for k, (hashes, counts) in zip(fresh, _shingles(part.column("text").take(pa.array(fresh, pa.int64()))), strict=True):
                if len(hashes):
                    digests.append(names[k])
                    keys.append(band_keys(sample(hashes, np.log(counts * weights.of(hashes)))))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array([d for d in digests for _ in range(BANDS)], pa.binary())],
                    ["key", "digest"],
                )

    return texts.mapInArrow(run, "key long, digest binary").distinct()


def _first_in_task(texts: DataFrame) -> DataFrame:
    """(digest, text) without the repetitions a task sees, so that copies are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            fresh = [k for k, d in enumerate(part.column("digest").to_pylist()) if d not in seen and not seen.add(d)]
            if len(seen) > 1_000_000:
                seen.clear()
            yield part.take(pa.array(fresh, pa.int64()))

    return texts.mapInArrow(run, texts.schema)


def _verify(pairs: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """(a, b, similarity) of pairs of digests; ``texts`` has one row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value

        def profiles(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            return [(h, c * weights.of(h)) for h, c in _shingles(column)]

        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                part = whole.slice(a, 64)
                # a leader is met many times in a row: its profile is built once
                names = part.column("b").to_pylist()
                heads = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
                right = profiles(part.column("b_text").take(pa.array(heads, pa.int64())))
                at = np.searchsorted(heads, np.arange(len(names)), side="right") - 1
                left = profiles(part.column("a_text"))
                found = [weighted_jaccard(x, right[k]) for x, k in zip(left, at, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"]
                )

    met = (
        pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("a_text")), "a")
        .join(texts.select(F.col("digest").alias("b"), F.col("text").alias("b_text")), "b")
        .select("a", "b", "a_text", "b_text")
    )
    return met.mapInArrow(run, "a binary, b binary, similarity double")


def _texts_of(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """One (digest, text) row for each digest in a one-column list."""
    wanted = digests.toDF("digest").distinct()
    found = _first_in_task(texts).join(wanted, "digest", "left_semi")
    return found.groupBy("digest").agg(F.any_value("text").alias("text"))


# ---- classes -------------------------------------------------------------------------------


def _stars(checked: DataFrame, labels: DataFrame) -> DataFrame:
    """(leader, digest, label, d, out): texts by the leader they met, for leaders with outsiders.

    ``d`` is the exact distance to the leader, ``out`` marks texts outside its component.
    """
    def label(name: str, new: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("root").alias(new))

    rows = checked.join(label("a", "root_a"), "a", "left").join(label("b", "root_b"), "b", "left").select(
        F.col("b").alias("leader"), F.col("a").alias("digest"), F.coalesce("root_a", "a").alias("label"),
        (1 - F.col("similarity")).alias("d"), F.coalesce("root_b", "b").alias("home"),
    )
    rows = rows.withColumn("out", F.col("label") != F.col("home")).drop("home")
    sizes = rows.groupBy("leader").agg(F.count("*").alias("rows"), F.count_if("out").alias("outs"))
    return rows.join(sizes.where("rows > 1 and outs > 0"), "leader")


def _deal(stars: DataFrame) -> DataFrame:
    """Blocks (unit, i, j): an outsider (role 1) and any text (role 2) of a leader meet in exactly one.

    Leaders with few texts share a unit; those with many are dealt over several blocks.
    """
    few = (F.col("rows") <= BLOCK_ROWS) & (F.col("outs") <= BLOCK_ROWS)
    units = max(1, stars.where(few).count() // BLOCK_ROWS + 1)
    lefts, rights = (F.ceil(F.col(c) / BLOCK_ROWS).cast("int") for c in ("outs", "rows"))
    place = F.xxhash64("digest")
    names = ["leader", "digest", "label", "d", "out"]
    small = stars.where(few).select(
        F.pmod(F.xxhash64("leader"), F.lit(units)).alias("unit"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), *names, F.lit(3).alias("role")
    )
    large = stars.where(~few).withColumn("unit", F.xxhash64("leader"))
    left = large.where("out").select(
        "unit", F.pmod(place, lefts).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"), *names, F.lit(1).alias("role")
    )
    right = large.select(
        "unit", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"), F.pmod(place, rights).cast("int").alias("j"), *names, F.lit(2).alias("role")
    ).select("unit", "i", "j", *names, "role")
    return small.unionByName(left).unionByName(right)


def _block_links(table: pa.Table, idf: Idf) -> list[tuple[bytes, bytes, float]]:
    """Links between texts of different components in one block, enough to join the components.

    Pairs of one leader are compared by the metric bound and their total weights, and exactly if both allow it;
    components that a link has joined are not compared again.
    """
    order = np.argsort(np.array(table.column("leader").to_pylist(), dtype=object), kind="stable")
    table = table.take(pa.array(order))
    leaders, digests = table.column("leader").to_pylist(), table.column("digest").to_pylist()
    texts = table.column("text").combine_chunks()
    profiles, sketches, at = [], np.zeros((len(digests), SAMPLES), dtype=np.uint64), 0
    while at < len(digests):  # slices of texts, one after the other
        part = texts.slice(at, 64)
        for k, (hashes, counts) in enumerate(_shingles(part)):
            profiles.append((hashes, counts * idf.of(hashes)))
            sketches[at + k] = sample(hashes, np.log(profiles[-1][1]))
        at += len(part)
    sketches = sketches.astype(np.uint8)
    names, label = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)
    rank = np.unique(np.array(digests, dtype=object), return_inverse=True)[1]
    d, out, role = (table.column(c).to_numpy() for c in ("d", "out", "role"))
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    totals = np.array([w.sum() for _, w in profiles])
    links = []
    edges = [k for k in range(len(leaders)) if k == 0 or leaders[k] != leaders[k - 1]] + [len(leaders)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rights = np.flatnonzero(role[a:b] & 2) + a
        # features numbered within the leader's texts: one text is spread out and the others look it up
        features, places = np.unique(np.concatenate([h for h, _ in profiles[a:b]]), return_inverse=True)
        places = np.split(places, np.cumsum([len(h) for h, _ in profiles[a:b]])[:-1])
        spread = np.zeros(len(features))
        for x in np.flatnonzero((role[a:b] & 1).astype(bool) & out[a:b]) + a:
            near = rights[(np.abs(d[rights] - d[x]) <= SLACK) & (label[rights] != label[x]) & (~out[rights] | (rank[x] < rank[rights]))]
            if not len(near):
                continue
            # shared weight is at most the smaller total, the union's at least the greater
            low, high = np.minimum(totals[near], totals[x]), np.maximum(totals[near], totals[x])
            near = near[low >= (SIMILARITY - 1e-9) * high]
            agree = (sketches[near] == sketches[x]).sum(axis=1)
            spread[places[x - a]] = profiles[x][1]
            for y in near[np.argsort(-agree, kind="stable")]:
                one, two = find(label[x]), find(label[y])
                if one != two:
                    shared = np.minimum(profiles[y][1], spread[places[y - a]]).sum()
                    if shared < (SIMILARITY - 1e-9) * (totals[x] + totals[y] - shared):
                        continue
                    similarity = weighted_jaccard(profiles[x], profiles[y])
                    if similarity >= SIMILARITY:
                        root[max(one, two)] = min(one, two)
                        links.append((digests[x], digests[y], similarity))
            spread[places[x - a]] = 0
    return links


def _cross_links(stars: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """(a, b, similarity) of links between components that met the same leader."""

    def run(table: pa.Table) -> pa.Table:
        links = _block_links(table, idf.value)
        kinds = [pa.binary(), pa.binary(), pa.float64()]
        return pa.Table.from_arrays([pa.array([x[k] for x in links], t) for k, t in enumerate(kinds)], names=["a", "b", "similarity"])

    rows = _deal(stars).join(texts, "digest")
    return rows.groupBy("unit", "i", "j").applyInArrow(run, "a binary, b binary, similarity double")


def _classes(texts: DataFrame) -> DataFrame:
    """(node, root) of the digests that are linked to another text."""
    spark = texts.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(texts.select("text"))))
    bands = cut_lineage(_signatures(texts, idf))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(bands.join(buckets, "key"))
    # the text whose bands are the most common ones is the likely origin of its copies
    central = members.groupBy("digest").agg(F.sum("n").alias("score"))
    leaders = (
        members.join(central, "digest").groupBy("key").agg(F.max(F.struct("score", "digest")).alias("l"))
        .select("key", F.col("l.digest").alias("leader"))
    )
    pairs = cut_lineage(
        members.join(leaders, "key").where(F.col("digest") != F.col("leader"))
        .select(F.col("digest").alias("a"), F.col("leader").alias("b")).distinct()
    )
    checked = cut_lineage(_verify(pairs, _texts_of(texts, pairs.select("a").union(pairs.select("b"))), idf))

    def links(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("similarity") >= SIMILARITY).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    labels = cut_lineage(connected_components(links(checked)))
    stars = cut_lineage(_stars(checked, labels))
    again = cut_lineage(_cross_links(stars, _texts_of(texts, stars.select("digest")), idf))
    if again.isEmpty():
        return labels
    # stars of the first round keep its components; the new links join them
    joined = labels.select(F.col("node").alias("src"), F.col("root").alias("dst"))
    return connected_components(joined.unionByName(links(again)))


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = columns(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return narrow.withColumn("digest", F.unhex(F.md5("text")))


def _digest_classes(digested: DataFrame) -> DataFrame:
    """(digest, rep_id, class_digest, class_id): one row per distinct text."""
    reps = digested.groupBy("digest").agg(F.min("doc_id").alias("rep_id"))
    classes = _classes(digested.select("digest", "text"))
    named = cut_lineage(
        reps.join(classes, F.col("digest") == F.col("node"), "left").select(
            "digest", "rep_id", F.coalesce("root", "digest").alias("class_digest")
        )
    )
    smallest = named.groupBy("class_digest").agg(F.min("rep_id").alias("class_id"))
    return named.join(smallest, "class_digest")


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id), one row per document row; a class is named by its smallest document id."""
    digested = _digested(docs, id_col, text_col)
    classes = _digest_classes(digested).select("digest", "class_id")
    return digested.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with its smallest id, with all columns of ``docs``."""
    names = docs.columns
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    work = docs.toDF(*[f"c{k}" for k in range(len(names))])
    work = work.withColumn("digest", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    classes = _digest_classes(_digested(docs, id_col, text_col))
    keep = (
        classes.where(F.col("rep_id").eqNullSafe(F.col("class_id"))).groupBy("class_digest")
        .agg(F.min("digest").alias("k_digest"), F.max("class_id").alias("k_id"))
    )
    kept = work.join(keep, (F.col("digest") == F.col("k_digest")) & F.col(key).eqNullSafe(F.col("k_id")))
    return kept.dropDuplicates(["digest"]).select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
