"""Template families: single-linkage merges of form letters by token-set Jaccard.

All form letters of all dockets at once, exactly, in two fixed passes:

1. Letters meet under few sketches of their token sets (least hashes, Broder 1997) and a band of set sizes. Every
   member is compared with its bucket's leader, the letter with most copies. What is linked by then is a family.
2. Similar letters share a token among the rarest of both sets (prefix filter, Chaudhuri et al. 2006, Bayardo et
   al. 2007). Letters of different families that meet under such a token and a band of sizes are compared, if sizes,
   positions and bitmaps allow. What is filed under tokens is a few numbers, once for each letter and token.

A campaign of a million variants costs about one comparison per variant and sketch instead of all pairs; no group is
collected. Under a crowded token only members outside the leader's family meet the rest; its bucket is divided by the
next common token (adaptive prefixes, Wang et al. 2012) and dealt over blocks, so that no task holds it.

Token sets are stored once, packed: two bytes for each of the most frequent tokens, eight for the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from docketscope.functions.dates import iso_day
from docketscope.operators.clusters import percent
from docketscope.operators.components import connected_components
from docketscope.operators.joins import checked_broadcast, keep_listed
from docketscope.session import cut_lineage

# Similarity cut-offs.
SIMILARITY = 0.8
SHORT_SET = 4
SHORT_SIMILARITY = 0.95

BITMAP_WORDS = 4
# Least hashes of a set by which it meets its likes.
SKETCHES = 3
# Tokens that are packed in two bytes; cells of the table of frequencies that orders the others.
CODES = 1 << 16
CELLS = 1 << 20
# Larger sets must share several of their rarest tokens: one more for so many tokens, up to a limit.
SHARED_EVERY = 64
MOST_SHARED = 8
# Steps of sizes, each a factor of 1 / threshold, in one band.
BAND_STEPS = 4

BUCKET = ["h", "band"]
# Pairs of one bucket that one task may form; rows of a block of a crowded one.
CROWDED_PAIRS = 4_000_000
BLOCK_ROWS = 2_000


def _numbered(letters: DataFrame) -> DataFrame:
    """Letters under stored numbers, ``id``, which stand for docket and key from here on."""
    if "id" in letters.columns:
        return letters
    return cut_lineage(letters.select(F.monotonically_increasing_id().alias("id"), "*"))


class Packed(NamedTuple):
    """Stored letters with ``packed`` and ``rare`` in place of tokens; (h, n), the letters of each token; the coded tokens and their letters."""

    letters: DataFrame
    frequency: DataFrame
    codes: np.ndarray
    counts: np.ndarray


def _packed(letters: DataFrame) -> Packed:
    """The token sets of numbered letters, ``rare`` tokens and codes.

    Tokens are hashed with their docket. The most frequent ones get codes in the order of their frequency; a set is its
    other tokens, rarest first, followed by its codes. All sets have one order. Equal hashes are taken as equal tokens.
    """
    hashed = F.transform("tokens", lambda t: F.xxhash64(F.col("docket_id"), t))
    counted = letters.select(F.explode(hashed).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    frequency = cut_lineage(counted)
    # a list and a table of fixed size
    most = frequency.orderBy(F.desc("n"), "h").limit(CODES).toArrow()
    cells = frequency.groupBy(F.pmod("h", F.lit(CELLS)).cast("int").alias("cell")).agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CELLS, np.int32)
    table[cells.column("cell").to_numpy()] = np.minimum(cells.column("n").to_numpy(), 2**31 - 1)
    by_code, counts = most.column("h").to_numpy()[::-1], most.column("n").to_numpy()[::-1]
    order = np.argsort(by_code)
    coded = by_code[order]
    others = [c for c in letters.columns if c != "tokens"]
    size, fixed = len(coded), CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                tokens = batch.column("_tokens")
                h = tokens.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                place = np.searchsorted(coded, h)
                known = place < size
                known &= coded.take(place, mode="clip") == h if size else known
                rank = table[h % fixed].astype(np.int64)
                rank[known] = order[place[known]]
                sort = np.lexsort((h, rank, known, row))
                h, rank, rare = h[sort], rank[sort].astype(np.uint16), np.bincount(row[~known], minlength=len(ends))
                first = ends - np.diff(ends, prepend=0)
                sets = [h[i : i + k].tobytes() + rank[i + k : j].tobytes() for i, k, j in zip(first, rare, ends)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in others), pa.array(rare, pa.int32()), pa.array(sets, pa.binary())],
                    names=[*others, "rare", "packed"],
                )

    schema = StructType([*(letters.schema[c] for c in others), StructField("rare", IntegerType()), StructField("packed", BinaryType())])
    stored = cut_lineage(letters.select(*others, hashed.alias("_tokens")).mapInArrow(run, schema))
    return Packed(stored, frequency, by_code, counts)


def _ranked(letters: DataFrame, threshold: float) -> DataFrame:
    """(id, n, shape, own, keep, shared, prefix, sketch): each set with its rarest tokens in order.

    Two sets with Jaccard >= t share a token among the first ``|x| - ceil(t |x|) + 1`` (``keep``)
    tokens of any common order; rarest first keeps the buckets small. Among k - 1 more each, two sets share k: so many
    more are told as ``shared`` asks for, and one at least.
    """
    packed = letters if "packed" in letters.columns else _packed(letters).letters
    fixed, words, step = [0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * k & (1 << 64) - 1 for k in range(SKETCHES)], BITMAP_WORDS, -log(threshold)
    names = ["id", "n", "shape", "own", "keep", "shared", "prefix", "sketch"]
    every, limit = SHARED_EVERY, MOST_SHARED

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pc.not_equal(pc.binary_length(whole.column("packed")), 0))
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = []
                for text, rare in zip(batch.column("packed").to_pylist(), batch.column("rare").to_pylist()):
                    sets.append(np.frombuffer(text, np.int64, rare))
                    sets.append(np.frombuffer(text, np.uint16, offset=8 * rare).astype(np.int64))
                size = np.array([len(x) + len(y) for x, y in zip(sets[::2], sets[1::2])])
                h = np.concatenate(sets)
                first = np.cumsum(size) - size
                mixed = [(h.astype(np.uint64) ^ (h.astype(np.uint64) >> np.uint64(31))) * np.uint64(m) for m in fixed]
                mixed = [x ^ (x >> np.uint64(29)) for x in mixed]
                bit = np.uint64(1) << (mixed[0] & np.uint64(63))
                word = (mixed[0] >> np.uint64(8)) % np.uint64(words)
                maps = [np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), first).view(np.int64) for w in range(words)]
                least = np.stack([np.minimum.reduceat(x * np.uint64(fixed[0]), first).view(np.int64) for x in mixed], axis=1)
                keep = (size - np.ceil(size * threshold - 1e-9) + 1).astype(np.int32)
                shared = np.minimum(1 + size // every, limit).astype(np.int32)
                told = np.minimum(keep + np.maximum(shared - 1, 1), size)
                ends = np.cumsum(told)
                places = np.repeat(first - (ends - told), told) + np.arange(ends[-1])
                shape = pa.StructArray.from_arrays([pa.array(size, pa.int32()), *map(pa.array, maps)], ["size", *(f"w{w}" for w in range(words))])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), batch.column("n"), shape, pa.array(np.floor(np.log(size) / step + 1e-9).astype(np.int32)), pa.array(keep),
                    pa.array(shared), lists(h[places], ends), lists(least.ravel(), np.arange(1, len(size) + 1) * len(fixed)),
                ], names=names)

    shape = ", ".join(["size: int", *(f"w{w}: long" for w in range(BITMAP_WORDS))])
    schema = f"id long, n long, shape struct<{shape}>, own int, keep int, shared int, prefix array<long>, sketch array<long>"
    return packed.select("id", F.col("n").cast("long").alias("n"), "rare", "packed").mapInArrow(run, schema)


def _bands() -> Column:
    """The bands of sizes of a set, a row each: sizes of similar sets differ by a step at most, so they share one."""
    return F.explode(F.array_distinct(F.array(*[F.floor((F.col("own") + k) / BAND_STEPS) for k in (0, 1)])))


def prefix_buckets(ranked: DataFrame, *carried: str) -> DataFrame:
    """(h, band, id, n, shape, pos, carried): each set under its rarest tokens and its bands of sizes."""
    rows = ranked.select(
        "id", "n", "shape", "own", *carried, F.posexplode(F.slice("prefix", F.lit(1), F.col("keep"))).alias("pos", "h")
    )
    return rows.select("h", _bands().alias("band"), "id", "n", "shape", "pos", *carried)


def _least_distance(a: Column, b: Column) -> Column:
    """Lower bound of the Jaccard distance of two sets, from their shapes alone.

    At least so many tokens differ: bits in which two bitmaps differ, or the sizes' difference.
    """
    bits = sum((F.bit_count(a[f"w{w}"].bitwiseXOR(b[f"w{w}"])) for w in range(BITMAP_WORDS)), F.lit(0))
    differing = F.greatest(bits, F.abs(a["size"] - b["size"]))
    return 2 * differing / (a["size"] + b["size"] + differing)


def _overlap_possible(a: Column, b: Column, most_a: Column, most_b: Column, threshold: float) -> Column:
    """Are enough tokens left in both sets of sizes a and b, if the bucket's token is their first common one?

    A similar pair passes in the bucket of its first common token.
    """
    return F.least(most_a, most_b) >= (a + b) * (threshold / (1 + threshold)) - 1e-9


def _compared(candidates: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, same) of candidate pairs.

    Sets in no pair stay where they are. Set ``a`` learns its partners where it lies and travels once, to ``b``. Very short sets
    must nearly coincide; tokens of different dockets differ.
    """
    short, cut = SHORT_SET, max(threshold, SHORT_SIMILARITY)
    sets = stored.select("id", "rare", "packed")
    pairs = checked_broadcast(candidates)
    left = pairs.join(sets.toDF("a", "ra", "pa"), "a")
    right = keep_listed(sets, pairs.select(F.col("b").alias("id")), ["id"]).toDF("b", "rb", "pb")
    schema = "a long, b long, similarity double, same boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ra, x, rb, y in zip(*(batch.column(c).to_pylist() for c in ("ra", "pa", "rb", "pb"))):
                a, b = ra + (len(x) - 8 * ra) // 2, rb + (len(y) - 8 * rb) // 2
                shared = len(np.intersect1d(np.frombuffer(x, np.int64, ra), np.frombuffer(y, np.int64, rb), True))
                shared += len(np.intersect1d(np.frombuffer(x, np.uint16, -1, 8 * ra), np.frombuffer(y, np.uint16, -1, 8 * rb), True))
                similar = shared / (a + b - shared) if a and b else 0.0
                found.append((similar, similar >= (cut if min(a, b) < short else threshold)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.bool_())],
                names=["a", "b", "similarity", "same"],
            )

    return left.join(right, "b").select("a", "b", "ra", "pa", "rb", "pb").mapInArrow(run, schema)


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("same").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _sketched(ranked: DataFrame) -> DataFrame:
    """(h, band, id, n, size): each set under its sketches."""
    rows = ranked.select("id", "n", F.col("shape")["size"].alias("size"), "own", F.posexplode("sketch").alias("k", "h"))
    return rows.select(F.xxhash64("k", "h").alias("h"), _bands().alias("band"), "id", "n", "size")


def _leaders(ranked: DataFrame) -> DataFrame:
    """(h, band, leader): the letter with most copies of every sketch and band that holds two letters or more."""
    grouped = _sketched(ranked).groupBy(*BUCKET).agg(F.max(F.struct("n", "id", "size")).alias("leader"), F.count("*").alias("members"))
    return grouped.where(F.col("members") > 1).drop("members")


def _leader_pairs(ranked: DataFrame, leaders: DataFrame, threshold: float) -> DataFrame:
    """(a, b): members and the leaders that they may resemble by their sizes."""
    met = _sketched(ranked).join(leaders, BUCKET)
    a, b = F.col("size"), F.col("leader.size")
    possible = (F.col("id") != F.col("leader.id")) & _overlap_possible(a, b, a, b, threshold)
    return met.where(possible).select(F.col("id").alias("a"), F.col("leader.id").alias("b")).distinct()


def _met(left: DataFrame, right: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """(a, b) of rows of different families that meet and may be similar; ``most`` tokens of each can be common.

    Rows ``outside`` meet all others, and each other once.
    """
    names = ("id", "size", "most", "label", "outside")
    left = left.select(*on, *[F.col(c).alias(f"{c}1") for c in names])
    right = right.select(*on, *[F.col(c).alias(f"{c}2") for c in names])
    return left.join(right, on).where(
        (F.col("label1") != F.col("label2"))
        & (~F.col("outside2") | (F.col("id1") < F.col("id2")))
        & _overlap_possible(F.col("size1"), F.col("size2"), F.col("most1"), F.col("most2"), threshold)
    ).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))


def _quiet_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, need): rows of different families that meet under a token; similar sets meet under ``need`` tokens at least.

    One of the first ``need`` common tokens leaves ``need - 1`` less to come. Two sets that share both bands meet in the first.
    """
    names = ("id", "size", "most", "label", "need", "later")
    left = rows.select("bucket", *[F.col(c).alias(f"{c}1") for c in names])
    right = rows.select("bucket", *[F.col(c).alias(f"{c}2") for c in names])
    need = F.least("need1", "need2")
    return left.join(right, "bucket").where(
        (F.col("id1") < F.col("id2")) & (F.col("label1") != F.col("label2")) & ~(F.col("later1") & F.col("later2"))
        & _overlap_possible(F.col("size1"), F.col("size2"), F.col("most1") + need - 1, F.col("most2") + need - 1, threshold)
    ).select(F.col("id1").alias("a"), F.col("id2").alias("b"), need.alias("need"))


def _split(rows: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """Rows of crowded buckets under a second token as well: ``second`` and what can be common from there on.

    Similar sets share two tokens among one more of their rarest: with the bucket's token
    as the first common one, the next common one comes after it in both. Of a similarity
    above one half, a set of one token resembles nothing but itself; it has no second token.
    Below that two common tokens are not certain, and the bucket stays whole.
    """
    if threshold <= 0.5:
        return rows.withColumn("second", F.lit(0).cast("long"))
    later = rows.join(ranked.select("id", "prefix", "keep"), "id").select(
        *rows.columns, F.posexplode_outer(F.slice("prefix", F.col("pos") + 2, F.col("keep") - F.col("pos"))).alias("_next", "_second")
    )
    after = F.when(F.col("_next").isNull(), F.col("most")).otherwise(F.col("most") - F.col("_next"))
    return later.withColumns({"second": F.coalesce("_second", F.lit(0).cast("long")), "most": after}).drop("_next", "_second")


def _dealt(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b) of crowded buckets: both sides of every cell are dealt over blocks of bounded size.

    A row stays only if some size in its cell is within what its position allows.
    """
    cell = [*BUCKET, "second"]
    largest = F.floor(F.col("most") * ((1 + threshold) / threshold) - F.col("size") + 1e-6).alias("largest")
    rows = cut_lineage(rows.select("*", largest))
    cells = rows.groupBy(*cell).agg(
        F.ceil(F.count_if("outside") / block).cast("int").alias("outsiders"),
        F.ceil(F.count("*") / block).cast("int").alias("members"),
        F.min("size").alias("_least"), F.max("largest").alias("_most"), F.count("*").alias("_rows"),
    )
    known = rows.join(cells.where((F.col("outsiders") > 0) & (F.col("_rows") > 1)), cell)
    known = known.where((F.col("largest") >= F.col("_least")) & (F.col("size") <= F.col("_most")))
    known = cut_lineage(known.drop("_least", "_most", "_rows", "largest"))

    def mine(blocks: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")

    def each(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = known.where("outside").select("*", mine("outsiders").alias("i"), each("members").alias("j"))
    right = known.select("*", each("outsiders").alias("i"), mine("members").alias("j"))
    return _met(left, right, [*cell, "i", "j"], threshold)


def _crowded_pairs(rows: DataFrame, ranked: DataFrame, threshold: float, crowded_pairs: int, block: int) -> DataFrame:
    """(a, b) under frequent tokens: members outside the family of their bucket's leader meet the rest.

    A bucket with more than ``crowded_pairs`` of outsiders times members is divided by a
    second token and its cells are dealt over blocks, so that no task holds it.
    """
    rows = cut_lineage(rows)
    homes = rows.groupBy(*BUCKET).agg(F.max_by("label", F.struct("n", "id")).alias("home"))
    rows = cut_lineage(rows.join(homes, BUCKET).withColumn("outside", F.col("label") != F.col("home")).drop("n", "home"))
    sizes = rows.groupBy(*BUCKET).agg(F.count_if("outside").alias("outsiders"), F.count("*").alias("members"))
    crowded = checked_broadcast(sizes.where(F.col("outsiders") * F.col("members") > crowded_pairs).select(*BUCKET))
    if crowded.isEmpty():
        return _met(rows.where("outside"), rows, BUCKET, threshold)
    quiet = rows.join(crowded, BUCKET, "left_anti")
    full = _split(rows.join(crowded, BUCKET), ranked, threshold)
    return _met(quiet.where("outside"), quiet, BUCKET, threshold).unionByName(_dealt(full, threshold, block))


def _bucket_pairs(
    ranked: DataFrame, labels: DataFrame | None, counts: np.ndarray, threshold: float, crowded_pairs: int, block: int
) -> DataFrame:
    """(a, b) of letters of different families that share a bucket and may be similar; without ``labels`` each is its own.

    ``counts`` tells how many letters hold each coded token; all others are in no more letters than the first of them.
    Buckets of tokens with at most ``crowded_pairs`` pairs are joined as they are, without a look at their sizes.
    """
    known = ranked.withColumn("label", F.col("id")) if labels is None else ranked.join(labels, "id")
    frequent = np.flatnonzero(counts * counts > crowded_pairs)
    size = F.col("shape")["size"]

    def quiet(h: Column) -> Column:
        if len(frequent) and frequent[0] == 0:
            return F.lit(False)
        return ~h.between(int(frequent[0]), len(counts) - 1) if len(frequent) else F.lit(True)

    told = F.slice("prefix", F.lit(1), F.col("keep") + F.col("shared") - 1)
    # tokens come in the order of their frequency: if the last is quiet, all are
    wanted = known.withColumns({"told": told, "need": F.when(quiet(F.element_at(told, -1)), F.col("shared")).otherwise(1)})
    rows = wanted.select("id", size.alias("size"), "own", "label", "need", F.posexplode("told").alias("pos", "h")).where(quiet(F.col("h")))
    rows = rows.select("*", _bands().alias("band")).select(
        # one number for the token and band; equal numbers of different ones only add candidates
        F.xxhash64("h", "band").alias("bucket"), "id", "size", (F.col("size") - F.col("pos")).alias("most"), "label", "need",
        (F.col("band") != F.floor(F.col("own") / BAND_STEPS)).alias("later"),
    )
    pairs = _quiet_pairs(rows, threshold)
    if len(frequent):
        filed = prefix_buckets(known, "label").where(~quiet(F.col("h")))
        filed = filed.select(*BUCKET, "id", "n", size.alias("size"), "pos", (size - F.col("pos")).alias("most"), "label")
        crowded = _crowded_pairs(filed, ranked, threshold, crowded_pairs, block)
        pairs = pairs.unionByName(crowded.withColumn("need", F.lit(1)))
    shapes = checked_broadcast(ranked.select("id", "shape"))
    shaped = pairs.join(shapes.toDF("a", "_a"), "a").join(shapes.toDF("b", "_b"), "b")
    near = shaped.where(_least_distance(F.col("_a"), F.col("_b")) <= 1 - threshold + 1e-9)
    met = near.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need"))
    return met.where(F.col("met") >= F.col("need")).select("a", "b")


def _labels(letters: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, label): smallest linked letter, or the letter itself."""
    return letters.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("root", "id").alias("label")
    )


def _labelled(
    letters: DataFrame, threshold: float = SIMILARITY, crowded_pairs: int = CROWDED_PAIRS, block: int = BLOCK_ROWS
) -> tuple[Packed, DataFrame]:
    """The packed letters; the letters without tokens, with ``id``, ``label`` (a number) and ``family`` (a key)."""
    packed = _packed(_numbered(letters))
    stored = packed.letters
    ranked = _ranked(stored, threshold)
    first = cut_lineage(_compared(_leader_pairs(ranked, _leaders(ranked), threshold), stored, threshold))
    roots = cut_lineage(connected_components(_links(first)))
    labels = checked_broadcast(_labels(stored, roots))
    crossing = _bucket_pairs(ranked, labels, packed.counts, threshold, crowded_pairs, block)
    second = cut_lineage(_compared(crossing, stored, threshold))
    # the stars of the first pass keep its families; the new links join them
    stars = roots.select(F.col("node").alias("src"), F.col("root").alias("dst"))
    labels = _labels(stored, connected_components(stars.unionByName(_links(second))))
    sized = cut_lineage(stored.drop("packed", "rare").join(labels, "id"))
    # largest member names the family, the smaller key on a tie
    heads = sized.groupBy("label").agg(
        F.min_by("key", F.struct(-F.col("n"), F.col("key"))).alias("family")
    )
    return packed, sized.join(heads, "label")


def family_tokens(letters: DataFrame, threshold: float, min_letters: int) -> tuple[DataFrame, DataFrame]:
    """The letters of families of at least so many, with ``id``, ``label`` and ``family``; and (token, id, label, n, letters, df).

    ``letters`` is the number of letters of the docket and ``df`` how many of them hold the token; rows lie by token.
    """
    packed, labelled = _labelled(letters, threshold)
    large = labelled.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") >= min_letters)
    sizes = labelled.groupBy("docket_id").agg(F.count("*").alias("letters"))
    kept = cut_lineage(labelled.join(large.select("label"), "label").join(sizes, "docket_id").select(
        "id", "label", "docket_id", "family", "key", "n", "letters"
    ))
    codes = packed.codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [
                    np.concatenate((np.frombuffer(x, np.int64, rare), codes[np.frombuffer(x, np.uint16, -1, 8 * rare)]))
                    for x, rare in zip(batch.column("packed").to_pylist(), batch.column("rare").to_pylist())
                ]
                if sets:
                    taken = batch.select(["id", "label", "n", "letters"]).take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *taken.columns], names=["token", *taken.schema.names])

    numbers = checked_broadcast(kept.select("id", "label", "n", "letters"))
    rows = packed.letters.select("id", "rare", "packed").join(numbers, "id").select("id", "label", "n", "letters", "rare", "packed")
    tokens = rows.mapInArrow(run, "token long, id long, label long, n long, letters long")
    return kept, tokens.join(packed.frequency.toDF("token", "df"), "token")


def families_of(
    letters: DataFrame, threshold: float = SIMILARITY, crowded_pairs: int = CROWDED_PAIRS, block: int = BLOCK_ROWS
) -> DataFrame:
    """(docket_id, key, family) of any number of letters per docket."""
    return _labelled(letters, threshold, crowded_pairs, block)[1].select("docket_id", "key", "family")


def template_pairs(
    letters: DataFrame, threshold: float = SIMILARITY, crowded_pairs: int = CROWDED_PAIRS, block: int = BLOCK_ROWS
) -> DataFrame:
    """All similar pairs of a docket's form letters; the result itself may be large.

    The same buckets, bounds and blocks as for families, but every pair that passes is compared.
    """
    packed = _packed(_numbered(letters))
    stored = packed.letters
    candidates = _bucket_pairs(_ranked(stored, threshold), None, packed.counts, threshold, crowded_pairs, block)
    similar = _compared(candidates, stored, threshold).where("same").select("a", "b", "similarity")
    keys = stored.select("id", "docket_id", "key")
    named = similar.join(keys.toDF("a", "docket_id", "key_a"), "a").join(keys.drop("docket_id").toDF("b", "key_b"), "b")
    return named.select(
        "docket_id", F.least("key_a", "key_b").alias("hash_a"), F.greatest("key_a", "key_b").alias("hash_b"), "similarity"
    )


def family_rows(letters: DataFrame, totals: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``template_families`` with ``sample_id``, the id of the representative's comment, if letters have one."""
    _, labelled = _labelled(letters, threshold)
    speaker = [F.min(F.when(F.col("key") == F.col("family"), F.col("sample_id"))).alias("sample_id")] if "sample_id" in letters.columns else []
    families = labelled.groupBy("docket_id", "family").agg(
        F.sum("n").alias("total_n"),
        F.count("*").alias("variant_count"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        *speaker,
    )
    joined = families.join(totals.select("docket_id", "total"), "docket_id")
    return joined.select(
        "docket_id",
        F.col("family").alias("family_id"),
        "total_n",
        percent(F.col("total_n"), F.col("total")).alias("share_pct"),
        "variant_count",
        iso_day(F.col("first_day")).alias("first_day"),
        iso_day(F.col("last_day")).alias("last_day"),
        *(["sample_id"] if speaker else []),
    )


def template_families(
    letters: DataFrame,
    totals: DataFrame,
    threshold: float = SIMILARITY,
) -> DataFrame:
    """One row per family: representative, comments, share, variants, first and last day.

    ``letters`` are form letters (docket_id, key, n, tokens, first_day, last_day).
    """
    rows = family_rows(letters, totals, threshold)
    return rows.drop("sample_id")
