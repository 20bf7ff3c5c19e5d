"""Approximate nearest neighbours: multiprobe p-stable hashing.

Rows are divided into ranges of norms by powers of two. In a range, largest inner products are nearest neighbours after
one coordinate is appended, sqrt(M**2 - |x|**2) for rows and 0 for queries (M the range's largest norm), so a few
very long vectors do not blur the hashing of the others. Each table of a range hashes a vector with Gaussian projections,
floor((a.x + b) / w). A query visits its own bucket and perturbed buckets in the order of their estimated success:
sets of +-1 steps by rising sum of squared distances to the cell walls (Lv et al. 2007), as far as a fitted sum. The
index holds every row. Scores are inner products of the original vectors in double precision.

The first projections of a table name a block of about BLOCK_ROWS rows, the others a bucket in it. A query's vector
travels once to each block with a bucket to visit, and the task of the block lists the buckets; only their rows
are compared. Blocks with many rows or queries are dealt over several tasks, each gives a query's best, and the
merge takes the nearest over all tables.

Tables, projections, width and sum are fitted together: of all settings with which TARGET of the exact neighbours of a
few queries are found (SAMPLE_QUERIES, by a scan of all rows), the one with the
fewest comparisons, judged by SAMPLE rows, and visits. A range of
at most BUCKET_ROWS rows is one bucket, and so is one for which no setting saves comparisons: both are exact. Queries that
find fewer rows than there are to find meet all rows in blocks.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows without id; an id that occurs more than once is one candidate, with its best
score; ties go to the smaller id; scores that overflow are infinite and rank as such; a table of BUCKET_ROWS rows is searched
exactly; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketscope.llm.runtime import columns
from docketscope.llm.textbytes import mix
from docketscope.operators.lookups import top_per_group
from docketscope.session import cut_lineage

NEAREST = 20
BUCKET_ROWS = 4096
BLOCK_ROWS = 16384
# A visit to a block costs about as much as comparing so many rows.
VISIT_ROWS = 256
SAMPLE = 2048
SAMPLE_QUERIES = 128
TARGET = 0.94
MOST_PROBES = 8192
SEED = 6
# Settings that are tried: tables, projections, widths in standard deviations of a projection.
SETTINGS = tuple(product((1, 2), (2, 4, 6, 8, 10, 12, 14, 16, 20), (1.5, 2.0, 3.0)))
# Norms below the largest by more than this power of two share the last range.
RANGES = 16
# Queries, and rows of their lists, that are merged together.
MERGED_QUERIES = 64
MERGED_ROWS = 8192
MERGED_PARTS = 64


def perturbations(low: np.ndarray, budget: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(steps, costs) of all sets of -1, 0 or +1 steps whose cost is within the budget, cheapest first.

    ``low`` is the place within the cell, 0 to 1 per projection; a step costs the squared distance to the wall it
    crosses. None if there are more than ``most``.
    """
    steps, costs = np.zeros((1, 0), dtype=np.int64), np.zeros(1)
    for d in low:
        sums = np.concatenate((costs, costs + d * d, costs + (1 - d) ** 2))
        kept = np.flatnonzero(sums <= budget)
        if most is not None and len(kept) > most:
            return None
        n = len(costs)
        steps = np.column_stack((steps[kept % n], np.array([0, -1, 1])[kept // n]))
        costs = sums[kept]
    order = np.argsort(costs, kind="stable")
    return steps[order], costs[order]


def _codes(first: np.ndarray, lattice: np.ndarray) -> np.ndarray:
    """64-bit codes of integer places, one row each, that begin from ``first``."""
    code = first.astype(np.int64).view(np.uint64)
    for k in range(lattice.shape[1]):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + lattice[:, k].astype(np.int64).view(np.uint64))
    return mix(code).view(np.int64)


class Hashing:
    """Seeded projections of the tables of one range of norms, and how far its queries probe."""

    def __init__(self, number: int, norm: float, sample: np.ndarray, tables: int = 1, bits: int = 0, width: float = 1.0) -> None:
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.number, self.norm, self.tables, self.bits = number, norm, tables, bits
        self.head, self.budget = 0, 0.0
        self.a = rng.standard_normal((tables * bits, sample.shape[1] + 1))
        shift = rng.random(tables * bits)
        spread = (self.rows(sample) @ self.a.T).std(axis=0) if bits and len(sample) else np.ones(tables * bits)
        self.width = width * np.where(spread > 0, spread, 1.0)
        self.b = shift * self.width

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that makes all norms equal."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack((x, rest))

    def cells(self, augmented: np.ndarray, table: int) -> np.ndarray:
        """Real-valued lattice places in one table, one row per vector."""
        part = slice(table * self.bits, (table + 1) * self.bits)
        return (augmented @ self.a[part].T + self.b[part]) / self.width[part]

    def places(self, queries: np.ndarray, table: int) -> np.ndarray:
        return self.cells(np.column_stack((queries, np.zeros(len(queries)))), table)

    def family(self, table: int) -> int:
        return self.number * 64 + table

    def blocks(self, heads: np.ndarray, table: int) -> np.ndarray:
        return _codes(np.full(len(heads), self.family(table) + 1), heads)

    def index(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, bucket) of rows in one table."""
        lattice = np.floor(self.cells(self.rows(x), table))
        return self.blocks(lattice[:, : self.head], table), _codes(np.zeros(len(x)), lattice[:, self.head :])

    def visits(self, place: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, cost so far) of every block in which a query has buckets to visit."""
        floor = np.floor(place)
        steps, costs = perturbations((place - floor)[: self.head], self.budget)
        return self.blocks(floor[: self.head] + steps, table), costs

    def buckets(self, place: np.ndarray, spent: float) -> np.ndarray:
        """Codes of the buckets to visit in a block, by rising cost."""
        floor = np.floor(place)
        steps, _ = perturbations((place - floor)[self.head :], self.budget - spent)
        return _codes(np.zeros(len(steps)), floor[self.head :] + steps)


def _costs(places: np.ndarray, lattice: np.ndarray) -> np.ndarray:
    """Cost of the step from one query's place to each row's cell; infinite beyond one step."""
    floor = np.floor(places)
    low, step = places - floor, lattice - floor
    each = np.where(step == 0, 0.0, np.where(step == -1, low * low, np.where(step == 1, (1 - low) ** 2, np.inf)))
    return each.sum(axis=1)


def fit(number: int, norm: float, rows: int, sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray]) -> Hashing:
    """The setting of one range that finds TARGET of the near rows of the queries with the fewest comparisons.

    ``near`` holds each query's exact neighbours in the range, ``sample`` rows of the range.
    """
    exact = Hashing(number, norm, sample)
    if rows <= BUCKET_ROWS or len(sample) < 16:
        return exact
    best, least = exact, 1.0
    found = sum(len(n) for n in near)
    for tables, bits, width in SETTINGS:
        tried = Hashing(number, norm, sample, tables, bits, width)
        augmented = tried.rows(sample)
        want, cost = [], []
        for table in range(tables):
            lattice, places = np.floor(tried.cells(augmented, table)), tried.places(queries, table)
            cost.append(np.stack([_costs(p, lattice) for p in places]))
            want.append(np.concatenate([_costs(p, np.floor(tried.cells(tried.rows(n), table))) for p, n in zip(places, near, strict=True)]))
        # without near rows in the range, a query visits its own bucket
        tried.budget = float(np.sort(np.min(want, axis=0))[ceil(TARGET * found) - 1]) if found else 0.0
        if not np.isfinite(tried.budget):
            continue
        compared = float(np.mean(np.sum([c <= tried.budget for c in cost], axis=0)))
        if compared >= least:
            continue
        lows = [p - np.floor(p) for p in tried.places(queries[:8], 0)]
        if any(perturbations(low, tried.budget, MOST_PROBES) is None for low in lows):
            continue
        tried.head = min(bits, max(0, int(log2(rows / BLOCK_ROWS))))
        blocks = tables * np.mean([len(perturbations(low[: tried.head], tried.budget)[0]) for low in lows])
        cost_of_all = compared + blocks * VISIT_ROWS / rows
        if cost_of_all < least:
            best, least = tried, cost_of_all
    return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _packed(vectors: DataFrame, largest: float) -> DataFrame:
    """(id, x, range): vectors as bytes of doubles, and the range of their norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            scaled = x / largest
            with np.errstate(divide="ignore"):
                norm = np.log2(np.sqrt((scaled * scaled).sum(axis=1)))
            number = np.clip(np.floor(-norm), 0, RANGES - 1).astype(np.int32)
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), rows, pa.array(number)], ["id", "x", "range"])

    return vectors.mapInArrow(run, "id long, x binary, range int")


def _longest(x: np.ndarray) -> float:
    with np.errstate(over="ignore"):
        return float(np.sqrt(np.einsum("ij,ij->i", x, x).max())) if len(x) else 0.0


def _best(
    ids: np.ndarray, x: np.ndarray, longest: float, query_id: int, q: np.ndarray, nearest: int
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the nearest of some rows, none above a norm, to one query, its own id left out."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.where(ids == query_id, -np.inf, x @ q)
        rough = np.where(np.isnan(rough), -np.inf, rough)
        chosen = np.flatnonzero(ids != query_id)
        if len(chosen) > nearest:
            scale = np.sqrt((q * q).sum()) * longest
            bound = np.partition(rough, -nearest)[-nearest]
            if np.isfinite(bound) and np.isfinite(scale):
                chosen = chosen[rough[chosen] >= bound - 1e-11 * scale]
        # summed row by row, so that equal vectors get equal scores
        exact = (x[chosen] * q).sum(axis=1)
    order = np.lexsort((ids[chosen], -exact))[:nearest]
    return ids[chosen][order], exact[order]


def _meet(index: DataFrame, visits: DataFrame, dim: int, nearest: int, hashings: dict[int, Hashing] | None = None) -> DataFrame:
    """(query_id, vec_ids, scores) of every query and block: (block, id, cell, x) meet (block, id, x, spent, family).

    Blocks are dealt over tasks of bounded size. Without ``hashings`` all rows of a block are compared.
    """
    shared = index.sparkSession.sparkContext.broadcast(hashings)
    visits = visits.toDF("block", "id", "x", "spent", "family")  # columns of its own, also when both sides come from one table

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))

    sizes = parts(index, "i_parts").join(parts(visits, "q_parts"), "block")

    def dealt(side: DataFrame, own: str, other: str, own_name: str, other_name: str, *more: str) -> DataFrame:
        return side.join(sizes, "block").select(
            "block", F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own_name),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name), "id", "x", *more,
        ).select("block", "i", "q", "id", "x", *more)

    rows = dealt(index, "i_parts", "q_parts", "i", "q", "cell")
    asks = dealt(visits, "q_parts", "i_parts", "q", "i", "spent", "family")
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            cell = left.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            ids, x = left.column("id").to_numpy()[order], _matrix(left.column("x"), dim)[order]
            cells, members = np.unique(cell, return_counts=True)
            longest = _longest(x)
            query_ids, q = right.column("id").to_numpy(), _matrix(right.column("x"), dim)
            tools, family = shared.value, right.column("family").to_numpy()
            tool = None if tools is None else tools[int(family[0]) // 64]
            if tool is not None:
                places, spent = tool.places(q, int(family[0]) % 64), right.column("spent").to_numpy()
            for k in range(len(q)):
                some, chosen = ids, x
                if tool is not None and tool.bits:
                    codes = tool.buckets(places[k], spent[k])
                    at = np.searchsorted(cells, codes)
                    at = at[(at < len(cells)) & (cells[np.minimum(at, len(cells) - 1)] == codes)]
                    if not len(at):
                        continue
                    visited = np.zeros(len(cells), dtype=bool)
                    visited[at] = True
                    taken = np.flatnonzero(np.repeat(visited, members))
                    some, chosen = ids[taken], x[taken]
                best, scores = _best(some, chosen, longest, query_ids[k], q[k], nearest)
                if len(best):
                    found.append((query_ids[k], best, scores))
        return pa.Table.from_arrays(
            [pa.array([f[k] for f in found], t.type) for k, t in enumerate(kind)], schema=kind
        )

    key = ("block", "i", "q")
    return rows.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(run, _FOUND)


_FOUND = "query_id long, vec_id array<long>, score array<double>"


def _exact_near(packed: DataFrame, ids: np.ndarray, queries: np.ndarray, nearest: int) -> list[tuple[int, int, bytes]]:
    """(query number, range, vector) of the exact nearest rows of a few queries: one scan, a short list per task."""
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                own, x = part.column("id").to_numpy(), _matrix(part.column("x"), dim)
                number, longest = part.column("range").to_numpy(), _longest(x)
                for k, q in enumerate(queries):
                    others = np.flatnonzero(own != ids[k]) if (own == ids[k]).any() else slice(None)
                    mine = x[others]
                    best, scores = _best(np.arange(len(mine)), mine, longest, -1, q, nearest)
                    held[k].extend((s, int(r), v.tobytes()) for s, r, v in zip(scores, number[others][best], mine[best], strict=True))
                    held[k] = sorted(held[k], reverse=True)[:nearest]
        rows = [(k, *row) for k, some in enumerate(held) for row in some]
        kinds = {"q": pa.int32(), "score": pa.float64(), "range": pa.int32(), "x": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    found = packed.mapInArrow(run, "q int, score double, range int, x binary")
    best = top_per_group(found, ["q"], [F.desc("score"), F.asc("x")], nearest)
    return [(r["q"], r["range"], bytes(r["x"])) for r in best.collect()]  # at most SAMPLE_QUERIES * nearest rows


def _nearest_of(found: DataFrame, queries: int, nearest: int) -> DataFrame:
    """One row per query: its nearest ids and scores over all the blocks it met.

    Rows are merged in groups of bounded size, level by level, each query's lists cut to ``nearest``.
    """

    def run(table: pa.Table) -> pa.Table:
        lists, scores = table.column("vec_id").combine_chunks(), table.column("score").combine_chunks()
        query = np.repeat(table.column("query_id").to_numpy(), np.diff(lists.offsets.to_numpy()))
        vec, score = lists.flatten().to_numpy(), scores.flatten().to_numpy()
        order = np.lexsort((-score, vec, query))
        query, vec, score = query[order], vec[order], score[order]
        fresh = np.ones(len(query), dtype=bool)  # an id met in several tables or blocks counts once
        fresh[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
        query, vec, score = query[fresh], vec[fresh], score[fresh]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        heads = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, int)
        keep = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query)))) < nearest
        sizes = np.add.reduceat(keep, heads) if len(heads) else heads
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.Table.from_arrays(
            [
                pa.array(query[heads], pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(vec[keep], pa.int64())),
                pa.ListArray.from_arrays(ends, pa.array(score[keep], pa.float64())),
            ],
            names=["query_id", "vec_id", "score"],
        )

    units = max(1, queries // MERGED_QUERIES)
    unit = F.pmod(F.xxhash64("query_id"), F.lit(units))
    parts = max(1, ceil(found.count() / units / MERGED_ROWS))
    while parts > 1:
        part = F.pmod(F.xxhash64("query_id", "vec_id"), F.lit(parts))
        found = found.groupBy(unit.alias("unit"), part.alias("part")).applyInArrow(run, _FOUND)
        parts = 1 if parts <= MERGED_PARTS else ceil(parts / MERGED_PARTS)
    return found.groupBy(unit.alias("unit")).applyInArrow(run, _FOUND)


def search(
    vectors: DataFrame,
    is_query: str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    nearest: int = NEAREST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of every query row.

    ``is_query`` is an SQL condition on ``id``.
    """
    context = vectors.sparkSession.sparkContext
    given = columns(vectors, id=id_col, v=F.col(f"`{vector_col}`").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = given.where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.max(F.sqrt(square))
    shape = (
        good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), largest.alias("largest"))
        .orderBy(F.desc("n"), "dim").first()
    )
    if shape is None:
        return given.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        ).where(F.lit(False))
    dim, count = shape["dim"], shape["n"]
    # norms beyond double precision share the first range, which is then searched exactly
    norm = shape["largest"] if 0 < shape["largest"] < float("inf") else float("inf")
    good = good.where(F.size("v") == dim)
    packed = _packed(good.select("id", "v"), norm if norm < float("inf") else 1.0)
    hashings = {0: Hashing(0, norm, np.zeros((0, dim)))}
    if count > BUCKET_ROWS and norm < float("inf"):
        chosen = packed.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE).toPandas()
        sample = np.stack([np.frombuffer(x) for x in chosen["x"]])
        queries = sample[:SAMPLE_QUERIES]
        near = _exact_near(packed, chosen["id"].to_numpy()[: len(queries)], queries, nearest)
        for row in packed.groupBy("range").agg(F.count("*").alias("n")).collect():  # at most RANGES rows
            number = row["range"]
            mine = [[np.frombuffer(x) for k, r, x in near if k == q and r == number] for q in range(len(queries))]
            hashings[number] = fit(
                number, norm * 2.0**-number, row["n"], sample[(chosen["range"] == number).to_numpy()],
                queries, [np.array(m).reshape(-1, dim) for m in mine],
            )
    else:
        packed = packed.withColumn("range", F.lit(0))
    shared = context.broadcast(hashings)

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            number = part.column("range").to_numpy()
            for r in np.unique(number):
                tool, some = shared.value[int(r)], part.filter(pa.array(number == r))
                x = _matrix(some.column("x"), dim)
                for table in range(tool.tables):
                    block, cell = tool.index(x, table) if tool.bits else (tool.blocks(np.zeros((len(x), 0)), 0), np.zeros(len(x), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block), some.column("id"), pa.array(cell), some.column("x")], ["block", "id", "cell", "x"]
                    )

    def visit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = _matrix(part.column("x"), dim)
            for tool in shared.value.values():
                for table in range(tool.tables):
                    places = tool.places(x, table)
                    found = [tool.visits(p, table) for p in places]
                    if not found:
                        continue
                    picked = part.take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([f[0] for f in found])), picked.column("id"), picked.column("x"),
                            pa.array(np.concatenate([f[1] for f in found])),
                            pa.array(np.full(picked.num_rows, tool.family(table), np.int32)),
                        ],
                        ["block", "id", "x", "spent", "family"],
                    )

    asking = packed.where(is_query)
    index = packed.mapInArrow(index_rows, "block long, id long, cell long, x binary")
    visits = asking.mapInArrow(visit_rows, "block long, id long, x binary, spent double, family int")

    asked = asking.select("id").distinct()
    number = asked.count()
    result = cut_lineage(_nearest_of(cut_lineage(_meet(index, visits, dim, nearest, hashings)), number, nearest))
    short = cut_lineage(
        asked.join(result, F.col("id") == F.col("query_id"), "left")
        .where(F.coalesce(F.size("vec_id"), F.lit(0)) < min(nearest, count - 1)).select("id")
    )
    if not short.isEmpty():
        everywhere, none = F.lit(0).cast("long"), F.lit(0)
        rest = _meet(
            packed.select(everywhere.alias("block"), "id", everywhere.alias("cell"), "x"),
            asking.join(short, "id", "left_semi").select(everywhere.alias("block"), "id", "x", none.cast("double").alias("spent"), none.alias("family")),
            dim, nearest,
        )
        rest = _nearest_of(cut_lineage(rest), number, nearest)
        result = result.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(rest)
    ranked = result.select("query_id", F.posexplode(F.arrays_zip("vec_id", "score")).alias("place", "r"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), "r.vec_id", "r.score")
