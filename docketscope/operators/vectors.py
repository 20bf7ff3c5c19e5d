"""Comments with nearly the same embedding: an exact join on cosine similarity.

Unit vectors are a metric space: cosine >= t is distance <= sqrt(2 - 2 t). About sqrt(n) pivots, taken by hash,
divide it into Voronoi cells. A row belongs to the cell of its nearest pivot and also visits every cell that can hold a
partner: its distance to the plane between the two pivots is at most the radius, and so is its distance to the
ball round the cell's rows. Of two cells only one sends visitors to the other, so a pair is formed once. Nothing is lost
by either bound, whatever the pivots are; poor pivots only cost comparisons. Cells are dealt over blocks of bounded size,
which Spark spreads, and a block is compared inside its task, a tile at a time: a matrix product of some components and
the length of the rest, in single precision, bounds every cosine from above; what may reach the threshold is computed exactly.

Rows without clusters visit nearly every cell, and their copies would grow with n * sqrt(n). So visits are counted
before a row is sent, and where larger blocks of all rows take fewer copies, all rows are compared in such blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketscope.operators.components import connected_components
from docketscope.session import cut_lineage

SIMILARITY = 0.9
# Pivots are broadcast: at most so many.
MOST_PIVOTS = 8192
BLOCK_ROWS = 2048
# Blocks of all rows: their bytes, and as many blocks at least where rows suffice, so that tasks share the work.
WHOLE_BYTES = 32 << 20
WHOLE_BLOCKS = 4
# Of fewer rows, cells are compared as they are.
WHOLE_FROM = 4096
# Slack of distances that are computed from inner products; of products in single precision, for each component.
SLACK = 1e-6
SINGLE_SLACK = 1e-6
# Share of the components in the product that bounds; rows and columns of a tile; pairs that are computed exactly at once.
HEAD_SHARE = 3 / 8
TILE = (512, 2048)
EXACT_PAIRS = 1 << 15

_PLACED = "id long, x binary, cell int, away double"
_VISIT = "cell int, id long, x binary"
_COUNT = "cell int, n long"
_PAIR = "a long, b long, similarity double"


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit) of the rows that take part.

    Null, zero and non-finite vectors, rows without id, and vectors of another length than most do not.
    """
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = given.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    usual = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    alike = good.join(F.broadcast(usual.select("dim")), F.size("v") == F.col("dim")).select("id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                # by the largest component first, so that squares neither overflow nor vanish; no negative zeros
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "unit"])

    return alike.mapInArrow(run, "id long, unit binary")


def directions_of(rows: DataFrame) -> DataFrame:
    """(id, unit): distinct directions under their smallest id; a hot one is a partial row per task."""
    return cut_lineage(rows.groupBy("unit").agg(F.min("id").alias("id")))


def _reader():
    """How tasks read the vectors of a column of bytes where they lie; a closure, so that executors need no module of ours."""

    def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
        return np.frombuffer(column.buffers()[2], count=len(column) * dim, offset=int(first)).reshape(-1, dim)

    return matrix


def _heads(dim: int):
    """How tasks shorten unit vectors: the products of what is left are at least the products of the vectors.

    Some components, and the length of all others as one more (Cauchy and Schwarz).
    """
    kept = max(1, int(dim * HEAD_SHARE))

    def heads(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt((x[:, kept:] * x[:, kept:]).sum(axis=1, keepdims=True))
        return np.concatenate((x[:, :kept], rest), axis=1).astype(np.float32)

    return heads


def _placed(units: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, x, cell, away): each row with its nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                x = np.frombuffer(b"".join(part.column("unit").to_pylist())).reshape(-1, pivots.shape[1])
                near = x @ pivots.T
                cell = near.argmax(axis=1)
                away = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(x)), cell], 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("unit"), pa.array(cell, pa.int32()), pa.array(away)],
                    ["id", "x", "cell", "away"],
                )

    return cut_lineage(units.select("id", "unit").mapInArrow(run, _PLACED))


def _visits(placed: DataFrame, pivots: np.ndarray, radii: np.ndarray, reach: float, count: bool = False) -> DataFrame:
    """(cell, id, x): rows in every other cell that may hold a partner and receives visitors of theirs.

    With ``count`` only their numbers: (cell, n), a row per cell and piece of the table.
    """
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    limit = reach + SLACK
    matrix = _reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(len(pivots))
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                x = matrix(part.column("x"), pivots.shape[1])
                home = part.column("cell").to_numpy()
                square = np.maximum(2 - 2 * (x @ pivots.T), 0)
                own = square[np.arange(len(x)), home][:, None]
                gap = between[home]
                plane = square - own <= 2 * gap * limit + SLACK
                ball = np.sqrt(square) <= radii[None, :] + limit
                even = (home[:, None] + number) % 2 == 0
                sends = np.where(even, home[:, None] < number, home[:, None] > number)
                visits = plane & ball & sends
                if count:
                    total += visits.sum(axis=0)
                    continue
                row, cell = np.nonzero(visits)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), taken.column("id"), taken.column("x")], ["cell", "id", "x"])

        if count:
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(total)], ["cell", "n"])

    return placed.mapInArrow(run, _COUNT if count else _VISIT)


def _whole_rows(rows: int, dim: int) -> int:
    """Rows of a block of all rows."""
    return max(BLOCK_ROWS, min(WHOLE_BYTES // (8 * dim), ceil(rows / WHOLE_BLOCKS)))


def _copies(homes: int, guests: int, block: int) -> int:
    """Rows that the units of one cell receive."""
    i, j = ceil(homes / block), ceil(guests / block)
    return homes * (i + 1 + j) + guests * i


def _dealt_whole(placed: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides under their units, all rows as one cell without visitors."""
    unit = ["cell", "visitor", "i", "j"]
    rows = placed.select(
        F.lit(0).alias("cell"), F.lit(False).alias("visitor"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("mine"), "id", "x"
    )
    left = rows.select("cell", "visitor", F.col("mine").alias("i"), F.explode(F.sequence(F.col("mine"), F.lit(blocks - 1))).alias("j"), "id", "x")
    right = rows.select("cell", "visitor", F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("i"), F.col("mine").alias("j"), "id", "x")
    return left, right.toDF(*unit, "id", "x")


def _dealt(placed: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides under their units (cell, visitor, i, j): every pair of a cell meets in one unit."""
    visits = cut_lineage(visits).toDF("cell", "id", "x")  # columns of its own: both sides come from one table
    homes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("homes"))
    guests = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("guests"))
    parts = F.broadcast(homes.join(guests, "cell", "left").na.fill(0, ["guests"]))  # at most a row per pivot
    unit = ["cell", "visitor", "i", "j"]

    def block(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def upto(first, last):
        return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))

    own = placed.select("cell", "id", "x").join(parts, "cell").withColumn("mine", block("homes"))
    come = visits.join(parts, "cell").withColumn("mine", block("guests"))
    no, yes, zero = F.lit(False).alias("visitor"), F.lit(True).alias("visitor"), F.lit(0)
    left = own.select("cell", no, F.col("mine").alias("i"), upto(F.col("mine"), F.col("homes") - 1).alias("j"), "id", "x").unionByName(
        own.select("cell", yes, F.col("mine").alias("i"), upto(zero, F.col("guests") - 1).alias("j"), "id", "x")
    )
    right = own.select("cell", no, upto(zero, F.col("mine")).alias("i"), F.col("mine").alias("j"), "id", "x").unionByName(
        come.select("cell", yes, upto(zero, F.col("homes") - 1).alias("i"), F.col("mine").alias("j"), "id", "x")
    )
    return left.select(*unit, "id", "x"), right.select(*unit, "id", "x").toDF(*unit, "id", "x")


def _compared(left: DataFrame, right: DataFrame, dim: int, threshold: float, forest: bool) -> DataFrame:
    """(a, b, similarity) of every similar pair of a unit, or of pairs that connect the same rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    matrix, heads, (tall, wide), at_once = _reader(), _heads(dim), TILE, EXACT_PAIRS
    least = threshold - SINGLE_SLACK * (dim + 2)

    def tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and columns of pairs whose bound reaches the threshold, some at once."""
        for first in range(0, len(left), tall):
            for second in range(0, len(right), wide):
                rows, cols = np.nonzero(left[first : first + tall] @ right[second : second + wide].T >= least)
                for at in range(0, len(rows), at_once):
                    yield rows[at : at + at_once] + first, cols[at : at + at_once] + second

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if one.num_rows and two.num_rows:
            ids, ids2 = one.column("id").to_numpy(), two.column("id").to_numpy()
            x, y = matrix(one.column("x"), dim), matrix(two.column("x"), dim)
            same = not two.column("visitor")[0].as_py() and two.column("i")[0].as_py() == two.column("j")[0].as_py()
            root = {int(i): int(i) for i in np.concatenate((ids, ids2))} if forest else {}

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for rows, cols in tiles(heads(x), heads(y)):
                exact = (x[rows] * y[cols]).sum(axis=1)
                keep = exact >= threshold
                if same:
                    keep &= ids[rows] < ids2[cols]
                a, b, s = ids[rows[keep]], ids2[cols[keep]], exact[keep]
                if forest:
                    for p, q, v in zip(a.tolist(), b.tolist(), s.tolist(), strict=True):
                        p0, q0 = top(p), top(q)
                        if p0 != q0:
                            root[max(p0, q0)] = min(p0, q0)
                            found.append((p, q, v))
                else:
                    found.extend(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), s.tolist(), strict=True))
        return pa.Table.from_arrays([pa.array([f[k] for f in found], c.type) for k, c in enumerate(schema)], schema=schema)

    unit = ["cell", "visitor", "i", "j"]
    return left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(run, _PAIR)


def _units(directions: DataFrame, threshold: float, pivots: int | None) -> tuple[DataFrame, DataFrame, int] | None:
    count = directions.count()
    number = min(MOST_PIVOTS, pivots or ceil(sqrt(count)))
    taken = directions.orderBy(F.xxhash64("id"), "id").limit(number).select("unit").collect()
    if not taken:
        return None
    points = np.array([np.frombuffer(r["unit"]) for r in taken])
    placed = _placed(directions, points)
    dim = points.shape[1]
    radii, homes, guests = np.zeros(len(points)), {}, {}
    for row in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # one row per pivot
        radii[row["cell"]], homes[row["cell"]] = row["r"], row["n"]
    reach = sqrt(max(2 - 2 * threshold, 0))
    for row in _visits(placed, points, radii, reach, count=True).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        guests[row["cell"]] = row["n"]
    whole = _whole_rows(count, dim)
    if count >= WHOLE_FROM and sum(_copies(n, guests[cell], BLOCK_ROWS) for cell, n in homes.items()) > _copies(count, 0, whole):
        return *_dealt_whole(placed, ceil(count / whole)), dim
    return *_dealt(placed, _visits(placed, points, radii, reach)), dim


def comparisons(left: DataFrame, right: DataFrame) -> DataFrame:
    """(units, pairs, most): how many pairs the units form, and the largest unit's."""
    unit = ["cell", "visitor", "i", "j"]
    n, m = left.groupBy(*unit).agg(F.count("*").alias("n")), right.groupBy(*unit).agg(F.count("*").alias("m"))
    pairs = F.when(~F.col("visitor") & (F.col("i") == F.col("j")), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m"))
    return n.join(m, unit).agg(F.count("*").alias("units"), F.sum(pairs).cast("long").alias("pairs"), F.max(pairs).cast("long").alias("most"))


def semantic_pairs(
    vectors: DataFrame,
    threshold: float = SIMILARITY,
    id_col: str = "comment_id",
    vector_col: str = "embedding",
    pivots: int | None = None,
) -> DataFrame:
    """(a, b, similarity) of all pairs of distinct directions with at least that cosine, a < b.

    A direction is named by its smallest id; ``semantic_classes`` says which rows share one.
    """
    dealt = _units(directions_of(unit_rows(vectors, id_col, vector_col)), threshold, pivots)
    if dealt is None:
        return vectors.sparkSession.createDataFrame([], _PAIR)
    return _compared(*dealt, threshold, forest=False)


def semantic_classes(
    vectors: DataFrame,
    threshold: float = SIMILARITY,
    id_col: str = "comment_id",
    vector_col: str = "embedding",
    pivots: int | None = None,
) -> DataFrame:
    """(id, class_id, kept) of every row with a vector: classes of rows linked by similar pairs.

    The smallest id names a class and is the row to keep. A task reports only links that join something, so
    a group of a million copies gives as many links as rows and not all pairs.
    """
    rows = unit_rows(vectors, id_col, vector_col)
    directions = directions_of(rows)
    dealt = _units(directions, threshold, pivots)
    if dealt is None:
        links = vectors.sparkSession.createDataFrame([], "src long, dst long")
    else:
        links = _compared(*dealt, threshold, forest=True).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = connected_components(links)
    # each direction's class, then each row's direction
    named = directions.join(roots, F.col("id") == F.col("node"), "left").select("unit", F.coalesce("root", "id").alias("class_id"))
    return rows.join(named, "unit").select(
        F.col("id").alias(id_col), "class_id", (F.col("id") == F.col("class_id")).alias("kept")
    )
