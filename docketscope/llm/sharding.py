"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**ring_bits cells. A document's cell is the head of a hash of its id; each shard
owns ``nodes`` cells, and a document belongs to the first owned cell clockwise. A shard holds at most
its even share of rows: documents beyond it continue clockwise to the next shard with room, so counts
differ by at most one, and changing the number of shards moves little more than the share that has to
move. Only the number of rows per cell reaches the driver, at most 2**ring_bits integers however
large the table is; placing cells happens there, placing rows in the join with the cells' segments.
Rows of a cell are ordered by a hash of id, size and checksum. A cell of many rows, as that of all null ids or
of one id with many texts, is ranked in ranges of that hash whose offsets are added up; the ranks are the same.

Cases: a null text has size 1 and checksum 0; null ids share one cell; repeated rows are counted
together first and then get places one by one, a bounded number of them in a task's array; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docketscope.llm.runtime import columns
from docketscope.session import cut_lineage

RING_BITS = 16
NODES = 64
SHARDS = 16
# Rows that are ranked together, and repeated rows that are laid out together.
RANGE_ROWS = 50_000


def ring_owners(shards: int, nodes: int = NODES, ring_bits: int = RING_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(cells of the virtual nodes in ring order, their shards). A cell wanted twice goes to the smaller hash."""
    wanted = []
    for shard in range(shards):
        for node in range(nodes):
            value = int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big")
            wanted.append((value >> (64 - ring_bits), value, shard))
    cells: dict[int, int] = {}
    for cell, _, shard in sorted(wanted):
        cells.setdefault(cell, shard)
    at = np.array(sorted(cells))
    return at, np.array([cells[c] for c in at])


def place_cells(loads: np.ndarray, shards: int, nodes: int = NODES, ring_bits: int = RING_BITS) -> pd.DataFrame:
    """Segments (cell, low, high, shard, slot): rows low to high - 1 of a cell, and the slot of the first.

    Every shard first keeps what it owns, in ring order, up to its share; what is left over
    continues clockwise from its cell to the next shard with room.
    """
    at, owner_of = ring_owners(shards, nodes, ring_bits)
    node = at.searchsorted(np.arange(1 << ring_bits)) % len(at)
    home = owner_of[node]
    total = int(loads.sum())
    wanted = np.bincount(home, weights=loads, minlength=shards).astype(np.int64)
    share = np.full(shards, total // shards, dtype=np.int64)
    share[np.argsort(-wanted, kind="stable")[: total % shards]] += 1
    room, slots = share.copy(), np.zeros(shards, dtype=np.int64)
    segments, over = [], []

    def put(cell: int, low: int, high: int, shard: int) -> None:
        segments.append((cell, low, high, shard, int(slots[shard])))
        slots[shard] += high - low
        room[shard] -= high - low

    for cell in np.flatnonzero(loads):
        shard, load = int(home[cell]), int(loads[cell])
        stay = min(load, int(room[shard]))
        if stay:
            put(int(cell), 0, stay, shard)
        if stay < load:
            over.append((int(cell), stay, load))
    for cell, low, high in over:
        k = int(node[cell])
        while low < high:
            shard = int(owner_of[k % len(at)])
            if room[shard]:
                some = min(high - low, int(room[shard]))
                put(cell, low, low + some, shard)
                low += some
            k += 1
    return pd.DataFrame(segments, columns=["cell", "low", "high", "shard", "slot"]).astype(
        {"cell": "int32", "low": "int64", "high": "int64", "shard": "int32", "slot": "int64"}
    )


def _ranked(rows: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Rows with ``rank``, the number of row copies before them in their cell; ``crowded`` has (cell, parts)."""
    order = ("head", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("head", F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_crc32"), 33))

    def before(window: WindowSpec) -> Column:
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if crowded is None:
        return rows.withColumn("rank", before(Window.partitionBy("cell").orderBy(*order)))
    # at most one row per cell of the ring
    dealt = rows.join(F.broadcast(crowded), "cell", "left").withColumn(
        "part", F.shiftrightunsigned(F.col("head") * F.coalesce("parts", F.lit(1)), 31)
    )
    inside = dealt.withColumn("inner", before(Window.partitionBy("cell", "part").orderBy(*order)))
    sums = dealt.where("parts is not null").groupBy("cell", "part").agg(F.sum("n").alias("n"))
    offsets = sums.select("cell", "part", before(Window.partitionBy("cell").orderBy("part")).alias("outer"))
    return inside.join(offsets, ["cell", "part"], "left").withColumn("rank", F.col("inner") + F.coalesce("outer", F.lit(0)))


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    nodes: int = NODES,
    ring_bits: int = RING_BITS,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per document row."""
    spark = docs.sparkSession
    text = F.col("text")
    narrow = columns(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = cut_lineage(
        narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
        .withColumn("cell", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ring_bits).cast("int"))
    )
    cells = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.max("n").alias("most")).toPandas()
    loads = np.zeros(1 << ring_bits, dtype=np.int64)
    loads[cells["cell"]] = cells["n"]
    placed = place_cells(loads, shards, nodes, ring_bits)
    segments = spark.createDataFrame(placed, "cell int, low long, high long, shard int, slot long")
    full = cells[cells["rows"] > RANGE_ROWS]
    crowded = None
    if len(full):
        parts = (full["rows"] // RANGE_ROWS + 1).astype("int64")
        crowded = spark.createDataFrame(pd.DataFrame({"cell": full["cell"], "parts": parts}), "cell int, parts long")
    ranked = _ranked(rows, crowded).withColumn("end", F.col("rank") + F.col("n"))
    if (cells["most"] > RANGE_ROWS).any():
        starts = F.sequence(F.col("rank"), F.col("end") - 1, F.lit(RANGE_ROWS).cast("long"))
        ranked = ranked.withColumn("rank", F.explode(starts)).withColumn("end", F.least("end", F.col("rank") + RANGE_ROWS))
        ranked = ranked.repartition("cell", "rank")
    ranked = ranked.withColumn("rank", F.explode(F.sequence("rank", F.col("end") - 1)))
    joined = ranked.join(F.broadcast(segments), "cell").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return joined.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("low")).alias("slot")
    )
