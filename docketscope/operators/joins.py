"""Joins of a huge side with a list whose size is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketscope.session import cut_lineage

# Rows of a few dozen bytes: about 100 MB per executor at the most.
BROADCAST_ROWS = 2_000_000
# Rows of a list that are broadcast whole, with columns beside the key: about 100 MB as well.
FEW_ROWS = 500_000
# Bits of the table that stands for a long list: 16 MB.
TABLE_BITS = 1 << 27


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Store a derived list, count it, and mark it for broadcast only if it is short.

    A longer list is joined by shuffle, with the same result.
    """
    stored = cut_lineage(small)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def keep_listed(
    big: DataFrame, listed: DataFrame, on: list[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows of ``big`` whose key is listed; texts are not shuffled for a short list."""
    return big.join(checked_broadcast(listed.select(*on).distinct(), max_rows), on, "left_semi")


def join_listed(
    listed: DataFrame, big: DataFrame, on: list[str], max_rows: int = BROADCAST_ROWS, few_rows: int = FEW_ROWS
) -> DataFrame:
    """A list, unique in ``on``, with the rows of ``big`` that it names.

    Texts are not shuffled for a few rows. Beyond ``max_rows`` all rows of ``big`` are shuffled once; they are never
    sorted, as the list is the side that is hashed in each partition.
    """
    stored = cut_lineage(listed)
    n = stored.count()
    if n <= max_rows:
        big = big.join(F.broadcast(stored.select(*on)), on, "left_semi")
    return (F.broadcast(stored) if n <= few_rows else stored.hint("shuffle_hash")).join(big, on)


def keep_possible(big: DataFrame, listed: DataFrame, key: str, max_rows: int = BROADCAST_ROWS, bits: int = TABLE_BITS) -> DataFrame:
    """Rows of ``big`` whose key is listed; where the list is long, some others too.

    No row of ``big`` is shuffled: a long list is a table of bits of fixed size, one for each hash of a key.
    """
    stored = cut_lineage(listed.select(key).where(F.col(key).isNotNull()).distinct())
    if stored.count() <= max_rows:
        return big.join(F.broadcast(stored), key, "left_semi")
    place = F.pmod(F.xxhash64(key), F.lit(bits)).alias("place")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = stored.select(place).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(bits // 64 + 1, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_place").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(table[at // 64] >> (at % 64) & 1 == 1)).drop_columns(["_place"])

    keyed = big.where(F.col(key).isNotNull()).withColumn("_place", place)
    return keyed.mapInArrow(run, big.schema)
