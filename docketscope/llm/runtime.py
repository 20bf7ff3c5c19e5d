"""What the operators share on the Spark side: code shipping, batch slicing, checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Workers then import the operators' modules wherever they run; the file is
    served by the driver and needs no shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "docketscope_pkg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def columns(df: DataFrame, **wanted: Column | str) -> DataFrame:
    """Project the input to the named columns an operator reads; all others are dropped."""
    ship(df.sparkSession)
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in wanted.items()])


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold at most ``most`` bytes (or one text)."""
    for batch in batches:
        column = batch.column(text)
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
        ends = ends.to_numpy(zero_copy_only=False)
        first, n = 0, batch.num_rows
        while first < n:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last
