"""Rollups kept up to date by partition: only what changed since the last run is read.

A source is a table in folders by agency. A rollup whose groups stay within an agency is made
of one part per agency. Each run lists the source's files, compares a mark per agency with that
of the last run, rebuilds the parts of changed agencies and takes over the others. Parts are
never overwritten, and a run counts from when its state is written, last: a job that fails
half-way leaves the previous state in force, and readers never see half a run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketscope.operators.joins import checked_broadcast

STATE = "agency_code string, mark decimal(38,0), made int, run int"


@dataclass(frozen=True)
class Refreshed:
    """The merged rollup, the agencies that were rebuilt, and the source rows that were read for it."""

    rollup: DataFrame
    changed: list[str | None]
    read: DataFrame


def _marks(source: DataFrame) -> DataFrame:
    """(agency_code, mark): files, sizes and times of every folder; no column of the source is read."""
    files = source.select(
        "agency_code", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("time"),
    ).distinct()
    return files.groupBy("agency_code").agg(F.sum(F.xxhash64("path", "size", "time").cast("decimal(38,0)")).alias("mark"))


def _last(spark: SparkSession, base: str) -> tuple[DataFrame, int]:
    """State of the last complete run and its number; an empty one before the first."""
    try:
        states = spark.read.schema(STATE).parquet(f"{base}/state")
    except AnalysisException:
        return spark.createDataFrame([], STATE), 0
    run = states.agg(F.max("run")).first()[0] or 0
    return states.where(F.col("run") == run), run


def _merged(spark: SparkSession, base: str, state: DataFrame) -> DataFrame:
    """Each agency's part from the run that made it; other folders are pruned."""
    parts = spark.read.option("basePath", f"{base}/parts").parquet(f"{base}/parts")
    valid = checked_broadcast(state.select(F.col("agency_code").alias("_agency"), F.col("made").alias("_made")))
    mine = parts["agency_code"].eqNullSafe(valid["_agency"]) & (parts["run"].cast("int") == valid["_made"])
    return parts.join(valid, mine, "left_semi").drop("run")


def refresh(source: DataFrame, base: str, build: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Bring the rollup under ``base`` up to the source's files.

    ``build`` makes rollup rows with an ``agency_code`` from rows of whole agencies. Agencies that
    are gone drop out, also when all are. The list of changed agencies, a name per folder, is all
    that reaches the driver.
    """
    spark = source.sparkSession
    state, last = _last(spark, base)
    run = last + 1
    marks = _marks(source)
    old = state.select(F.col("agency_code").alias("_agency"), F.col("mark").alias("_mark"), F.col("made").alias("_made"))
    same = marks["agency_code"].eqNullSafe(old["_agency"]) & (marks["mark"] == old["_mark"])
    now = marks.join(old, same, "left").select(
        "agency_code", "mark", F.coalesce("_made", F.lit(run)).alias("made")
    )
    # written apart from the state: the state is the last thing of a run
    now.write.mode("overwrite").parquet(f"{base}/marks/run={run}")
    now = spark.read.parquet(f"{base}/marks/run={run}")
    changed = [r[0] for r in now.where(F.col("made") == run).select("agency_code").collect()]
    wanted = F.col("agency_code").isin([c for c in changed if c is not None])
    read = source.where(wanted | F.col("agency_code").isNull() if None in changed else wanted)
    if changed or not last:
        build(read).write.mode("overwrite").partitionBy("agency_code").parquet(f"{base}/parts/run={run}")
    now.write.mode("overwrite").parquet(f"{base}/state/run={run}")
    return Refreshed(_merged(spark, base, now), changed, read)
