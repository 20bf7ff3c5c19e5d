"""Exports: CSV, JSON bundles, Parquet and the partitioned comments mirror."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketscope.functions.fields import clean_strings
from docketscope.operators.lookups import clean_id


def csv_field(c: Column) -> Column:
    """One CSV field: NULL is empty; quoted only if it holds a comma, quote or newline."""
    text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\n]'), quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row of an export as the text of its CSV record."""
    clean = clean_strings(df)
    return clean.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in clean.columns]).alias("line"))


def sink_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header per part file; many tasks write many parts."""
    (
        clean_strings(df)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def sink_parquet(df: DataFrame, path: str) -> None:
    clean_strings(df).write.mode("overwrite").parquet(path)


def _record(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def json_records(dockets: DataFrame, documents: DataFrame, comments: DataFrame) -> DataFrame:
    """Bundle records of every docket: (agency_code, docket_id, section, record).

    One row per object instead of one array per docket, so that a docket with a
    third of all comments is still written by many tasks.
    """
    parts = [("docket", dockets), ("documents", documents), ("comments", comments)]
    rows = None
    for section, df in parts:
        clean = clean_strings(df)
        part = clean.select("agency_code", "docket_id", F.lit(section).alias("section"), _record(clean).alias("record"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def sink_json_bundles(
    dockets: DataFrame, documents: DataFrame, comments: DataFrame, path: str
) -> None:
    """All dockets in one job, as JSON lines {docket_id, section, record} in one folder per agency.

    Rows are range-partitioned by agency, docket, section and a hash of the record: small
    dockets share files, a large one is split over several, and no docket has a folder of
    its own. Files are compressed: records repeat their field names.
    """
    (
        json_records(dockets, documents, comments)
        .repartitionByRange("agency_code", "docket_id", "section", F.xxhash64("record"))
        .sortWithinPartitions("agency_code", "docket_id", "section")
        .write.mode("overwrite")
        .partitionBy("agency_code")
        .option("compression", "gzip")
        .json(path)
    )


def docket_bundle(
    dockets: DataFrame, documents: DataFrame, comments: DataFrame, docket_id: str
) -> DataFrame:
    """One docket's download as rows (place, section, record): the docket, its documents, its comments.

    Newest first in each section. Rows instead of one object, so that neither a task
    nor the driver holds a docket of a million comments; written in order, the records
    are the download's lines.
    """
    wanted = clean_id(docket_id)
    mine = [df.where(F.col("docket_id") == wanted) for df in (dockets, documents, comments)]
    dated = [df.withColumn("_day", F.col("posted_date")) if "posted_date" in df.columns else df.withColumn("_day", F.lit(None).cast("string")) for df in mine]
    rows = None
    for place, (section, df, source) in enumerate(zip(("docket", "documents", "comments"), dated, mine, strict=True)):
        clean = clean_strings(df)
        part = clean.select(
            F.lit(place).alias("place"), F.lit(section).alias("section"), "_day",
            F.to_json(F.struct(*source.columns), {"ignoreNullFields": "false"}).alias("record"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy("place", F.desc_nulls_last("_day"), "record").drop("_day")


def write_comments_mirror(comments: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """The mirror: one folder per agency, sorted by docket, small row groups.

    Range partitioning on (agency, docket, comment) splits a huge agency or
    docket over tasks while keeping each file's docket range narrow, so a docket
    filter prunes files and row groups.
    """
    (
        comments.repartitionByRange("agency_code", "docket_id", "comment_id")
        .sortWithinPartitions("agency_code", "docket_id", "comment_id")
        .write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
        .partitionBy("agency_code")
        .parquet(path)
    )
