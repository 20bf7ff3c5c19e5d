"""Scans by id, pages, counts and per-docket listings.

Listings take ``docket_id=None`` for all dockets at once: a ``row_number`` limit
per docket, which Spark applies as a partial top-k before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketscope.functions.fields import unquote
from docketscope.functions.text import comment_body

DEFAULT_LIMIT = 1000

DOCKET_COLUMNS = ["docket_id", "agency_code", "title", "abstract", "docket_type", "modify_date"]
DOCUMENT_COLUMNS = [
    "document_id", "docket_id", "agency_code", "title", "document_type", "posted_date",
    "modify_date", "comment_start_date", "comment_end_date", "file_url",
]
DOCKET_DOCUMENT_COLUMNS = [
    "docket_id", "document_id", "title", "document_type", "posted_date",
    "comment_start_date", "comment_end_date", "file_url",
]

_ID_COLUMN = {"dockets": "docket_id", "documents": "document_id", "comments": "comment_id"}


def clean_id(docket_id: str) -> str:
    return docket_id.removeprefix('"').removesuffix('"').upper()


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int | None) -> DataFrame:
    """First k rows of each group under a total order; k None keeps all."""
    if k is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def by_agency_docket(
    df: DataFrame, agency_code: str | None = None, docket_id: str | None = None
) -> DataFrame:
    if agency_code:
        df = df.where(F.col("agency_code") == agency_code.upper())
    if docket_id:
        df = df.where(F.col("docket_id") == docket_id.upper())
    return df


def resolve_comment_partitions(
    comments: DataFrame, index: DataFrame, docket_id: str | None = None
) -> DataFrame:
    """Comments whose (agency, docket) the index knows.

    The index is authoritative for a docket's agency, which may differ from the
    id prefix. A filter on one docket reaches both sides of the semi-join, and through
    the filtered index only that docket's agency folders of the mirror are read.
    """
    keys = ["agency_code", "docket_id"]
    known = index.select(*keys)
    if docket_id is not None:
        cid = clean_id(docket_id)
        comments = comments.where(F.col("docket_id") == cid)
        known = known.where(F.col("docket_id") == cid)
    return comments.join(known, keys, "left_semi")


def get_data(
    df: DataFrame,
    table: str,
    agency_code: str | None = None,
    docket_id: str | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """One page of a table's rows, ordered by its id so that pages never overlap."""
    rows = by_agency_docket(df, agency_code, docket_id)
    if table == "dockets":
        rows = rows.select(*DOCKET_COLUMNS)
    return rows.orderBy(F.col(_ID_COLUMN[table]).asc_nulls_last()).offset(offset).limit(limit)


def data_count(
    df: DataFrame, agency_code: str | None = None, docket_id: str | None = None
) -> DataFrame:
    return by_agency_docket(df, agency_code, docket_id).agg(F.count("*").alias("count"))


def comment_data_count(
    index: DataFrame, agency_code: str | None = None, docket_id: str | None = None
) -> DataFrame:
    """Comment count from the index alone."""
    rows = by_agency_docket(index, agency_code, docket_id)
    return rows.agg(F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("count"))


def list_agencies(dockets: DataFrame) -> DataFrame:
    return dockets.select("agency_code").distinct().orderBy(F.asc_nulls_last("agency_code"))


def list_dockets(dockets: DataFrame, agency_code: str) -> DataFrame:
    rows = dockets.where(F.col("agency_code") == agency_code.upper())
    return rows.select("docket_id").distinct().orderBy(F.desc_nulls_last("docket_id"))


def docket_by_id(dockets: DataFrame, docket_id: str) -> DataFrame:
    return dockets.where(F.col("docket_id") == clean_id(docket_id)).limit(1)


def document_by_id(documents: DataFrame, document_id: str) -> DataFrame:
    wanted = document_id.removeprefix('"').removesuffix('"')
    return documents.where(F.col("document_id") == wanted).select(*DOCUMENT_COLUMNS).limit(1)


def documents_for_docket(
    documents: DataFrame, docket_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """A docket's documents, newest first; every docket's when no id is given.

    ``limit`` cuts each docket's listing; by default all documents are listed.
    """
    order = [F.desc_nulls_last("posted_date"), F.asc("document_id")]
    rows = documents.select(*DOCKET_DOCUMENT_COLUMNS)
    if docket_id is None:
        return top_per_group(rows.where(F.col("docket_id").isNotNull()), ["docket_id"], order, limit)
    mine = rows.where(F.col("docket_id") == clean_id(docket_id)).orderBy(*order)
    return mine if limit is None else mine.limit(limit)


def _of_docket(comments: DataFrame, docket_id: str, index: DataFrame | None) -> DataFrame:
    """One docket's comments; the index, where given, names the agency folders to read."""
    if index is not None:
        return resolve_comment_partitions(comments, index, docket_id)
    return comments.where(F.col("docket_id") == clean_id(docket_id))


def comments_for_docket(
    comments: DataFrame,
    docket_id: str,
    limit: int = 10,
    offset: int = 0,
    sort_by: str = "recent",
    index: DataFrame | None = None,
) -> DataFrame:
    """One page of a docket's comments with the resolved body."""
    when = F.asc_nulls_last("posted_date") if sort_by == "oldest" else F.desc_nulls_last("posted_date")
    page = (
        _of_docket(comments, docket_id, index)
        .orderBy(when, F.asc("comment_id"))
        .offset(offset)
        .limit(limit)
    )
    return page.select(
        "comment_id", "docket_id", "agency_code", "title",
        comment_body(F.col("comment"), F.col("text_content")).alias("comment"),
        "first_name", "last_name", "organization", "category",
        "posted_date", "modify_date", "attachments_json",
    )


def export_comments(
    comments: DataFrame, docket_id: str, limit: int | None = None, index: DataFrame | None = None
) -> DataFrame:
    """All comments of one docket, newest first; ``limit`` keeps the newest only."""
    rows = _of_docket(comments, docket_id, index)
    ordered = rows.orderBy(F.desc_nulls_last("posted_date"), F.asc("comment_id"))
    return ordered if limit is None else ordered.limit(limit)


def comment_counts(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Comments per requested docket (column ``docket_id`` of ``ids``); absent ones count 0."""
    wanted = ids.select(F.upper(unquote(F.col("docket_id"))).alias("docket_id")).distinct()
    counted = index.groupBy("docket_id").agg(F.sum("row_count").alias("n"))
    joined = wanted.join(counted, "docket_id", "left")
    return joined.select("docket_id", F.coalesce("n", F.lit(0)).cast("long").alias("comment_count"))


def search_resources(
    tables: dict[str, DataFrame], text: str, agency_code: str | None = None, limit: int = 10
) -> DataFrame:
    """Title matches over several tables, tagged by type."""
    rows = None
    for kind, df in tables.items():
        found = df.where(F.contains(F.lower("title"), F.lit(text.lower())))
        if kind == "comments" and agency_code:
            found = found.where(F.col("agency_code") == agency_code)
        part = found.select(F.lit(kind).alias("type"), "title", "docket_id", "agency_code")
        rows = part if rows is None else rows.unionByName(part)
    order = [F.asc_nulls_last(c) for c in ("type", "title", "docket_id", "agency_code")]
    return rows.orderBy(*order).limit(limit)
