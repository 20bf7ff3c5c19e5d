"""Table contracts and readers for the Parquet tables and the search corpus."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketscope.functions.fields import unquote
from docketscope.session import configure

# name -> (required columns, optional columns); DDL types, STRING when omitted.
CONTRACTS = {
    "dockets": (
        "docket_id agency_code title",
        "abstract docket_type modify_date date_created raw_json",
    ),
    "documents": (
        "document_id docket_id agency_code title document_type posted_date",
        "modify_date comment_start_date comment_end_date file_url",
    ),
    "comments": (
        "comment_id docket_id agency_code comment posted_date",
        "title text_content first_name last_name organization category document_type "
        "modify_date receive_date attachments_json",
    ),
    "federal_register": (
        "document_number title document_type publication_date",
        "abstract subtype effective_on comments_close_on signing_date agency_slugs "
        "docket_ids_json regulation_id_numbers_json html_url pdf_url executive_order_number",
    ),
    "comments_index": ("agency_code docket_id year:bigint month:bigint row_count:bigint", ""),
    "feed_summary": (
        "docket_id agency_code title comment_count:bigint",
        "abstract docket_type modify_date date_created comment_end_date",
    ),
    "agency_stats": (
        "agency_code docket_count:bigint document_count:bigint comment_count:bigint",
        "",
    ),
    "agency_monthly_volume": (
        "agency_code year:bigint month:bigint document_type document_count:bigint",
        "",
    ),
    "rulemaking_lifecycles": (
        "kind docket_id agency_code title proposed_date:date final_date:date days:int",
        "",
    ),
    "discovery_signals": ("agency_code recent_30d:bigint baseline:double ratio:double", ""),
    "fr_docket_links": (
        "docket_id document_number title document_type publication_date",
        "abstract subtype effective_on comments_close_on signing_date agency_slugs "
        "docket_ids_json regulation_id_numbers_json html_url pdf_url executive_order_number",
    ),
}

CORPUS_SCHEMA = (
    "version string, count bigint, "
    "docs array<struct<id:string,a:string,t:string,x:string,d:string,s:string>>"
)


def _fields(spec: str) -> list[T.StructField]:
    fields = []
    for item in spec.split():
        name, _, ddl = item.partition(":")
        fields.append(T.StructField(name, T.DataType.fromDDL(ddl or "string")))
    return fields


def table_schema(name: str) -> T.StructType:
    required, optional = CONTRACTS[name]
    return T.StructType(_fields(required) + _fields(optional))


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project a table to its contract.

    Missing optional columns become NULL; a missing required column is an error
    rather than a column of NULLs.
    """
    missing = [f.name for f in _fields(CONTRACTS[name][0]) if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing required columns {missing}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(name).fields
        ]
    )


def read_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a table under its contract; unused columns are pruned from the scan."""
    return conform(configure(spark).read.parquet(path), name)


def scan_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table by name: ``{base}/{name}.parquet``."""
    return read_parquet(spark, f"{base}/{name}.parquet", name)


def scan_comments_partitioned(
    spark: SparkSession, base: str, agency_code: str | None = None
) -> DataFrame:
    """The per-agency comments mirror; the agency comes from the directory name.

    Partition type inference is off, so agency codes stay strings and a filter on
    the agency prunes directories.
    """
    comments = read_parquet(spark, f"{base}/comments/agency", "comments")
    if agency_code is not None:
        comments = comments.where(F.col("agency_code") == agency_code)
    return comments


def scan_external_source(spark: SparkSession, base: str, table: str) -> DataFrame:
    """An external source table; every column is a string."""
    return spark.read.parquet(f"{base}/{table}.parquet")


def scan_sources(spark: SparkSession, base: str, tables: list[str]) -> dict[str, DataFrame]:
    """Every readable source; one that is missing is left out, not fatal."""
    found = {}
    for table in tables:
        try:
            found[table] = scan_external_source(spark, base, table)
        except AnalysisException:
            continue
    return found


def scan_search_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Gzip-JSON payload(s) of dockets as rows; a missing abstract is empty."""
    payload = spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).json(path)
    return payload_to_corpus(payload)


def payload_to_corpus(payload: DataFrame) -> DataFrame:
    doc = payload.select(F.explode("docs").alias("doc"))
    return doc.select(
        F.col("doc.id").alias("docket_id"),
        F.col("doc.a").alias("agency_code"),
        F.col("doc.t").alias("title"),
        F.col("doc.x").alias("docket_type"),
        F.col("doc.d").alias("modify_date"),
        F.coalesce("doc.s", F.lit("")).alias("abstract"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Give every core rows of a table read in fewer splits than there are cores.

    One file with one row group is one task, however heavy the text work on its
    rows. Larger tables are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def to_silver(df: DataFrame) -> DataFrame:
    """Unquote string columns once, so keys compare equal everywhere downstream."""
    return df.select(
        *[unquote(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    )
