"""Builders of the rollup tables that the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketscope.functions.dates import AsOf, as_instant, to_day, to_instant
from docketscope.functions.fields import json_strings, unquote

PROPOSED, FINAL = "Proposed Rule", "Rule"


def build_comments_index(comments: DataFrame) -> DataFrame:
    """Comments per agency, docket and month of posting; undated ones have a NULL month."""
    day = to_day(F.col("posted_date"))
    keys = [
        F.col("agency_code"),
        F.col("docket_id"),
        F.year(day).cast("long").alias("year"),
        F.month(day).cast("long").alias("month"),
    ]
    return comments.groupBy(*keys).agg(F.count("*").alias("row_count"))


def build_feed_summary(dockets: DataFrame, index: DataFrame, documents: DataFrame) -> DataFrame:
    """Dockets with their comment count and the comment end of their proposed rules.

    Both sides are one row per docket before they are joined.
    """
    counts = index.groupBy("docket_id").agg(F.sum("row_count").alias("comment_count"))
    ends = (
        documents.where((F.col("document_type") == PROPOSED) & (F.col("comment_end_date") != ""))
        .groupBy("docket_id")
        .agg(F.max("comment_end_date").alias("comment_end_date"))
    )
    joined = dockets.join(counts, "docket_id", "left").join(ends, "docket_id", "left")
    return joined.select(
        "docket_id", "agency_code", "title", "abstract", "docket_type", "modify_date",
        "date_created",
        F.coalesce("comment_count", F.lit(0)).alias("comment_count"),
        "comment_end_date",
    )


def build_agency_stats(dockets: DataFrame, documents: DataFrame, index: DataFrame) -> DataFrame:
    """Docket, document and comment counts per agency, 0 where a side has none.

    Each side is counted first; the union of the three small results is summed.
    """
    zero = F.lit(0).cast("long")

    def part(df: DataFrame, measure, name: str) -> DataFrame:
        names = ["docket_count", "document_count", "comment_count"]
        counted = df.where(F.col("agency_code").isNotNull()).groupBy("agency_code").agg(measure.alias(name))
        return counted.select("agency_code", *[F.col(n) if n == name else zero.alias(n) for n in names])

    rows = (
        part(dockets, F.count("*"), "docket_count")
        .unionByName(part(documents, F.count("*"), "document_count"))
        .unionByName(part(index, F.sum("row_count"), "comment_count"))
    )
    names = ["docket_count", "document_count", "comment_count"]
    return rows.groupBy("agency_code").agg(*[F.sum(n).alias(n) for n in names])


def build_agency_monthly_volume(documents: DataFrame) -> DataFrame:
    day = to_day(F.col("posted_date"))
    dated = documents.where(day.isNotNull())
    keys = [
        F.col("agency_code"),
        F.year(day).cast("long").alias("year"),
        F.month(day).cast("long").alias("month"),
        F.col("document_type"),
    ]
    return dated.groupBy(*keys).agg(F.count("*").alias("document_count"))


def build_rulemaking_lifecycles(documents: DataFrame, dockets: DataFrame) -> DataFrame:
    """Per docket: first proposal and the first rule on or after it, or no rule at all.

    A docket whose rules all precede the proposal is neither. Documents are read
    once and reduced to distinct (docket, type, day) rows, so the window per
    docket meets at most two rows per calendar day however many documents it has.
    """
    day = to_day(F.col("posted_date"))
    kinds = F.col("document_type")
    dated = (
        documents.where(kinds.isin(PROPOSED, FINAL) & F.col("docket_id").isNotNull())
        .select("docket_id", "document_type", day.alias("day"))
        .where(F.col("day").isNotNull())
        .distinct()
    )
    first = F.min(F.when(kinds == PROPOSED, F.col("day"))).over(Window.partitionBy("docket_id"))
    proposed = dated.withColumn("proposed_date", first).where(F.col("proposed_date").isNotNull())
    later = (kinds == FINAL) & (F.col("day") >= F.col("proposed_date"))
    outcome = proposed.groupBy("docket_id", "proposed_date").agg(
        F.min(F.when(later, F.col("day"))).alias("final_date"),
        F.count_if(kinds == FINAL).alias("finals"),
    )
    kind = F.when(F.col("final_date").isNotNull(), "pair").when(F.col("finals") == 0, "stuck")
    named = outcome.withColumn("kind", kind).where(F.col("kind").isNotNull())
    joined = named.join(dockets.select("docket_id", "agency_code", "title"), "docket_id")
    return joined.select(
        "kind", "docket_id", "agency_code", "title", "proposed_date", "final_date",
        F.datediff("final_date", "proposed_date").alias("days"),
    )


def build_discovery_spike(
    documents: DataFrame, as_of: AsOf = None, min_prior: int = 24, min_ratio: float = 2.0
) -> DataFrame:
    """Agencies whose last 30 days are at least twice their prior-year monthly mean."""
    posted, now = to_instant(F.col("posted_date")), as_instant(as_of)
    months_ago = lambda m: now - F.make_ym_interval(months=F.lit(m))
    recent = posted >= now - F.make_dt_interval(days=F.lit(30))
    prior = (posted >= months_ago(13)) & (posted < months_ago(1))
    rows = documents.where((posted >= months_ago(13)) & F.col("agency_code").isNotNull())
    counted = rows.groupBy("agency_code").agg(
        F.count_if(recent).alias("recent_30d"), F.count_if(prior).alias("prior")
    )
    baseline = F.col("prior") / F.lit(12.0)
    rated = counted.where(F.col("prior") >= min_prior).select(
        "agency_code", "recent_30d", baseline.alias("baseline"), (F.col("recent_30d") / baseline).alias("ratio")
    )
    return rated.where(F.col("ratio") >= min_ratio)


def build_fr_docket_links(register: DataFrame) -> DataFrame:
    """One row per (notice, docket id) with the notice's columns."""
    exploded = register.withColumn("docket_id", F.explode(F.array_distinct(json_strings(F.col("docket_ids_json")))))
    linked = exploded.withColumn("docket_id", unquote(F.col("docket_id")))
    return linked.where(F.col("docket_id") != "")


def write_fr_docket_links(links: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """Link table sorted by docket, so that a docket filter prunes files and row groups."""
    (
        links.repartitionByRange("docket_id", "document_number")
        .sortWithinPartitions("docket_id", "document_number")
        .write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )


def publish_rollups(
    base: str, dockets: DataFrame, documents: DataFrame, comments: DataFrame, register: DataFrame, as_of: AsOf = None
) -> dict[str, str]:
    """Write the seven rollups under ``base``; name -> path.

    The comments index is written first, and the rollups that need it read it back,
    so comments are scanned once.
    """
    spark = dockets.sparkSession
    paths = {
        name: f"{base}/{name}.parquet"
        for name in (
            "comments_index", "feed_summary", "agency_stats", "agency_monthly_volume", "rulemaking_lifecycles",
            "discovery_signals", "fr_docket_links",
        )
    }

    def put(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(paths[name])

    put("comments_index", build_comments_index(comments))
    index = spark.read.parquet(paths["comments_index"])
    put("feed_summary", build_feed_summary(dockets, index, documents))
    put("agency_stats", build_agency_stats(dockets, documents, index))
    put("agency_monthly_volume", build_agency_monthly_volume(documents))
    put("rulemaking_lifecycles", build_rulemaking_lifecycles(documents, dockets))
    put("discovery_signals", build_discovery_spike(documents, as_of))
    write_fr_docket_links(build_fr_docket_links(register), paths["fr_docket_links"])
    return paths
