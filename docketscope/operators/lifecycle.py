"""Rulemaking durations: percentiles, samples, stuck proposals, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketscope.functions.dates import AsOf, as_day, days_until, iso_day
from docketscope.functions.fields import unquote
from docketscope.operators.lookups import top_per_group

PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def id_hash(c: Column) -> Column:
    """A hash any engine can reproduce: the first 32 bits of the md5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def _percentiles(days: Column) -> list[Column]:
    # exact and mergeable: the state is one counter per distinct day count
    return [F.percentile(days, F.lit(q)).alias(name) for name, q in PERCENTILES.items()]


def _pairs(lifecycles: DataFrame, agencies: list[str] | None) -> DataFrame:
    pairs = lifecycles.where(F.col("kind") == "pair")
    if agencies is not None:
        pairs = pairs.where(F.col("agency_code").isin([a.upper() for a in agencies]))
    return pairs


def lifecycle_summary(lifecycles: DataFrame, agencies: list[str] | None = None) -> DataFrame:
    days = F.col("days")
    summary = _pairs(lifecycles, agencies).groupBy("agency_code").agg(
        F.count("*").alias("n"),
        *_percentiles(days),
        F.min(days).alias("min"),
        F.max(days).alias("max"),
    )
    return summary.orderBy(F.desc("n"), F.asc_nulls_last("agency_code"))


def lifecycle_benchmark(lifecycles: DataFrame) -> DataFrame:
    """The same percentiles pooled over all agencies.

    Counts per (agency, days) first: the pooled aggregate then reads a small
    table, with each day count weighted by its frequency.
    """
    pairs = _pairs(lifecycles, None).where(F.col("agency_code").isNotNull())
    counted = pairs.groupBy("agency_code", "days").agg(F.count("*").alias("weight"))
    weighted = [
        F.percentile(F.col("days"), F.lit(q), F.col("weight")).alias(name)
        for name, q in PERCENTILES.items()
    ]
    return counted.agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("n"),
        F.countDistinct("agency_code").alias("agency_count"),
        *weighted,
    )


def lifecycle_comparison(summary: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each agency's median against the pooled median, in words."""
    pooled = benchmark.select(F.col("p50")).scalar()
    framed = summary.select("agency_code", "p50", F.lit(pooled).alias("bench"))
    ratio = F.col("p50") / F.nullif(F.col("bench"), F.lit(0.0))
    whole = lambda c: F.round(c).cast("long").cast("string")
    median = F.concat(F.lit("the all-agency median of "), whole(F.col("bench")), F.lit(" days"))
    text = (
        F.when(ratio.isNull(), "")
        .when(F.abs(ratio - 1) < 0.05, F.concat(F.lit("roughly in line with "), median))
        .when(ratio < 1, F.concat(F.lit("about "), whole((1 - ratio) * 100), F.lit("% faster than "), median))
        .when(ratio < 2, F.concat(F.lit("about "), whole((ratio - 1) * 100), F.lit("% slower than "), median))
        .otherwise(F.concat(F.lit("about "), F.format_string("%.1f", F.round(ratio, 1)), F.lit("× "), median))
    )
    return framed.select("agency_code", "p50", F.col("bench").alias("bench_p50"), text.alias("comparison"))


def lifecycle_extremes(summary: DataFrame) -> DataFrame:
    """Agencies with the smallest and the largest median; ties go to the larger agency."""
    order = F.struct(-F.col("n"), F.col("agency_code"))
    fastest = F.min_by(F.struct("agency_code", "p50"), F.struct(F.col("p50"), order))
    slowest = F.min_by(F.struct("agency_code", "p50"), F.struct(-F.col("p50"), order))
    both = summary.agg(fastest.alias("f"), slowest.alias("s"))
    return both.select(
        F.col("f.agency_code").alias("fastest"),
        F.col("f.p50").alias("fastest_p50"),
        F.col("s.agency_code").alias("slowest"),
        F.col("s.p50").alias("slowest_p50"),
    )


def lifecycle_sample(
    lifecycles: DataFrame, agencies: list[str] | None = None, sample_per_agency: int = 80
) -> DataFrame:
    """Fastest third, slowest third and a hash bucket of each agency's pairs.

    Three bounded selections instead of two full rankings: each ``row_number``
    limit is cut to a few rows per agency before its shuffle.
    """
    pairs = _pairs(lifecycles, agencies).select(
        "docket_id", "agency_code", "title", "proposed_date", "final_date", "days"
    )
    third = sample_per_agency / 3
    low = top_per_group(pairs, ["agency_code"], [F.asc("days"), F.asc("docket_id")], int(third))
    high = top_per_group(pairs, ["agency_code"], [F.desc("days"), F.asc("docket_id")], int(third))
    bucket = pairs.where(F.pmod(id_hash(F.col("docket_id")), F.lit(100)) < third)
    rows = low.unionByName(high).unionByName(bucket).dropDuplicates(["docket_id", "agency_code"])
    return rows.withColumns(
        {
            "proposed_date": iso_day(F.col("proposed_date")),
            "final_date": iso_day(F.col("final_date")),
            "title": unquote(F.col("title")),
        }
    )


def lifecycle_stuck(
    lifecycles: DataFrame,
    agencies: list[str] | None = None,
    limit: int = 20,
    as_of: AsOf = None,
) -> DataFrame:
    """Proposals 18 months to 8 years old without a rule, spread over three age tiers."""
    today, proposed = as_day(as_of), F.col("proposed_date")
    rows = lifecycles.where(
        (F.col("kind") == "stuck")
        & (proposed <= F.add_months(today, -18))
        & (proposed >= F.add_months(today, -96))
    )
    if agencies is not None:
        rows = rows.where(F.col("agency_code").isin([a.upper() for a in agencies]))
    tier = (
        F.when(proposed >= F.add_months(today, -36), "recent")
        .when(proposed >= F.add_months(today, -60), "mid")
        .otherwise("old")
    )
    aged = rows.select(
        "docket_id",
        "agency_code",
        unquote(F.col("title")).alias("title"),
        iso_day(proposed).alias("proposed_date"),
        F.datediff(today, proposed).cast("long").alias("days_open"),
        tier.alias("tier"),
    )
    order = [id_hash(F.col("docket_id")), F.asc("docket_id")]
    picked = top_per_group(aged, ["tier"], order, max(2, limit // 3))
    return picked.orderBy(F.desc("days_open"), F.asc("docket_id"))


def comment_period(documents: DataFrame) -> DataFrame:
    """Earliest comment start and latest comment end per docket; blanks are ignored."""
    start = F.nullif(unquote(F.col("comment_start_date")), F.lit(""))
    end = F.nullif(unquote(F.col("comment_end_date")), F.lit(""))
    grouped = documents.where(F.col("docket_id").isNotNull()).groupBy("docket_id")
    return grouped.agg(F.min(start).alias("period_start"), F.max(end).alias("period_end"))


def lifecycle_stage(documents: DataFrame, windows: DataFrame, as_of: AsOf = None) -> DataFrame:
    """State of the proposed / comment / final stages per docket.

    ``windows`` has (docket_id, comment_end_date) and decides which dockets appear.
    """
    kind = unquote(F.col("document_type"))
    posted = F.nullif(unquote(F.col("posted_date")), F.lit(""))
    final = kind.rlike("(?i)^rule$") | kind.rlike("(?i)final rule")
    facts = documents.groupBy("docket_id").agg(
        F.bool_or(F.coalesce(final, F.lit(False))).alias("has_final"),
        F.min(F.when(kind.rlike("(?i)proposed rule"), posted)).alias("first_proposed"),
        F.min(posted).alias("first_any"),
        F.min(F.when(final, posted)).alias("final_date"),
    )
    joined = windows.select("docket_id", "comment_end_date").join(facts, "docket_id", "left")
    days = days_until(F.col("comment_end_date"), as_of)
    has_final = F.coalesce("has_final", F.lit(False))
    closed = F.coalesce(days < 0, F.lit(False))
    return joined.select(
        "docket_id",
        F.lit("done").alias("proposed_state"),
        F.coalesce("first_proposed", "first_any").alias("proposed_date"),
        F.when(days >= 0, "active").when(closed | has_final, "done").otherwise("pending").alias("comment_state"),
        F.when(has_final, "done").when(closed, "active").otherwise("pending").alias("final_state"),
        "final_date",
    )
