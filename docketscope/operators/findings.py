"""Findings over a docket's comments: volume burst, stance split, template coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketscope.functions.dates import AsOf, as_day, iso_day, to_day
from docketscope.functions.stance import STANCES
from docketscope.operators.clusters import percent

# Thresholds of the findings.
BURST_SHARE_PCT = 80.0
BURST_WINDOW_DAYS = 2
BURST_MIN_PERIOD_MULTIPLE = 2
DOMINANT_TEMPLATE_PCT = 50.0
LOPSIDED_PCT = 80.0
SPLIT_MIN_PCT = 25.0
COVERAGE_TOP = 6


def volume_burst(
    daily: DataFrame,
    totals: DataFrame,
    periods: DataFrame,
    as_of: AsOf = None,
    share_threshold: float = BURST_SHARE_PCT,
    window_days: int = BURST_WINDOW_DAYS,
) -> DataFrame:
    """Dockets whose fullest run of days holds an outsized share of all comments.

    ``daily`` is (docket_id, day, n), already one row per docket and day, so the
    moving window meets at most one row per calendar day. The share is of all
    comments (``totals``), dated or not; the earliest fullest window wins.
    ``periods`` is (docket_id, period_start, period_end); a period shorter than
    twice the window is never a finding.
    """
    dated = daily.where(F.col("n") > 0).withColumn("d", to_day(F.col("day")))
    frame = (
        Window.partitionBy("docket_id")
        .orderBy(F.unix_date("d"))
        .rangeBetween(0, window_days - 1)
    )
    windows = dated.select(
        "docket_id", "d", F.sum("n").over(frame).alias("count"), F.max("d").over(frame).alias("last")
    )
    best = F.max_by(F.struct("count", "d", "last"), F.struct("count", -F.unix_date("d")))
    peaks = windows.groupBy("docket_id").agg(best.alias("b")).select("docket_id", "b.*")
    joined = peaks.join(totals.select("docket_id", "total"), "docket_id").join(
        periods.select("docket_id", "period_start", "period_end"), "docket_id", "left"
    )
    start, end = to_day(F.col("period_start")), to_day(F.col("period_end"))
    length = F.abs(F.datediff(end, start)) + 1
    left = F.datediff(end, as_day(as_of))
    share = percent(F.col("count"), F.col("total"))
    found = joined.where(
        (share >= share_threshold)
        & F.coalesce(length >= window_days * BURST_MIN_PERIOD_MULTIPLE, F.lit(True))
    )
    is_open = F.coalesce(left >= 0, F.lit(False))
    return found.select(
        "docket_id",
        share.alias("pct"),
        "count",
        "total",
        F.lit(window_days).cast("long").alias("window_days"),
        iso_day(F.col("d")).alias("start_day"),
        iso_day(F.col("last")).alias("end_day"),
        length.cast("long").alias("period_days"),
        F.col("period_end").alias("period_end_day"),
        is_open.alias("period_open"),
        F.when(is_open, left).cast("long").alias("days_remaining"),
    )


def stance_totals(scored: DataFrame, weight: str = "total_n") -> DataFrame:
    """Comment-weighted stance totals per docket: always all four labels.

    ``scored`` has (docket_id, stance, weight).
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col("stance") == s, F.col(weight))), F.lit(0)).alias(s)
        for s in STANCES
    ]
    return scored.groupBy("docket_id").agg(*sums, F.sum(weight).alias("covered"))


def stance_coverage(totals: DataFrame, comment_totals: DataFrame) -> DataFrame:
    """Adds the share of all comments that the scored templates cover."""
    joined = totals.join(comment_totals.select("docket_id", "total"), "docket_id")
    return joined.withColumn("coverage_pct", percent(F.col("covered"), F.col("total")))


def dominant_stance(counts: dict[str, Column]) -> Column:
    """Largest of the four; ties go support > oppose > mixed > unclear."""
    best = F.greatest(*counts.values())
    chain = [F.when(counts[s] == best, s) for s in STANCES]
    return F.coalesce(*chain)


def stance_finding(scored: DataFrame, rank_by: str = "family_id") -> DataFrame:
    """The one notable fact of each docket's stance split, if there is any.

    ``scored`` has (docket_id, family_id, stance, total_n). Priority: flip,
    concentrated, lopsided, split.
    """
    top = F.min_by(F.struct("stance", "total_n"), F.struct(-F.col("total_n"), F.col(rank_by)))
    facts = stance_totals(scored).join(
        scored.groupBy("docket_id").agg(F.count("*").alias("templates"), top.alias("top")), "docket_id"
    )
    counts = {s: F.col(s) for s in STANCES}
    covered = F.col("covered")
    plurality = dominant_stance(counts)
    top_n = F.col("top.total_n")
    # what remains without the largest template
    rest = {s: F.col(s) - F.when(F.col("top.stance") == s, top_n).otherwise(0) for s in STANCES}
    rest_n = covered - top_n
    rest_stance = dominant_stance(rest)
    best_of = lambda c: F.greatest(*c.values())
    facts = facts.select(
        "docket_id",
        "covered",
        "templates",
        plurality.alias("plurality"),
        percent(best_of(counts), covered).alias("plurality_pct"),
        percent(top_n, covered).alias("top_pct"),
        top_n.alias("top_count"),
        F.col("top.stance").alias("top_stance"),
        F.when(rest_n > 0, rest_stance).alias("rest_stance"),
        percent(best_of(rest), rest_n).alias("rest_pct"),
        rest_n.alias("rest_n"),
        percent(F.col("support"), covered).alias("support_share"),
        percent(F.col("oppose"), covered).alias("oppose_share"),
    )
    sides = ("support", "oppose")
    directional = F.col("plurality").isin(*sides)
    carried = (
        directional
        & (F.col("top_stance") == F.col("plurality"))
        & (F.col("top_pct") >= DOMINANT_TEMPLATE_PCT)
        & (F.col("templates") > 1)
    )
    reversed_rest = F.coalesce(
        F.col("rest_stance").isin(*sides) & (F.col("rest_stance") != F.col("plurality")), F.lit(False)
    )
    divided = (F.col("support_share") >= SPLIT_MIN_PCT) & (F.col("oppose_share") >= SPLIT_MIN_PCT)
    kind = (
        F.when(carried & reversed_rest, "flip")
        .when(carried, "concentrated")
        .when(directional & (F.col("plurality_pct") >= LOPSIDED_PCT), "lopsided")
        .when(divided, "split")
    )
    found = facts.where(F.col("covered") > 0).withColumn("kind", kind).where(F.col("kind").isNotNull())
    is_kind = lambda *ks: F.col("kind").isin(*ks)
    return found.select(
        "docket_id",
        "kind",
        F.when(~is_kind("split"), F.col("plurality")).alias("stance"),
        F.when(is_kind("split"), F.greatest("support_share", "oppose_share"))
        .otherwise(F.col("plurality_pct")).alias("pct"),
        F.when(~is_kind("split"), F.col("templates")).alias("template_count"),
        F.when(is_kind("flip", "concentrated"), F.col("top_pct")).alias("top_pct"),
        F.when(is_kind("flip", "concentrated"), F.col("top_count")).alias("top_count"),
        F.when(is_kind("flip"), F.col("rest_stance")).alias("remainder_stance"),
        F.when(is_kind("flip"), F.col("rest_pct")).alias("remainder_pct"),
        F.when(is_kind("flip"), F.col("rest_n")).alias("remainder_count"),
        F.when(is_kind("split"), F.col("support_share")).alias("support_pct"),
        F.when(is_kind("split"), F.col("oppose_share")).alias("oppose_pct"),
    )


def template_coverage(families: DataFrame, totals: DataFrame, cap: int = COVERAGE_TOP) -> DataFrame:
    """Segments of a docket: its top families, the other families, the unique rest.

    The top ``cap`` comes from a ranked limit and the tail is what the docket's
    families hold beyond it, so no full ranking of a docket is needed.
    """
    order = [F.desc("total_n"), F.asc("family_id")]
    rank = F.row_number().over(Window.partitionBy("docket_id").orderBy(*order))
    top = families.withColumn("rank", rank).where(F.col("rank") <= cap)
    per_docket = families.groupBy("docket_id").agg(F.sum("total_n").alias("families_n"))
    shown = top.groupBy("docket_id").agg(F.sum("total_n").alias("shown_n"))
    sums = (
        totals.select("docket_id", "total")
        .join(per_docket, "docket_id", "left")
        .join(shown, "docket_id", "left")
        .select(
            "docket_id",
            "total",
            F.coalesce("families_n", F.lit(0)).alias("families_n"),
            F.coalesce("shown_n", F.lit(0)).alias("shown_n"),
        )
    )
    segment = lambda name, place, n: F.struct(
        F.lit(name).alias("segment"), F.lit(place).cast("long").alias("place"), n.alias("n")
    )
    rest = F.array(
        segment("other", cap + 1, F.col("families_n") - F.col("shown_n")),
        segment("unique", cap + 2, F.greatest(F.lit(0), F.col("total") - F.col("families_n"))),
    )
    tail = sums.select("docket_id", F.inline(rest))
    head = top.select(
        "docket_id", F.col("family_id").alias("segment"), F.col("rank").cast("long").alias("place"),
        F.col("total_n").alias("n"),
    )
    rows = head.unionByName(tail).where(F.col("n") > 0).join(totals.select("docket_id", "total"), "docket_id")
    return rows.where(F.col("total") > 0).select(
        "docket_id", "segment", "place", "n", percent(F.col("n"), F.col("total")).alias("pct")
    )
