"""Agency counts, monthly volume, activity and the directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketscope.functions.dates import AsOf, as_day, era_of, iso_day, to_day
from docketscope.functions.fields import unquote
from docketscope.operators.lookups import top_per_group
from docketscope.sources.dims import UNGROUPED_DEPARTMENT


def agency_stats(stats: DataFrame, codes: DataFrame) -> DataFrame:
    """Docket, document and comment counts of the requested agencies; absent ones are 0."""
    wanted = codes.select(F.upper("agency_code").alias("agency_code")).distinct()
    counts = ["docket_count", "document_count", "comment_count"]
    joined = wanted.join(stats, "agency_code", "left")
    return joined.select("agency_code", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def all_agency_counts(stats: DataFrame) -> DataFrame:
    """Docket and comment counts per agency; blank codes are skipped."""
    code = unquote(F.col("agency_code"))
    return stats.where(code != "").select(
        code.alias("agency_code"),
        F.col("docket_count").alias("dockets"),
        F.col("comment_count").alias("comments"),
    )


def popular_agencies(stats: DataFrame, limit: int = 4) -> DataFrame:
    rows = stats.select(unquote(F.col("agency_code")).alias("agency_code"), "docket_count")
    return rows.orderBy(F.desc_nulls_last("docket_count"), F.asc("agency_code")).limit(limit)


def rollup_month() -> Column:
    """First day of a monthly-volume row."""
    return F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1))


def doc_counts_by_agency_month(
    volume: DataFrame,
    document_types: list[str],
    since: str = "2014-01-01",
    agency_codes: list[str] | None = None,
) -> DataFrame:
    rows = volume.where(
        F.col("document_type").isin(document_types) & (rollup_month() >= F.lit(since).cast("date"))
    )
    if agency_codes:
        rows = rows.where(F.col("agency_code").isin([c.upper() for c in agency_codes]))
    grouped = rows.groupBy("agency_code", "document_type", iso_day(rollup_month()).alias("month"))
    counted = grouped.agg(F.sum("document_count").alias("n"))
    return counted.orderBy(*[F.asc_nulls_last(c) for c in ("agency_code", "document_type", "month")])


def _first_month(as_of: AsOf, months: int) -> Column:
    return F.add_months(F.trunc(as_day(as_of), "month"), 1 - months)


def agency_monthly_volume_batch(
    volume: DataFrame, codes: DataFrame, months: int = 12, as_of: AsOf = None
) -> DataFrame:
    """Sparse last-N-months series; an agency without documents keeps one NULL-month row."""
    wanted = codes.select(F.upper("agency_code").alias("agency_code")).distinct()
    recent = volume.where(rollup_month() >= _first_month(as_of, months))
    series = recent.groupBy(
        F.upper(unquote(F.col("agency_code"))).alias("agency_code"),
        F.date_format(rollup_month(), "yyyy-MM").alias("month"),
    ).agg(F.sum("document_count").alias("n"))
    return wanted.join(series, "agency_code", "left")


def volume_densify(
    volume: DataFrame, codes: DataFrame, months: int = 12, as_of: AsOf = None
) -> DataFrame:
    """One row per agency and month of the last N months, 0 where there is no data."""
    calendar = F.sequence(
        _first_month(as_of, months), F.trunc(as_day(as_of), "month"), F.expr("interval 1 month")
    )
    grid = (
        codes.select(F.upper("agency_code").alias("agency_code"))
        .distinct()
        .select("agency_code", F.explode(calendar).alias("m"))
        .select("agency_code", F.date_format("m", "yyyy-MM").alias("month"))
    )
    series = agency_monthly_volume_batch(volume, codes, months, as_of)
    joined = grid.join(series, ["agency_code", "month"], "left")
    return joined.select("agency_code", "month", F.coalesce("n", F.lit(0)).alias("n"))


def parent_department(agencies: DataFrame, departments: DataFrame) -> DataFrame:
    """Adds department and its display order; unmapped agencies come last."""
    placed = agencies.join(departments, "agency_code", "left")
    last = F.lit(2**31 - 1)
    return placed.withColumns(
        {
            "department": F.coalesce("department", F.lit(UNGROUPED_DEPARTMENT)),
            "department_order": F.coalesce("department_order", last),
        }
    )


def agency_directory(
    agencies: DataFrame,
    departments: DataFrame,
    stats: DataFrame,
    dense_volume: DataFrame,
    sort_by: str = "active",
    query: str = "",
) -> DataFrame:
    """Departments in order, their agencies sorted, counts and a 12-month series."""
    text = query.strip().lower()
    rows = parent_department(agencies, departments)
    if text:
        rows = rows.where(
            F.contains(F.lower("agency_code"), F.lit(text)) | F.contains(F.lower("name"), F.lit(text))
        )
    counts = all_agency_counts(stats)
    point = F.struct("month", "n")
    # at most N months per agency
    series = dense_volume.groupBy("agency_code").agg(
        F.transform(F.sort_array(F.collect_list(point)), lambda p: p["n"]).alias("monthly")
    )
    joined = rows.join(counts, "agency_code", "left").join(series, "agency_code", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dockets", "comments")})
    keys = {
        "az": F.asc_nulls_last("name"),
        "comments": F.desc("comments"),
        "active": F.desc("dockets"),
    }
    return filled.orderBy("department_order", keys[sort_by], "name", "agency_code").select(
        "department", "agency_code", "name", "dockets", "comments", "monthly"
    )


def related_agencies(
    agencies: DataFrame, departments: DataFrame, curated: DataFrame, limit: int = 6
) -> DataFrame:
    """Curated peers of each agency, else its department siblings by name."""
    placed = parent_department(agencies, departments)
    known = agencies.select(F.col("agency_code").alias("peer_code"), F.col("name").alias("peer_name"))
    picked = curated.select("agency_code", "peer_code", F.col("position").cast("long").alias("position"))
    # the first limit + 1 names of a department are all its members can be shown
    first_names = top_per_group(placed, ["department"], [F.asc_nulls_last("name"), F.asc("agency_code")], limit + 1)
    siblings = placed.join(curated.select("agency_code"), "agency_code", "left_anti").join(
        first_names.select(F.col("agency_code").alias("peer_code"), "department"), "department"
    )
    by_name = siblings.select("agency_code", "peer_code", F.lit(0).cast("long").alias("position"))
    peers = picked.unionByName(by_name).join(known, "peer_code")
    peers = peers.where(F.col("peer_code") != F.col("agency_code"))
    order = [F.asc("position"), F.asc_nulls_last("peer_name"), F.asc("peer_code")]
    rank = F.row_number().over(Window.partitionBy("agency_code").orderBy(*order))
    ranked = peers.withColumn("rank", rank).where(F.col("rank") <= limit)
    return ranked.select("agency_code", F.col("rank").cast("long").alias("rank"), "peer_code", "peer_name")


def ten_years_back(as_of: AsOf) -> Column:
    """First day of the month ten years ago."""
    return F.add_months(F.trunc(as_day(as_of), "month"), -120)


def top_rule_agencies(documents: DataFrame, limit: int = 20, as_of: AsOf = None) -> DataFrame:
    """Agencies with most final rules in the last ten years."""
    rules = documents.where(
        (F.col("document_type") == "Rule")
        & (to_day(F.col("posted_date")) >= ten_years_back(as_of))
        & F.col("agency_code").isNotNull()
    )
    counted = rules.groupBy("agency_code").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc("agency_code")).limit(limit)


def midnight_ratio(
    volume: DataFrame,
    pool: DataFrame,
    tail: tuple[str, str] = ("2024-11-21", "2025-01-20"),
    baseline: tuple[str, str] = ("2023-11-01", "2024-10-31"),
    document_type: str = "Rule",
    since: str | None = None,
    limit: int | None = 6,
) -> DataFrame:
    """Rules in the last two months of a term against twice the mean baseline month.

    Months count when their first day lies in the period; only months with data
    enter the mean. Agencies without rules in the tail rank below all others.
    """
    day = F.col("m")
    monthly = volume.where(F.col("document_type") == document_type)
    if since:
        monthly = monthly.where(rollup_month() >= F.lit(since).cast("date"))
    monthly = monthly.groupBy("agency_code", rollup_month().alias("m")).agg(
        F.sum("document_count").alias("n")
    )

    def within(period: tuple[str, str]) -> Column:
        return day.between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date"))

    per_agency = monthly.groupBy("agency_code").agg(
        F.coalesce(F.sum(F.when(within(tail), F.col("n"))), F.lit(0)).alias("midnight_count"),
        F.coalesce(F.avg(F.when(within(baseline), F.col("n"))) * 2, F.lit(0.0)).alias("baseline_rate"),
    )
    joined = pool.select("agency_code").join(per_agency, "agency_code", "left")
    count = F.coalesce("midnight_count", F.lit(0))
    rate = F.coalesce("baseline_rate", F.lit(0.0))
    ratio = F.when(rate > 0, count / F.nullif(rate, F.lit(0.0))).otherwise(0.0)
    rows = joined.select(
        "agency_code",
        count.alias("midnight_count"),
        rate.alias("baseline_rate"),
        ratio.alias("ratio"),
        F.when(count > 0, ratio).otherwise(-1.0).alias("rank_ratio"),
    )
    ordered = rows.orderBy(F.desc("rank_ratio"), F.asc("agency_code"))
    return ordered if limit is None else ordered.limit(limit)


def midnight_finding(ranked: DataFrame) -> DataFrame:
    """The top agency of the pool, when it has rules in the tail and a baseline."""
    top = ranked.orderBy(F.desc("rank_ratio"), F.asc("agency_code")).limit(1)
    return top.where((F.col("midnight_count") > 0) & (F.col("baseline_rate") > 0))


def era_tag(monthly: DataFrame, month: str = "month") -> DataFrame:
    """Adds the administration (president, party) each month falls in."""
    day = to_day(F.col(month))
    return monthly.withColumns({"president": era_of(day), "party": era_of(day, "party")})


def top_rulemaking_agencies(
    documents: DataFrame, limit: int = 8, since: str = "2010-01-01"
) -> DataFrame:
    """Agencies by (proposed, final) document pairs that share a docket.

    Pairs are counted, never formed: per docket they are proposals times finals,
    so a docket with many documents on both sides stays two numbers.
    """
    kind = F.col("document_type")
    proposals = documents.where(
        (kind == "Proposed Rule")
        & F.col("agency_code").isNotNull()
        & (to_day(F.col("posted_date")) >= F.lit(since).cast("date"))
    )
    per_agency = proposals.groupBy("docket_id", "agency_code").agg(F.count("*").alias("proposals"))
    finals = documents.where(kind == "Rule").groupBy("docket_id").agg(F.count("*").alias("finals"))
    counted = (
        per_agency.join(finals, "docket_id")
        .groupBy("agency_code")
        .agg(
            F.sum(F.col("proposals") * F.col("finals")).alias("n"),
            F.count("*").alias("dockets"),
        )
    )
    return counted.orderBy(F.desc("n"), F.asc("agency_code")).limit(limit)
