"""Docket feed: membership predicate, pages, counts and the merged river."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketscope.functions.dates import (
    DATE_RANGE_DAYS,
    AsOf,
    as_instant,
    to_instant,
    window_open,
)
from docketscope.functions.fields import blank_to_null, unquote
from docketscope.operators.lookups import top_per_group
from docketscope.sources.dims import TOPICS

FEED_COLUMNS = [
    "docket_id", "agency_code", "title", "abstract", "docket_type", "modify_date",
    "date_created", "comment_count", "comment_end_date",
]
AGENCY_DOCKET_COLUMNS = [
    "docket_id", "agency_code", "title", "abstract", "comment_count", "comment_end_date",
    "docket_type",
]


def topic_predicate(agencies: list[str], keywords: list[str]) -> Column:
    """An agency of the topic, or a keyword anywhere in title or abstract."""
    title, abstract = F.lower("title"), F.lower("abstract")
    tests = [F.col("agency_code").isin([a.upper() for a in agencies])]
    for word in keywords:
        tests += [F.contains(title, F.lit(word.lower())), F.contains(abstract, F.lit(word.lower()))]
    return reduce(lambda a, b: a | b, tests)


def type_predicate(docket_type: str) -> Column:
    kind = F.col("docket_type")
    if docket_type == "rule":
        return kind == "Rulemaking"
    if docket_type == "nonrule":
        return kind == "Nonrulemaking"
    if docket_type == "other":
        return ~kind.isin("Rulemaking", "Nonrulemaking") | kind.isNull()
    raise ValueError(f"unknown docket type: {docket_type}")


def feed_predicate(
    agency_code: str | None = None,
    sort_by: str = "recent",
    date_range: str | None = None,
    docket_type: str | None = None,
    topic: str | None = None,
    as_of: AsOf = None,
    topics: dict[str, dict[str, list[str]]] = TOPICS,
) -> Column:
    """Which feed rows belong; shared by list and count so that they agree."""
    tests = [F.lit(True)]
    if agency_code:
        tests.append(F.col("agency_code") == agency_code.upper())
    if docket_type:
        tests.append(type_predicate(docket_type))
    if topic:
        tests.append(topic_predicate(**topics[topic]))
    by_window = sort_by in ("open", "closed")
    if date_range:
        stamp = F.col("comment_end_date") if by_window else F.coalesce("date_created", "modify_date")
        age = F.make_dt_interval(days=F.lit(DATE_RANGE_DAYS[date_range]))
        tests.append(to_instant(stamp) >= as_instant(as_of) - age)
    if by_window:
        tests.append(window_open(F.col("comment_end_date"), as_of, sort_by == "open"))
    return reduce(lambda a, b: a & b, tests)


def feed_order(sort_by: str) -> list[Column]:
    orders = {
        "recent": [F.desc_nulls_last("modify_date")],
        "popular": [F.desc_nulls_last("comment_count"), F.desc_nulls_last("modify_date")],
        "open": [F.asc_nulls_last("comment_end_date")],
        "closed": [F.desc_nulls_last("comment_end_date")],
    }
    return [*orders[sort_by], F.asc("docket_id")]


def docket_feed(
    feed: DataFrame, limit: int = 20, offset: int = 0, sort_by: str = "recent", **filters
) -> DataFrame:
    rows = feed.where(feed_predicate(sort_by=sort_by, **filters)).select(*FEED_COLUMNS)
    return rows.orderBy(*feed_order(sort_by)).offset(offset).limit(limit)


def feed_count(feed: DataFrame, **filters) -> DataFrame:
    return feed.where(feed_predicate(**filters)).agg(F.count("*").alias("count"))


def docket_meta_fallback(feed: DataFrame, dockets: DataFrame) -> DataFrame:
    """Title, abstract and comment end per docket: the feed row, else the bare docket row."""
    fields = ["docket_id", "title", "abstract"]
    from_feed = feed.select(*fields, "comment_end_date")
    rest = dockets.select(*fields).join(feed.select("docket_id"), "docket_id", "left_anti")
    return from_feed.unionByName(rest.withColumn("comment_end_date", F.lit(None).cast("string")))


def open_rulemakings(
    feed: DataFrame, agency_code: str | None = None, limit: int | None = None, as_of: AsOf = None
) -> DataFrame:
    """Open comment windows, soonest first: one agency's, or every agency's; ``limit`` cuts each listing."""
    rows = feed.where(window_open(F.col("comment_end_date"), as_of)).select(*AGENCY_DOCKET_COLUMNS)
    order = [F.asc_nulls_last("comment_end_date"), F.asc("docket_id")]
    return _per_agency(rows, agency_code, order, limit)


def top_dockets_by_comments(
    feed: DataFrame, agency_code: str | None = None, limit: int = 10
) -> DataFrame:
    """Most-commented dockets of one agency, or of every agency."""
    order = [F.desc_nulls_last("comment_count"), F.asc("docket_id")]
    return _per_agency(feed.select(*AGENCY_DOCKET_COLUMNS), agency_code, order, limit)


def _per_agency(
    rows: DataFrame, agency_code: str | None, order: list[Column], limit: int | None
) -> DataFrame:
    if agency_code is None:
        return top_per_group(rows, ["agency_code"], order, limit)
    mine = rows.where(F.col("agency_code") == agency_code.upper()).orderBy(*order)
    return mine if limit is None else mine.limit(limit)


def feed_dedupe(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per key under an order (pages can repeat a row)."""
    return top_per_group(rows.withColumn("_key", unquote(F.col(key))), ["_key"], order, 1).drop("_key")


def feed_with_fr(
    dockets: DataFrame,
    register: DataFrame,
    docket_has_more: bool = True,
    register_has_more: bool = True,
) -> DataFrame:
    """Merge two loaded pages by date.

    A stream that still has more rows hides everything older than its own last
    loaded row, so that a later page never splices in above shown rows.
    """
    docket_date = F.coalesce(
        blank_to_null(unquote(F.col("modify_date"))), blank_to_null(unquote(F.col("date_created")))
    )
    # a row without a usable date sorts as the epoch
    stamp = lambda c: F.coalesce(to_instant(c), F.lit("1970-01-01").cast("timestamp"))
    kinds = [
        dockets.select(F.lit("docket").alias("kind"), F.col("docket_id").alias("id"), "title",
                       stamp(docket_date).alias("date")),
        register.select(F.lit("fr").alias("kind"), F.col("document_number").alias("id"), "title",
                        stamp(F.col("publication_date")).alias("date")),
    ]
    merged = kinds[0].unionByName(kinds[1])
    for page, has_more in zip(kinds, (docket_has_more, register_has_more), strict=True):
        if has_more:
            floor = page.agg(F.min("date").alias("floor")).scalar()
            merged = merged.where(F.coalesce(F.col("date") >= floor, F.lit(True)))
    return merged.orderBy(F.desc("date"), F.asc("kind"), F.asc("id"))
