"""Discovery signals and the rail that interleaves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketscope.functions.dates import AsOf, as_instant, to_instant
from docketscope.operators.lifecycle import id_hash

SIGNAL_ORDER = ["surge", "closing", "spike", "discussed"]


def month_number() -> Column:
    return F.col("year") * 12 + (F.col("month") - 1)


def discovery_surge(index: DataFrame, feed: DataFrame, limit: int = 3) -> DataFrame:
    """Largest rise of comments from the previous to the newest month of the index.

    The top k is taken before titles are looked up, so the join reads k rows.
    """
    newest = index.agg(F.max(month_number())).scalar()
    recent = index.where(month_number() >= newest - 1)
    count_in = lambda m: F.sum(F.when(month_number() == m, F.col("row_count")))
    per_docket = recent.groupBy("docket_id", "agency_code").agg(
        count_in(newest).alias("recent_n"),
        F.coalesce(count_in(newest - 1), F.lit(0)).alias("prev_n"),
    )
    order = [F.desc("delta"), F.asc("docket_id"), F.asc("agency_code")]
    ranked = (
        per_docket.where(F.col("recent_n") > 0)
        .withColumn("delta", F.col("recent_n") - F.col("prev_n"))
        .orderBy(*order)
        .limit(limit)
    )
    titled = ranked.join(feed.select("docket_id", "title"), "docket_id", "left").select(
        "docket_id", "agency_code", "title", "recent_n", "prev_n", "delta"
    )
    return titled.orderBy(*order)


def discovery_closing(
    feed: DataFrame, limit: int = 3, as_of: AsOf = None, within_days: int = 3
) -> DataFrame:
    """Comment windows that close within a few days, soonest first."""
    now = as_instant(as_of)
    soon = to_instant(F.col("comment_end_date")).between(
        now, now + F.make_dt_interval(days=F.lit(within_days))
    )
    rows = feed.where(soon).select(
        "docket_id", "agency_code", "title", "comment_end_date", "comment_count"
    )
    return rows.orderBy(F.asc_nulls_last("comment_end_date"), F.asc("docket_id")).limit(limit)


def discovery_spike(signals: DataFrame, limit: int = 3) -> DataFrame:
    rows = signals.select("agency_code", "recent_30d", "baseline", "ratio")
    return rows.orderBy(F.desc_nulls_last("ratio"), F.asc("agency_code")).limit(limit)


def discovery_discussed(feed: DataFrame, limit: int = 3) -> DataFrame:
    rows = feed.select("docket_id", "agency_code", "title", "comment_count")
    return rows.orderBy(F.desc_nulls_last("comment_count"), F.asc("docket_id")).limit(limit)


def discovery_rail(
    surge: DataFrame, closing: DataFrame, spike: DataFrame, discussed: DataFrame
) -> DataFrame:
    """Cards of all kinds, round-robin: rank within the kind, then the kind's place.

    Inputs are top-k reports, so the single ordered window over them is small.
    """
    kinds = {
        "surge": (surge, F.col("docket_id"), F.col("delta").cast("double"), F.desc),
        "closing": (closing, F.col("docket_id"), F.col("comment_end_date"), F.asc),
        "spike": (spike, F.lit(None).cast("string"), F.col("ratio"), F.desc),
        "discussed": (discussed, F.col("docket_id"), F.col("comment_count").cast("double"), F.desc),
    }
    cards = None
    for place, kind in enumerate(SIGNAL_ORDER):
        df, docket, measure, direction = kinds[kind]
        order = [direction("_m"), F.asc("docket_id"), F.asc("agency_code")]
        part = df.select(docket.alias("docket_id"), "agency_code", measure.alias("_m"))
        part = part.select(
            F.lit(kind).alias("kind"),
            F.lit(place).alias("place"),
            "docket_id",
            "agency_code",
            F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy(*order)).alias("rank"),
        )
        cards = part if cards is None else cards.unionByName(part)
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "place"))
    return cards.select(position.cast("long").alias("position"), "kind", "docket_id", "agency_code").orderBy("position")


def random_dockets(
    index: DataFrame,
    count: int = 2,
    min_comments: int = 200,
    max_comments: int = 50_000,
    seed: str | None = None,
) -> DataFrame:
    """A random pick of dockets with a workable number of comments.

    With a seed the pick is a salted id hash, the same on every run and cluster.
    """
    sized = index.groupBy("docket_id").agg(F.sum("row_count").alias("n"))
    sized = sized.where(F.col("n").between(min_comments, max_comments))
    salted = F.concat(F.lit(seed or ""), F.col("docket_id"))
    order = F.rand() if seed is None else id_hash(salted)
    return sized.orderBy(order, F.asc("docket_id")).limit(count)
