"""Comment clusters at three fidelity tiers.

Cost model: texts are read and normalised once and reduced to keys on the map
side. Only narrow rows (docket, tier, key, counts, dates, one id) are shuffled,
pre-aggregated, so a docket or a letter that holds a third of all comments is a
handful of partial rows per task. Sample texts are fetched afterwards, for the
reported clusters only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketscope.functions.dates import iso_day, to_day
from docketscope.functions.text import (
    TIERS,
    is_blank,
    name_mask,
    tier_key,
)
from docketscope.operators.forms import placeholder_flags, with_forms
from docketscope.operators.joins import join_listed, keep_listed
from docketscope.operators.lookups import top_per_group

# Clusters of about 130 bytes that are broadcast to their texts.
LETTER_ROWS = 1_500_000

# name -> the flag column that marks a placeholder sample
PLACEHOLDER_RULES = {"text": "placeholder", "body": "placeholder_body"}


def keyed_comments(
    comments: DataFrame,
    tiers: tuple[str, ...] = TIERS,
    name_columns: tuple[str, ...] = (),
    carried: tuple[str, ...] = (),
    flags: bool = True,
) -> DataFrame:
    """Per comment: docket, id, day, flags and the key of every tier; no text.

    ``name_columns`` masks the signer's own names before the template keys; ``carried`` columns
    are kept. Without the placeholder ``flags`` exact keys need no form of a text.
    """
    made = tuple(t for t in tiers if t != "exact")
    rows = comments.select(
        "docket_id",
        "comment_id",
        to_day(F.col("posted_date")).alias("day"),
        is_blank(F.col("comment")).alias("blank"),
        *([tier_key("exact", F.col("comment")).alias("key_exact")] if "exact" in tiers else []),
        *carried,
        *([F.array(*[name_mask(F.col(c)) for c in name_columns]).alias("_mask")] if name_columns else []),
        "comment",
    )
    keys = ["docket_id", "comment_id", "day", "blank"]
    if not made and not flags:
        return rows.select(*keys, "key_exact", *carried)
    forms = with_forms(rows, "comment", (*made, *(("head", "body_head") if flags else ())), "_mask" if name_columns else None)
    return forms.select(
        *keys,
        *(placeholder_flags() if flags else []),
        *[F.col("key_exact" if t == "exact" else t).alias(f"key_{t}") for t in tiers],
        *carried,
    )


def all_clusters(keyed: DataFrame, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """Every (docket, tier, key) group, blank comments counted apart.

    One expand to (tier, key) rows and one pre-aggregated shuffle serve all
    tiers. ``sample_id`` is the smallest id of the non-blank members, whose flags are told if comments have them.
    """
    flags = [c for c in ("placeholder", "placeholder_body") if c in keyed.columns]
    pairs = F.array(
        *[F.struct(F.lit(t).alias("tier"), F.col(f"key_{t}").alias("key")) for t in tiers]
    )
    rows = keyed.select(
        "docket_id", "comment_id", "day", "blank", *flags,
        F.explode(pairs).alias("t"),
    ).select("*", "t.tier", "t.key")
    filled = ~F.col("blank")
    member = F.when(filled, F.col("comment_id"))
    return rows.groupBy("docket_id", "tier", "key").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("blank")).alias("empty"),
        F.count_if(filled).alias("n"),
        F.min(member).alias("sample_id"),
        *[F.min_by(c, member).alias(c) for c in flags],
        F.min(F.when(filled, F.col("day"))).alias("first_day"),
        F.max(F.when(filled, F.col("day"))).alias("last_day"),
    )


def cluster_totals(clusters: DataFrame) -> DataFrame:
    """Comments, distinct keys (a NULL key is none) and blank comments per docket and tier."""
    return clusters.groupBy("docket_id", "tier").agg(
        F.sum("rows").alias("total"),
        F.count("key").alias("distinct_keys"),
        F.sum("empty").alias("empty"),
    )


def top_clusters(clusters: DataFrame, top_n: int | None = None) -> DataFrame:
    """Non-blank clusters; with ``top_n`` only the largest per docket and tier, for a listing."""
    filled = clusters.where(F.col("n") > 0).drop("rows", "empty")
    if top_n is None:
        return filled
    order = [F.desc("n"), F.asc("key")]
    return top_per_group(filled, ["docket_id", "tier"], order, top_n)


def with_raw(clusters: DataFrame, comments: DataFrame, max_rows: int = LETTER_ROWS) -> DataFrame:
    """Adds the representative's comment as it is, ``_raw``; ``clusters`` is a stored table.

    Up to ``max_rows`` clusters are sent to the texts, beyond that texts are shuffled.
    """
    keys = ["docket_id", "sample_id"]
    source = comments.select(
        "docket_id", F.col("comment_id").alias("sample_id"), F.col("comment").alias("_raw")
    )
    if clusters.count() <= max_rows:
        return source.join(F.broadcast(clusters), keys)
    return clusters.join(keep_listed(source, clusters, keys), keys)


def with_tokens(clusters: DataFrame, comments: DataFrame, max_rows: int = LETTER_ROWS) -> DataFrame:
    """Adds the representative's content tokens alone, as hashes; ``clusters`` is a stored table.

    They are made where the text is read and meet the clusters there: no text and no token is shuffled for up to
    ``max_rows`` clusters.
    """
    source = comments.select("docket_id", F.col("comment_id").alias("sample_id"), "comment")
    keys = ["docket_id", "sample_id"]
    words = F.filter(F.split("tokenset", " "), lambda w: w != "")
    tokens = F.transform(words, lambda w: F.xxhash64(w)).alias("tokens")
    if clusters.count() <= max_rows:
        met = with_forms(source.join(F.broadcast(clusters), keys), "comment", ("tokenset",))
        return met.select(*clusters.columns, tokens)
    made = with_forms(keep_listed(source, clusters, keys), "comment", ("tokenset",)).select(*keys, tokens)
    return clusters.hint("shuffle_hash").join(made, keys)


def with_samples(
    clusters: DataFrame, comments: DataFrame, sample_chars: int | None = None
) -> DataFrame:
    """Adds the representative's display text and token set.

    Reads the comments again for the reported ids alone; only those rows are
    normalised. ``sample_chars`` shortens the shown sample.
    """
    source = comments.select("docket_id", F.col("comment_id").alias("sample_id"), "comment")
    shown = with_forms(join_listed(clusters, source, ["docket_id", "sample_id"]), "comment", ("display", "tokenset"))
    sample = F.col("display") if sample_chars is None else F.substring("display", 1, sample_chars)
    return shown.withColumn("sample", sample).drop("display")


def comment_clusters(
    comments: DataFrame,
    tier: str = "exact",
    top_n: int | None = None,
    sample_chars: int | None = None,
) -> DataFrame:
    """The clusters of every docket at one tier, with sample and token set.

    ``top_n`` and ``sample_chars`` shorten a listing that is shown.
    """
    keyed = keyed_comments(comments, (tier,), flags=False)
    clusters = top_clusters(all_clusters(keyed, (tier,)), top_n)
    rows = with_samples(clusters, comments, sample_chars)
    return rows.select(
        "docket_id",
        F.col("key").alias("hash"),
        "n",
        "sample",
        "tokenset",
        iso_day(F.col("first_day")).alias("first_day"),
        iso_day(F.col("last_day")).alias("last_day"),
    )


def form_letters(clusters: DataFrame, placeholder_rule: str = "text", min_size: int = 2) -> DataFrame:
    """Clusters with several members whose sample is a real text."""
    flag = F.col(PLACEHOLDER_RULES[placeholder_rule])
    return clusters.where(~flag & (F.col("n") >= min_size))


def orchestration_stats(
    clusters: DataFrame, placeholder_rule: str = "text", min_size: int = 2
) -> DataFrame:
    """Form letters and their share of all comments, per docket and tier.

    ``unique_count`` is the comments outside form letters, not the distinct keys.
    """
    flag = F.col(PLACEHOLDER_RULES[placeholder_rule])
    filled = F.col("n") > 0
    letter = filled & ~flag & (F.col("n") >= min_size)
    stats = clusters.groupBy("docket_id", "tier").agg(
        F.sum("rows").alias("total"),
        F.count("key").alias("distinct_keys"),
        F.count_if(filled & ~flag).alias("real_clusters"),
        F.count_if(letter).alias("form_letters"),
        F.coalesce(F.sum(F.when(letter, F.col("n"))), F.lit(0)).alias("orchestrated_count"),
    )
    unique = F.col("total") - F.col("orchestrated_count")
    return stats.select(
        "*",
        unique.alias("unique_count"),
        percent(unique, F.col("total")).alias("unique_pct"),
        percent(F.col("orchestrated_count"), F.col("total")).alias("orchestrated_pct"),
    )


def percent(part: Column, whole: Column) -> Column:
    """Share 0..100; 0 for an empty whole."""
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0)) * 100).otherwise(0.0)


def fidelity_ladder(comments: DataFrame) -> DataFrame:
    """Each docket at all tiers, with the change of the unique share against exact."""
    stats = orchestration_stats(all_clusters(keyed_comments(comments)))
    # three rows per docket: the exact tier's share becomes a column of the group
    tiers = F.collect_list(
        F.struct("tier", "total", "form_letters", "unique_pct", "orchestrated_pct")
    )
    exact = F.max(F.when(F.col("tier") == "exact", F.col("unique_pct")))
    per_docket = stats.groupBy("docket_id").agg(tiers.alias("tiers"), exact.alias("exact_unique_pct"))
    rows = per_docket.select("docket_id", "exact_unique_pct", F.inline("tiers"))
    delta = F.col("unique_pct") - F.col("exact_unique_pct")
    return rows.select(
        "docket_id", "tier", "total", "form_letters", "unique_pct", "orchestrated_pct",
        "exact_unique_pct", delta.alias("delta_vs_exact"),
    )


def comment_volume_by_day(comments: DataFrame) -> DataFrame:
    """Comments per docket and day; unparseable dates are left out."""
    day = to_day(F.col("posted_date"))
    grouped = comments.where(day.isNotNull()).groupBy("docket_id", day.alias("d"))
    counted = grouped.agg(F.count("*").alias("n"))
    return counted.select("docket_id", iso_day(F.col("d")).alias("day"), "n")


