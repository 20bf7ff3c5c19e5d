"""Stored keys of comments: texts are normalised once, reports group what is stored.

Three tables under one folder, built from one pass over the texts and a second over one
speaker per letter:

* ``letters``: a row per (near key, template key, docket, agency), pre-aggregated, bucketed by
  the near key. The near key is made from the template's tokens, so a template never crosses
  buckets: clusters, campaigns and stance group bucket by bucket without a shuffle. Copies of a
  letter are one row per docket and agency, so a campaign that holds a third of all comments
  does not make a bucket large.
* ``exact``: clusters of identical texts, bucketed by their key.
* ``speakers``: display text of each letter's smallest comment, and the stance of the templates
  they speak for. Token texts are made from display texts when they are read, and where more than two
  million comments speak, a few that do not are stored as well: so no text is shuffled to be stored.

Empty input gives empty tables; a comment without text has no keys and is counted in its
docket's row without one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from docketscope.functions.dates import iso_day
from docketscope.functions.stance import OPPOSE_PHRASES, SUPPORT_PHRASES, stance_hits, stance_label
from docketscope.functions.text import text_display
from docketscope.operators.clusters import LETTER_ROWS, all_clusters, keyed_comments, orchestration_stats, top_clusters
from docketscope.operators.forms import with_forms
from docketscope.operators.joins import BROADCAST_ROWS, checked_broadcast, keep_possible

TEMPLATE = ["key_near", "key_template"]


@dataclass(frozen=True)
class StoredKeys:
    """Where the tables are; ``names`` are their names in the session's catalog."""

    spark: SparkSession
    base: str
    letters: str
    exact: str

    def table(self, name: str) -> DataFrame:
        return self.spark.table(getattr(self, name))

    def speakers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/speakers")


def _write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One file per bucket, so that the scan knows each bucket's place from the names of files."""
    name = f"stored_{uuid4().hex}"
    df.limit(0).write.parquet(f"{path}_columns")  # an empty bucketed table has no file to name them
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").options(compression="zstd", path=path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay


def open_keys(spark: SparkSession, base: str, buckets: int) -> StoredKeys:
    """Register stored tables in this session, with the number of buckets they were written with."""
    names = {}
    for table, key in (("letters", "key_near"), ("exact", "key")):
        path = f"{base}/{table}"
        columns = ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(f"{path}_columns").dtypes)
        names[table] = f"{table}_{uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {names[table]} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS "
            f"LOCATION '{path}'"
        )
    return StoredKeys(spark, base, **names)


def _letters(keyed: DataFrame) -> DataFrame:
    filled = ~F.col("blank")
    member = F.when(filled, F.col("comment_id"))
    real = filled & ~F.col("placeholder")
    return keyed.groupBy(*TEMPLATE, "docket_id", "agency_code").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("blank")).alias("empty"),
        F.count_if(filled).alias("n"),
        F.min(member).alias("sample_id"),
        F.min_by("placeholder", member).alias("placeholder"),
        F.min_by("placeholder_body", member).alias("placeholder_body"),
        F.min(F.when(filled, F.col("day"))).alias("first_day"),
        F.max(F.when(filled, F.col("day"))).alias("last_day"),
        F.count_if(real).alias("real"),
        F.min(F.when(real, F.col("day"))).alias("real_first"),
        F.max(F.when(real, F.col("day"))).alias("real_last"),
        F.min("comment_id").alias("speaker"),
    )


def store_keys(
    comments: DataFrame,
    base: str,
    buckets: int | None = None,
    support: Sequence[str] = SUPPORT_PHRASES,
    oppose: Sequence[str] = OPPOSE_PHRASES,
    max_rows: int = BROADCAST_ROWS,
) -> StoredKeys:
    """Write the tables under ``base``, in shared storage, and open them.

    ``buckets`` is the number of tasks that later reports use; as many as shuffles have
    unless it is given. Up to ``max_rows`` ids are broadcast.
    """
    spark = comments.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed_comments(comments, carried=("agency_code",)).write.parquet(f"{base}/keys", compression="zstd")
    keyed = spark.read.parquet(f"{base}/keys")
    _write_bucketed(_letters(keyed), f"{base}/letters", "key_near", buckets)
    _write_bucketed(all_clusters(keyed, ("exact",)), f"{base}/exact", "key", buckets)
    keys = open_keys(spark, base, buckets)

    letters = keys.table("letters").where(F.col("key_template").isNotNull())
    shown = letters.select(F.col("sample_id").alias("comment_id")).union(letters.select("speaker"))
    texts = keep_possible(comments.select("comment_id", "comment"), shown, "comment_id", max_rows)
    # an id that repeats speaks once; such ids are found without the texts, and only their texts are grouped
    counted = comments.where("comment_id IS NOT NULL").groupBy("comment_id").agg(F.count("*").alias("n"))
    repeated = checked_broadcast(counted.where("n > 1").select("comment_id"))
    if not repeated.isEmpty():
        once = texts.join(repeated, "comment_id", "left_semi").groupBy("comment_id").agg(F.min("comment").alias("comment"))
        texts = texts.join(repeated, "comment_id", "left_anti").unionByName(once)
    display = texts.select("comment_id", text_display(F.col("comment")).alias("body"))
    pro, con = stance_hits(F.col("body"), support, oppose)
    scored = display.select("comment_id", "body", pro.alias("support_hits"), con.alias("oppose_hits"))
    scored = scored.withColumn("stance", stance_label(F.col("support_hits"), F.col("oppose_hits")))
    scored.write.parquet(f"{base}/speakers", compression="zstd")
    return keys


def stored_clusters(keys: StoredKeys, tier: str) -> DataFrame:
    """The cluster table of one tier, as ``all_clusters`` gives it, from one scan without a shuffle.

    A near key is a function of its template key, so grouping by both groups by the template.
    """
    if tier == "exact":
        return keys.table("exact")
    if tier not in ("near", "template"):
        raise ValueError(f"unknown tier: {tier}")
    key = "key_near" if tier == "near" else "key_template"
    rows = keys.table("letters")
    return rows.groupBy("docket_id", *(TEMPLATE if tier == "template" else ["key_near"])).agg(
        F.sum("rows").alias("rows"), F.sum("empty").alias("empty"), F.sum("n").alias("n"),
        F.min_by("placeholder", "sample_id").alias("placeholder"),
        F.min_by("placeholder_body", "sample_id").alias("placeholder_body"),
        F.min("sample_id").alias("sample_id"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
    ).select(
        "docket_id", F.lit(tier).alias("tier"), F.col(key).alias("key"), "rows", "empty", "n", "sample_id",
        "placeholder", "placeholder_body", "first_day", "last_day",
    )


def stored_comment_clusters(keys: StoredKeys, tier: str = "near", top_n: int | None = None) -> DataFrame:
    """``comment_clusters`` of the near or template tier; samples are joined by id, only their words are split.

    Clusters are sent to the texts, up to ``LETTER_ROWS``; beyond that texts meet them in a shuffle, without a sort.
    """
    if tier == "exact":
        raise ValueError("samples are stored for near and template letters")
    clusters = top_clusters(stored_clusters(keys, tier), top_n).select("docket_id", "key", "n", "sample_id", "first_day", "last_day")
    texts = keys.speakers().select(F.col("comment_id").alias("sample_id"), "body")
    if clusters.count() <= LETTER_ROWS:
        met = texts.join(F.broadcast(clusters), "sample_id")
    else:
        met = clusters.hint("shuffle_hash").join(keep_possible(texts, clusters, "sample_id", 0), "sample_id")
    return with_forms(met, "body", ("display", "tokenset"), displayed=True).select(
        "docket_id", F.col("key").alias("hash"), "n", F.col("display").alias("sample"), "tokenset",
        iso_day(F.col("first_day")).alias("first_day"), iso_day(F.col("last_day")).alias("last_day"),
    )


def stored_orchestration(keys: StoredKeys, tiers: Sequence[str] = ("exact", "template", "near")) -> DataFrame:
    """``orchestration_stats``: one partial row per bucket, docket and tier is all that moves."""
    rows = None
    for tier in tiers:
        part = stored_clusters(keys, tier)
        rows = part if rows is None else rows.unionByName(part)
    return orchestration_stats(rows)


def stored_stance(keys: StoredKeys) -> DataFrame:
    """``stance_by_template``: templates are grouped in their buckets and meet their speaker's stance."""
    letters = keys.table("letters").where(F.col("key_template").isNotNull())
    templates = letters.groupBy(*TEMPLATE).agg(F.sum("rows").alias("n"), F.min("speaker").alias("comment_id"))
    stance = keys.speakers().select("comment_id", "support_hits", "oppose_hits", "stance")
    return templates.join(stance, "comment_id").select(
        F.col("key_template").alias("skeleton_hash"), "n", "support_hits", "oppose_hits", "stance"
    )


def stored_campaigns(keys: StoredKeys, min_dockets: int = 2) -> DataFrame:
    """``cross_docket_campaigns`` without a shuffle: dockets and agencies are counted where they first occur."""
    first = lambda column, order: F.row_number().over(Window.partitionBy(*TEMPLATE, column).orderBy(order)) == 1
    rows = keys.table("letters").where(F.col("real") > 0)
    marked = rows.select(
        *TEMPLATE, "real", "real_first", "real_last",
        (F.col("docket_id").isNotNull() & first("docket_id", "agency_code")).alias("docket"),
        (F.col("agency_code").isNotNull() & first("agency_code", "docket_id")).alias("agency"),
    )
    campaigns = marked.groupBy(*TEMPLATE).agg(
        F.sum("real").alias("n"), F.count_if("docket").alias("dockets"), F.count_if("agency").alias("agencies"),
        iso_day(F.min("real_first")).alias("first_day"), iso_day(F.max("real_last")).alias("last_day"),
    )
    return campaigns.where(F.col("dockets") >= min_dockets).drop("key_near").withColumnRenamed("key_template", "skeleton_hash")
