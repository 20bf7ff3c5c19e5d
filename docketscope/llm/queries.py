"""The registered query of each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketscope.llm import (
    centroids, conversations, language, mixing, near_dups, neighbours, packing, pii, quality, sharding, store,
    token_counts, toxicity, warc,
)
from docketscope.llm.capture_index import CaptureIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learnt from the labels outside the held-out fifth."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near-copies."""
    return near_dups.find_near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; counts of shards differ by at most one."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language."""
    return language.identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, as counts and span digests."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def text(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k) for k in pii.BASE_KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_BLANK = r"[ \t\n\x0B\x0C\r]"
_RATIOS = " UNION ALL ".join(
    f"SELECT r, lang, source, base_failed, '{f}' AS feature, coalesce({over} / nullif({under}, 0), 0.0) AS x FROM counted"
    for f, (over, under, _, _) in quality.FEATURES.items()
)
_SLACK = " ".join(f"WHEN '{f}' THEN {slack}" for f, (_, _, slack, _) in quality.FEATURES.items())
_BOTH = ", ".join(f"'{f}'" for f, (_, _, _, sides) in quality.FEATURES.items() if sides == 0)
_GROWTH = log((1 + quality.ACCURACY) / (1 - quality.ACCURACY))

SQL["op10_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS ws FROM d)),
grams AS (
  SELECT r, i, count(*) OVER ahead AS k, string_agg(w, ' ') OVER ahead AS g
  FROM words WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {quality.WINDOW - 1} FOLLOWING)),
twice AS (SELECT r, i, k = {quality.WINDOW} AND count(*) OVER (PARTITION BY r, k, g) > 1 AS again FROM grams),
echoed AS (
  SELECT r, count(*) FILTER (w = before) AS n_echoes
  FROM (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS before FROM words) GROUP BY r),
inside AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (covered) AS n_repeat_words
  FROM (SELECT r, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {quality.WINDOW - 1} PRECEDING AND CURRENT ROW)
          AS covered FROM twice) GROUP BY r),
lines AS (
  SELECT r, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines
  FROM (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')) AS ls FROM d)),
counted AS (
  SELECT d.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks, n_lines, n_dup_lines,
         coalesce(n_echoes, 0) AS n_echoes,
         coalesce(n_words, 0) < {quality.LEAST_WORDS}
           OR 100 * coalesce(n_repeat_words, 0) > {100 * quality.MOST_REPEATED} * coalesce(n_words, 0) AS base_failed
  FROM d LEFT JOIN inside USING (r) LEFT JOIN echoed USING (r) JOIN lines USING (r)),
ratios AS ({_RATIOS}),
sketch AS (
  SELECT lang, source, feature, CASE WHEN x > 0 THEN ceil(ln(x) / {_GROWTH!r}) ELSE -1e9 END AS bucket, count(*) AS n
  FROM ratios WHERE NOT base_failed GROUP BY ALL),
merged AS (
  SELECT 0 AS level, lang, source, feature, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, feature, bucket, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, feature, bucket, sum(n) FROM sketch GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, feature ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, feature) AS rows_ FROM merged),
quartiles AS (
  SELECT level, lang, source, feature, any_value(rows_) AS rows_,
         min(bucket) FILTER (upto >= 0.25 * rows_) AS b1, min(bucket) FILTER (upto >= 0.75 * rows_) AS b3
  FROM ranked GROUP BY ALL),
fences AS (
  SELECT *, q1 - spread AS low, q3 + spread AS high
  FROM (SELECT *, {quality.REACH} * greatest(q3 - q1, CASE feature {_SLACK} END) AS spread
        FROM (SELECT *, CASE WHEN b1 < -1e8 THEN 0 ELSE exp(b1 * {_GROWTH!r}) * {1 - quality.ACCURACY} END AS q1,
                     CASE WHEN b3 < -1e8 THEN 0 ELSE exp(b3 * {_GROWTH!r}) * {1 - quality.ACCURACY} END AS q3
              FROM quartiles))),
beyond AS (
  SELECT DISTINCT r FROM (
    SELECT x.r, x.x, x.feature, f.low, f.high
    FROM ratios x JOIN fences f ON f.feature = x.feature AND (f.rows_ >= {quality.LEAST_ROWS} OR f.level = 2)
      AND (f.level = 2 OR f.lang IS NOT DISTINCT FROM x.lang AND (f.level = 1 OR f.source IS NOT DISTINCT FROM x.source))
    QUALIFY row_number() OVER (PARTITION BY x.r, x.feature ORDER BY f.level) = 1)
  WHERE x > high OR feature IN ({_BOTH}) AND x < low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM beyond) AS kept
FROM counted"""


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, and its cheapest repair."""
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.summarise(conversations.repair(damaged))


@query
def op12_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives, found by its address in the index and read back."""
    pages = table(spark, sf_dir, "pages")
    folder = store.new_folder(spark, "warc")
    index = CaptureIndex.build(warc.write_archives(pages, folder), folder)
    records = warc.read_records(index.lookup(pages), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op12_archives"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
  SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS first_id
  FROM p WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.LEAST_SHARED} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.LEAST_SHARED} AND place > 1 THEN first_id END AS refers_to
FROM q"""


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds, with exact distances."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _assigned_sql(k: int) -> str:
    """Nearest centroid of every vector before round k: a{k}(r, d, c)."""
    return f"""
a{k} AS (
  SELECT r, min(CAST(d AS HUGEINT) * 1000 + c) // 1000 AS d, CAST(min(CAST(d AS HUGEINT) * 1000 + c) % 1000 AS INTEGER) AS c
  FROM (SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{k}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM kept, c{k})
  GROUP BY r)"""


def _moved_sql(k: int) -> str:
    """Centroids after round k: c{k + 1}(c, v)."""
    return f"""
m{k} AS (
  SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT c, i, sum(x) AS s, count(*) AS n
        FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k} JOIN kept USING (r)) GROUP BY c, i)
  GROUP BY c),
c{k + 1} AS (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))"""


_ROUNDS = ",".join(f"{_assigned_sql(k)},{_moved_sql(k)}" for k in range(centroids.ROUNDS))

SQL["op13_centroids"] = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.DIMENSIONS}),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v
  FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL
        ORDER BY h, v LIMIT {centroids.CLUSTERS})),{_ROUNDS},{_assigned_sql(centroids.ROUNDS)}
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN kept USING (r) JOIN c{centroids.ROUNDS} f USING (c)"""
