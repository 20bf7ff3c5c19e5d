"""Scans, lookups, feed, rollup builders and exports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from docketscope.functions import dates as D
from docketscope.functions import fields as X
from docketscope.functions.text import comment_body
from docketscope.operators import feed as FEED
from docketscope.operators import lookups as LK
from docketscope.plans import incremental
from docketscope.plans import rollups as R
from docketscope.session import ensure_checkpoint_dir
from docketscope.sources import sinks, tables
from workload.catalog import AS_OF, query

# ---------------------------------------------------------------- scans, sinks


def _folder(t, kind):
    """A new folder in the shared checkpoint storage."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{kind}-{uuid4().hex}"


@query("scan_table", "dockets", """
    SELECT docket_id, agency_code, title, abstract, docket_type, modify_date, date_created,
           CAST(NULL AS varchar) AS raw_json FROM dockets""")
def _(t):
    base = _folder(t, "tables")
    t("dockets").write.parquet(f"{base}/dockets.parquet")
    return tables.scan_table(t.spark, base, "dockets")


@query("scan_external_source", "", "SELECT * FROM customer")
def _(t):
    return tables.scan_external_source(t.spark, t.sf_dir, "customer")


PAYLOAD_DOCKETS = 200


@query("scan_search_corpus", "corpus", """
    SELECT docket_id, agency_code, title, docket_type, modify_date, abstract FROM corpus""")
def _(t):
    doc = F.struct(
        F.col("docket_id").alias("id"), F.col("agency_code").alias("a"), F.col("title").alias("t"),
        F.col("docket_type").alias("x"), F.col("modify_date").alias("d"), F.col("abstract").alias("s"),
    )
    # compressed payload files of about so many dockets each, as a publisher would ship them, however many there are
    parts = F.ceil(t("corpus").agg(F.count("*") / PAYLOAD_DOCKETS).scalar())
    payloads = t("corpus").select(F.pmod(F.xxhash64("docket_id"), F.greatest(parts, F.lit(1))).alias("part"), doc.alias("doc"))
    path = _folder(t, "corpus")
    grouped = payloads.groupBy("part").agg(F.collect_list("doc").alias("docs"))
    grouped.repartition("part").write.partitionBy("part").option("compression", "gzip").json(path)
    return tables.scan_search_corpus(t.spark, path)


_MIRROR_SQL = """
    SELECT agency_code, count(*) AS n, count(DISTINCT docket_id) AS dockets,
           CAST(sum(length(comment)) AS bigint) AS chars FROM comments GROUP BY 1"""


def _mirror(t):
    base = _folder(t, "mirror")
    sinks.write_comments_mirror(t("comments"), f"{base}/comments/agency")
    return base


@query("write_comments_mirror", "comments", _MIRROR_SQL)
def _(t):
    mirror = tables.scan_comments_partitioned(t.spark, _mirror(t))
    return mirror.groupBy("agency_code").agg(
        F.count("*").alias("n"), F.countDistinct("docket_id").alias("dockets"),
        F.sum(F.length("comment")).alias("chars"),
    )


@query("scan_comments_partitioned", "comments", """
    SELECT comment_id, docket_id, agency_code, comment, posted_date FROM comments WHERE agency_code = 'src1'""")
def _(t):
    mirror = tables.scan_comments_partitioned(t.spark, _mirror(t), "src1")
    return mirror.select(F.col("comment_id").cast("long").alias("comment_id"), "docket_id", "agency_code",
                         "comment", "posted_date")


@query("resolve_comment_partitions", "reg_documents dockets", """
    SELECT document_id, agency_code, docket_id FROM reg_documents
    WHERE (agency_code, docket_id) IN (SELECT (agency_code, docket_id) FROM dockets WHERE docket_type = 'Rulemaking')""")
def _(t):
    # the index knows only some of the dockets
    index = t("dockets").where("docket_type = 'Rulemaking'")
    known = LK.resolve_comment_partitions(t("reg_documents"), index)
    return known.select("document_id", "agency_code", "docket_id")


@query("get_data", "dockets", """
    SELECT docket_id, agency_code, title, abstract, docket_type, modify_date FROM dockets
    WHERE agency_code = 'NATION_7' ORDER BY docket_id LIMIT 1000 OFFSET 50""")
def _(t):
    return LK.get_data(t("dockets"), "dockets", "nation_7", offset=50)


@query("docket_by_id", "dockets", "SELECT * FROM dockets WHERE docket_id = '77'")
def _(t):
    return LK.docket_by_id(t("dockets"), "77")


@query("document_by_id", "reg_documents", """
    SELECT document_id, docket_id, agency_code, title, document_type, posted_date, modify_date,
           comment_start_date, comment_end_date, file_url
    FROM reg_documents WHERE document_id = (SELECT min(document_id) FROM reg_documents)""")
def _(t):
    first = t("reg_documents").agg(F.min("document_id")).first()[0]
    return LK.document_by_id(t("reg_documents"), f'"{first}"')


@query("documents_for_docket", "reg_documents", """
    SELECT docket_id, document_id, title, document_type, posted_date, comment_start_date,
           comment_end_date, file_url
    FROM (SELECT *, row_number() OVER (PARTITION BY docket_id
                                       ORDER BY posted_date DESC NULLS LAST, document_id) rn
          FROM reg_documents) WHERE rn <= 5""")
def _(t):
    return LK.documents_for_docket(t("reg_documents"), limit=5)


@query("comments_for_docket", "comments", """
    SELECT comment_id, docket_id, agency_code, title,
           CASE WHEN comment IS NULL OR trim(comment) = ''
                     OR lower(trim(comment)) LIKE 'see attached%'
                THEN coalesce(nullif(trim(text_content), ''), comment) ELSE comment END AS comment,
           first_name, last_name, organization, category, posted_date, modify_date,
           attachments_json
    FROM comments WHERE docket_id = 'EN'
    ORDER BY posted_date DESC NULLS LAST, comment_id LIMIT 40 OFFSET 10""")
def _(t):
    # ids come quoted and in any case
    return LK.comments_for_docket(t("comments"), '"en"', limit=40, offset=10)


_EXPORT = ("comment_id docket_id agency_code title comment organization posted_date").split()


@query("export_comments", "comments", """
    SELECT comment_id, docket_id, agency_code, title, comment, organization, posted_date
    FROM comments WHERE docket_id = 'EN'""")
def _(t):
    mirror = tables.scan_comments_partitioned(t.spark, _mirror(t)).withColumn("comment_id", F.col("comment_id").cast("long"))
    return LK.export_comments(mirror.select(*_EXPORT), '"en"', index=t("comments"))


_CSV_FIELD = """CASE WHEN {c} IS NULL THEN '' WHEN regexp_matches({c}, '[,"\\n]')
    THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""
_CSV_SQL = "SELECT " + " || ',' || ".join(
    _CSV_FIELD.format(c=f"regexp_replace(CAST({c} AS varchar), '^\"|\"$', '', 'g')")
    for c in _EXPORT
) + " AS line FROM comments"


@query("csv_lines", "comments", _CSV_SQL)
def _(t):
    return sinks.csv_lines(t("comments").select(*_EXPORT))


# written and read back: an empty field is a missing value
@query("sink_csv", "comments", "SELECT " + ", ".join(
    f"nullif(regexp_replace(CAST({c} AS varchar), '^\"|\"$', '', 'g'), '') AS {c}" for c in _EXPORT) + " FROM comments")
def _(t):
    path = _folder(t, "csv")
    sinks.sink_csv(t("comments").select(*_EXPORT), path)
    return t.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("sink_parquet", "comments", """
    SELECT comment_id, regexp_replace(docket_id, '^"|"$', '', 'g') AS docket_id,
           regexp_replace(comment, '^"|"$', '', 'g') AS comment FROM comments""")
def _(t):
    path = _folder(t, "export")
    sinks.sink_parquet(t("comments").select("comment_id", "docket_id", "comment"), path)
    return t.spark.read.parquet(path)


@query("sink_json_bundle", "dockets reg_documents", """
    SELECT agency_code, docket_id, 'docket' AS section,
           CAST(to_json({agency_code: agency_code, docket_id: docket_id, title: title, docket_type: docket_type}) AS varchar) AS record
    FROM dockets
    UNION ALL
    SELECT agency_code, docket_id, 'documents',
           CAST(to_json({agency_code: agency_code, docket_id: docket_id, document_id: document_id, file_url: file_url}) AS varchar)
    FROM reg_documents
    UNION ALL
    SELECT agency_code, docket_id, 'comments',
           CAST(to_json({agency_code: agency_code, docket_id: docket_id, comment_id: document_id, posted_date: posted_date}) AS varchar)
    FROM reg_documents""")
def _(t):
    documents = t("reg_documents")
    path = _folder(t, "bundles")
    sinks.sink_json_bundles(
        t("dockets").select("agency_code", "docket_id", "title", "docket_type"),
        documents.select("agency_code", "docket_id", "document_id", "file_url"),
        documents.select("agency_code", "docket_id", F.col("document_id").alias("comment_id"), "posted_date"),
        path,
    )
    return t.spark.read.schema("docket_id string, section string, record string, agency_code string").json(path)


@query("search_resources", "dockets reg_documents comments", """
    SELECT * FROM (
      SELECT 'dockets' AS type, title, docket_id, agency_code FROM dockets WHERE title ILIKE '%#00000012%'
      UNION ALL
      SELECT 'documents', title, docket_id, agency_code FROM reg_documents WHERE title ILIKE '%#00000012%'
      UNION ALL
      SELECT 'comments', title, docket_id, agency_code FROM comments
      WHERE title ILIKE '%#00000012%' AND agency_code = 'src0')
    ORDER BY type, title, docket_id, agency_code LIMIT 10""")
def _(t):
    found = {"dockets": t("dockets"), "documents": t("reg_documents"), "comments": t("comments")}
    return LK.search_resources(found, "#00000012", agency_code="src0")


# ------------------------------------------------------------- counts, listings


@query("data_count", "dockets comments_index", """
    SELECT 'dockets' AS tbl, count(*) AS count FROM dockets WHERE agency_code = 'NATION_3'
    UNION ALL
    SELECT 'comments', CAST(coalesce(sum(row_count), 0) AS bigint) FROM comments_index
    WHERE agency_code = 'NATION_3'""")
def _(t):
    tag = lambda n, df: df.select(F.lit(n).alias("tbl"), "count")
    dockets = LK.data_count(t("dockets"), "nation_3")
    comments = LK.comment_data_count(t("comments_index"), "nation_3")
    return tag("dockets", dockets).unionByName(tag("comments", comments))


@query("list_agencies", "dockets", "SELECT DISTINCT agency_code FROM dockets")
def _(t):
    return LK.list_agencies(t("dockets"))


@query("list_dockets", "dockets", """
    SELECT DISTINCT docket_id FROM dockets WHERE agency_code = 'NATION_5'""")
def _(t):
    return LK.list_dockets(t("dockets"), "nation_5")


@query("comment_counts", "dockets comments_index", """
    SELECT d.docket_id, CAST(coalesce(n, 0) AS bigint) AS comment_count
    FROM (SELECT DISTINCT docket_id FROM dockets) d
    LEFT JOIN (SELECT docket_id, sum(row_count) n FROM comments_index GROUP BY 1) USING (docket_id)""")
def _(t):
    return LK.comment_counts(t("comments_index"), t("dockets"))


# ------------------------------------------------------------------------- feed

TOPICS = {"automobiles": {"agencies": ["NATION_3", "NATION_11"], "keywords": ["automobile", "urgent"]}}

_FEED_COLS = """docket_id, agency_code, title, abstract, docket_type, modify_date, date_created,
    comment_count, comment_end_date"""
_TOPIC = """(agency_code IN ('NATION_3', 'NATION_11') OR title ILIKE '%automobile%'
    OR abstract ILIKE '%automobile%' OR title ILIKE '%urgent%' OR abstract ILIKE '%urgent%')"""
_OTHER = "(docket_type NOT IN ('Rulemaking', 'Nonrulemaking') OR docket_type IS NULL)"
_NOW = f"TIMESTAMP '{AS_OF}'"


@query("docket_feed", "feed_summary", f"""
    SELECT {_FEED_COLS} FROM feed_summary
    ORDER BY modify_date DESC NULLS LAST, docket_id LIMIT 100 OFFSET 20""")
def _(t):
    return FEED.docket_feed(t("feed_summary"), limit=100, offset=20)


@query("docket_feed_popular", "feed_summary", f"""
    SELECT {_FEED_COLS} FROM feed_summary
    WHERE docket_type = 'Rulemaking' AND {_TOPIC}
    ORDER BY comment_count DESC NULLS LAST, modify_date DESC NULLS LAST, docket_id LIMIT 50""")
def _(t):
    return FEED.docket_feed(
        t("feed_summary"), limit=50, sort_by="popular", docket_type="rule",
        topic="automobiles", topics=TOPICS,
    )


@query("docket_feed_open", "feed_summary", f"""
    SELECT {_FEED_COLS} FROM feed_summary
    WHERE TRY_CAST(comment_end_date AS timestamp) > {_NOW} AND {_OTHER}
    ORDER BY comment_end_date ASC NULLS LAST, docket_id LIMIT 50""")
def _(t):
    return FEED.docket_feed(t("feed_summary"), 50, sort_by="open", docket_type="other", as_of=AS_OF)


@query("docket_feed_closed", "feed_summary", f"""
    SELECT {_FEED_COLS} FROM feed_summary
    WHERE TRY_CAST(comment_end_date AS timestamp) < {_NOW}
      AND TRY_CAST(comment_end_date AS timestamp) >= {_NOW} - INTERVAL '90' DAY
      AND docket_type = 'Nonrulemaking'
    ORDER BY comment_end_date DESC NULLS LAST, docket_id LIMIT 50""")
def _(t):
    return FEED.docket_feed(
        t("feed_summary"), 50, sort_by="closed", date_range="90d", docket_type="nonrule", as_of=AS_OF
    )


@query("feed_membership", "feed_summary", f"""
    SELECT docket_id FROM feed_summary
    WHERE {_TOPIC} AND {_OTHER}
      AND TRY_CAST(coalesce(date_created, modify_date) AS timestamp) >= {_NOW} - INTERVAL '365' DAY""")
def _(t):
    member = FEED.feed_predicate(
        docket_type="other", topic="automobiles", date_range="365d", as_of=AS_OF, topics=TOPICS
    )
    return t("feed_summary").where(member).select("docket_id")


@query("feed_count", "feed_summary", f"""
    SELECT count(*) AS count FROM feed_summary WHERE agency_code = 'NATION_3' AND {_TOPIC}""")
def _(t):
    return FEED.feed_count(t("feed_summary"), agency_code="nation_3", topic="automobiles", topics=TOPICS)


@query("comment_window_open", "feed_summary", f"""
    SELECT docket_id, TRY_CAST(comment_end_date AS timestamp) > {_NOW} AS is_open,
           TRY_CAST(comment_end_date AS timestamp) < {_NOW} AS is_closed FROM feed_summary""")
def _(t):
    end = F.col("comment_end_date")
    return t("feed_summary").select(
        "docket_id", D.window_open(end, AS_OF).alias("is_open"),
        D.window_open(end, AS_OF, False).alias("is_closed"),
    )


@query("docket_meta_fallback", "dockets feed_summary", """
    SELECT coalesce(f.docket_id, d.docket_id) AS docket_id,
           CASE WHEN f.docket_id IS NULL THEN d.title ELSE f.title END AS title,
           CASE WHEN f.docket_id IS NULL THEN d.abstract ELSE f.abstract END AS abstract,
           f.comment_end_date
    FROM feed_summary f FULL JOIN (
      SELECT docket_id, title, abstract FROM dockets
      UNION ALL SELECT 'S-' || s_suppkey, s_name, NULL FROM supplier) d ON f.docket_id = d.docket_id""")
def _(t):
    # suppliers stand in for dockets that the feed does not have yet
    late = t("supplier").select(
        F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("docket_id"), F.col("s_name").alias("title"),
        F.lit(None).cast("string").alias("abstract"),
    )
    dockets = t("dockets").select("docket_id", "title", "abstract").unionByName(late)
    return FEED.docket_meta_fallback(t("feed_summary"), dockets)


@query("open_rulemakings", "feed_summary", f"""
    SELECT docket_id, agency_code, title, abstract, comment_count, comment_end_date, docket_type
    FROM feed_summary WHERE TRY_CAST(comment_end_date AS timestamp) > {_NOW}""")
def _(t):
    return FEED.open_rulemakings(t("feed_summary"), as_of=AS_OF)


@query("top_dockets_by_comments", "feed_summary", """
    SELECT docket_id, agency_code, title, abstract, comment_count, comment_end_date, docket_type
    FROM (SELECT *, row_number() OVER (PARTITION BY agency_code
                                       ORDER BY comment_count DESC NULLS LAST, docket_id) rn
          FROM feed_summary) WHERE rn <= 10""")
def _(t):
    return FEED.top_dockets_by_comments(t("feed_summary"))


@query("feed_dedupe", "fr_docket_links", """
    SELECT document_number, docket_id, title
    FROM (SELECT *, row_number() OVER (PARTITION BY document_number
                                       ORDER BY publication_date DESC, docket_id) rn
          FROM fr_docket_links) WHERE rn = 1""")
def _(t):
    rows = FEED.feed_dedupe(
        t("fr_docket_links"), "document_number", [F.desc("publication_date"), F.asc("docket_id")]
    )
    return rows.select("document_number", "docket_id", "title")


@query("feed_with_fr", "feed_summary federal_register", """
    WITH dk AS (SELECT 'docket' AS kind, docket_id AS id, title,
                       TRY_CAST(modify_date AS timestamp) AS d
                FROM feed_summary ORDER BY modify_date DESC NULLS LAST, docket_id LIMIT 200),
         fr AS (SELECT 'fr' AS kind, document_number AS id, title,
                       TRY_CAST(publication_date AS timestamp) AS d
                FROM federal_register
                ORDER BY publication_date DESC NULLS LAST, document_number LIMIT 100)
    SELECT kind, id, title, strftime(d, '%Y-%m-%d') AS day
    FROM (SELECT * FROM dk UNION ALL SELECT * FROM fr)
    WHERE d >= (SELECT min(d) FROM dk) AND d >= (SELECT min(d) FROM fr)""")
def _(t):
    dockets = FEED.docket_feed(t("feed_summary"), limit=200)
    notices = t("federal_register").orderBy(
        F.desc_nulls_last("publication_date"), F.asc("document_number")
    ).limit(100)
    rows = FEED.feed_with_fr(dockets, notices)
    return rows.select("kind", "id", "title", D.iso_day(F.col("date")).alias("day"))


@query("deadline_status", "feed_summary", f"""
    WITH x AS (SELECT docket_id, comment_end_date,
        CAST(ceil(date_diff('second', {_NOW}, TRY_CAST(comment_end_date AS timestamp)) / 86400.0) AS bigint) AS days
        FROM feed_summary)
    SELECT docket_id, days, CASE WHEN days < 0 THEN 'closed' WHEN days <= 3 THEN 'red'
                WHEN days <= 12 THEN 'amber' WHEN days IS NOT NULL THEN 'green' END AS state,
           CASE WHEN days < 0 THEN 'Comment period closed' WHEN days <= 0 THEN 'Closes today'
                ELSE days || 'd left' END AS label,
           coalesce(floor(date_diff('second', TRY_CAST(comment_end_date AS timestamp), {_NOW}) / 86400.0)
                    BETWEEN 0 AND 30, false) AS recently_closed
    FROM x""")
def _(t):
    end = F.col("comment_end_date")
    return t("feed_summary").select(
        "docket_id", D.days_until(end, AS_OF).alias("days"), D.deadline_state(end, AS_OF).alias("state"),
        D.deadline_text(end, AS_OF).alias("label"),
        D.recently_closed(end, AS_OF).alias("recently_closed"),
    )


@query("comment_period", "reg_documents", """
    SELECT docket_id, min(nullif(comment_start_date, '')) AS period_start,
           max(nullif(comment_end_date, '')) AS period_end FROM reg_documents GROUP BY 1""")
def _(t):
    from docketscope.operators.lifecycle import comment_period

    return comment_period(t("reg_documents"))


@query("comment_period_progress", "reg_documents", f"""
    WITH p AS (SELECT docket_id, CAST(min(nullif(comment_start_date, '')) AS date) AS s,
                      CAST(max(nullif(comment_end_date, '')) AS date) AS e
               FROM reg_documents GROUP BY 1)
    SELECT docket_id, CASE WHEN e > s THEN CAST(greatest(1, e - s) AS bigint) END AS period_days,
           CASE WHEN e > s THEN round(least(1.0, greatest(0.0,
                CAST(DATE '{AS_OF}' - s AS double) / (e - s))), 6) END AS elapsed
    FROM p""")
def _(t):
    from docketscope.operators.lifecycle import comment_period

    start, end = F.col("period_start"), F.col("period_end")
    return comment_period(t("reg_documents")).select(
        "docket_id", D.period_days(start, end).alias("period_days"),
        F.round(D.period_elapsed(start, end, AS_OF), 6).alias("elapsed"),
    )


# ---------------------------------------------------------------- field clean-up


@query("comment_body", "comments", """
    SELECT comment_id, CASE WHEN comment IS NULL OR trim(comment) = ''
                                 OR lower(trim(comment)) LIKE 'see attached%'
                            THEN coalesce(nullif(trim(text_content), ''), comment)
                            ELSE comment END AS body FROM comments""")
def _(t):
    return t("comments").select(
        "comment_id", comment_body(F.col("comment"), F.col("text_content")).alias("body")
    )


@query("parse_raw_json", "raw_dockets", """
    SELECT docket_id, coalesce(
        nullif(regexp_replace(k, '^"|"$', '', 'g'), ''),
        CASE WHEN NOT json_valid(raw_json) THEN NULL
             ELSE coalesce(TRY(json_extract_string(raw_json, '$.data.attributes.k')),
                           TRY(json_extract_string(raw_json, '$.data.k')),
                           TRY(json_extract_string(raw_json, '$.k'))) END) AS k
    FROM raw_dockets""")
def _(t):
    value = X.with_raw_json_fallback(F.col("k"), F.col("raw_json"), "k")
    return t("raw_dockets").select("docket_id", value.alias("k"))


@query("normalize_source_row", "congress_bills", """
    SELECT nullif(trim(regexp_replace(bill_id, '^"|"$', '', 'g')), '') AS bill_id,
           nullif(trim(regexp_replace(title, '^"|"$', '', 'g')), '') AS title,
           nullif(trim(regexp_replace(latest_action_text, '^"|"$', '', 'g')), '') AS latest_action_text
    FROM congress_bills""")
def _(t):
    return X.normalize_source_row(t("congress_bills").select("bill_id", "title", "latest_action_text"))


@query("comment_attachments", "comments", """
    WITH a AS (SELECT comment_id, unnest(CAST(attachments_json AS JSON[])) AS a
               FROM comments WHERE json_valid(attachments_json)),
         f AS (SELECT comment_id, a->>'$.title' AS title,
                      unnest(CAST(a->'$.formats' AS JSON[])) AS f FROM a)
    SELECT comment_id, coalesce(nullif(title, ''),
                                nullif(string_split(f->>'$.url', '/')[-1], ''), 'Attachment') AS name,
           f->>'$.url' AS url, upper(coalesce(nullif(f->>'$.format', ''), 'file')) AS format
    FROM f WHERE f->>'$.url' <> ''""")
def _(t):
    return X.comment_attachments(t("comments"))


@query("document_attachment", "reg_documents", """
    WITH x AS (SELECT document_id, file_url AS url, string_split(file_url, '/')[-1] AS name
               FROM reg_documents WHERE file_url <> '')
    SELECT document_id, name, url, CASE WHEN contains(name, '.')
           THEN upper(string_split(name, '.')[-1]) ELSE 'FILE' END AS type FROM x""")
def _(t):
    return X.document_attachment(t("reg_documents"))


@query("comment_author", "comments", """
    SELECT comment_id, coalesce(nullif(organization, ''),
             nullif(concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')), ''),
             nullif(title, ''), 'Anonymous') AS author,
           coalesce(organization <> '', false) AS is_org FROM comments""")
def _(t):
    org = F.col("organization")
    author = X.comment_author(org, F.col("first_name"), F.col("last_name"), F.col("title"))
    return t("comments").select("comment_id", author.alias("author"), X.is_organization(org).alias("is_org"))


# ---------------------------------------------------------------------- rollups


@query("build_comments_index", "comments_index", "SELECT * FROM comments_index")
def _(t):
    return t("comments_index")


@query("build_feed_summary", "feed_summary", "SELECT * FROM feed_summary")
def _(t):
    return t("feed_summary")


@query("build_agency_stats", "agency_stats", "SELECT * FROM agency_stats")
def _(t):
    return t("agency_stats")


@query("build_agency_monthly_volume", "agency_monthly_volume", "SELECT * FROM agency_monthly_volume")
def _(t):
    return t("agency_monthly_volume")


_LIFECYCLE = """SELECT kind, docket_id, agency_code, title,
    strftime(proposed_date, '%Y-%m-%d') AS proposed_date,
    strftime(final_date, '%Y-%m-%d') AS final_date, days FROM rulemaking_lifecycles"""


def _lifecycle_rows(t):
    return t("rulemaking_lifecycles").withColumns(
        {c: D.iso_day(F.col(c)) for c in ("proposed_date", "final_date")}
    )


@query("build_rulemaking_lifecycles", "rulemaking_lifecycles", _LIFECYCLE)
def _(t):
    return _lifecycle_rows(t)


@query("rulemaking_pairs", "rulemaking_lifecycles", _LIFECYCLE + " WHERE kind = 'pair'")
def _(t):
    return _lifecycle_rows(t).where("kind = 'pair'")


@query("build_discovery_spike", "discovery_signals", """
    SELECT agency_code, recent_30d, round(baseline, 6) AS baseline, round(ratio, 6) AS ratio
    FROM discovery_signals""")
def _(t):
    return t("discovery_signals").select(
        "agency_code", "recent_30d", F.round("baseline", 6).alias("baseline"),
        F.round("ratio", 6).alias("ratio"),
    )


@query("build_fr_docket_links", "fr_docket_links", "SELECT * FROM fr_docket_links")
def _(t):
    return t("fr_docket_links")


@query("publish_rollups", "comments_index feed_summary agency_stats agency_monthly_volume rulemaking_lifecycles "
       "discovery_signals fr_docket_links", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS rollup, count(*) AS n FROM {n}" + (" WHERE ratio >= 2" if n == "discovery_signals" else "")
    for n in ("comments_index feed_summary agency_stats agency_monthly_volume rulemaking_lifecycles "
              "discovery_signals fr_docket_links").split()))
def _(t):
    paths = R.publish_rollups(
        _folder(t, "rollups"), t("dockets"), t("reg_documents"), t("reg_documents"), t("federal_register"), AS_OF
    )
    rows = None
    for name, path in paths.items():
        part = t.spark.read.parquet(path).agg(F.lit(name).alias("rollup"), F.count("*").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("publish_rollups_rows", "comments_index feed_summary agency_stats agency_monthly_volume rulemaking_lifecycles "
       "discovery_signals fr_docket_links", """
    SELECT 'comments_index' AS rollup, docket_id AS a, concat_ws('-', agency_code, year, month) AS b, row_count AS v
    FROM comments_index
    UNION ALL SELECT 'feed_summary', docket_id, concat_ws('-', agency_code, title, comment_end_date), comment_count
    FROM feed_summary
    UNION ALL SELECT 'agency_stats', agency_code, concat_ws('-', docket_count, document_count), comment_count
    FROM agency_stats
    UNION ALL SELECT 'agency_monthly_volume', agency_code, concat_ws('-', document_type, year, month), document_count
    FROM agency_monthly_volume
    UNION ALL SELECT 'rulemaking_lifecycles', docket_id,
        concat_ws('-', kind, agency_code, title, strftime(proposed_date, '%Y-%m-%d'), strftime(final_date, '%Y-%m-%d')),
        CAST(days AS bigint)
    FROM rulemaking_lifecycles
    UNION ALL SELECT 'discovery_signals', agency_code, CAST(CAST(round(baseline * 12) AS bigint) AS varchar), recent_30d
    FROM discovery_signals WHERE ratio >= 2
    UNION ALL SELECT 'fr_docket_links', docket_id, concat_ws('-', document_number, title, publication_date),
        CAST(length(docket_ids_json) AS bigint)
    FROM fr_docket_links""")
def _(t):
    """The rows of the published rollups, read back from their files."""
    paths = R.publish_rollups(
        _folder(t, "rollups"), t("dockets"), t("reg_documents"), t("reg_documents"), t("federal_register"), AS_OF
    )
    columns = {
        "comments_index": ("docket_id", "agency_code year month", "row_count"),
        "feed_summary": ("docket_id", "agency_code title comment_end_date", "comment_count"),
        "agency_stats": ("agency_code", "docket_count document_count", "comment_count"),
        "agency_monthly_volume": ("agency_code", "document_type year month", "document_count"),
        "rulemaking_lifecycles": ("docket_id", "kind agency_code title proposed_date final_date", "days"),
        "discovery_signals": ("agency_code", "prior", "recent_30d"),
        "fr_docket_links": ("docket_id", "document_number title publication_date", "size"),
    }
    rows = None
    for name, path in paths.items():
        table = t.spark.read.parquet(path)
        if name == "discovery_signals":
            table = table.withColumn("prior", F.round(F.col("baseline") * 12).cast("long"))
        if name == "fr_docket_links":
            table = table.withColumn("size", F.length("docket_ids_json"))
        a, b, v = columns[name]
        part = table.select(
            F.lit(name).alias("rollup"), F.col(a).alias("a"),
            F.concat_ws("-", *[F.col(c).cast("string") for c in b.split()]).alias("b"), F.col(v).cast("long").alias("v"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _refreshed(t, build):
    """A rollup after two snapshots: the older documents, then the others appended to their agencies' folders."""
    base, docs = _folder(t, "incremental"), t("reg_documents")
    early = F.coalesce(F.col("posted_date") < "1997", F.lit(True))
    docs.where(early).write.partitionBy("agency_code").parquet(f"{base}/documents")
    incremental.refresh(t.spark.read.parquet(f"{base}/documents"), f"{base}/rollup", build)
    docs.where(~early).write.mode("append").partitionBy("agency_code").parquet(f"{base}/documents")
    return incremental.refresh(t.spark.read.parquet(f"{base}/documents"), f"{base}/rollup", build).rollup


@query("incremental_comments_index", "comments_index", "SELECT * FROM comments_index")
def _(t):
    return _refreshed(t, R.build_comments_index).select("agency_code", "docket_id", "year", "month", "row_count")


@query("incremental_monthly_volume", "agency_monthly_volume", "SELECT * FROM agency_monthly_volume")
def _(t):
    return _refreshed(t, R.build_agency_monthly_volume)
