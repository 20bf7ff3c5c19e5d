"""Feed, sources, discovery, search, sinks and plan shapes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docketscope.operators import browse as BR
from docketscope.operators import discovery as DS
from docketscope.operators import feed as FEED
from docketscope.operators import lookups as LK
from docketscope.operators import search as SE
from docketscope.plans import rollups as R
from docketscope.sources import dims, sinks, tables
from docketscope.sources.registry import BY_KEY, SOURCES

FEED_SCHEMA = (
    "docket_id string, agency_code string, title string, abstract string, docket_type string, "
    "modify_date string, date_created string, comment_count bigint, comment_end_date string"
)


@pytest.fixture(scope="module")
def feed(spark):
    rows = [
        ("A-1", "EPA", "Clean water", None, "Rulemaking", "2026-05-01", None, 5, "2026-06-03"),
        ("A-2", "FDA", "Engine repair", "x", None, "2026-05-03", "2026-01-01", 9, "2026-05-01"),
        ("A-3", "SEC", "Filings", None, "Nonrulemaking", None, None, 0, None),
        ("A-4", "SEC", "Markets", "stock tips", "Other", "2026-05-02", "2026-05-30", 9, "bad"),
    ]
    return spark.createDataFrame(rows, FEED_SCHEMA)


def ids(df):
    return [r.docket_id for r in df.collect()]


def test_feed_orders(feed):
    assert ids(FEED.docket_feed(feed)) == ["A-2", "A-4", "A-1", "A-3"]
    assert ids(FEED.docket_feed(feed, sort_by="popular")) == ["A-2", "A-4", "A-1", "A-3"]
    assert ids(FEED.docket_feed(feed, sort_by="open", as_of="2026-05-31")) == ["A-1"]
    assert ids(FEED.docket_feed(feed, sort_by="closed", as_of="2026-05-31")) == ["A-2"]


def test_topic_keyword_is_a_substring(feed):
    # "air" occurs in "repair"
    assert set(ids(FEED.docket_feed(feed, topic="environment"))) == {"A-1", "A-2"}


def test_other_type_includes_missing(feed):
    assert set(ids(FEED.docket_feed(feed, docket_type="other"))) == {"A-2", "A-4"}


def test_date_range_column_depends_on_sort(feed):
    assert ids(FEED.docket_feed(feed, date_range="7d", as_of="2026-05-31")) == ["A-4"]
    recent = FEED.docket_feed(feed, date_range="30d", sort_by="closed", as_of="2026-05-31")
    assert ids(recent) == ["A-2"]


@pytest.mark.parametrize("filters", [{}, {"topic": "finance"}, {"docket_type": "other"}, {"agency_code": "sec"}])
def test_count_equals_list_and_pages_do_not_overlap(feed, filters):
    everything = ids(FEED.docket_feed(feed, 100, **filters))
    assert FEED.feed_count(feed, **filters).first()["count"] == len(everything)
    pages = ids(FEED.docket_feed(feed, 2, 0, **filters)) + ids(FEED.docket_feed(feed, 2, 2, **filters))
    assert pages == everything[:4]


def test_feed_page_is_one_top_k(feed):
    plan = FEED.docket_feed(feed, 20, 40)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_merge_floor_hides_rows_older_than_loaded_tail(spark, feed):
    register = spark.createDataFrame(
        [("F1", "t", "2026-05-04"), ("F2", "t", "2026-04-01")], "document_number string, title string, publication_date string"
    )
    rows = FEED.feed_with_fr(feed.where("modify_date IS NOT NULL"), register, True, False).collect()
    assert [r.id for r in rows] == ["F1", "A-2", "A-4", "A-1"]


def test_rail_interleaves(spark):
    surge = spark.createDataFrame([("s1", "A", 9), ("s2", "A", 5)], "docket_id string, agency_code string, delta bigint")
    closing = spark.createDataFrame([("c1", "A", "2026-06-01")], "docket_id string, agency_code string, comment_end_date string")
    spike = spark.createDataFrame([("B", 3.0)], "agency_code string, ratio double")
    talked = spark.createDataFrame([("d1", "A", 7)], "docket_id string, agency_code string, comment_count bigint")
    rail = DS.discovery_rail(surge, closing, spike, talked).orderBy("position").collect()
    assert [r.kind for r in rail] == ["surge", "closing", "spike", "discussed", "surge"]


def test_surge_uses_newest_month_of_the_index(spark, feed):
    index = spark.createDataFrame(
        [("EPA", "A-1", 2026, 1, 40), ("EPA", "A-1", 2025, 12, 10), ("FDA", "A-2", 2025, 12, 99), ("SEC", "zz", 2026, 1, 5)],
        "agency_code string, docket_id string, year bigint, month bigint, row_count bigint",
    )
    rows = DS.discovery_surge(index, feed).collect()
    assert [(r.docket_id, r.title, r.delta) for r in rows] == [("A-1", "Clean water", 30), ("zz", None, 5)]
    assert len(DS.random_dockets(index, 5, 1, 1000).collect()) == 3


def test_lifecycle_pairs_need_a_rule_on_or_after_the_proposal(spark):
    docs = spark.createDataFrame(
        [("d1", "Proposed Rule", "2020-01-10"), ("d1", "Rule", "2019-01-01"), ("d1", "Rule", "2020-03-10"),
         ("d2", "Proposed Rule", "2020-01-01"), ("d3", "Proposed Rule", "2020-01-01"), ("d3", "Rule", "2019-01-01"),
         ("d4", "Rule", "2020-01-01")],
        "docket_id string, document_type string, posted_date string",
    )
    dockets = spark.createDataFrame([(f"d{i}", "A", "t") for i in range(1, 5)], "docket_id string, agency_code string, title string")
    rows = {r.docket_id: (r.kind, r.days) for r in R.build_rulemaking_lifecycles(docs, dockets).collect()}
    assert rows == {"d1": ("pair", 60), "d2": ("stuck", None)}


# ------------------------------------------------------------------- sources


@pytest.mark.parametrize("source", SOURCES, ids=lambda s: s.key)
def test_registry_is_consistent_and_cards_tolerate_missing_values(spark, source):
    assert source.default_sort in source.sorts and source.tiebreak
    columns = set(source.columns) | set(source.search_fields) | {"lobbying_activities_json", "last_modified", "cfr_ref"}
    empty = spark.createDataFrame([(None,) * len(columns)], ", ".join(f"{c} string" for c in sorted(columns)))
    page = BR.source_browse(empty, source, limit=5)
    card = BR.source_cards(page, source).first()
    assert card.title is not None or source.key == "unified-agenda"
    assert [c for c in card.chips if c.label is None] == []


def test_registry_keys_are_unique():
    assert len(BY_KEY) == len(SOURCES) == 10


def bills(spark):
    rows = [
        ("b1", "119", "hr", "2573", "50% off_sale act", "House", "2026-01-02", "x"),
        ("b2", "119", "zz", "1", None, "Senate", "2026-01-03", "y"),
        ("b3", "118", "s", "9", "500 offXsale", "Senate", None, "z"),
    ]
    names = BY_KEY["congress-bills"].columns
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))


def test_browse_search_is_literal_and_filters_are_declared(spark):
    source = BY_KEY["congress-bills"]
    get = lambda **kw: [r.bill_id for r in BR.source_browse(bills(spark), source, **kw).collect()]
    assert get(search="50% OFF_") == ["b1"]
    assert get(filter_values={"congress": "119", "chamber": "Senate"}) == ["b2"]
    assert get(filter_values={"congress": "1 OR 1=1"}) == ["b2", "b1", "b3"]
    assert get(sort_key="oldest") == ["b1", "b2", "b3"]
    assert get(sort_key="nonsense") == ["b2", "b1", "b3"]


def test_bill_card(spark):
    source = BY_KEY["congress-bills"]
    cards = {c.id: c for c in BR.source_cards(bills(spark), source).collect()}
    first = cards["b1"]
    assert [c.label for c in first.chips] == ["H.R. 2573", "119th Congress", "House"]
    assert first.href.endswith("/119th-congress/house-bill/2573") and first.meta_right == "Latest action Jan 2, 2026"
    assert cards["b2"].href is None and cards["b2"].title == "(untitled bill)"


def test_agenda_takes_latest_edition(spark):
    names = BY_KEY["unified-agenda"].columns
    row = lambda rin, ed: (rin, "t", "a", "n", "s", "st", "p", ed, "2026-01-01", "u")
    agenda = spark.createDataFrame([row("R1", "202404"), row("R1", "202410"), row("R2", "202404")], ", ".join(f"{c} string" for c in names))
    links = spark.createDataFrame(
        [("d", '["R1","R2"]'), ("d", '["R1"]'), ("e", "[]"), ("f", None), ("g", "junk")],
        "docket_id string, regulation_id_numbers_json string",
    )
    rows = BR.agenda_for_docket(links, agenda, "d").collect()
    assert [(r.rin, r.agenda_edition) for r in rows] == [("R1", "202410"), ("R2", "202404")]
    assert BR.agenda_for_docket(links, agenda).count() == 2


def test_litigation_needs_a_full_name(spark):
    names = BY_KEY["court-dockets"].columns
    suit = lambda i, case, day: (i, case, "c", "n", day, None, None, None, None, "u")
    suits = spark.createDataFrame(
        [suit("1", "Doe v. Environmental Protection Agency", "2024-01-01"), suit("2", "X v. Department of Energy", "2024-01-02"),
         suit("3", "Sub-environmental protection agencyx", "2024-01-03"), suit("4", "EPA", None)],
        ", ".join(f"{c} string" for c in names),
    )
    assert BR.litigation_for_agency(suits, "EPA").count() == 0
    agencies = spark.createDataFrame(
        [("EPA", "Environmental Protection Agency"), ("DOE", "Department of Energy"), ("ED", "ED"), ("DOI", "Department of Interior")],
        "agency_code string, name string",
    )
    found = {(r.agency_code, r.cl_docket_id) for r in BR.litigation_all_agencies(suits, agencies).collect()}
    assert found == {("EPA", "1"), ("EPA", "3"), ("DOE", "2")}


def test_stats_skip_missing_tables(spark, tmp_path):
    bills(spark).write.parquet(str(tmp_path / "congress_bills.parquet"))
    found = tables.scan_sources(spark, str(tmp_path), [s.table for s in SOURCES])
    assert [(r.tbl, r.n, r.latest) for r in BR.source_stats(found).collect()] == [("congress_bills", 3, "2026-01-03")]


def test_departments_match_agencies(spark):
    dept = dims.department_dim(spark)
    assert dept.count() == dept.select("agency_code").distinct().count()
    peers = dims.curated_peer_dim(spark)
    assert peers.where("agency_code = 'EPA'").count() == 4


# -------------------------------------------------------------------- search


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("1", "EPA", "Vehicle emission standards", "Rulemaking", "2026-01-01", "Limits for heavy trucks"),
        ("2", "EPA", "Truck brakes", "Rulemaking", "2026-02-01", "The emission of noise and emissions tests"),
        ("3", "FDA", "Food labels", "Rulemaking", "2026-03-01", None),
        ("4", "FDA", "Vehicle emission inventory", "Other", "2026-04-01", "Counting"),
    ]
    corpus = spark.createDataFrame(
        rows, "docket_id string, agency_code string, title string, docket_type string, modify_date string, abstract string"
    )
    return SE.search_index_build(corpus)


def found(df):
    return [r.docket_id for r in df.collect()]


def test_title_outranks_abstract(index):
    assert found(SE.docket_search(index, "emission"))[-1] == "2"
    assert found(SE.docket_search(index, "")) == []


def test_prefix_and_fuzzy_match_below_exact(index):
    rows = SE.docket_search(index, "emission").collect()
    assert rows[-1].matched_terms == ["emission", "emissions"]
    assert found(SE.docket_search(index, "emision"))[0] in ("1", "4")
    assert found(SE.docket_search(index, "lab")) == ["3"]
    # a fifth of a four-letter word rounds to one edit
    assert found(SE.docket_search(index, "fodd")) == ["3"]


def test_search_filters_sorts_and_counts(index):
    assert found(SE.docket_search(index, "vehicle", agency_code="FDA")) == ["4"]
    assert found(SE.docket_search(index, "emission", sort_by="recency")) == ["4", "2", "1"]
    assert SE.docket_search_total(index, "emission").first().total == 3
    assert SE.docket_search_total(index, "emission", "EPA").first().total == 2


def test_suggest(index):
    assert [r.suggestion for r in SE.docket_suggest(index, "vehi").collect()] == ["vehicle"]
    assert SE.docket_suggest(index, "v").count() == 0


def test_related_uses_topical_title_words(one, index):
    assert one(SE.title_terms, "Notice of the Proposed Vehicle Emission Standards Rule") == ["standards", "emission", "vehicle"]
    assert found(SE.related_dockets(index, "1"))[0] == "4"


def test_snippet(one):
    long = "a" * 300 + " target " + "b" * 300
    text = one(lambda t: SE.search_snippet(t, F.array(F.lit("Target"))), long)
    assert text.startswith("…") and text.endswith("…") and "target" in text and len(text) == 242
    assert one(lambda t: SE.search_snippet(t, F.array(F.lit("zzz"))), long) == "a" * 240 + "…"
    assert one(lambda t: SE.search_snippet(t, F.array(F.lit("x"))), "short") == "short"


def test_search_index_round_trip(spark, index, tmp_path):
    index.write(str(tmp_path))
    stored = SE.SearchIndex.read(spark, str(tmp_path))
    assert found(SE.docket_search(stored, "emission")) == found(SE.docket_search(index, "emission"))


# ---------------------------------------------------------------------- sinks


def comments(spark):
    rows = [
        ("c1", "D-1", "EPA", 'He said "no", twice', "2026-01-02", '"Jane"', None),
        ("c2", "D-1", "EPA", "line\nbreak", "2026-01-03", None, ""),
        ("c3", "D-2", "001", " padded ", "2026-01-01", "x", "y"),
    ]
    return spark.createDataFrame(
        rows, "comment_id string, docket_id string, agency_code string, comment string, posted_date string, first_name string, last_name string"
    )


def test_csv_lines(spark):
    lines = [r.line for r in sinks.csv_lines(comments(spark)).collect()]
    assert lines == [
        'c1,D-1,EPA,"He said ""no"", twice",2026-01-02,Jane,',
        'c2,D-1,EPA,"line\nbreak",2026-01-03,,',
        "c3,D-2,001, padded ,2026-01-01,x,y",
    ]


def test_csv_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.sink_csv(comments(spark).coalesce(1), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = {r.comment_id: r for r in back.collect()}
    assert rows["c1"].comment == 'He said "no", twice' and rows["c2"].comment == "line\nbreak"
    assert rows["c3"].comment == " padded " and rows["c1"].first_name == "Jane" and rows["c2"].last_name is None


def test_mirror_keeps_codes_as_text_and_prunes_by_agency(spark, tmp_path):
    path = f"{tmp_path}/comments/agency"
    sinks.write_comments_mirror(comments(spark), path)
    mirror = tables.scan_comments_partitioned(spark, str(tmp_path))
    assert sorted(r.agency_code for r in mirror.select("agency_code").distinct().collect()) == ["001", "EPA"]
    one_agency = tables.scan_comments_partitioned(spark, str(tmp_path), "EPA")
    assert one_agency.count() == 2
    plan = one_agency._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(agency_code" in plan


def test_partition_lookup_uses_the_index(spark):
    index = spark.createDataFrame([("EPA", "D-1", 2026, 1, 2)], "agency_code string, docket_id string, year bigint, month bigint, row_count bigint")
    assert LK.resolve_comment_partitions(comments(spark), index, '"d-1"').count() == 2
    assert LK.resolve_comment_partitions(comments(spark), index, "D-2").count() == 0


def test_partition_lookup_reads_only_the_docket_s_agency_folder(spark, tmp_path):
    sinks.write_comments_mirror(comments(spark), f"{tmp_path}/comments/agency")
    index = spark.createDataFrame([("EPA", "D-1", 1)], "agency_code string, docket_id string, row_count bigint")
    index.write.parquet(f"{tmp_path}/index")
    mirror = tables.scan_comments_partitioned(spark, str(tmp_path))
    rows = LK.export_comments(mirror, '"d-1"', index=spark.read.parquet(f"{tmp_path}/index"))
    assert "dynamicpruning" in rows._jdf.queryExecution().optimizedPlan().toString().lower() or "dynamicpruning" in plan_of(rows).lower()
    assert rows.count() == 2
    assert LK.export_comments(comments(spark), "d-1").count() == LK.export_comments(comments(spark), "D-1").count() == 2
    assert LK.comments_for_docket(mirror, '"D-1"').count() == 2


def test_bundles(spark, tmp_path):
    dockets = spark.createDataFrame(
        [("EPA", "D-1", '"A title"'), ("001", "D-2", None)], "agency_code string, docket_id string, title string"
    )
    documents = spark.createDataFrame(
        [("EPA", "x", "D-1", "t", "2026-01-01")],
        "agency_code string, document_id string, docket_id string, title string, posted_date string",
    )
    rows = sinks.docket_bundle(dockets, documents, comments(spark), '"d-1"').collect()
    assert [r.section for r in rows] == ["docket", "documents", "comments", "comments"]
    assert json.loads(rows[0].record) == {"agency_code": "EPA", "docket_id": "D-1", "title": "A title"}
    assert [json.loads(r.record)["comment_id"] for r in rows[2:]] == ["c2", "c1"]
    path = str(tmp_path / "all")
    sinks.sink_json_bundles(dockets, documents, comments(spark), path)
    stored = spark.read.json(path).groupBy("docket_id", "section").count().collect()
    assert {(r.docket_id, r.section): r["count"] for r in stored} == {
        ("D-1", "docket"): 1, ("D-1", "documents"): 1, ("D-1", "comments"): 2, ("D-2", "docket"): 1, ("D-2", "comments"): 1,
    }
    assert all(name.startswith(("agency_code=", "_", ".")) for name in os.listdir(path))


def test_bundle_files_are_compressed(spark, tmp_path):
    one = spark.createDataFrame([("EPA", "D-1", "t")], "agency_code string, docket_id string, title string")
    sinks.sink_json_bundles(one, one, one, str(tmp_path / "all"))
    names = [name for name in os.listdir(tmp_path / "all" / "agency_code=EPA") if not name.startswith(".")]
    assert names and all(name.endswith(".json.gz") for name in names)
    assert spark.read.json(str(tmp_path / "all")).count() == 3


def test_contract_rejects_missing_required_and_fills_optional(spark):
    full = tables.conform(comments(spark), "comments")
    assert "attachments_json" in full.columns and full.first().attachments_json is None
    with pytest.raises(ValueError, match="comment"):
        tables.conform(comments(spark).drop("comment"), "comments")


def test_search_corpus_from_gzip_json(spark, tmp_path):
    import gzip

    payload = {"version": "1", "count": 2, "docs": [
        {"id": "A", "a": "EPA", "t": "T", "x": "Rulemaking", "d": "2026-01-01"},
        {"id": "B", "a": "FDA", "t": "U", "x": "Other", "d": "2026-01-02", "s": "text"}]}
    with gzip.open(tmp_path / "corpus.json.gz", "wt") as f:
        json.dump(payload, f)
    rows = {r.docket_id: r.abstract for r in tables.scan_search_corpus(spark, str(tmp_path / "corpus.json.gz")).collect()}
    assert rows == {"A": "", "B": "text"}


# ----------------------------------------------------------------- plan shapes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_per_docket_is_cut_before_the_shuffle(spark):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["documents_for_docket"](spark, "/root/testdata/sf0.001"))
    assert plan.count("WindowGroupLimit") == 2


def test_texts_are_not_shuffled_for_samples(spark):
    from docketscope.operators import clusters as CL

    rows = spark.range(100).selectExpr("id AS comment_id", "'d' AS docket_id", "concat('some longer text ', id % 7) AS comment", "'2026-01-01' AS posted_date")
    plan = plan_of(CL.comment_clusters(rows, "near"))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_a_long_list_falls_back_to_a_shuffle_join(spark):
    from docketscope.operators.joins import keep_listed

    big, listed = spark.range(1000).toDF("k"), spark.range(0, 1000, 3).toDF("k")
    short, long = (keep_listed(big, listed, ["k"], n) for n in (1000, 10))
    assert short.count() == long.count() == 334


def test_scans_read_only_needed_columns(spark):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["build_agency_monthly_volume"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string,l_shipdate:timestamp" in plan
