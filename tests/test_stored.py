"""Stored comment keys: same rows as the direct plans, read without shuffles or patterns."""

import re

import pytest

from pyspark.sql import functions as F

from docketscope.functions import text as TX
from docketscope.operators import clusters as CL
from docketscope.operators import forms as FR
from docketscope.operators import joins as J
from docketscope.plans import report as RP
from docketscope.plans import stored as SK

COMMENTS = "comment_id string, docket_id string, agency_code string, comment string, posted_date string, extra string"


def rows():
    letter = "I support this rule because clean water matters to every family in our town"
    out = []
    for i in range(40):
        text = letter if i % 2 else f"{letter} {i}!"  # digits and marks leave the skeleton alone
        out.append((f"c{i:03}", f"d{i % 3}", f"a{i % 2}", text, f"2024-01-{1 + i % 9:02}", None))
    out += [
        ("c900", "d0", "a0", None, None, "x"), ("c901", "d0", "a0", "", "2024-02-01", "x"),
        ("c902", "d1", None, "see attached", "bad", "x"), ("c903", None, "a0", letter, "2024-03-01", "x"),
        ("c904", "d2", "a1", "<p>Oppose &amp; withdraw this rule at once, it would ruin our farms</p>", "2024-01-05", "x"),
        ("c905", "d2", "a1", "word " * 20_000, "2024-01-05", "x"),
    ]
    return out


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    comments = spark.createDataFrame(rows(), COMMENTS)
    return comments, SK.store_keys(comments, str(tmp_path_factory.mktemp("keys") / "t"), buckets=3)


def same(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    order = lambda df: sorted(map(repr, df.select(*names).collect()))
    assert order(got) == order(want)


def test_stored_reports_equal_the_direct_ones(both):
    comments, keys = both
    direct = CL.all_clusters(CL.keyed_comments(comments))
    for tier in ("exact", "template", "near"):
        same(SK.stored_clusters(keys, tier), direct.where(f"tier = '{tier}'"))
    same(SK.stored_orchestration(keys), CL.orchestration_stats(direct))
    same(SK.stored_stance(keys), RP.stance_by_template(comments))
    same(SK.stored_campaigns(keys), RP.cross_docket_campaigns(comments))
    listed = SK.stored_comment_clusters(keys, "near").where("docket_id IS NOT NULL")
    same(listed, CL.comment_clusters(comments, "near"))


def test_plans_have_no_shuffle_and_no_patterns(both):
    _, keys = both
    for df in (SK.stored_clusters(keys, "near"), SK.stored_clusters(keys, "template"), SK.stored_campaigns(keys)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert not re.search("regexp|rlike", plan)
    for df in (SK.stored_comment_clusters(keys), SK.stored_orchestration(keys), SK.stored_stance(keys)):
        assert not re.search("regexp|rlike", df._jdf.queryExecution().executedPlan().toString())


def test_tables_open_again_and_copies_are_one_row(both, spark):
    _, keys = both
    again = SK.open_keys(spark, keys.base, 3)
    same(SK.stored_clusters(again, "near"), SK.stored_clusters(keys, "near"))
    campaign = keys.table("letters").orderBy("rows", ascending=False).first()
    assert campaign["rows"] > 5  # every variant of the letter in that docket and agency


def test_no_comments(spark, tmp_path):
    keys = SK.store_keys(spark.createDataFrame([], COMMENTS), str(tmp_path / "t"), buckets=2)
    assert SK.stored_clusters(keys, "near").count() == 0 and SK.stored_campaigns(keys).count() == 0
    assert SK.stored_stance(keys).count() == 0 and SK.stored_orchestration(keys).count() == 0


def test_only_texts_of_repeated_ids_are_grouped(spark, tmp_path, monkeypatch):
    twice = [("c1", "d0", "a0", "Please stop this rule before it ruins us", "2024-01-05", "x"), ("c1", "d0", "a0", "Another text under the same id, and longer", "2024-01-06", "x"),
             ("c2", "d1", "a0", "A letter of its own, about clean water", "2024-01-07", "x")]
    grouped = []
    plain = type(spark.range(0)).groupBy
    monkeypatch.setattr(type(spark.range(0)), "groupBy", lambda df, *by: grouped.append(df.columns) or plain(df, *by))
    SK.store_keys(spark.createDataFrame(twice[1:], COMMENTS), str(tmp_path / "one"), buckets=2)
    assert ["comment_id", "comment"] not in grouped
    keys = SK.store_keys(spark.createDataFrame(twice, COMMENTS), str(tmp_path / "two"), buckets=2)
    assert ["comment_id", "comment"] in grouped
    bodies = sorted((r["comment_id"], r["body"]) for r in keys.speakers().collect())
    assert bodies == [("c1", twice[1][3]), ("c2", twice[2][3])]


def test_a_long_list_of_speakers_is_a_table_of_bits(spark, both, tmp_path):
    """More speakers than are broadcast: all are stored, their texts are not shuffled, the reports are the same."""
    comments, keys = both
    long = SK.store_keys(comments, str(tmp_path / "t"), buckets=3, max_rows=0)
    assert set(keys.speakers().columns) == {"comment_id", "body", "support_hits", "oppose_hits", "stance"}
    assert {tuple(r) for r in keys.speakers().collect()} <= {tuple(r) for r in long.speakers().collect()}
    same(SK.stored_stance(long), SK.stored_stance(keys))
    same(SK.stored_comment_clusters(long), SK.stored_comment_clusters(keys))
    big = spark.range(1000).selectExpr("id AS k", "concat('text ', id) AS comment")
    listed = spark.range(0, 1000, 3).selectExpr("id AS k")
    found = J.keep_possible(big, listed, "k", 0, 1 << 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    kept = {r.k for r in found.collect()}
    assert kept >= set(range(0, 1000, 3)) and len(kept) < 400


def test_texts_that_are_displayed_keep_their_marks(spark):
    rows = spark.createDataFrame([(1, "&amp;lt;b&amp;gt;bold&amp;lt;/b&amp;gt; words for all, see <i>this</i>")], "id int, comment string")
    shown = rows.select("id", TX.text_display(F.col("comment")).alias("body"))
    want = shown.select("body", TX.text_token_set(TX.text_skeleton(F.col("body")))).first()
    assert tuple(FR.with_forms(shown, "body", ("display", "tokenset"), displayed=True).select("display", "tokenset").first()) == tuple(want)
