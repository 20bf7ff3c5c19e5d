"""Rollups refreshed by partition: equal to a rebuild, unchanged folders unread."""

from docketscope.plans import incremental, rollups

DOCS = "document_id string, docket_id string, agency_code string, document_type string, posted_date string, extra int"


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, DOCS).write.mode(mode).partitionBy("agency_code").parquet(path)


def rows_of(df):
    names = ["agency_code", "docket_id", "year", "month", "row_count"]
    return sorted(map(repr, df.select(*names).collect()))


def test_two_snapshots_equal_a_rebuild(spark, tmp_path):
    source, base = str(tmp_path / "docs"), str(tmp_path / "rollup")
    write(spark, source, [(f"x{i}", f"d{i % 7}", f"A{i % 4}", "Rule", f"2024-0{1 + i % 5}-01", i) for i in range(200)])
    write(spark, source, [("n1", "d1", None, "Rule", "2024-01-01", 0), ("n2", None, "A1", "Rule", None, 0)])
    first = incremental.refresh(spark.read.parquet(source), base, rollups.build_comments_index)
    assert set(first.changed) == {"A0", "A1", "A2", "A3", None}
    assert rows_of(first.rollup) == rows_of(rollups.build_comments_index(spark.read.parquet(source)))

    write(spark, source, [("y1", "d1", "A2", "Rule", "2024-02-01", 1), ("y2", "d9", "A9", "Rule", "2024-02-01", 1)])
    second = incremental.refresh(spark.read.parquet(source), base, rollups.build_comments_index)
    assert set(second.changed) == {"A2", "A9"}
    plan = second.read.select("docket_id")
    assert plan.select("docket_id").where("docket_id IS NOT NULL").count() == 52
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [agency_code" in scan and "A2" in scan
    assert rows_of(second.rollup) == rows_of(rollups.build_comments_index(spark.read.parquet(source)))

    again = incremental.refresh(spark.read.parquet(source), base, rollups.build_comments_index)
    assert again.changed == [] and rows_of(again.rollup) == rows_of(second.rollup)


def test_a_failed_run_leaves_the_last_state(spark, tmp_path):
    source, base = str(tmp_path / "docs"), str(tmp_path / "rollup")
    write(spark, source, [("a", "d", "A", "Rule", "2024-01-01", 0), ("b", "d", "B", "Rule", "2024-01-01", 0)])
    incremental.refresh(spark.read.parquet(source), base, rollups.build_comments_index)
    write(spark, source, [("c", "d", "B", "Rule", "2024-01-01", 0)])

    def broken(df):
        raise RuntimeError("lost")

    try:
        incremental.refresh(spark.read.parquet(source), base, broken)
    except RuntimeError:
        pass
    done = incremental.refresh(spark.read.parquet(source), base, rollups.build_comments_index)
    assert done.changed == ["B"]
    assert rows_of(done.rollup) == rows_of(rollups.build_comments_index(spark.read.parquet(source)))


def test_a_folder_that_is_gone_drops_out(spark, tmp_path):
    source, base = str(tmp_path / "docs"), str(tmp_path / "rollup")
    write(spark, source, [("a", "d", "A", "Rule", "2024-01-01", 0), ("b", "d", "B", "Rule", "2024-01-01", 0)])
    incremental.refresh(spark.read.parquet(source), base, rollups.build_comments_index)
    kept = spark.read.parquet(source).where("agency_code = 'A'")
    left = incremental.refresh(kept, base, rollups.build_comments_index)
    assert left.changed == [] and [r["agency_code"] for r in left.rollup.collect()] == ["A"]
