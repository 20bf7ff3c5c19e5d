"""Clusters, families, components and findings against known cases and brute force."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from docketscope.functions import text as TX
from docketscope.operators import clusters as CL
from docketscope.operators import families as FM
from docketscope.operators import findings as FN
from docketscope.operators import forms as FR
from docketscope.operators import joins as J
from docketscope.operators.components import connected_components
from docketscope.plans import report as RP

LETTERS = "docket_id string, key string, n bigint, tokens array<string>, first_day date, last_day date"
DAY = dt.date(2026, 5, 27)


def letters(spark, rows):
    return spark.createDataFrame([(d, k, n, sorted(t), DAY, DAY) for d, k, n, t in rows], LETTERS)


def totals(spark, rows):
    return spark.createDataFrame(rows, "docket_id string, total bigint")


def words(*names):
    return [f"word{n}" for n in names]


def test_variants_fold_into_one_family(spark):
    base = words(*range(9))
    data = letters(spark, [("d", "a", 60, base), ("d", "b", 40, [*base, "extra"])])
    row = FM.template_families(data, totals(spark, [("d", 200)])).first()
    assert (row.family_id, row.total_n, row.variant_count, row.share_pct) == ("a", 100, 2, 50.0)


def test_chain_is_single_linkage(spark):
    a, b, c = words(1, 2, 3, 4), words(2, 3, 4, 5), words(3, 4, 5, 6)
    data = letters(spark, [("d", "a", 9, a), ("d", "b", 8, b), ("d", "c", 7, c)])
    row = FM.template_families(data, totals(spark, [("d", 30)]), threshold=0.6).collect()
    assert [(r.family_id, r.variant_count) for r in row] == [("a", 3)]


def test_short_and_empty_sets_do_not_merge(spark):
    data = letters(spark, [("d", "a", 5, words(1, 2, 3)), ("d", "b", 4, words(1, 2, 3, 4)),
                           ("d", "c", 3, []), ("d", "e", 2, [])])
    families = FM.template_families(data, totals(spark, [("d", 20)]), threshold=0.7)
    assert families.count() == 4


def brute_families(rows, threshold):
    parent = {(d, k): (d, k) for d, k, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (d1, k1, _, t1), (d2, k2, _, t2) in itertools.combinations(rows, 2):
        a, b = set(t1), set(t2)
        if d1 != d2 or not a or not b:
            continue
        cut = max(threshold, 0.95) if min(len(a), len(b)) < 4 else threshold
        if len(a & b) / len(a | b) >= cut:
            parent[find((d1, k1))] = find((d2, k2))
    groups = {}
    for d, k, n, _ in rows:
        groups.setdefault(find((d, k)), []).append((-n, k, d))
    return sorted((m[0][2], m[0][1], len(m)) for m in map(sorted, groups.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_families_equal_brute_force(spark, seed):
    """Campaigns of edited copies beside unrelated letters; one docket holds most rows."""
    rng = random.Random(seed)
    rows = []
    for campaign in range(6):
        base = [f"c{campaign}w{i}" for i in range(rng.randint(5, 25))] + words(*range(5))
        for copy in range(20 if campaign == 0 else 6):
            edited = set(base)
            for _ in range(rng.randint(0, 4)):
                edited.discard(rng.choice(base))
                edited.add(f"x{rng.randint(0, 30)}")
            docket = "hot" if campaign < 5 else "small"
            rows.append((docket, f"k{campaign:02}{copy:02}", rng.randint(2, 9), sorted(edited)))
    data = letters(spark, rows)
    sizes = totals(spark, [("hot", 1000), ("small", 100)])
    got = FM.template_families(data, sizes).collect()
    assert sorted((r.docket_id, r.family_id, r.variant_count) for r in got) == brute_families(rows, 0.8)
    pairs = {(r.docket_id, r.hash_a, r.hash_b) for r in FM.template_pairs(data).collect()}
    want = set()
    for (d1, k1, _, t1), (d2, k2, _, t2) in itertools.combinations(rows, 2):
        a, b = set(t1), set(t2)
        if d1 == d2 and len(a & b) / len(a | b) >= (0.95 if min(len(a), len(b)) < 4 else 0.8):
            want.add((d1, min(k1, k2), max(k1, k2)))
    assert pairs == want
    # every bucket crowded, and dealt over blocks of two rows
    pairs = {(r.docket_id, r.hash_a, r.hash_b) for r in FM.template_pairs(data, crowded_pairs=0, block=2).collect()}
    assert pairs == want
    named = FM.families_of(data, crowded_pairs=0, block=2)
    got = named.groupBy("docket_id", "family").count().collect()
    assert sorted((r.docket_id, r.family, r["count"]) for r in got) == brute_families(rows, 0.8)


@pytest.mark.parametrize("threshold", [0.4, 0.6])
def test_crowded_buckets_at_low_thresholds(spark, threshold):
    """At 0.4 two common tokens are not certain, so a bucket is dealt without a second token."""
    rng = random.Random(7)
    rows = [("d", f"k{i:02}", 2 + i % 3, sorted({f"w{rng.randint(0, 14)}" for _ in range(rng.randint(1, 9))})) for i in range(60)]
    got = FM.families_of(letters(spark, rows), threshold, crowded_pairs=0, block=3).groupBy("docket_id", "family").count().collect()
    assert sorted((r.docket_id, r.family, r["count"]) for r in got) == brute_families(rows, threshold)


def test_a_crowded_bucket_of_unlike_letters_is_divided(spark):
    """20,000 letters that share a token and a size band, but no two of which are similar."""
    n = 20_000
    pool = [F.concat(F.lit("p"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)).cast("string")) for i in range(14)]
    own = [F.format_string(f"u%06dx{i}", "id") for i in range(2)]
    rows = spark.range(n).select(
        F.lit("d").alias("docket_id"), F.format_string("k%06d", "id").alias("key"), (2 + F.col("id") % 9).alias("n"),
        F.array_sort(F.array_distinct(F.array(*own, F.lit("shared"), *pool))).alias("tokens"),
    )
    rows = FM._numbered(rows)
    ranked = FM._ranked(rows, 0.8)
    alone = FM.prefix_buckets(ranked).drop("n").withColumns(
        {"label": F.col("id"), "low": F.lit(0.0), "high": F.lit(1.0), "outside": F.lit(True)}
    ).withColumn("most", F.col("shape")["size"] - F.col("pos"))
    buckets = alone.groupBy("h", "band").count()
    largest = buckets.agg(F.max("count")).first()[0]
    divided = FM._split(alone, ranked, 0.8).groupBy("h", "band", "second").count().agg(F.max("count")).first()[0]
    assert largest > 2_000 and divided < largest / 3
    families = FM.families_of(rows, crowded_pairs=100_000, block=500)
    assert families.select("family").distinct().count() == n



def test_a_large_campaign_forms_about_one_pair_per_member(spark):
    """20,000 variants that share all their common tokens, beside some letters of their own."""
    n, base = 20_000, [f"common{i}" for i in range(30)]
    own = F.array(*[F.concat(F.lit(f"v{i}x"), (F.col("id") % (7 + 1000 * i)).cast("string")) for i in range(2)])
    rows = spark.range(n).select(
        F.lit("d").alias("docket_id"), F.format_string("k%06d", "id").alias("key"),
        (2 + F.col("id") % 9).alias("n"), F.array_sort(F.concat(F.array(*map(F.lit, base)), own)).alias("tokens"),
    )
    numbered = FM._numbered(rows)
    ranked = FM._ranked(numbered, 0.8)
    assert FM._leader_pairs(ranked, FM._leaders(ranked), 0.8).count() <= 20 * n
    families = FM.families_of(rows)
    assert families.select("family").distinct().count() == 1 and families.count() == n


@pytest.mark.parametrize("crowded", [FM.CROWDED_PAIRS, 40])
def test_long_letters_equal_brute_force(spark, crowded):
    """Sets of 50 to 700 tokens about the cut-off, which must share several rare tokens; some tokens are crowded, some not."""
    rng = random.Random(crowded)
    rows, pool = [], [f"p{i}" for i in range(900)]
    for campaign in range(14):
        base = rng.sample(pool, rng.choice([50, 100, 250, 500])) + [f"c{campaign}w{i}" for i in range(rng.choice([10, 60, 200]))]
        for copy in range(8):
            edits = int(len(base) * rng.choice([0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.2]))
            kept = rng.sample(base, len(base) - edits)
            rows.append(("d", f"k{campaign:02}{copy}", rng.randint(2, 9), sorted({*kept, *(f"x{rng.randint(0, 400)}" for _ in range(edits))})))
    want = {
        (min(k1, k2), max(k1, k2)): len(a & b) / len(a | b)
        for (k1, a), (k2, b) in itertools.combinations([(k, set(t)) for _, k, _, t in rows], 2) if len(a & b) / len(a | b) >= 0.8
    }
    data = letters(spark, rows)
    got = FM.template_pairs(data, crowded_pairs=crowded, block=7).collect()
    assert len(got) == len(want) > 50 and {(r.hash_a, r.hash_b): r.similarity for r in got} == want
    named = FM.families_of(data, crowded_pairs=crowded, block=7).groupBy("docket_id", "family").count().collect()
    assert sorted((r.docket_id, r.family, r["count"]) for r in named) == brute_families(rows, 0.8)


def test_sets_are_stored_packed_and_few_are_compared(spark):
    """Frequent tokens take two bytes; long unlike letters that share a rare token are not fetched for a comparison."""
    rng = random.Random(3)
    pool = [f"p{i}" for i in range(20_000)]
    rows = [("d", f"k{i:03}", 2, sorted({*rng.sample(pool, 600), f"r{i // 2}"})) for i in range(200)]
    packed = FM._packed(FM._numbered(letters(spark, rows)))
    assert [r[0] for r in packed.letters.select(F.length("packed")).distinct().collect()] == [2 * 601]
    ranked = FM._ranked(packed.letters, 0.8)
    assert FM._bucket_pairs(ranked, None, packed.counts, 0.8, FM.CROWDED_PAIRS, FM.BLOCK_ROWS).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [("x", "y"), ("y", "z")]
    random.Random(0).shuffle(chain)
    roots = connected_components(spark.createDataFrame(chain, "src string, dst string"))
    counts = dict(roots.groupBy("root").count().collect())
    assert counts == {"n0000": 301, "x": 3}
    assert roots.count() == roots.select("node").distinct().count()


def test_components_without_edges(spark):
    none = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert connected_components(none).count() == 0


COMMENTS = "comment_id bigint, docket_id string, comment string, posted_date string"


@pytest.fixture
def small(spark):
    letter = "Please protect our rivers and streams from pollution today"
    rows = [
        (1, "d", letter, "2026-05-01"),
        (2, "d", f"<p>{letter}</p> 20500", "2026-05-02"),
        (3, "d", "today pollution from streams and rivers our protect Please", "2026-05-03"),
        (4, "d", None, "2026-05-04"),
        (5, "d", " ", "bad date"),
        (6, "d", "See attached file(s).", "2026-05-04"),
        (7, "d", "See attached file(s).", "2026-05-04"),
        (8, "e", "Something else entirely, long enough to count", "2026-05-04"),
    ]
    return spark.createDataFrame(rows, COMMENTS)


def test_tiers_coarsen(small):
    ladder = {(r.docket_id, r.tier): r for r in CL.fidelity_ladder(small).collect()}
    assert ladder["d", "exact"].form_letters == 0
    assert ladder["d", "template"].form_letters == 1
    assert ladder["d", "near"].unique_pct == pytest.approx(400 / 7)
    assert ladder["d", "near"].delta_vs_exact == pytest.approx(-300 / 7)
    assert ladder["e", "near"].delta_vs_exact == 0


def test_totals_count_blank_and_missing(small):
    keyed = CL.all_clusters(CL.keyed_comments(small, ("exact",)), ("exact",))
    row = CL.cluster_totals(keyed).where("docket_id = 'd'").first()
    # a missing body has no key; a blank one has
    assert (row.total, row.distinct_keys, row.empty) == (7, 5, 2)


def test_clusters_report_sample_and_days(small):
    rows = {(r.docket_id, r.n): r for r in CL.comment_clusters(small, "near").collect()}
    top = rows["d", 3]
    assert top.sample.startswith("Please protect") and (top.first_day, top.last_day) == ("2026-05-01", "2026-05-03")
    assert top.tokenset == "and from our please pollution protect rivers streams today"


def test_near_never_splits_template(spark, small):
    keyed = CL.keyed_comments(small).where("key_template IS NOT NULL")
    split = keyed.groupBy("key_template").agg(F.countDistinct("key_near").alias("n")).where("n > 1")
    assert split.count() == 0


def test_letters_are_stored_without_their_texts(spark, small):
    near, sums = RP.near_letters(small)
    assert not {"body", "sample", "_raw"} & set(near.columns) and dict(near.dtypes)["tokens"] == "array<bigint>"
    scored = RP.families_with_stance(near, sums, small, min_size=1, support=["protect*"], oppose=["nothing"]).collect()
    assert scored and {r.stance for r in scored} <= {"support", "unclear"} and any(r.support_hits for r in scored)


def test_families_keep_every_comment(spark, small):
    near, sums = RP.near_letters(small)
    families = FM.template_families(near, sums)
    assert families.agg(F.sum("total_n")).first()[0] == near.agg(F.sum("n")).first()[0]


# ------------------------------------------------------------------- text forms

ODD_TEXTS = [
    None, "", " ", "\t\n", "See attached file(s).", "<p>See attached</p>&nbsp;&amp;hellip;", "short & sweet", "a" * 39, "ä" * 40,
    "See attached &lt;b&gt;file&lt;/b&gt; &copy; and" + " " * 300 + "x", "&amp;lt;b&amp;gt; one &lt;two &gt; three & four",
    "<<<p>unclosed < tag > and <> empty <", "Write to a@b.c, @me, you@ or x@@y\nand see HTTPS://Example.org/a?b=1 or (WWW.site) www. end",
    "http:// none https://x prefixhttp://y.z", "Caf\u00e9 M\u00dcLLER \u0130stanbul \u212aelvin \u00a0 nbsp \u2003 wide \u017fharp 12,5",
    "one\x0btwo\x0cthree\x1cfour\x85five\r\nsix", "Dear all zebra apple zebra an of apple Zebra 42 times", "\U0001f600 " * 60, "x" * 500,
    "\U0001f600" * 39, "\u03a3\u03a3 " * 30, "See attached files " + "\u00df" * 20, "1@2 3@4 www.a.b", "I\u0307 i\u0307 \u0130",
]


def test_forms_equal_the_column_functions(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id int, comment string").repartition(2)
    display, skeleton = F.col("d"), TX.text_skeleton(F.col("d"))
    shown = rows.select("id", TX.text_display(F.col("comment")).alias("d"))
    want = shown.select(
        "id", display.alias("display"), F.md5(TX.text_canonical(display)).alias("canonical"), F.md5(skeleton).alias("template"),
        F.md5(TX.text_token_set(skeleton)).alias("near"), TX.text_token_set(skeleton).alias("tokenset"),
        TX.word_count(TX.text_canonical(display)).alias("words"),
        TX.is_placeholder(display).alias("placeholder"), TX.is_placeholder_body(display).alias("placeholder_body"),
    )
    made = FR.with_forms(rows, "comment", FR.FORMS)
    got = made.select(*want.columns[:-2], TX.is_placeholder(F.col("head")).alias("placeholder"),
                      TX.is_placeholder(F.col("body_head")).alias("placeholder_body"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_names_are_masked_in_forms_as_in_columns(spark):
    texts = ["Yours, Ann  Lee\nof Z\u00dcrich ann@x.y lee", "no name here", None, "\u00dcmit wrote \u00fcmit", "An is too short"]
    rows = spark.createDataFrame([(i, t, "Ann", n) for i, t in enumerate(texts) for n in ("Ann Lee", " \u00dcMIT ", "An", None)],
                                 "comment_id int, comment string, first_name string, last_name string")
    rows = rows.withColumns({"docket_id": F.lit("d"), "posted_date": F.lit("2026-05-01")})
    names = ("first_name", "last_name")
    keyed = CL.keyed_comments(rows, name_columns=names)
    skeleton = TX.text_skeleton(TX.text_display(F.col("comment")), [F.col(c) for c in names])
    want = rows.select("comment_id", F.md5(skeleton).alias("key_template"), F.md5(TX.text_token_set(skeleton)).alias("key_near"))
    got = keyed.select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_stored_columns_are_made_without_patterns(small):
    plan = plan_of(RP.comment_precompute(small.withColumn("agency_code", F.lit("a"))))
    assert "MapInArrow" in plan and "regexp_replace" not in plan and "sort_array" not in plan


def test_keys_are_made_without_patterns(small):
    """Exact keys need no form of a text at all."""
    exact = plan_of(CL.all_clusters(CL.keyed_comments(small, ("exact",), flags=False), ("exact",)))
    assert "regexp_replace" not in exact and "MapInArrow" not in exact
    plan = plan_of(CL.fidelity_ladder(small))
    assert "MapInArrow" in plan and "regexp_replace" not in plan and "sort_array" not in plan


def test_samples_are_made_without_patterns(small):
    for tier in TX.TIERS:
        plan = plan_of(CL.comment_clusters(small, tier))
        assert "MapInArrow" in plan and "regexp_replace" not in plan and "sort_array" not in plan


def test_listed_rows_are_found_alike_at_every_size(spark):
    big = spark.range(1000).select(F.col("id").alias("k"), F.lit("text").alias("comment"))
    listed = spark.range(0, 2000, 3).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    found = [J.join_listed(listed, big, ["k"], most, few) for most, few in ((1000, 1000), (1000, 10), (10, 10))]
    assert [f.agg(F.count("*"), F.sum("k")).first() for f in found] == [(334, sum(range(0, 1000, 3)))] * 3
    # a long list is hashed, so that texts are not sorted
    assert "ShuffledHashJoin" in plan_of(found[2]) and "Sort " not in plan_of(found[2])


# --------------------------------------------------------------------- findings

DAILY = [("d", "2026-03-03", 7), ("d", "2026-03-10", 150), ("d", "2026-03-11", 260), ("d", "2026-03-30", 16)]


def burst(spark, daily, total=500, start="2026-03-02", end="2026-04-10", **kw):
    return FN.volume_burst(
        spark.createDataFrame(daily, "docket_id string, day string, n bigint"),
        totals(spark, [("d", total)]),
        spark.createDataFrame([("d", start, end)], "docket_id string, period_start string, period_end string"),
        "2026-03-21",
        **kw,
    ).collect()


def test_burst(spark):
    (row,) = burst(spark, DAILY)
    assert (row.start_day, row.end_day, row["count"], row.pct) == ("2026-03-10", "2026-03-11", 410, 82.0)
    assert (row.period_days, row.period_open, row.days_remaining) == (40, True, 20)


def test_no_burst_in_short_period_or_spread(spark):
    assert burst(spark, DAILY, end="2026-03-04") == []
    spread = [("d", f"2026-03-{d:02}", 4) for d in range(2, 31)]
    assert burst(spark, spread, total=116) == []


def test_burst_threshold_and_first_window_wins(spark):
    daily = [("d", "2026-03-05", 33), ("d", "2026-03-06", 33), ("d", "2026-03-25", 66)]
    (row,) = burst(spark, daily, total=190, share_threshold=34.0)
    assert row.start_day == "2026-03-05"
    assert burst(spark, daily, total=190) == []


FAMILIES = "docket_id string, family_id string, stance string, total_n bigint"


def finding(spark, rows):
    df = spark.createDataFrame([("d", f"f{i}", s, n) for i, (s, n) in enumerate(rows)], FAMILIES)
    found = FN.stance_finding(df).collect()
    return found[0] if found else None


def test_stance_findings(spark):
    row = finding(spark, [("oppose", 60), ("unclear", 20)])
    assert (row.kind, row.stance, row.top_pct) == ("concentrated", "oppose", 75.0)
    row = finding(spark, [("oppose", 70), ("support", 30), ("support", 20)])
    assert (row.kind, row.remainder_stance, row.remainder_count, row.remainder_pct) == ("flip", "support", 50, 100.0)
    row = finding(spark, [("oppose", 44), ("oppose", 42), ("support", 14)])
    assert (row.kind, row.stance, row.pct) == ("lopsided", "oppose", 86.0)
    row = finding(spark, [("oppose", 40), ("support", 30), ("mixed", 30)])
    assert (row.kind, row.support_pct, row.oppose_pct) == ("split", 30.0, 40.0)
    assert finding(spark, [("mixed", 50), ("oppose", 40), ("support", 10)]) is None
    # one template alone cannot be "concentrated"
    assert finding(spark, [("oppose", 77)]).kind == "lopsided"


def test_stance_totals_have_all_labels(spark):
    df = spark.createDataFrame([("d", "a", "mixed", 31), ("d", "b", "support", 12)], FAMILIES)
    row = FN.stance_totals(df).first()
    assert (row.support, row.oppose, row.mixed, row.unclear) == (12, 0, 31, 0)


def test_coverage_adds_up(spark):
    rows = [("d", f"f{i}", 10 - i) for i in range(8)]
    families = spark.createDataFrame(rows, "docket_id string, family_id string, total_n bigint")
    parts = FN.template_coverage(families, totals(spark, [("d", 100)])).collect()
    by_name = {r.segment: r.n for r in parts}
    assert sum(by_name.values()) == 100 and by_name["other"] == 7 and by_name["unique"] == 48
    assert len(parts) == 8


def test_texts_are_read_once_and_do_not_cross_the_shuffle(spark):
    from docketscope.plans import report as RP

    df = spark.createDataFrame(
        [("d1", "a", 1, "I support this rule because clean water matters", "2024-01-01"), ("d2", "b", 2, "I support this rule because clean water matters 7", "2024-01-02"),
         ("d1", "a", 3, None, None), ("d1", "a", 4, "see attached", "2024-01-03")],
        "docket_id string, agency_code string, comment_id int, comment string, posted_date string",
    )
    stance, campaigns = RP.stance_by_template(df), RP.cross_docket_campaigns(df)
    assert sorted((r["n"], r["support_hits"], r["oppose_hits"], r["stance"]) for r in stance.collect()) == [(1, 0, 0, "unclear"), (2, 2, 0, "support")]
    assert [(r["n"], r["dockets"], r["agencies"], r["first_day"], r["last_day"]) for r in campaigns.collect()] == [(2, 2, 2, "2024-01-01", "2024-01-02")]
    for found in (stance, campaigns):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
        # a filter below the text forms would compute them a second time
        assert not any("regexp_replace" in line for line in plan.splitlines() if "Filter" in line)


def test_features_tell_placeholders(spark, tmp_path):
    """All five features of a comment: words, links, greeting, sign-off, placeholder."""
    import __spark_entry__ as entry

    docs = [(1, "Dear all, see https://a.example.org/ on this long enough rule. Thanks", "en", "s"), (2, "No.", "fr", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.comment_id: r for r in entry.queries()["comment_features"](spark, str(tmp_path)).collect()}
    assert set(rows[5].asDict()) == {"comment_id", "words", "links", "greeting", "signoff", "placeholder"}
    # the whole letter, "See attached file(s).", a short text, the same in markup with one more word
    assert [rows[c].placeholder for c in (5, 8, 10, 11)] == [False, True, True, False]


def test_bodies_of_heads_are_met_where_they_lie(spark):
    """Texts are not shuffled to the heads of families, whose texts are read for a stance."""
    comments = spark.range(50).selectExpr("id AS comment_id", "'d' AS docket_id", "concat('text ', id) AS comment")
    heads = spark.createDataFrame([("d", 3, 5), ("d", 9, 4)], "docket_id string, sample_id long, n long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = CL.with_raw(heads, comments)
        assert "Exchange hashpartitioning" not in plan_of(found)
        assert sorted((r["sample_id"], r["n"], r["_raw"]) for r in found.collect()) == [(3, 5, "text 3"), (9, 4, "text 9")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
