"""Comment text, clusters, families, stance and findings."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from docketscope.functions import stance as ST
from docketscope.functions import text as TX
from docketscope.operators import clusters as CL
from docketscope.operators import families as FM
from docketscope.operators import findings as FN
from docketscope.plans import report as RP
from docketscope.plans import stored as SK
from docketscope.session import ensure_checkpoint_dir
from workload.catalog import AS_OF_2024, TEXT_SQL, query

# Cue words that occur in the test texts; the library's own lexicon does not.
SUPPORT = ["el", "with*", "this is", "die*", "rewh"]
OPPOSE = ["la", "are*", "for the", "les"]
MIN_FAMILY = 3


# The entities a display text resolves, in this order.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")]


def with_display(source: str) -> str:
    """A subquery that adds ``display``, one step per lateral alias."""
    steps = ["regexp_replace(comment, '<[^>]+>', ' ', 'g') AS d0"]
    steps += [f"replace(d{k}, '{entity}', '{char}') AS d{k + 1}" for k, (entity, char) in enumerate(ENTITIES)]
    steps.append(f"trim(regexp_replace(d{len(ENTITIES)}, '\\s+', ' ', 'g')) AS display")
    aliases = ", ".join(f"d{k}" for k in range(len(ENTITIES) + 1))
    return f"(SELECT * EXCLUDE ({aliases}) FROM (SELECT *, {', '.join(steps)} FROM {source}))"


def with_contacts(source: str) -> str:
    """Adds ``plain``: lower case without mail addresses and links."""
    return f"""(SELECT * EXCLUDE (unmailed), regexp_replace(unmailed, 'https?://\\S+|www\\.\\S+', ' ', 'g') AS plain
        FROM (SELECT *, regexp_replace(lower(display), '\\S+@\\S+', ' ', 'g') AS unmailed FROM {source}))"""


def placeholder_sql(c: str) -> str:
    clean = f"lower(trim({c}))"
    return (
        f"(length({clean}) < 20 OR regexp_matches({clean}, '^see attached( file(s)?)?\\.?$') "
        f"OR ({clean} LIKE 'see attached%' AND length({clean}) < 40))"
    )


def hits_sql(c: str, phrases: list[str]) -> str:
    return " + ".join(
        f"len(regexp_extract_all({c}, '\\b{ST.phrase_body(p).replace(chr(92) + ' ', ' ')}\\b'))" for p in phrases
    )


def stance_sql(s: str, o: str) -> str:
    return (
        f"CASE WHEN {s} = 0 AND {o} = 0 THEN 'unclear' WHEN {s} > 0 AND {o} > 0 THEN 'mixed' "
        f"WHEN {s} > 0 THEN 'support' ELSE 'oppose' END"
    )


_BODY = ("trim(regexp_replace(regexp_replace(regexp_replace(display, '<[^>]+>', ' ', 'g'), "
         "'(?i)&[a-z]+;', ' ', 'g'), '\\s+', ' ', 'g'))")

TEXT_SQL["forms"] = (["comments"], f"""
    WITH skeletons AS (
      SELECT *, trim(regexp_replace(plain, '[^a-z]+', ' ', 'g')) AS skeleton
      FROM {with_contacts(with_display('comments'))}),
    words AS (
      SELECT comment_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS kept
      FROM (SELECT comment_id, unnest(string_split(skeleton, ' ')) AS w FROM skeletons) WHERE length(w) > 2 GROUP BY 1)
    SELECT s.*, CASE WHEN skeleton IS NOT NULL THEN coalesce(kept, '') END AS tokenset
    FROM skeletons s LEFT JOIN words USING (comment_id)""")
TEXT_SQL["keyed"] = (["forms"], f"""
    SELECT docket_id, comment_id, TRY_CAST(posted_date AS date) AS day,
           comment IS NULL OR trim(comment) = '' AS blank,
           coalesce({placeholder_sql('display')}, true) AS ph,
           coalesce({placeholder_sql(_BODY)}, true) AS phb,
           md5(lower(trim(comment))) AS k_exact, md5(skeleton) AS k_template, md5(tokenset) AS k_near
    FROM forms""")
TEXT_SQL["clusters"] = (["keyed"], """
    SELECT docket_id, tier, key, count(*) AS rows_, count(*) FILTER (blank) AS empty,
           count(*) FILTER (NOT blank) AS n, min(comment_id) FILTER (NOT blank) AS sample_id,
           arg_min(ph, comment_id) FILTER (NOT blank) AS ph,
           arg_min(phb, comment_id) FILTER (NOT blank) AS phb,
           min(day) FILTER (NOT blank) AS first_day, max(day) FILTER (NOT blank) AS last_day
    FROM (SELECT *, 'exact' AS tier, k_exact AS key FROM keyed
          UNION ALL SELECT *, 'template', k_template FROM keyed
          UNION ALL SELECT *, 'near', k_near FROM keyed)
    GROUP BY 1, 2, 3""")
TEXT_SQL["totals"] = (["clusters"], """
    SELECT docket_id, tier, CAST(sum(rows_) AS bigint) AS total, count(key) AS distinct_keys,
           CAST(sum(empty) AS bigint) AS empty FROM clusters GROUP BY 1, 2""")
TEXT_SQL["letters"] = (["clusters", "forms"], """
    SELECT c.docket_id, key, n, first_day, last_day, display AS body,
           CASE WHEN tokenset = '' THEN [] ELSE string_split(tokenset, ' ') END AS tokens
    FROM clusters c JOIN forms f ON f.comment_id = c.sample_id
    WHERE tier = 'near' AND n >= 2 AND NOT phb""")
TEXT_SQL["edges"] = (["letters"], """
    SELECT docket_id, a, b, shared / (na + nb - shared) AS similarity
    FROM (SELECT x.docket_id, x.key AS a, y.key AS b, len(x.tokens) AS na, len(y.tokens) AS nb,
                 len(list_intersect(x.tokens, y.tokens)) AS shared
          FROM letters x JOIN letters y ON x.docket_id = y.docket_id AND x.key <> y.key
            -- sets whose sizes differ by more cannot reach 0.8
            AND len(x.tokens) >= 0.8 * len(y.tokens) AND len(y.tokens) >= 0.8 * len(x.tokens))
    WHERE na > 0 AND nb > 0
      AND shared / (na + nb - shared) >= CASE WHEN na < 4 OR nb < 4 THEN 0.95 ELSE 0.8 END""")
TEXT_SQL["reach"] = (["letters", "edges"], """
    SELECT docket_id, key AS a, key AS b FROM letters
    UNION
    SELECT r.docket_id, r.a, e.b FROM reach r
    JOIN edges e ON e.docket_id = r.docket_id AND e.a = r.b""")
TEXT_SQL["families"] = (["reach", "letters", "totals"], """
    WITH head AS (
      SELECT r.docket_id, r.a, arg_min(r.b, (-l.n, r.b)) AS family_id
      FROM reach r JOIN letters l ON l.docket_id = r.docket_id AND l.key = r.b GROUP BY 1, 2)
    SELECT h.docket_id, family_id, CAST(sum(l.n) AS bigint) AS total_n,
           sum(l.n) / any_value(t.total) * 100 AS share_pct, count(*) AS variant_count,
           min(first_day) AS first_day, max(last_day) AS last_day
    FROM head h JOIN letters l ON l.docket_id = h.docket_id AND l.key = h.a
    JOIN totals t ON t.docket_id = h.docket_id AND t.tier = 'near' GROUP BY 1, 2""")
TEXT_SQL["scored"] = (["families", "letters"], f"""
    SELECT *, {stance_sql('support_hits', 'oppose_hits')} AS stance FROM (
      SELECT f.*, {hits_sql('lower(body)', SUPPORT)} AS support_hits,
             {hits_sql('lower(body)', OPPOSE)} AS oppose_hits
      FROM families f JOIN letters l ON l.docket_id = f.docket_id AND l.key = f.family_id
      WHERE total_n >= {MIN_FAMILY})""")
_SUMS = ", ".join(
    f"CAST(coalesce(sum(total_n) FILTER (stance = '{s}'), 0) AS bigint) AS {s}" for s in ST.STANCES
)
TEXT_SQL["stances"] = (["scored"], f"""
    SELECT docket_id, {_SUMS}, CAST(sum(total_n) AS bigint) AS covered, count(*) AS templates
    FROM scored GROUP BY 1""")


def _dominant(cols: list[str]) -> str:
    best = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(
        f"WHEN {c} = {best} THEN '{s}'" for c, s in zip(cols, ST.STANCES, strict=True)
    ) + " END"


_R = [f"r_{s}" for s in ST.STANCES]
TEXT_SQL["finding"] = (["scored", "stances"], f"""
    WITH top AS (SELECT docket_id, arg_min(stance, (-total_n, family_id)) AS ts, max(total_n) AS tn
                 FROM scored GROUP BY 1),
    a AS (SELECT s.*, ts, tn, covered - tn AS rest_n,
                 {', '.join(f"{s} - CASE WHEN ts = '{s}' THEN tn ELSE 0 END AS r_{s}" for s in ST.STANCES)},
                 {_dominant(list(ST.STANCES))} AS plurality,
                 greatest({', '.join(ST.STANCES)}) / covered * 100 AS ppct, tn / covered * 100 AS tpct,
                 support / covered * 100 AS spct, oppose / covered * 100 AS opct
          FROM stances s JOIN top USING (docket_id)),
    b AS (SELECT *, CASE WHEN rest_n > 0 THEN {_dominant(_R)} END AS rest,
                 CASE WHEN rest_n > 0 THEN greatest({', '.join(_R)}) / rest_n * 100 ELSE 0 END AS rpct,
                 plurality IN ('support', 'oppose') AS dir FROM a),
    c AS (SELECT *, dir AND ts = plurality AND tpct >= 50 AND templates > 1 AS carried FROM b),
    d AS (SELECT *, CASE WHEN carried AND coalesce(rest IN ('support', 'oppose') AND rest <> plurality, false)
                         THEN 'flip' WHEN carried THEN 'concentrated'
                         WHEN dir AND ppct >= 80 THEN 'lopsided'
                         WHEN spct >= 25 AND opct >= 25 THEN 'split' END AS kind FROM c)
    SELECT docket_id, kind, CASE WHEN kind <> 'split' THEN plurality END AS stance,
           CASE WHEN kind = 'split' THEN greatest(spct, opct) ELSE ppct END AS pct,
           CASE WHEN kind <> 'split' THEN templates END AS template_count,
           CASE WHEN kind IN ('flip', 'concentrated') THEN tpct END AS top_pct,
           CASE WHEN kind IN ('flip', 'concentrated') THEN tn END AS top_count,
           CASE WHEN kind = 'flip' THEN rest END AS remainder_stance,
           CASE WHEN kind = 'flip' THEN rpct END AS remainder_pct,
           CASE WHEN kind = 'flip' THEN rest_n END AS remainder_count,
           CASE WHEN kind = 'split' THEN spct END AS support_pct,
           CASE WHEN kind = 'split' THEN opct END AS oppose_pct
    FROM d WHERE kind IS NOT NULL""")

def _display():
    return TX.text_display(F.col("comment"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def shown(t):
    return t("comments").select("comment_id", "first_name", "last_name", "organization",
                                _display().alias("display"))


# ------------------------------------------------------------------- text forms


@query("text_display", "html_comments comments", f"""
    SELECT comment_id, docket_id, display FROM {with_display(
        "(SELECT comment_id, docket_id, comment FROM html_comments"
        " UNION ALL SELECT comment_id, docket_id, comment FROM comments)")}""")
def _(t):
    columns = ["comment_id", "docket_id", "comment"]
    rows = t("html_comments").select(*columns).unionByName(t("comments").select(*columns))
    return rows.select("comment_id", "docket_id", _display().alias("display"))


@query("text_canonical", "forms", """
    SELECT comment_id, trim(regexp_replace(lower(display), '[^a-z0-9]+', ' ', 'g')) AS canonical FROM forms""")
def _(t):
    return shown(t).select("comment_id", TX.text_canonical(F.col("display")).alias("canonical"))


@query("text_strip_contacts", "forms", "SELECT comment_id, plain AS text FROM forms")
def _(t):
    return shown(t).select("comment_id", TX.text_strip_contacts(F.col("display")).alias("text"))


@query("text_strip_name", "forms", """
    SELECT comment_id, CASE WHEN organization <> '' THEN array_to_string(string_split(plain, 'with'), ' ')
                            ELSE plain END AS text
    FROM forms""")
def _(t):
    name = F.when(F.col("organization") != "", " With ").when(F.col("first_name") == "Ann", "of")
    text = TX.text_strip_name(TX.text_strip_contacts(F.col("display")), F.col("name"))
    return shown(t).withColumn("name", name).select("comment_id", text.alias("text"))


@query("text_skeleton", "forms", "SELECT comment_id, skeleton FROM forms")
def _(t):
    return shown(t).select("comment_id", TX.text_skeleton(F.col("display")).alias("skeleton"))


@query("text_token_set", "forms", "SELECT comment_id, tokenset FROM forms")
def _(t):
    skeleton = shown(t).select("comment_id", TX.text_skeleton(F.col("display")).alias("s"))
    return skeleton.select("comment_id", TX.text_token_set(F.col("s")).alias("tokenset"))


@query("tier_key", "keyed", "SELECT comment_id, k_exact, k_template, k_near FROM keyed")
def _(t):
    keyed = CL.keyed_comments(t("comments"))
    return keyed.select("comment_id", *[F.col(f"key_{x}").alias(f"k_{x}") for x in TX.TIERS])


_WORDS = "sincerely|respectfully|regards|best regards|thank you|thanks"


@query("comment_features", "forms", f"""
    SELECT comment_id,
           CAST(len(list_filter(string_split(trim(regexp_replace(lower(display), '[^a-z0-9]+', ' ', 'g')), ' '),
                    lambda w: w <> '')) AS bigint) AS words,
           CAST(len(regexp_extract_all(display, '(?i)\\b(?:https?://|www\\.)\\S+'))
                + len(regexp_extract_all(display, '(?i)\\S+@\\S+\\.\\S+')) AS bigint) AS links,
           regexp_matches(trim(display), '(?i)^(?:dear\\b|to whom it may concern|hello\\b|hi\\b|greetings\\b)') AS greeting,
           regexp_matches(trim(display), '(?i)\\b(?:{_WORDS})\\b[\\s,]*$') AS signoff,
           {placeholder_sql('display')} AS placeholder
    FROM forms""")
def _(t):
    display = F.col("display")
    return shown(t).select(
        "comment_id", TX.word_count(TX.text_canonical(display)).alias("words"),
        TX.link_count(display).alias("links"), TX.has_greeting(display).alias("greeting"),
        TX.has_signoff(display).alias("signoff"), TX.is_placeholder(display).alias("placeholder"),
    )


@query("is_placeholder", "forms", f"""
    SELECT comment_id, {placeholder_sql('display')} AS placeholder, {placeholder_sql(_BODY)} AS placeholder_body
    FROM forms""")
def _(t):
    return shown(t).select(
        "comment_id", TX.is_placeholder(F.col("display")).alias("placeholder"),
        TX.is_placeholder_body(F.col("display")).alias("placeholder_body"),
    )


@query("stance_score", "forms", f"""
    SELECT comment_id, support, oppose, {stance_sql('support', 'oppose')} AS stance FROM (
      SELECT comment_id, {hits_sql("lower(coalesce(display, ''))", SUPPORT)} AS support,
             {hits_sql("lower(coalesce(display, ''))", OPPOSE)} AS oppose FROM forms)""")
def _(t):
    pro, con = ST.stance_hits(F.col("display"), SUPPORT, OPPOSE)
    rows = shown(t).select("comment_id", pro.alias("support"), con.alias("oppose"))
    return rows.withColumn("stance", ST.stance_label(F.col("support"), F.col("oppose")))


# --------------------------------------------------------------------- clusters


def clusters(t):
    return CL.all_clusters(CL.keyed_comments(t("comments")))


@query("cluster_totals", "totals", "SELECT * FROM totals")
def _(t):
    return CL.cluster_totals(clusters(t))


CLUSTERS_SQL = """
    SELECT c.docket_id, key AS hash, n, display AS sample, tokenset,
           strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day
    FROM clusters c JOIN forms f ON f.comment_id = c.sample_id WHERE tier = '{tier}' AND n > 0"""

for _tier in TX.TIERS:

    @query(
        f"comment_clusters_{_tier}" if _tier != "near" else "comment_clusters", "clusters forms",
        CLUSTERS_SQL.format(tier=_tier),
    )
    def _(t, tier=_tier):
        return CL.comment_clusters(t("comments"), tier)


# the listing shown for each docket: its 20 largest clusters, samples cut for display
@query("comment_clusters_listing", "clusters forms", """
    SELECT c.docket_id, key AS hash, n, substr(display, 1, 600) AS sample, tokenset,
           strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day
    FROM (SELECT * FROM clusters WHERE n > 0
          QUALIFY row_number() OVER (PARTITION BY docket_id, tier ORDER BY n DESC, key NULLS FIRST) <= 20) c
    JOIN forms f ON f.comment_id = c.sample_id WHERE tier = 'near'""")
def _(t):
    return CL.comment_clusters(t("comments"), "near", top_n=20, sample_chars=600)


_LETTER = "NOT ph AND n >= 2"


def _orch_sql(source: str) -> str:
    return f"""
    WITH f AS (SELECT docket_id, tier, count(*) FILTER (NOT ph) AS real_clusters,
                      count(*) FILTER ({_LETTER}) AS form_letters,
                      CAST(coalesce(sum(n) FILTER ({_LETTER}), 0) AS bigint) AS orchestrated_count
               FROM {source} WHERE n > 0 GROUP BY 1, 2)
    SELECT t.docket_id, t.tier, total, distinct_keys, coalesce(real_clusters, 0) AS real_clusters,
           coalesce(form_letters, 0) AS form_letters, coalesce(orchestrated_count, 0) AS orchestrated_count,
           total - coalesce(orchestrated_count, 0) AS unique_count,
           round((total - coalesce(orchestrated_count, 0)) / total * 100, 6) AS unique_pct,
           round(coalesce(orchestrated_count, 0) / total * 100, 6) AS orchestrated_pct
    FROM totals t LEFT JOIN f USING (docket_id, tier)"""


@query("orchestration_stats", "totals clusters", _orch_sql("clusters"))
def _(t):
    return rounded(CL.orchestration_stats(clusters(t)), "unique_pct", "orchestrated_pct")


@query("fidelity_ladder", "totals clusters", f"""
    WITH s AS ({_orch_sql('clusters')})
    SELECT a.docket_id, a.tier, a.total, a.form_letters, a.unique_pct, a.orchestrated_pct,
           e.unique_pct AS exact_unique_pct, round(a.unique_pct - e.unique_pct, 4) AS delta_vs_exact
    FROM s a JOIN s e ON e.docket_id = a.docket_id AND e.tier = 'exact'""")
def _(t):
    rows = rounded(CL.fidelity_ladder(t("comments")), "unique_pct", "orchestrated_pct", "exact_unique_pct")
    return rows.withColumn("delta_vs_exact", F.round("delta_vs_exact", 4))


_DAILY = """SELECT docket_id, strftime(TRY_CAST(posted_date AS date), '%Y-%m-%d') AS day, count(*) AS n
    FROM event_comments WHERE TRY_CAST(posted_date AS date) IS NOT NULL GROUP BY 1, 2"""


@query("comment_volume_by_day", "event_comments", _DAILY)
def _(t):
    return CL.comment_volume_by_day(t("event_comments"))


BURST_SHARE = 12.0


def burst_sql(source: str, share: float, days: int) -> str:
    """Fullest run of days of each docket, where it holds the share; bodies of ``WITH`` and the last SELECT's source."""
    return f"""daily AS (SELECT docket_id, TRY_CAST(posted_date AS date) AS d, count(*) AS n FROM {source}
                   WHERE TRY_CAST(posted_date AS date) IS NOT NULL GROUP BY 1, 2),
    tot AS (SELECT docket_id, count(*) AS total, min(nullif(posted_date, '')) AS s,
                   max(nullif(posted_date, '')) AS e FROM {source} GROUP BY 1),
    w AS (SELECT a.docket_id, a.d, CAST(sum(b.n) AS bigint) AS c, max(b.d) AS l
          FROM daily a JOIN daily b ON b.docket_id = a.docket_id AND b.d BETWEEN a.d AND a.d + {days - 1} GROUP BY 1, 2),
    p AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY c DESC, d) = 1),
    x AS (SELECT *, CAST(e AS date) - CAST(s AS date) + 1 AS len, CAST(e AS date) - DATE '{AS_OF_2024}' AS lft
          FROM p JOIN tot USING (docket_id)),
    burst AS (SELECT docket_id, round(c / total * 100, 6) AS pct, c AS count, total, CAST({days} AS bigint) AS window_days,
                     strftime(d, '%Y-%m-%d') AS start_day, strftime(l, '%Y-%m-%d') AS end_day,
                     CAST(len AS bigint) AS period_days, e AS period_end_day, lft >= 0 AS period_open,
                     CAST(CASE WHEN lft >= 0 THEN lft END AS bigint) AS days_remaining
              FROM x WHERE c / total * 100 >= {share} AND len >= {2 * days})"""


@query("volume_burst", "event_comments", f"WITH {burst_sql('event_comments', BURST_SHARE, 2)} SELECT * FROM burst")
def _(t):
    events = t("event_comments")
    posted = F.nullif("posted_date", F.lit(""))
    facts = events.groupBy("docket_id").agg(
        F.count("*").alias("total"), F.min(posted).alias("period_start"), F.max(posted).alias("period_end")
    )
    daily = CL.comment_volume_by_day(events)
    return rounded(FN.volume_burst(daily, facts, facts, AS_OF_2024, BURST_SHARE), "pct")


# --------------------------------------------------------------------- families


@query("template_pairs", "edges", """
    SELECT docket_id, a AS hash_a, b AS hash_b, round(similarity, 6) AS similarity FROM edges WHERE a < b""")
def _(t):
    letters, _totals = RP.near_letters(t("comments"))
    return rounded(FM.template_pairs(letters), "similarity")


_FAMILY = """SELECT docket_id, family_id, total_n, round(share_pct, 6) AS share_pct, variant_count,
    strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day FROM {f}"""


@query("template_families", "families", _FAMILY.format(f="families"), recursive=True)
def _(t):
    return rounded(FM.template_families(*RP.near_letters(t("comments"))), "share_pct")


@query("template_families_all", "families", _FAMILY.format(f="families") + " WHERE total_n >= 2", recursive=True)
def _(t):
    letters, totals = RP.near_letters(t("comments"))
    return rounded(FM.template_families(letters, totals), "share_pct").where("total_n >= 2")


def scored(t):
    letters, totals = RP.near_letters(t("comments"))
    return RP.families_with_stance(letters, totals, t("comments"), MIN_FAMILY, SUPPORT, OPPOSE), totals


@query("stance_totals", "stances totals", """
    SELECT s.docket_id, support, oppose, mixed, unclear, covered, total,
           round(covered / total * 100, 6) AS coverage_pct
    FROM stances s JOIN totals t ON t.docket_id = s.docket_id AND t.tier = 'near'""", recursive=True)
def _(t):
    families, totals = scored(t)
    return rounded(FN.stance_coverage(FN.stance_totals(families), totals), "coverage_pct")


_PCTS = ("pct", "top_pct", "remainder_pct", "support_pct", "oppose_pct")


@query("stance_finding", "finding", "SELECT docket_id, kind, stance, template_count, top_count, "
       "remainder_stance, remainder_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PCTS)
       + " FROM finding", recursive=True)
def _(t):
    return rounded(FN.stance_finding(scored(t)[0]), *_PCTS)


@query("template_coverage", "families totals", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY docket_id ORDER BY total_n DESC, family_id) AS k
               FROM families),
    seg AS (
      SELECT docket_id, family_id AS segment, k AS place, total_n AS n FROM r WHERE k <= 6
      UNION ALL
      SELECT docket_id, 'other', 7, CAST(sum(total_n) AS bigint) FROM r WHERE k > 6 GROUP BY 1
      UNION ALL
      SELECT t.docket_id, 'unique', 8, greatest(0, total - CAST(coalesce(s, 0) AS bigint))
      FROM totals t LEFT JOIN (SELECT docket_id, sum(total_n) AS s FROM families GROUP BY 1) f USING (docket_id)
      WHERE t.tier = 'near')
    SELECT g.docket_id, segment, place, n, round(n / total * 100, 6) AS pct
    FROM seg g JOIN totals t ON t.docket_id = g.docket_id AND t.tier = 'near' WHERE n > 0""", recursive=True)
def _(t):
    letters, totals = RP.near_letters(t("comments"))
    return rounded(FN.template_coverage(FM.template_families(letters, totals), totals), "pct")


# Comments of the test tables are spread over a month: two days hold a fifteenth at least.
REPORT_BURST_SHARE = 8.0
_DATED = "(SELECT docket_id, CASE WHEN posted_date <> 'undated' THEN posted_date END AS posted_date FROM comments)"


@query("form_letter_report", "totals stances finding comments", f"""
    WITH {burst_sql(_DATED, REPORT_BURST_SHARE, 2)}
    SELECT t.docket_id, t.total, distinct_keys, empty, coalesce(templates, 0) AS families,
           coalesce(covered, 0) AS orchestrated_count,
           round(coalesce(covered, 0) / t.total * 100, 6) AS orchestrated_pct,
           round((t.total - coalesce(covered, 0)) / t.total * 100, 6) AS unique_pct,
           CASE WHEN coalesce(covered, 0) / t.total * 100 < 5 THEN 'low'
                WHEN coalesce(covered, 0) / t.total * 100 < 50 THEN 'mixed' ELSE 'high' END AS band,
           coalesce(support, 0) AS support, coalesce(oppose, 0) AS oppose, coalesce(mixed, 0) AS mixed,
           coalesce(unclear, 0) AS unclear, b.pct AS burst_pct,
           b.start_day AS burst_start, b.end_day AS burst_end,
           f.kind AS stance_finding, f.stance AS finding_stance
    FROM totals t LEFT JOIN stances s USING (docket_id) LEFT JOIN finding f USING (docket_id)
    LEFT JOIN burst b USING (docket_id)
    WHERE t.tier = 'near'""", recursive=True)
def _(t):
    comments = t("comments")
    day = F.nullif("posted_date", F.lit("undated"))
    periods = comments.groupBy("docket_id").agg(
        F.min(day).alias("period_start"), F.max(day).alias("period_end")
    )
    report = RP.form_letter_report(
        comments, CL.comment_volume_by_day(comments), periods, AS_OF_2024,
        min_size=MIN_FAMILY, support=SUPPORT, oppose=OPPOSE, burst_share=REPORT_BURST_SHARE,
    )
    return rounded(report, "orchestrated_pct", "unique_pct", "burst_pct")


@query("comment_precompute", "forms", f"""
    SELECT agency_code, docket_id, comment_id,
           md5(trim(regexp_replace(lower(display), '[^a-z0-9]+', ' ', 'g'))) AS canonical_hash,
           md5(skeleton) AS skeleton_hash, md5(tokenset) AS near_hash,
           CAST(len(list_filter(string_split(trim(regexp_replace(lower(display), '[^a-z0-9]+', ' ', 'g')), ' '),
                    lambda w: w <> '')) AS bigint) AS word_count,
           {placeholder_sql('display')} AS is_placeholder FROM forms""")
def _(t):
    return RP.comment_precompute(t("comments"))


STANCE_BY_TEMPLATE_SQL = f"""
    WITH h AS (SELECT comment_id, md5(skeleton) AS skeleton_hash, {hits_sql("lower(display)", SUPPORT)} AS s,
                      {hits_sql("lower(display)", OPPOSE)} AS o FROM forms WHERE display IS NOT NULL),
    g AS (SELECT skeleton_hash, count(*) AS n, arg_min(s, comment_id) AS support_hits,
                 arg_min(o, comment_id) AS oppose_hits FROM h GROUP BY 1)
    SELECT *, {stance_sql('support_hits', 'oppose_hits')} AS stance FROM g"""


@query("stance_by_template", "forms", STANCE_BY_TEMPLATE_SQL)
def _(t):
    return RP.stance_by_template(t("comments"), SUPPORT, OPPOSE)


CAMPAIGNS_SQL = f"""
    SELECT md5(skeleton) AS skeleton_hash, count(*) AS n, count(DISTINCT (docket_id, agency_code)) AS dockets,
           count(DISTINCT agency_code) AS agencies,
           strftime(min(TRY_CAST(posted_date AS date)), '%Y-%m-%d') AS first_day,
           strftime(max(TRY_CAST(posted_date AS date)), '%Y-%m-%d') AS last_day
    FROM forms
    WHERE NOT (comment IS NULL OR trim(comment) = '') AND NOT coalesce({placeholder_sql('display')}, true)
    GROUP BY skeleton HAVING count(DISTINCT (docket_id, agency_code)) >= 2"""


@query("cross_docket_campaigns", "forms", CAMPAIGNS_SQL)
def _(t):
    # one docket for each language and source
    split = t("comments").withColumn("docket_id", F.concat_ws("-", "docket_id", "agency_code"))
    return RP.cross_docket_campaigns(split)


# the same rows from stored keys, written to the shared folder first
def stored(t, comments=None):
    ensure_checkpoint_dir(t.spark)
    base = f"{t.spark.sparkContext.getCheckpointDir()}/keys-{uuid4().hex}"
    return SK.store_keys(t("comments") if comments is None else comments, base, support=SUPPORT, oppose=OPPOSE)


@query("stored_comment_clusters", "clusters forms", CLUSTERS_SQL.format(tier="near"))
def _(t):
    return SK.stored_comment_clusters(stored(t))


@query("stored_orchestration_stats", "totals clusters", _orch_sql("clusters"))
def _(t):
    return rounded(SK.stored_orchestration(stored(t)), "unique_pct", "orchestrated_pct")


@query("stored_stance_by_template", "forms", STANCE_BY_TEMPLATE_SQL)
def _(t):
    return SK.stored_stance(stored(t))


@query("stored_cross_docket_campaigns", "forms", CAMPAIGNS_SQL)
def _(t):
    split = t("comments").withColumn("docket_id", F.concat_ws("-", "docket_id", "agency_code"))
    return SK.stored_campaigns(stored(t, split))


@query("outlier_letters", "reach letters", """
    WITH head AS (
      SELECT r.docket_id, r.a AS key, arg_min(r.b, (-l.n, r.b)) AS family
      FROM reach r JOIN letters l ON l.docket_id = r.docket_id AND l.key = r.b GROUP BY 1, 2),
    toks AS (SELECT docket_id, key, family, n, unnest(tokens) AS token
             FROM letters JOIN head USING (docket_id, key)),
    idf AS (SELECT docket_id, token, ln((1 + any_value(total)) / (1 + count(*))) + 1 AS w
            FROM toks JOIN (SELECT docket_id, count(*) AS total FROM letters GROUP BY 1) USING (docket_id) GROUP BY 1, 2),
    vec AS (SELECT * FROM toks JOIN idf USING (docket_id, token)),
    centre AS (SELECT docket_id, family, token, sum(n * w) AS c FROM vec GROUP BY ALL),
    norm AS (SELECT docket_id, family, sqrt(sum(c * c)) AS cl FROM centre GROUP BY ALL),
    kept AS (SELECT docket_id, family FROM head GROUP BY ALL HAVING count(*) >= 3)
    SELECT docket_id, family, key, n, round(1 - sum(w * c) / (sqrt(sum(w * w)) * any_value(cl)), 6) + 0.0 AS distance
    FROM vec JOIN centre USING (docket_id, family, token) JOIN norm USING (docket_id, family)
    JOIN kept USING (docket_id, family) GROUP BY docket_id, family, key, n""", recursive=True)
def _(t):
    letters, _totals = RP.near_letters(t("comments"))
    return rounded(RP.outlier_letters(letters), "distance").withColumn("distance", F.col("distance") + 0.0)
