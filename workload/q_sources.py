"""Official register and external sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketscope.functions import fields as X
from docketscope.operators import browse as BR
from docketscope.operators import register as FR
from docketscope.sources.registry import BY_KEY, SOURCES
from workload.catalog import AS_OF, query

_UNQ = "regexp_replace({c}, '^\"|\"$', '', 'g')"


def _norm_sql(alias=""):
    text = ("document_number title abstract document_type subtype publication_date agency_slugs "
            "html_url pdf_url").split()
    optional = "effective_on comments_close_on signing_date executive_order_number".split()
    cols = [f"coalesce({_UNQ.format(c=c)}, '') AS {c}" for c in text]
    cols += [f"nullif({_UNQ.format(c=c)}, '') AS {c}" for c in optional]
    cols.append("""coalesce(array_to_string(list_filter(CAST(json_extract(docket_ids_json, '$') AS VARCHAR[]),
                    lambda x: x <> ''), '|'), '') AS docket_ids""")
    return ", ".join(cols)


_FR = _norm_sql()


def flat_ids(df):
    return df.withColumn("docket_ids", F.array_join("docket_ids", "|"))


@query("fr_normalize", "federal_register", f"SELECT {_FR} FROM federal_register")
def _(t):
    return flat_ids(FR.fr_normalize(t("federal_register")))


@query("fr_browse", "federal_register", f"""
    SELECT {_FR} FROM (
      SELECT * FROM federal_register
      WHERE document_type = 'Rule' AND agency_slugs LIKE '%nation_1%'
        AND TRY_CAST(publication_date AS date) >= DATE '{AS_OF}' - INTERVAL '365' DAY
      ORDER BY publication_date DESC NULLS LAST, document_number LIMIT 40 OFFSET 5)""")
def _(t):
    return flat_ids(FR.fr_browse(
        t("federal_register"), 40, 5, document_type="Rule", agency_slug="nation_1",
        date_range="365d", as_of=AS_OF,
    ))


@query("fr_browse_deadline", "federal_register", f"""
    SELECT {_FR} FROM (
      SELECT * FROM federal_register WHERE TRY_CAST(comments_close_on AS date) >= DATE '{AS_OF}'
      ORDER BY comments_close_on ASC NULLS LAST, document_number LIMIT 40)""")
def _(t):
    return flat_ids(FR.fr_browse(t("federal_register"), 40, sort_by="comment-deadline", as_of=AS_OF))


@query("fr_browse_exact_slug", "federal_register", f"""
    SELECT {_FR} FROM (
      SELECT * FROM federal_register
      WHERE list_contains(list_transform(string_split(agency_slugs, ','), lambda s: trim(s)), 'nation_1')
      ORDER BY publication_date ASC NULLS LAST, document_number LIMIT 40)""")
def _(t):
    return flat_ids(FR.fr_browse(
        t("federal_register"), 40, agency_slug="nation_1", sort_by="oldest", exact_slug=True
    ))


@query("fr_search", "federal_register", f"""
    SELECT {_FR} FROM (
      SELECT * FROM federal_register
      WHERE (title ILIKE '%Customer#00000001%' OR abstract ILIKE '%Customer#00000001%')
      ORDER BY publication_date DESC NULLS LAST, document_number LIMIT 20)""")
def _(t):
    return flat_ids(FR.fr_search(t("federal_register"), " customer#00000001 "))


@query("fr_agencies", "federal_register", """
    SELECT document_number,
           array_to_string(list_sort(list_distinct(list_filter(list_transform(
             string_split(agency_slugs, ','), lambda s: trim(s)), lambda s: s <> ''))), '|') AS agencies,
           CASE WHEN document_type = 'Presidential Document' AND subtype <> ''
                THEN concat_ws(' ', subtype, nullif(executive_order_number, '')) END AS label
    FROM federal_register""")
def _(t):
    slugs = F.array_join(F.array_sort(X.slug_list(F.col("agency_slugs"))), "|")
    label = X.presidential_label(
        F.col("document_type"), F.col("subtype"), F.col("executive_order_number")
    )
    return t("federal_register").select("document_number", slugs.alias("agencies"), label.alias("label"))


@query("fr_publications_for_docket", "fr_docket_links", f"""
    SELECT docket_id, {_FR} FROM (
      SELECT *, row_number() OVER (PARTITION BY docket_id
                                   ORDER BY publication_date DESC NULLS LAST, document_number) rn
      FROM fr_docket_links) WHERE rn <= 5""")
def _(t):
    return flat_ids(FR.fr_publications_for_docket(t("fr_docket_links"), limit=5))


# ---------------------------------------------------------------------- sources


def silver(t, source):
    """Source rows cleaned once, as at ingest."""
    return X.normalize_source_row(t(source.table))


def clean_sql(table, columns):
    cols = ", ".join(
        f"nullif(trim(regexp_replace(CAST({c} AS varchar), '^\"|\"$', '', 'g')), '') AS {c}" for c in columns
    )
    return f"(SELECT {cols} FROM {table})"


def cols_of(key):
    return BY_KEY[key].columns


_AGENDA = clean_sql("unified_agenda", cols_of("unified-agenda"))
_SUITS = clean_sql("court_dockets", cols_of("court-dockets"))


@query("source_browse", "unified_agenda", f"""
    SELECT * FROM {_AGENDA}
    WHERE (title ILIKE '%customer#%' OR abstract ILIKE '%customer#%' OR rin ILIKE '%customer#%'
           OR agency_name ILIKE '%customer#%') AND rule_stage = 'Final Rule Stage'
    ORDER BY CASE WHEN next_action_date >= '2999' THEN NULL ELSE next_action_date END DESC NULLS LAST,
             rin, agenda_edition LIMIT 50 OFFSET 10""")
def _(t):
    source = BY_KEY["unified-agenda"]
    return BR.source_browse(
        silver(t, source), source, "Customer#", {"stage": "Final Rule Stage", "bogus": "x"},
        limit=50, offset=10,
    )


@query("source_browse_status", "court_dockets", f"""
    SELECT * FROM {_SUITS} WHERE date_terminated IS NULL AND
      (case_name ILIKE '%00\\%%' ESCAPE '\\' OR docket_number ILIKE '%7-c%')
    ORDER BY date_filed ASC NULLS LAST, cl_docket_id LIMIT 50""")
def _(t):
    source = BY_KEY["court-dockets"]
    rows = silver(t, source)
    return BR.source_browse(rows, source, "7-c", {"status": "open"}, sort_key="oldest", limit=50)


@query("source_browse_citation", "cfr_sections", f"""
    SELECT * FROM {clean_sql("cfr_sections", cols_of("cfr-sections"))}
    ORDER BY TRY_CAST(title AS int) NULLS LAST,
             TRY_CAST(split_part(coalesce(section, part), '-', 1) AS int) NULLS LAST,
             TRY_CAST(split_part(section, '-', 2) AS int) NULLS LAST, granule_id LIMIT 60""")
def _(t):
    source = BY_KEY["cfr-sections"]
    return BR.source_browse(silver(t, source), source, limit=60)


@query("source_browse_amount", "usaspending_recipients", f"""
    SELECT * FROM {clean_sql("usaspending_recipients", cols_of("usaspending"))}
    ORDER BY TRY_CAST(total_award_amount AS double) DESC NULLS LAST, recipient_id LIMIT 30""")
def _(t):
    source = BY_KEY["usaspending"]
    return BR.source_browse(silver(t, source), source, filter_values={"level": "unknown"}, limit=30)


_RECENCY = {
    "unified_agenda": "max(agenda_edition)",
    "congress_bills": "CAST(max(TRY_CAST(latest_action_date AS date)) AS varchar)",
    "cfr_sections": "strftime(max(TRY_CAST(last_modified AS timestamp)), '%Y-%m-%d %H:%M:%S')",
    "sam_entities": "CAST(max(TRY_CAST(registration_date AS date)) AS varchar)",
    "lobbying_filings": "strftime(max(TRY_CAST(dt_posted AS timestamp)), '%Y-%m-%d %H:%M:%S')",
    "fec_committees": "CAST(max(TRY_CAST(last_file_date AS date)) AS varchar)",
    "usaspending_recipients": "NULL",
    "court_dockets": "CAST(max(TRY_CAST(date_filed AS date)) AS varchar)",
    "gao_reports": "CAST(max(TRY_CAST(published_date AS date)) AS varchar)",
    "federal_register": "CAST(max(TRY_CAST(publication_date AS date)) AS varchar)",
    "crs_reports": "CAST(max(TRY_CAST(published_date AS date)) AS varchar)",
}


@query("source_stats", " ".join(_RECENCY), "\nUNION ALL\n".join(
    f"SELECT '{n}' AS tbl, count(*) AS n, {e} AS latest FROM {n}" for n, e in _RECENCY.items()))
def _(t):
    return BR.source_stats({name: t(name) for name in _RECENCY})


@query("agenda_latest_edition", "unified_agenda", f"""
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY rin ORDER BY agenda_edition DESC) rn FROM {_AGENDA})
    WHERE rn = 1""")
def _(t):
    source = BY_KEY["unified-agenda"]
    return BR.agenda_latest_edition(BR.source_rows(t(source.table), source))


@query("agenda_for_docket", "fr_docket_links unified_agenda", f"""
    WITH named AS (
      SELECT docket_id, list_distinct(flatten(list(
               regexp_extract_all(regulation_id_numbers_json, '"([^"]*)"', 1)))) AS rins
      FROM fr_docket_links WHERE regulation_id_numbers_json IS NOT NULL GROUP BY docket_id),
    editions AS (SELECT rin AS r, max(agenda_edition) AS edition FROM {_AGENDA} GROUP BY rin)
    SELECT n.docket_id, a.*
    FROM named n JOIN {_AGENDA} a ON list_contains(n.rins, a.rin)
    JOIN editions e ON e.r = a.rin AND e.edition = a.agenda_edition""")
def _(t):
    return BR.agenda_for_docket(t("fr_docket_links"), t("unified_agenda"))


@query("litigation_for_agency", "court_dockets", f"""
    SELECT * FROM {_SUITS} WHERE case_name ILIKE '%Nation\\_17%' ESCAPE '\\'
    ORDER BY date_filed DESC NULLS LAST, cl_docket_id LIMIT 4""")
def _(t):
    return BR.litigation_for_agency(t("court_dockets"), "Nation_17")


# agencies here are nations and customers, so names differ in length and some
# (NATION_1) occur inside others (NATION_12)
@query("litigation_all_agencies", "court_dockets", f"""
    WITH names AS (SELECT n_name AS agency_code, lower(n_name) AS name FROM nation
                   UNION ALL SELECT c_name, lower(c_name) FROM customer)
    SELECT * EXCLUDE (rn) FROM (
      SELECT s.*, n.agency_code,
             row_number() OVER (PARTITION BY n.agency_code
                                ORDER BY date_filed DESC NULLS LAST, cl_docket_id) AS rn
      FROM {_SUITS} s JOIN names n ON contains(lower(s.case_name), n.name) WHERE length(n.name) >= 8)
    WHERE rn <= 4""")
def _(t):
    nations = t("nation").select(F.col("n_name").alias("agency_code"), F.col("n_name").alias("name"))
    people = t("customer").select(F.col("c_name").alias("agency_code"), F.col("c_name").alias("name"))
    return BR.litigation_all_agencies(t("court_dockets"), nations.unionByName(people))


# -------------------------------------------------------------------- cards

_DATE = """CASE WHEN year(TRY_CAST({c} AS timestamp)) < 2999
    THEN strftime(TRY_CAST({c} AS timestamp), '%b %-d, %Y') END"""


def _dated(prefix, c):
    return f"'{prefix}' || {_DATE.format(c=c)}"


def _usd(c):
    n = f"TRY_CAST({c} AS double)"
    size = f"abs({n})"
    pick = "CASE " + " ".join(
        f"WHEN {size} >= {floor} THEN '$' || regexp_replace(printf('%.1f', round({size} / {unit}, 1)), "
        f"'\\.0$', '') || '{suffix}'"
        for floor, unit, suffix in [
            (999950000000, 1e12, "T"), (999950000, 1e9, "B"), (999950, 1e6, "M"), (999.95, 1e3, "K"), (0, 1, ""),
        ]
    ) + " END"
    return f"CASE WHEN isfinite({n}) THEN CASE WHEN {n} < 0 THEN '-' ELSE '' END || {pick} END"


_ORD = """CASE WHEN regexp_full_match(congress, '\\d+') THEN congress || CASE
    WHEN CAST(congress AS int) % 100 BETWEEN 11 AND 13 THEN 'th'
    WHEN CAST(congress AS int) % 10 = 1 THEN 'st' WHEN CAST(congress AS int) % 10 = 2 THEN 'nd'
    WHEN CAST(congress AS int) % 10 = 3 THEN 'rd' ELSE 'th' END END"""
_BILLS = {
    "hr": ("house-bill", "H.R."), "s": ("senate-bill", "S."),
    "hjres": ("house-joint-resolution", "H.J.Res."), "sjres": ("senate-joint-resolution", "S.J.Res."),
    "hconres": ("house-concurrent-resolution", "H.Con.Res."),
    "sconres": ("senate-concurrent-resolution", "S.Con.Res."),
    "hres": ("house-resolution", "H.Res."), "sres": ("senate-resolution", "S.Res."),
}


def _bill(i, other):
    return "CASE lower(bill_type) " + " ".join(
        f"WHEN '{k}' THEN '{v[i]}'" for k, v in _BILLS.items()
    ) + f" ELSE {other} END"


# key -> (id, chips, title, href, body, meta_left, meta_right, link_label)
_CARD_SQL = {
    "unified-agenda": ("rin || '-' || agenda_edition", ["agency_name|accent", "rule_stage|neutral", "rin|code"],
        "coalesce(title, '(untitled rulemaking)')", "url", "abstract", "priority_category",
        _dated("Next action ", "next_action_date"), "'reginfo.gov'"),
    "congress-bills": ("coalesce(bill_id, '')",
        [f"{_bill(1, 'upper(bill_type)')} || ' ' || bill_number|code", f"{_ORD} || ' Congress'|neutral",
         "origin_chamber|neutral"], "coalesce(title, '(untitled bill)')",
        f"'https://www.congress.gov/bill/' || {_ORD} || '-congress/' || {_bill(0, 'NULL')} || '/' || bill_number",
        "latest_action_text", "NULL", _dated("Latest action ", "latest_action_date"), "'congress.gov'"),
    "cfr-sections": ("coalesce(granule_id, '')",
        ["CASE WHEN section IS NOT NULL THEN title || ' CFR § ' || regexp_replace(section, '-', '.') "
         "WHEN part IS NOT NULL THEN title || ' CFR Part ' || part ELSE 'Title ' || title || ' CFR' END|code",
         "edition_year || ' edition'|neutral"], "coalesce(heading, '(untitled granule)')", "url",
        "NULL", "NULL", "NULL", "'govinfo.gov'"),
    "sam-entities": ("coalesce(uei, '')",
        ["nullif(concat_ws(', ', city, state), '')|neutral", "'NAICS ' || primary_naics|neutral", "uei|code"],
        "coalesce(legal_business_name, '(unnamed entity)')", "entity_url", "NULL", "'d/b/a ' || dba_name",
        _dated("Registered ", "registration_date"), "CASE WHEN entity_url IS NOT NULL THEN 'website' END"),
    "lobbying": ("coalesce(filing_uuid, '')",
        ["nullif(concat_ws(' ', CASE filing_period WHEN 'first_quarter' THEN 'Q1' WHEN 'second_quarter' THEN 'Q2' "
         "WHEN 'year_end' THEN 'Year-end' ELSE filing_period END, filing_year), '')|neutral",
         f"coalesce({_usd('income')}, {_usd('expenses')})|accent"],
        "coalesce(client_name, '(unnamed client)')", "url", "first_activity", "'via ' || registrant_name",
        _dated("Posted ", "dt_posted"), "'lda.senate.gov'"),
    "fec-committees": ("coalesce(committee_id, '')",
        ["committee_type_full|neutral", "party_full|accent", "state|code"],
        "coalesce(name, '(unnamed committee)')",
        "'https://www.fec.gov/data/committee/' || replace(committee_id, ' ', '%20') || '/'", "NULL",
        "designation_full", _dated("Last filing ", "last_file_date"), "'fec.gov'"),
    "usaspending": ("coalesce(recipient_id, '')",
        [f"{_usd('total_award_amount')}|accent",
         "CASE upper(recipient_level) WHEN 'R' THEN 'Recipient' WHEN 'P' THEN 'Parent' WHEN 'C' THEN 'Child' "
         "ELSE recipient_level END|neutral", "uei|code"], "coalesce(name, '(unnamed recipient)')",
        "'https://www.usaspending.gov/recipient/' || recipient_id || '/latest'", "NULL", "NULL",
        "'All-time award total'", "'usaspending.gov'"),
    "court-dockets": ("coalesce(cl_docket_id, '')",
        ["CASE WHEN date_terminated IS NULL THEN 'Pending' END|accent",
         "CASE WHEN date_terminated IS NOT NULL THEN 'Closed' END|neutral", "court|neutral", "docket_number|code"],
        "coalesce(case_name, '(unnamed case)')", "absolute_url",
        "coalesce(cause, nullif(trim(regexp_replace(nature_of_suit, '^\\d+\\s+', '')), ''))",
        "'Judge ' || assigned_to", _dated("Filed ", "date_filed"), "'courtlistener.com'"),
    "gao-reports": ("coalesce(report_id, '')", ["upper(report_id)|code"],
        "coalesce(title, '(untitled report)')", "url",
        "nullif(trim(regexp_replace(abstract, '(?i)^\\s*what gao found\\s*', '')), '')", "NULL",
        _DATE.format(c="published_date"), "'gao.gov'"),
    "crs-reports": ("coalesce(report_id, '')", ["report_id|code"], "coalesce(title, '(untitled report)')",
        "'https://www.congress.gov/crs-product/' || replace(report_id, ' ', '%20')", "NULL", "NULL",
        _DATE.format(c="published_date"), "'congress.gov'"),
}
_FIRST = """nullif(trim(json_extract_string(lobbying_activities_json, '$[0].description')), '') AS first_activity"""


def _card_sql(source):
    cid, chips, title, href, body, left, right, link = _CARD_SQL[source.key]
    parts = []
    for chip in chips:
        label, variant = chip.rsplit("|", 1)
        parts.append(f"({label}) || ':{variant}'")
    clean = clean_sql(source.table, source.columns)
    if source.key == "lobbying":
        clean = clean.replace(" FROM lobbying_filings", f", {_FIRST} FROM lobbying_filings")
    return f"""SELECT '{source.key}' AS source, {cid} AS id, concat_ws(';', {', '.join(parts)}) AS chips,
        {title} AS title, {href} AS href, CAST({body} AS varchar) AS body, CAST({left} AS varchar) AS meta_left,
        CAST({right} AS varchar) AS meta_right, CAST({link} AS varchar) AS link_label FROM {clean}"""


@query("source_cards", " ".join(s.table for s in SOURCES),
       "\nUNION ALL\n".join(_card_sql(s) for s in SOURCES))
def _(t):
    rows = None
    for source in SOURCES:
        cards = BR.source_cards(BR.source_rows(t(source.table), source), source)
        label = lambda c: F.concat(c["label"], F.lit(":"), c["variant"])
        part = cards.withColumns(
            {"source": F.lit(source.key), "chips": F.array_join(F.transform("chips", label), ";")}
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows
