"""Registry of the browsable external sources.

Every source is described by data and small Column factories; the browser,
statistics and card queries in ``operators.browse`` are generic over it.

Fixed values: table and column names, filter parameters and values, sort keys and labels below are those of
the published tables and pages; they are stated as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketscope.functions import labels as L
from docketscope.functions.fields import blank_to_null

ColumnFactory = Callable[[], Column]
Chip = tuple[Column, str]


@dataclass(frozen=True)
class Sort:
    order: Callable[[], list[Column]]
    where: ColumnFactory | None = None


@dataclass(frozen=True)
class Card:
    """Display model of one row; ``chips`` with a NULL label are dropped."""

    id: Column
    title: Column
    href: Column
    chips: list[Chip] = field(default_factory=list)
    body: Column | None = None
    meta_left: Column | None = None
    meta_right: Column | None = None
    link_label: Column | None = None


@dataclass(frozen=True)
class SourceDef:
    key: str
    table: str
    columns: list[str]
    search_fields: list[str]
    tiebreak: list[str]
    default_sort: str
    sorts: dict[str, Sort]
    card: Callable[[], Card]
    derived: dict[str, ColumnFactory] = field(default_factory=dict)
    # filter parameter -> allowed value -> predicate
    filters: dict[str, dict[str, ColumnFactory]] = field(default_factory=dict)
    recency: ColumnFactory | None = None


def equals(column: str, values: list[str]) -> dict[str, ColumnFactory]:
    """Filter options that test a column for one of the declared values."""
    return {v: (lambda v=v: F.col(column) == v) for v in values}


def newest(column: str) -> Sort:
    return Sort(lambda: [F.desc_nulls_last(column)])


def oldest(column: str) -> Sort:
    return Sort(lambda: [F.asc_nulls_last(column)])


def latest_day(column: str) -> ColumnFactory:
    return lambda: F.max(F.col(column).try_cast("date")).cast("string")


def latest_instant(column: str) -> ColumnFactory:
    return lambda: F.max(F.col(column).try_cast("timestamp")).cast("string")


def _or(column: Column, default: str) -> Column:
    return F.coalesce(column, F.lit(default))


def _dated(prefix: str, column: str) -> Column:
    return L.prefixed(prefix, L.date_label(F.col(column)))


def _citation_order() -> list[Column]:
    place = F.coalesce("section", "part")
    number = lambda text, i: F.split_part(text, F.lit("-"), F.lit(i)).try_cast("int")
    return [
        F.col("title").try_cast("int").asc_nulls_last(),
        number(place, 1).asc_nulls_last(),
        number(F.col("section"), 2).asc_nulls_last(),
    ]


def _agenda_card() -> Card:
    return Card(
        id=F.concat_ws("-", "rin", "agenda_edition"),
        chips=[
            (F.col("agency_name"), "accent"),
            (F.col("rule_stage"), "neutral"),
            (F.col("rin"), "code"),
        ],
        title=_or(F.col("title"), "(untitled rulemaking)"),
        href=F.col("url"),
        body=F.col("abstract"),
        meta_left=F.col("priority_category"),
        meta_right=_dated("Next action ", "next_action_date"),
        link_label=F.lit("reginfo.gov"),
    )


def _bill_card() -> Card:
    kind, number = F.col("bill_type"), F.col("bill_number")
    return Card(
        id=_or(F.col("bill_id"), ""),
        chips=[
            (L.bill_label(kind, number), "code"),
            (F.concat(L.congress_ordinal(F.col("congress")), F.lit(" Congress")), "neutral"),
            (F.col("origin_chamber"), "neutral"),
        ],
        title=_or(F.col("title"), "(untitled bill)"),
        href=L.congress_bill_url(F.col("congress"), kind, number),
        body=F.col("latest_action_text"),
        meta_right=_dated("Latest action ", "latest_action_date"),
        link_label=F.lit("congress.gov"),
    )


def _cfr_card() -> Card:
    return Card(
        id=_or(F.col("granule_id"), ""),
        chips=[
            (L.cfr_citation(F.col("title"), F.col("part"), F.col("section")), "code"),
            (F.concat(F.col("edition_year"), F.lit(" edition")), "neutral"),
        ],
        title=_or(F.col("heading"), "(untitled granule)"),
        href=F.col("url"),
        link_label=F.lit("govinfo.gov"),
    )


def _entity_card() -> Card:
    place = blank_to_null(F.concat_ws(", ", "city", "state"))
    return Card(
        id=_or(F.col("uei"), ""),
        chips=[
            (place, "neutral"),
            (L.prefixed("NAICS ", F.col("primary_naics")), "neutral"),
            (F.col("uei"), "code"),
        ],
        title=_or(F.col("legal_business_name"), "(unnamed entity)"),
        href=F.col("entity_url"),
        meta_left=L.prefixed("d/b/a ", F.col("dba_name")),
        meta_right=_dated("Registered ", "registration_date"),
        link_label=F.when(F.col("entity_url").isNotNull(), "website"),
    )


def _lobbying_card() -> Card:
    period = F.concat_ws(" ", L.filing_period(F.col("filing_period")), "filing_year")
    money = F.coalesce(L.usd_compact(F.col("income")), L.usd_compact(F.col("expenses")))
    return Card(
        id=_or(F.col("filing_uuid"), ""),
        chips=[(blank_to_null(period), "neutral"), (money, "accent")],
        title=_or(F.col("client_name"), "(unnamed client)"),
        href=F.col("url"),
        body=F.col("first_activity"),
        meta_left=L.prefixed("via ", F.col("registrant_name")),
        meta_right=_dated("Posted ", "dt_posted"),
        link_label=F.lit("lda.senate.gov"),
    )


def _committee_card() -> Card:
    return Card(
        id=_or(F.col("committee_id"), ""),
        chips=[
            (F.col("committee_type_full"), "neutral"),
            (F.col("party_full"), "accent"),
            (F.col("state"), "code"),
        ],
        title=_or(F.col("name"), "(unnamed committee)"),
        href=L.fec_committee_url(F.col("committee_id")),
        meta_left=F.col("designation_full"),
        meta_right=_dated("Last filing ", "last_file_date"),
        link_label=F.lit("fec.gov"),
    )


def _recipient_card() -> Card:
    return Card(
        id=_or(F.col("recipient_id"), ""),
        chips=[
            (L.usd_compact(F.col("total_award_amount")), "accent"),
            (L.recipient_level(F.col("recipient_level")), "neutral"),
            (F.col("uei"), "code"),
        ],
        title=_or(F.col("name"), "(unnamed recipient)"),
        href=L.usaspending_url(F.col("recipient_id")),
        meta_right=F.lit("All-time award total"),
        link_label=F.lit("usaspending.gov"),
    )


def _suit_card() -> Card:
    pending = F.col("date_terminated").isNull()
    return Card(
        id=_or(F.col("cl_docket_id"), ""),
        chips=[
            (F.when(pending, "Pending"), "accent"),
            (F.when(~pending, "Closed"), "neutral"),
            (F.col("court"), "neutral"),
            (F.col("docket_number"), "code"),
        ],
        title=_or(F.col("case_name"), "(unnamed case)"),
        href=F.col("absolute_url"),
        body=F.coalesce("cause", L.suit_nature(F.col("nature_of_suit"))),
        meta_left=L.prefixed("Judge ", F.col("assigned_to")),
        meta_right=_dated("Filed ", "date_filed"),
        link_label=F.lit("courtlistener.com"),
    )


def _gao_card() -> Card:
    return Card(
        id=_or(F.col("report_id"), ""),
        chips=[(F.upper("report_id"), "code")],
        title=_or(F.col("title"), "(untitled report)"),
        href=F.col("url"),
        body=L.gao_abstract(F.col("abstract")),
        meta_right=L.date_label(F.col("published_date")),
        link_label=F.lit("gao.gov"),
    )


def _crs_card() -> Card:
    return Card(
        id=_or(F.col("report_id"), ""),
        chips=[(F.col("report_id"), "code")],
        title=_or(F.col("title"), "(untitled report)"),
        href=L.crs_report_url(F.col("report_id")),
        meta_right=L.date_label(F.col("published_date")),
        link_label=F.lit("congress.gov"),
    )


SOURCES = [
    SourceDef(
        key="unified-agenda",
        table="unified_agenda",
        columns="rin title abstract agency_name rin_status rule_stage priority_category "
        "agenda_edition next_action_date url".split(),
        search_fields=["title", "abstract", "rin", "agency_name"],
        tiebreak=["rin", "agenda_edition"],
        default_sort="next-action",
        sorts={
            # undated entries carry a year-3000 date; they sort with the missing ones
            "next-action": Sort(
                lambda: [
                    F.when(F.col("next_action_date") < "2999", F.col("next_action_date"))
                    .desc_nulls_last()
                ]
            ),
            "title": oldest("title"),
        },
        filters={
            "stage": equals(
                "rule_stage",
                ["Prerule Stage", "Proposed Rule Stage", "Final Rule Stage", "Long-Term Actions",
                 "Completed Actions"],
            )
        },
        recency=lambda: F.max("agenda_edition"),
        card=_agenda_card,
    ),
    SourceDef(
        key="congress-bills",
        table="congress_bills",
        columns="bill_id congress bill_type bill_number title origin_chamber latest_action_date "
        "latest_action_text".split(),
        search_fields=["title", "bill_id"],
        tiebreak=["bill_id"],
        default_sort="recent",
        sorts={"recent": newest("latest_action_date"), "oldest": oldest("latest_action_date")},
        filters={
            "congress": equals("congress", ["119", "118", "117", "116"]),
            "chamber": equals("origin_chamber", ["House", "Senate"]),
        },
        recency=latest_day("latest_action_date"),
        card=_bill_card,
    ),
    SourceDef(
        key="cfr-sections",
        table="cfr_sections",
        columns="granule_id title part section heading edition_year url".split(),
        search_fields=["heading", "cfr_ref"],
        tiebreak=["granule_id"],
        default_sort="citation",
        sorts={"citation": Sort(_citation_order), "recent": newest("last_modified")},
        recency=latest_instant("last_modified"),
        card=_cfr_card,
    ),
    SourceDef(
        key="sam-entities",
        table="sam_entities",
        columns="uei legal_business_name dba_name city state primary_naics registration_date "
        "registration_expiration_date entity_url".split(),
        search_fields=["legal_business_name", "dba_name", "uei", "city"],
        tiebreak=["uei"],
        default_sort="recent",
        sorts={"recent": newest("registration_date"), "name": oldest("legal_business_name")},
        recency=latest_day("registration_date"),
        card=_entity_card,
    ),
    SourceDef(
        key="lobbying",
        table="lobbying_filings",
        columns="filing_uuid filing_type filing_year filing_period dt_posted registrant_name "
        "client_name income expenses url".split(),
        derived={
            "first_activity": lambda: F.get_json_object(
                "lobbying_activities_json", "$[0].description"
            )
        },
        search_fields=["client_name", "registrant_name"],
        tiebreak=["filing_uuid"],
        default_sort="recent",
        # offsets are mixed, so text order is not time order
        sorts={
            "recent": Sort(lambda: [F.col("dt_posted").try_cast("timestamp").desc_nulls_last()])
        },
        filters={
            "year": equals("filing_year", ["2026", "2025", "2024"]),
            "period": equals(
                "filing_period",
                ["first_quarter", "second_quarter", "third_quarter", "fourth_quarter"],
            ),
        },
        recency=latest_instant("dt_posted"),
        card=_lobbying_card,
    ),
    SourceDef(
        key="fec-committees",
        table="fec_committees",
        columns="committee_id name committee_type_full designation_full party_full state "
        "last_file_date".split(),
        search_fields=["name", "committee_id"],
        tiebreak=["committee_id"],
        default_sort="recent",
        sorts={"recent": newest("last_file_date"), "name": oldest("name")},
        filters={
            "type": equals(
                "committee_type_full",
                ["House", "Senate", "Presidential", "PAC - Qualified", "PAC - Nonqualified",
                 "Super PAC (Independent Expenditure-Only)", "Party - Qualified",
                 "Party - Nonqualified"],
            )
        },
        recency=latest_day("last_file_date"),
        card=_committee_card,
    ),
    SourceDef(
        key="usaspending",
        table="usaspending_recipients",
        columns="recipient_id name uei recipient_level total_award_amount".split(),
        search_fields=["name", "uei"],
        tiebreak=["recipient_id"],
        default_sort="top",
        # amounts are text
        sorts={
            "top": Sort(lambda: [F.col("total_award_amount").try_cast("double").desc_nulls_last()])
        },
        filters={"level": equals("recipient_level", ["R", "P", "C"])},
        card=_recipient_card,
    ),
    SourceDef(
        key="court-dockets",
        table="court_dockets",
        columns="cl_docket_id case_name court docket_number date_filed date_terminated "
        "nature_of_suit cause assigned_to absolute_url".split(),
        search_fields=["case_name", "docket_number"],
        tiebreak=["cl_docket_id"],
        default_sort="recent",
        sorts={"recent": newest("date_filed"), "oldest": oldest("date_filed")},
        filters={
            "status": {
                "open": lambda: F.col("date_terminated").isNull(),
                "closed": lambda: F.col("date_terminated").isNotNull(),
            }
        },
        recency=latest_day("date_filed"),
        card=_suit_card,
    ),
    SourceDef(
        key="gao-reports",
        table="gao_reports",
        columns="report_id title abstract published_date url".split(),
        search_fields=["title", "abstract"],
        tiebreak=["report_id"],
        default_sort="recent",
        sorts={"recent": newest("published_date")},
        recency=latest_day("published_date"),
        card=_gao_card,
    ),
    SourceDef(
        key="crs-reports",
        table="crs_reports",
        columns="report_id title report_type published_date url".split(),
        search_fields=["title", "report_id"],
        tiebreak=["report_id"],
        default_sort="recent",
        sorts={"recent": newest("published_date")},
        recency=latest_day("published_date"),
        card=_crs_card,
    ),
]

BY_KEY = {s.key: s for s in SOURCES}

# The register is counted with the sources but browsed by its own operators.
REGISTER_TABLE = "federal_register"
REGISTER_RECENCY = latest_day("publication_date")


def recency_by_table() -> dict[str, ColumnFactory | None]:
    return {s.table: s.recency for s in SOURCES} | {REGISTER_TABLE: REGISTER_RECENCY}
