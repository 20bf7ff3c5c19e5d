"""Generic browsing of external sources, their statistics, cards and linkages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketscope.functions.fields import json_strings, normalize_source_row
from docketscope.operators.joins import keep_listed
from docketscope.operators.lookups import top_per_group
from docketscope.session import cut_lineage
from docketscope.sources.registry import BY_KEY, SourceDef, recency_by_table
from docketscope.sources.tables import spread

MIN_AGENCY_NAME = 8


def _text_match(fields: list[str], text: str) -> Column:
    wanted = F.lit(text.lower())
    return reduce(lambda a, b: a | b, [F.contains(F.lower(f), wanted) for f in fields])


def source_rows(df: DataFrame, source: SourceDef) -> DataFrame:
    """The source's projection, cleaned."""
    derived = [make().alias(name) for name, make in source.derived.items()]
    return normalize_source_row(df.select(*source.columns, *derived))


def source_browse(
    df: DataFrame,
    source: SourceDef,
    search: str = "",
    filter_values: dict[str, str] | None = None,
    sort_key: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """One page: literal search, declared filters, sort with a unique tiebreak.

    Reads rows cleaned at ingest (``normalize_source_row``), so filters compare
    plain columns and reach the scan, and a blank value is already NULL.
    """
    rows = df
    if search.strip():
        rows = rows.where(_text_match(source.search_fields, search.strip()))
    for param, options in source.filters.items():
        predicate = options.get((filter_values or {}).get(param, ""))
        if predicate is not None:
            rows = rows.where(predicate())
    sort = source.sorts.get(sort_key or "", source.sorts[source.default_sort])
    if sort.where is not None:
        rows = rows.where(sort.where())
    order = [*sort.order(), *[F.asc_nulls_last(c) for c in source.tiebreak]]
    page = rows.orderBy(*order).offset(int(offset)).limit(int(limit))
    return source_rows(page, source)


def source_cards(rows: DataFrame, source: SourceDef) -> DataFrame:
    """Display cards of cleaned rows."""
    card = source.card()
    none = F.lit(None).cast("string")
    chips = F.array(
        *[F.struct(label.alias("label"), F.lit(variant).alias("variant")) for label, variant in card.chips]
    )
    return rows.select(
        card.id.alias("id"),
        F.filter(chips, lambda c: c["label"].isNotNull()).alias("chips"),
        card.title.alias("title"),
        card.href.alias("href"),
        *[
            (none if value is None else value).alias(name)
            for name, value in [
                ("body", card.body),
                ("meta_left", card.meta_left),
                ("meta_right", card.meta_right),
                ("link_label", card.link_label),
            ]
        ],
    )


def source_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, n, latest) per available source: one aggregate each, one union."""
    rows = None
    for name, recency in recency_by_table().items():
        if name not in tables:
            continue
        latest = F.lit(None).cast("string") if recency is None else recency()
        part = tables[name].agg(F.count("*").alias("n"), latest.alias("latest"))
        part = part.select(F.lit(name).alias("tbl"), "n", F.nullif("latest", F.lit("")).alias("latest"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def agenda_latest_edition(agenda: DataFrame) -> DataFrame:
    """Each regulation's newest agenda entry."""
    return top_per_group(agenda, ["rin"], [F.desc_nulls_last("agenda_edition")], 1)


def agenda_for_docket(
    links: DataFrame, agenda: DataFrame, docket_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Agenda entries linked to a docket through the regulation ids of its notices.

    With ``docket_id=None`` every docket is answered at once. The newest edition
    is chosen per regulation before the join, so it is done once per regulation
    and not once per link.
    """
    rows = links if docket_id is None else links.where(F.col("docket_id") == docket_id)
    rins = rows.select(
        "docket_id", F.explode(json_strings(F.col("regulation_id_numbers_json"))).alias("rin")
    ).distinct()
    source = BY_KEY["unified-agenda"]
    joined = rins.join(agenda_latest_edition(source_rows(agenda, source)), "rin")
    if docket_id is not None:
        ordered = joined.orderBy("rin")
        return ordered if limit is None else ordered.limit(limit)
    return joined if limit is None else top_per_group(joined, ["docket_id"], [F.asc("rin")], limit)


def litigation_for_agency(suits: DataFrame, agency_name: str, limit: int = 4) -> DataFrame:
    """Newest suits naming an agency in full; short names match inside words, so none."""
    rows = source_rows(suits, BY_KEY["court-dockets"])
    named = F.contains(F.lower("case_name"), F.lit(agency_name.strip().lower()))
    if len(agency_name.strip()) < MIN_AGENCY_NAME:
        named = F.lit(False)
    order = [F.desc_nulls_last("date_filed"), F.asc("cl_docket_id")]
    return rows.where(named).orderBy(*order).limit(limit)


def _grams(text: Column) -> Column:
    """Distinct substrings of the minimal name length."""
    last = F.length(text) - (MIN_AGENCY_NAME - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(
        F.transform(starts, lambda i: F.substring(text, i, F.lit(MIN_AGENCY_NAME)))
    )


def litigation_all_agencies(suits: DataFrame, agencies: DataFrame, limit: int = 4) -> DataFrame:
    """The same for every agency: (agency_code, name) against all case names.

    A name of at least eight characters occurs in a case name only if each of
    its eight-character grams does. A case's grams become rows of (id, gram) and meet
    the names' grams in a semi-join, broadcast up to a checked size, so each case costs
    its own length, whatever the number of names. Every name is then looked up by the one
    of its grams that the fewest case names hold: an equi-join on ids, followed by the
    exact test. The suits' columns are added to the reported rows alone.
    """
    rows = source_rows(suits, BY_KEY["court-dockets"])
    names = agencies.select("agency_code", F.lower(F.trim("name")).alias("name"))
    name_grams = cut_lineage(names.select("*", F.explode(_grams(F.col("name"))).alias("gram")))
    cases = spread(rows.select("cl_docket_id", "date_filed", F.lower("case_name").alias("case")))
    case_grams = cut_lineage(
        keep_listed(cases.select("cl_docket_id", F.explode(_grams(F.col("case"))).alias("gram")), name_grams, ["gram"])
    )
    frequency = case_grams.groupBy("gram").agg(F.count("*").alias("cases"))
    keyed = (
        name_grams.join(frequency, "gram", "left")
        .groupBy("agency_code", "name")
        .agg(
            F.min_by("gram", F.struct(F.coalesce("cases", F.lit(0)), F.col("gram"))).alias("gram"),
            F.min(F.coalesce("cases", F.lit(0))).alias("cases"),
        )
        .where(F.col("cases") > 0)
        .drop("cases")
    )
    near = case_grams.join(keyed, "gram").select("cl_docket_id", "agency_code", "name")
    found = near.join(cases, "cl_docket_id").where(F.contains("case", F.col("name")))
    order = [F.desc_nulls_last("date_filed"), F.asc("cl_docket_id")]
    top = top_per_group(found.select("agency_code", "cl_docket_id", "date_filed"), ["agency_code"], order, limit)
    return top.select("agency_code", "cl_docket_id").join(rows, "cl_docket_id")
