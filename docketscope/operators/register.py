"""Official-register notices: normalise, browse, search and docket links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketscope.functions.dates import DATE_RANGE_DAYS, AsOf, as_day, to_day
from docketscope.functions.fields import blank_to_null, clean_ids, json_strings, slug_list, unquote
from docketscope.operators.lookups import top_per_group

FR_TEXT_COLUMNS = [
    "document_number", "title", "abstract", "document_type", "subtype", "publication_date",
    "agency_slugs", "html_url", "pdf_url",
]
FR_OPTIONAL_COLUMNS = ["effective_on", "comments_close_on", "signing_date", "executive_order_number"]



def fr_normalize(register: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 14 display columns: unquoted text, blank optional fields NULL, ids as an array."""
    return register.select(
        *keep,
        *[F.coalesce(unquote(F.col(c)), F.lit("")).alias(c) for c in FR_TEXT_COLUMNS],
        *[blank_to_null(unquote(F.col(c))).alias(c) for c in FR_OPTIONAL_COLUMNS],
        clean_ids(json_strings(F.col("docket_ids_json"))).alias("docket_ids"),
    )


def _slug_filter(register: DataFrame, slug: str | None, exact: bool) -> DataFrame:
    if not slug:
        return register
    if exact:
        return register.where(F.array_contains(slug_list(F.col("agency_slugs")), slug))
    return register.where(F.contains("agency_slugs", F.lit(slug)))


def fr_browse(
    register: DataFrame,
    limit: int = 20,
    offset: int = 0,
    document_type: str | None = None,
    agency_slug: str | None = None,
    date_range: str | None = None,
    sort_by: str = "recent",
    as_of: AsOf = None,
    exact_slug: bool = False,
) -> DataFrame:
    """One filtered page, normalised after the limit so that only the page is parsed."""
    rows = register
    if document_type:
        rows = rows.where(F.col("document_type") == document_type)
    rows = _slug_filter(rows, agency_slug, exact_slug)
    if date_range:
        since = F.date_sub(as_day(as_of), DATE_RANGE_DAYS[date_range])
        rows = rows.where(to_day(F.col("publication_date")) >= since)
    if sort_by == "comment-deadline":
        rows = rows.where(to_day(F.col("comments_close_on")) >= as_day(as_of))
        order = F.asc_nulls_last("comments_close_on")
    elif sort_by == "oldest":
        order = F.asc_nulls_last("publication_date")
    else:
        order = F.desc_nulls_last("publication_date")
    page = rows.orderBy(order, F.asc("document_number")).offset(offset).limit(limit)
    return fr_normalize(page)


def fr_search(
    register: DataFrame,
    query: str,
    limit: int = 20,
    offset: int = 0,
    agency_slug: str | None = None,
    exact_slug: bool = False,
) -> DataFrame:
    """Literal, case-insensitive substring search over title and abstract, newest first."""
    text = query.strip().lower()
    if not text:
        return fr_normalize(register.limit(0))
    hit = F.contains(F.lower("title"), F.lit(text)) | F.contains(F.lower("abstract"), F.lit(text))
    rows = _slug_filter(register.where(hit), agency_slug, exact_slug)
    order = [F.desc_nulls_last("publication_date"), F.asc("document_number")]
    return fr_normalize(rows.orderBy(*order).offset(offset).limit(limit))


def fr_publications_for_docket(
    links: DataFrame, docket_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Newest notices of one docket, or of every docket, from the link table."""
    order = [F.desc_nulls_last("publication_date"), F.asc("document_number")]
    if docket_id is None:
        rows = top_per_group(links, ["docket_id"], order, limit)
    else:
        wanted = unquote(F.lit(docket_id))
        rows = links.where(F.col("docket_id") == wanted).orderBy(*order)
        rows = rows if limit is None else rows.limit(limit)
    return fr_normalize(rows, keep=("docket_id",))
