"""Display labels of the external sources, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketscope.functions.fields import blank_to_null

# Sentinel year meaning "to be determined".
UNDATED_YEAR = 2999

# Bill type -> (congress.gov path segment, label).
BILL_TYPES = {
    "hr": ("house-bill", "H.R."),
    "s": ("senate-bill", "S."),
    "hjres": ("house-joint-resolution", "H.J.Res."),
    "sjres": ("senate-joint-resolution", "S.J.Res."),
    "hconres": ("house-concurrent-resolution", "H.Con.Res."),
    "sconres": ("senate-concurrent-resolution", "S.Con.Res."),
    "hres": ("house-resolution", "H.Res."),
    "sres": ("senate-resolution", "S.Res."),
}

# Recipient level and filing period codes.
RECIPIENT_LEVELS = {"R": "Recipient", "P": "Parent", "C": "Child"}
FILING_PERIODS = {
    "first_quarter": "Q1",
    "second_quarter": "Q2",
    "third_quarter": "Q3",
    "fourth_quarter": "Q4",
    "mid_year": "Mid-year",
    "year_end": "Year-end",
}


def lookup(code: Column, table: dict[str, str]) -> Column:
    """Constant-table lookup; NULL for an unknown code."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, F.coalesce(code, F.lit("")))


def _dated(c: Column, pattern: str) -> Column:
    moment = c.try_cast("timestamp")
    return F.when(F.year(moment) < UNDATED_YEAR, F.date_format(moment, pattern))


def date_label(c: Column) -> Column:
    """"Jul 16, 2026"; NULL when missing, unparseable or a sentinel."""
    return _dated(c, "MMM d, yyyy")


def month_label(c: Column) -> Column:
    return _dated(c, "MMM yyyy")


def prefixed(prefix: str, label: Column) -> Column:
    """Prefix and label, or NULL when there is no label."""
    return F.concat(F.lit(prefix), label)


def usd_compact(amount: Column) -> Column:
    """"$117.1B", "$30K"; NULL when the text is not a finite number."""
    n = amount.try_cast("double")
    size = F.abs(n)
    units = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"), (1.0, "")]
    label = F.lit(None).cast("string")
    for unit, suffix in reversed(units):
        # a value that rounds up to 1000 of a unit belongs to the next unit
        floor = unit * 0.99995 if unit > 1e3 else (999.95 if unit == 1e3 else 0.0)
        digits = F.regexp_replace(
            F.format_string("%.1f", F.round(size / F.lit(unit), 1)), r"\.0$", ""
        )
        label = F.when(size >= floor, F.concat(F.lit("$"), digits, F.lit(suffix))).otherwise(label)
    finite = n.isNotNull() & ~F.isnan(n) & (size < float("inf"))
    return F.when(finite, F.concat(F.when(n < 0, "-").otherwise(""), label))


def ordinal(n: Column) -> Column:
    """119 -> "119th", 122 -> "122nd"."""
    teens, last = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    suffix = (
        F.when(teens.between(11, 13), "th")
        .when(last == 1, "st")
        .when(last == 2, "nd")
        .when(last == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def congress_ordinal(congress: Column) -> Column:
    """Ordinal of a congress number held as text; NULL unless it is an integer."""
    return F.when(congress.rlike(r"^\s*\d+\s*$"), ordinal(F.trim(congress).try_cast("long")))


def bill_label(bill_type: Column, number: Column) -> Column:
    known = lookup(F.lower(bill_type), {k: v[1] for k, v in BILL_TYPES.items()})
    return F.concat(F.coalesce(known, F.upper(bill_type)), F.lit(" "), number)


def congress_bill_url(congress: Column, bill_type: Column, number: Column) -> Column:
    path = lookup(F.lower(bill_type), {k: v[0] for k, v in BILL_TYPES.items()})
    return F.concat(
        F.lit("https://www.congress.gov/bill/"),
        congress_ordinal(congress),
        F.lit("-congress/"),
        path,
        F.lit("/"),
        number,
    )


def _uri_component(c: Column) -> Column:
    # url_encode is form encoding; a URI component writes a space as %20 and
    # leaves a few marks alone
    encoded = F.url_encode(c)
    for form, uri in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"),
                      ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(form), F.lit(uri))
    return encoded


def crs_report_url(report_id: Column) -> Column:
    return prefixed("https://www.congress.gov/crs-product/", _uri_component(report_id))


def fec_committee_url(committee_id: Column) -> Column:
    base = prefixed("https://www.fec.gov/data/committee/", _uri_component(committee_id))
    return F.concat(base, F.lit("/"))


def usaspending_url(recipient_id: Column) -> Column:
    base = prefixed("https://www.usaspending.gov/recipient/", _uri_component(recipient_id))
    return F.concat(base, F.lit("/latest"))


def cfr_citation(title: Column, part: Column, section: Column) -> Column:
    """"40 CFR § 10.1", "40 CFR Part 10" or "Title 40 CFR"."""
    dotted = F.regexp_replace(section, "^([^-]*)-", "$1.")
    return (
        F.when(section.isNotNull(), F.concat(title, F.lit(" CFR § "), dotted))
        .when(part.isNotNull(), F.concat(title, F.lit(" CFR Part "), part))
        .otherwise(F.concat(F.lit("Title "), title, F.lit(" CFR")))
    )


def gao_abstract(abstract: Column) -> Column:
    """Abstract without its boilerplate first heading."""
    return blank_to_null(F.trim(F.regexp_replace(abstract, r"(?i)^\s*what gao found\s*", "")))


def suit_nature(nature: Column) -> Column:
    """Nature of suit without its numeric code."""
    return blank_to_null(F.trim(F.regexp_replace(nature, r"^\d+\s+", "")))


def recipient_level(level: Column) -> Column:
    return F.coalesce(lookup(F.upper(level), RECIPIENT_LEVELS), level)


def filing_period(period: Column) -> Column:
    return F.coalesce(lookup(period, FILING_PERIODS), period)


def agenda_edition(edition: Column) -> Column:
    """"202510" -> "Fall 2025"; other shapes pass through."""
    season = F.when(edition.endswith("04"), "Spring ").otherwise("Fall ")
    known = edition.rlike(r"^\d{4}(04|10)$")
    return F.when(known, F.concat(season, F.substring(edition, 1, 4))).otherwise(edition)
