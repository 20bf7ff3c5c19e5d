"""Field clean-up and row-level derivations over raw string and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTACHMENTS_SCHEMA = "array<struct<title:string,formats:array<struct<url:string,format:string>>>>"
STRING_LIST = "array<string>"


def unquote(c: Column) -> Column:
    """Drop one literal double quote at either end."""
    return F.regexp_replace(c, r'^"|"$', "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Any value as a trimmed, unquoted string; empty becomes NULL."""
    return blank_to_null(F.trim(unquote(c.cast("string"))))


def normalize_source_row(df: DataFrame) -> DataFrame:
    """Clean every column of an all-string source table in one projection."""
    return df.select(*[clean_text(F.col(f"`{c}`")).alias(c) for c in df.columns])


def clean_strings(df: DataFrame) -> DataFrame:
    """Unquote the string columns of an export and leave the others alone."""
    return df.select(
        *[unquote(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    )


def raw_json_field(raw: Column, field: str) -> Column:
    """Soft access to ``data.attributes``, else ``data``, else the root object.

    The first block that exists decides, as an absent field inside it must not
    fall through to an outer one.
    """
    attributes = F.get_json_object(raw, "$.data.attributes")
    data = F.get_json_object(raw, "$.data")
    return (
        F.when(attributes.isNotNull(), F.get_json_object(attributes, f"$.{field}"))
        .when(data.isNotNull(), F.get_json_object(data, f"$.{field}"))
        .otherwise(F.get_json_object(raw, f"$.{field}"))
    )


def with_raw_json_fallback(c: Column, raw: Column, field: str) -> Column:
    return F.coalesce(blank_to_null(unquote(c)), blank_to_null(raw_json_field(raw, field)))


def file_name(url: Column, default: str) -> Column:
    last = F.element_at(F.split(url, "/"), -1)
    return F.coalesce(blank_to_null(last), F.lit(default))


def json_strings(c: Column) -> Column:
    """A JSON array of strings; unparseable input gives NULL."""
    return F.from_json(c, STRING_LIST)


def clean_ids(ids: Column) -> Column:
    """Unquoted, non-empty ids; NULL becomes an empty array."""
    cleaned = F.filter(
        F.transform(ids, lambda i: unquote(F.coalesce(i, F.lit("")))), lambda i: i != ""
    )
    return F.coalesce(cleaned, F.array().cast(STRING_LIST))


def comment_attachments(
    comments: DataFrame, json_col: str = "attachments_json", keep: tuple[str, ...] = ("comment_id",)
) -> DataFrame:
    """One row per attached file: name, url, upper-case format."""
    parsed = F.from_json(F.col(json_col), ATTACHMENTS_SCHEMA)
    files = (
        comments.select(*keep, F.explode(parsed).alias("a"))
        .select(*keep, F.col("a.title").alias("title"), F.explode("a.formats").alias("f"))
        .where(F.col("f.url") != "")
    )
    url = F.col("f.url")
    return files.select(
        *keep,
        F.coalesce(blank_to_null(F.col("title")), file_name(url, "Attachment")).alias("name"),
        url.alias("url"),
        F.upper(F.coalesce(blank_to_null(F.col("f.format")), F.lit("file"))).alias("format"),
    )


def document_attachment(documents: DataFrame) -> DataFrame:
    """The 0-or-1 attachment carried by a document's ``file_url``."""
    url = unquote(F.col("file_url"))
    name = file_name(url, "Document")
    extension = F.upper(F.element_at(F.split(name, r"\."), -1))
    return documents.where(url != "").select(
        "document_id",
        name.alias("name"),
        F.when(F.contains(name, F.lit(".")), extension).otherwise("FILE").alias("type"),
        url.alias("url"),
    )


def comment_author(
    organization: Column, first_name: Column, last_name: Column, title: Column
) -> Column:
    """Organization, else "First Last", else the title, else Anonymous."""
    person = F.concat_ws(
        " ", blank_to_null(unquote(first_name)), blank_to_null(unquote(last_name))
    )
    return F.coalesce(
        blank_to_null(unquote(organization)),
        blank_to_null(person),
        blank_to_null(unquote(title)),
        F.lit("Anonymous"),
    )


def is_organization(organization: Column) -> Column:
    return F.coalesce(unquote(organization) != "", F.lit(False))


def slug_list(slugs: Column) -> Column:
    """Comma-joined agency slugs as a distinct list without blanks."""
    parts = F.transform(F.split(slugs, ","), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


def presidential_label(document_type: Column, subtype: Column, order_number: Column) -> Column:
    numbered = F.concat_ws(" ", subtype, blank_to_null(order_number))
    return F.when((document_type == "Presidential Document") & (subtype != ""), numbered)
