"""Comment-text normalisation: display -> canonical -> skeleton -> token set.

All functions are Column -> Column and stay inside the JVM. Word boundaries are
written as ASCII lookarounds because Java's own ``\\b`` is Unicode-aware and
would miss a cue next to an accented letter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities decoded, in this order (so "&amp;lt;" becomes "<").
ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
]

# Greeting openers and sign-off closers.
GREETING_WORDS = ["dear", "hello", "hi", "greetings"]
GREETING_PHRASE = "to whom it may concern"
SIGNOFF_WORDS = ["sincerely", "respectfully", "regards", "best regards", "thank you", "thanks"]

# One of these is in every sign-off.
SIGNOFF_STEMS = ["sincerely", "respectfully", "regards", "thank"]

WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"

URL_PATTERN = rf"(?i){WORD_START}(?:https?://|www\.)\S+"
EMAIL_PATTERN = r"(?i)\S+@\S+\.\S+"

TIERS = ("exact", "template", "near")


def _only_if(test: Column, changed: Column, text: Column) -> Column:
    """Run a costly rewrite only on texts that can contain what it rewrites."""
    return F.when(test, changed).otherwise(text)


def text_display(raw: Column) -> Column:
    """Readable text: tags to spaces, entities decoded, whitespace collapsed."""
    text = _only_if(F.contains(raw, F.lit("<")), F.regexp_replace(raw, r"<[^>]+>", " "), raw)
    decoded = text
    for entity, char in ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    text = _only_if(F.contains(raw, F.lit("&")), decoded, text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_canonical(display: Column) -> Column:
    """Lower-case alphanumerics separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(display), r"[^a-z0-9]+", " "))


def text_strip_contacts(display: Column) -> Column:
    """Lower-case text without e-mail addresses and URLs."""
    lower = F.lower(display)
    no_mail = _only_if(
        F.contains(display, F.lit("@")), F.regexp_replace(lower, r"\S+@\S+", " "), lower
    )
    linked = F.contains(display, F.lit("://")) | F.contains(lower, F.lit("www."))
    return _only_if(linked, F.regexp_replace(no_mail, r"https?://\S+|www\.\S+", " "), no_mail)


def name_mask(name: Column) -> Column:
    """A submitter name as it is removed from lower-case text; NULL unless longer than two characters."""
    return F.when(F.length(F.trim(name)) > 2, F.lower(F.trim(name)))


def text_strip_name(text: Column, name: Column) -> Column:
    """Remove one submitter name (longer than two characters) from lower-case text."""
    return F.coalesce(F.replace(text, name_mask(name), F.lit(" ")), text)


def text_letters(text: Column) -> Column:
    """Last skeleton step: letters only."""
    return F.trim(F.regexp_replace(text, r"[^a-z]+", " "))


def text_skeleton(display: Column, names: list[Column] | None = None) -> Column:
    """Template text: contacts (and optionally the signer's names), digits, punctuation gone."""
    text = text_strip_contacts(display)
    for name in names or []:
        text = text_strip_name(text, name)
    return text_letters(text)


def token_array(skeleton: Column) -> Column:
    """Sorted distinct tokens longer than two characters."""
    words = F.filter(F.split(skeleton, " "), lambda w: F.length(w) > 2)
    return F.sort_array(F.array_distinct(words))


def text_token_set(skeleton: Column) -> Column:
    """The token array joined by spaces: the order-tolerant near-duplicate text."""
    return F.array_join(token_array(skeleton), " ")


def tier_key(tier: str, raw: Column, skeleton: Column | None = None) -> Column:
    """Grouping key of one fidelity tier."""
    if tier == "exact":
        return F.md5(F.lower(F.trim(raw)))
    if tier == "template":
        return F.md5(skeleton)
    if tier == "near":
        return F.md5(text_token_set(skeleton))
    raise ValueError(f"unknown tier: {tier}")


def is_blank(raw: Column) -> Column:
    return raw.isNull() | (F.trim(raw) == "")


def is_placeholder(display: Column) -> Column:
    """Too short to be a letter, or only points at an attachment.

    Nothing of 40 characters or more can be one, so long texts cost a length.
    """
    trimmed = F.trim(display)
    clean = F.lower(trimmed)
    short = (
        (F.length(clean) < 20)
        | clean.rlike(r"^see attached( file(s)?)?\.?$")
        | (clean.startswith("see attached") & (F.length(clean) < 40))
    )
    return F.when(F.length(trimmed) >= 40, False).otherwise(short)


def is_placeholder_body(display: Column) -> Column:
    """The report's variant, on display text: drop tags and any named entity first."""
    plain = F.regexp_replace(F.regexp_replace(display, r"<[^>]+>", " "), r"(?i)&[a-z]+;", " ")
    marked = F.contains(display, F.lit("<")) | F.contains(display, F.lit("&"))
    return F.when(marked, is_placeholder(F.trim(F.regexp_replace(plain, r"\s+", " ")))).otherwise(
        is_placeholder(display)
    )


def word_count(canonical: Column) -> Column:
    return F.size(F.filter(F.split(canonical, " "), lambda w: w != "")).cast("long")


def _none(text: Column) -> Column:
    """No matches; NULL for a NULL text."""
    return F.when(text.isNotNull(), F.lit(0))


def link_count(display: Column) -> Column:
    linked = F.contains(display, F.lit("://")) | F.contains(F.lower(display), F.lit("www."))
    urls = _only_if(linked, F.regexp_count(display, F.lit(URL_PATTERN)), _none(display))
    mails = _only_if(F.contains(display, F.lit("@")), F.regexp_count(display, F.lit(EMAIL_PATTERN)), _none(display))
    return (urls + mails).cast("long")


def has_greeting(display: Column) -> Column:
    words = "|".join(GREETING_WORDS)
    pattern = rf"(?i)^(?:(?:{words}){WORD_END}|{GREETING_PHRASE})"
    return F.trim(display).rlike(pattern)


def has_signoff(display: Column) -> Column:
    words = "|".join(SIGNOFF_WORDS)
    lower = F.lower(display)
    held = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(stem)) for stem in SIGNOFF_STEMS])
    found = F.trim(display).rlike(rf"(?i){WORD_START}(?:{words}){WORD_END}[\s,]*$")
    return F.when(held, found).when(display.isNotNull(), False)


def comment_body(body: Column, attachment_text: Column) -> Column:
    """Attachment text when the body is blank or only says "see attached"."""
    stub = is_blank(body) | F.lower(F.trim(body)).startswith("see attached")
    filled = F.coalesce(F.nullif(F.trim(attachment_text), F.lit("")), body)
    return F.when(stub, filled).otherwise(body)
