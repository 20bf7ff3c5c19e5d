"""Personal data: anchors by Aho-Corasick, boundaries by local parsers.

One automaton finds at-signs, digits after a dot or a plus, digits, address schemes and identifier cues
in a text. Each anchor starts a parser that expands to the left and right, validates (number
ranges, digit counts, check digits, host names) and gives at most one span. Text without anchors
is passed over at the automaton's speed; no pattern scans it.

Kinds of the base, leftmost and non-overlapping per kind:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(.[A-Za-z0-9-]+)+
    ip     four digit groups joined by dots, each at most 255
    card   digits with single blanks or hyphens between them, 13 to 19 digits, Luhn sum
    phone  + digit, then blanks, brackets, dots, hyphens, digits up to the last digit; 9 to 15 digits

The base's candidates that fail a check are dropped without another try inside them. Beyond the base:

    url      scheme://user[:password]@host, an address that carries a login
    account  the value after an identifier cue (token, password, ...) and = or :

Offsets count code points, ends are exclusive. Cases: null and empty texts have no spans; texts of
any length are read whole; null ids and repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from docketscope.llm.runtime import columns, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "iban", "account", "ssn")

_DIGITS = frozenset("0123456789")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_LOCAL = _HOST | frozenset("._%+")
_PHONE = _DIGITS | frozenset(" ().-")
_VALUE = _HOST | frozenset("_+/=.")
_USER = _LOCAL | frozenset(":~!$&*")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("email", 1))
    for digit in "0123456789":
        automaton.add_word(digit, ("card", 1))
        automaton.add_word("." + digit, ("ip", 2))
        automaton.add_word("+" + digit, ("phone", 2))
    for scheme in SCHEMES:
        automaton.add_word(scheme, ("url", len(scheme)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            automaton.add_word(form, ("account", len(form)))
    automaton.make_automaton()
    return automaton


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """End of the run of allowed characters from ``at`` on."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, least: int, allowed: frozenset[str]) -> int:
    """Start of the run of allowed characters that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    """Check sum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _email(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """From the at-sign: local part to the left, a host of two or more labels to the right."""
    start = _back(text, at, least, _LOCAL)
    if start == at:
        return None
    end = _run(text, at + 1, _HOST)
    if end == at + 1:
        return None
    labels = 1
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _HOST:
        end = _run(text, end + 1, _HOST)
        labels += 1
    return (start, end, True) if labels > 1 else None


def _ip(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """From the first dot: the group before it and three more groups."""
    start = _back(text, at, least, _DIGITS)
    if start == at:
        return None
    groups, end = [text[start:at]], at
    for _ in range(3):
        if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in _DIGITS:
            return None
        stop = _run(text, end + 1, _DIGITS)
        groups.append(text[end + 1 : stop])
        end = stop
    small = all(len(g := group.lstrip("0")) <= 3 and int(g or 0) <= 255 for group in groups)
    return start, end, small


def _card(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """From the first digit: digits joined by nothing, one blank or one hyphen."""
    if at < least:
        return None
    end, n = at + 1, len(text)
    digits = [text[at]]
    while end < n:
        if text[end] in _DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    if len(digits) < 2:
        return None
    return at, end, 13 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """From the plus: up to the last digit of the run of phone characters."""
    if at < least:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4 or text[end - 1] not in _DIGITS:
        return None
    return at, end, 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15


def _url(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """From the scheme: a login, an at-sign and a host of two or more labels."""
    begin = text.find("//", at) + 2
    if at < least:
        return None
    sign = _run(text, begin, _USER)
    if sign == begin or sign >= len(text) or text[sign] != "@":
        return None
    host = _email(text, sign, begin)
    return (at, host[1], True) if host else None


def _account(text: str, at: int, least: int, length: int) -> tuple[int, int, bool] | None:
    """From the cue: a separator, an optional quote, and a value of 8 or more characters with a digit."""
    if at < least or at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    n, k = len(text), at + length
    while k < n and text[k] in " \t":
        k += 1
    if k >= n or text[k] not in "=:":
        return None
    k += 1
    while k < n and text[k] in " \t":
        k += 1
    if k < n and text[k] in "\"'":
        k += 1
    end = _run(text, k, _VALUE)
    while end > k and text[end - 1] in ".=":
        end -= 1
    value = text[k:end]
    return (k, end, len(value) >= 8 and any(c in _DIGITS for c in value)) if value else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind in the order of KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _anchors().iter(text):
        at = last - length + 1
        if kind == "card":
            if at < done["card"]:
                continue
            span = _card(text, at, done["card"])
        elif kind == "email":
            span = _email(text, at, done["email"])
        elif kind == "ip":
            span = _ip(text, at, done["ip"])
        elif kind == "phone":
            span = _phone(text, at, done["phone"])
        elif kind == "url":
            span = _url(text, at, done["url"])
        else:
            span = _account(text, at, done["account"], length)
        if span:
            start, end, valid = span
            done[kind] = end
            if valid:
                found[kind].append((start, end))
    return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    parts, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        end = -end
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every document."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text or "")]
                for text in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(item))], ["doc_id", "spans"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    )


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the spans of ``text_col`` replaced; null stays null."""
    from docketscope.llm.runtime import ship

    ship(docs.sparkSession)
    schema, place = docs.schema, docs.columns.index(text_col)
    work = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{place}"):
            clean = [None if t is None else redact(t, find_spans(t)) for t in part.column(place).to_pylist()]
            arrays = part.columns
            arrays[place] = pa.array(clean, part.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return work.mapInArrow(run, work.schema).toDF(*schema.names)
