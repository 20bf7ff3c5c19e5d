"""Text forms of comments, made in Arrow batches.

A text is read once, as UTF-8 bytes, and reduced to what is asked for; each form is what ``functions/text.py``
says of the same text. Tags, entities and contacts are looked for only where a text holds their marks, folding of
letters is one table look-up per byte, and words are split once, so the time grows with the bytes of the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docketscope.functions.text import ENTITIES, is_placeholder

# display: readable text; canonical, template, near: md5 of the canonical text, of the skeleton and of its token
# set; skeleton, tokenset: the skeleton and the token set themselves; words: words of the canonical text; head, body_head: the display text, and
# the report's variant without tags and entities, if shorter than 40 characters, else more than 40 of its first.
FORMS = ("display", "canonical", "template", "near", "skeleton", "tokenset", "words", "head", "body_head")

# Rows whose forms are held at once inside a task.
SLICE_ROWS = 256


def with_forms(
    rows: DataFrame, text: str, forms: tuple[str, ...], names: str | None = None, displayed: bool = False
) -> DataFrame:
    """``rows`` with the asked forms in place of column ``text``; NULL for a NULL text.

    Column ``names``, an array of lower-case names that are masked before the skeleton, is dropped too. A text that is
    ``displayed`` is a display text already: marks that its entities left stay.
    """
    others = [c for c in rows.columns if c not in (text, names)]
    mask = [] if names is None else [F.col(names).cast("array<binary>").alias("_names")]
    sent = rows.select(*others, F.col(text).cast("binary").alias("_text"), *mask)
    kept = [rows.schema[c] for c in others]
    schema = StructType([*kept, *(StructField(f, LongType() if f == "words" else StringType()) for f in forms)])
    return sent.mapInArrow(_reader(others, forms, displayed), schema)


def placeholder_flags() -> list[Column]:
    """The placeholder flags of keyed comments from their heads; a missing text is one."""
    heads = {"placeholder": "head", "placeholder_body": "body_head"}
    return [F.coalesce(is_placeholder(F.col(head)), F.lit(True)).alias(flag) for flag, head in heads.items()]


def _reader(others: list[str], forms: tuple[str, ...], displayed: bool = False):
    """The function of one task: a closure, so that executors need no copy of this package."""
    entities = [(mark.encode(), char.encode()) for mark, char in ENTITIES]
    rows_at_once = SLICE_ROWS
    wanted = set(forms)
    tag, entity = re.compile(rb"<[^>]+>"), re.compile(rb"&[A-Za-z]+;")
    link = re.compile(rb"https?://\S+|www\.\S+")
    # bytes of other characters separate words; letters are folded
    folded = bytes(range(256)).lower()
    letters = bytes(b if 97 <= b <= 122 else 32 for b in folded)
    alnum = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in folded)
    # the two other characters that have a letter a to z in their lower case
    others_folded = [("\u0130".encode(), "i\u0307".encode()), ("\u212a".encode(), b"k")]

    def md5(text: bytes) -> str:
        return hashlib.md5(text, usedforsecurity=False).hexdigest()

    def untagged(text: bytes) -> bytes:
        end = text.rfind(b">") + 1  # no tag ends behind it
        return tag.sub(b" ", text[:end]) + text[end:]

    def head(text: bytes) -> str:
        return b" ".join(text.split(None, 40)[:40])[:200].decode("utf-8", "ignore")

    def uncontacted(text: bytes) -> bytes:
        text = text.lower()
        if b"@" in text:
            text = b" ".join([b" " if 0 < w.find(b"@", 1) < len(w) - 1 else w for w in text.split()])
        return link.sub(b" ", text) if b"://" in text or b"www." in text else text

    def forms_of(raw: bytes, names: list[bytes | None]) -> dict:
        out: dict = {}
        text = raw if raw.isascii() else raw.decode("utf-8", "replace").encode()
        marked = b"&" in text and not displayed
        if b"<" in text and not displayed:
            text = untagged(text)
        if marked:
            for mark, char in entities:
                text = text.replace(mark, char)
        if "display" in wanted:
            out["display"] = b" ".join(text.split()).decode()
        if "head" in wanted:
            out["head"] = head(text)
        if "body_head" in wanted:
            plain = entity.sub(b" ", untagged(text)) if b"<" in text or b"&" in text else text
            out["body_head"] = head(plain)
        if not text.isascii():
            for char, lower in others_folded:
                text = text.replace(char, lower)
        if wanted & {"canonical", "words"}:
            words = text.translate(alnum).split()
            out["canonical"], out["words"] = md5(b" ".join(words)), len(words)
        if wanted & {"template", "near", "skeleton", "tokenset"}:
            plain = uncontacted(b" ".join(text.split()) if any(names) else text)
            if any(names):
                plain = plain.decode().lower().encode()
                for name in filter(None, names):
                    plain = plain.replace(name, b" ")
            words = plain.translate(letters).split()
            if "template" in wanted:
                out["template"] = md5(b" ".join(words))
            if "skeleton" in wanted:
                out["skeleton"] = b" ".join(words).decode()
            if wanted & {"near", "tokenset"}:
                tokens = b" ".join(sorted([w for w in set(words) if len(w) > 2]))
                out["near"], out["tokenset"] = md5(tokens), tokens.decode()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                texts = batch.column("_text").to_pylist()
                names = batch.column("_names").to_pylist() if "_names" in batch.schema.names else [None] * len(texts)
                made = [{} if t is None else forms_of(t, n or []) for t, n in zip(texts, names, strict=True)]
                arrays = [pa.array([m.get(f) for m in made], pa.int64() if f == "words" else pa.string()) for f in forms]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *arrays], names=[*others, *forms])

    return run
