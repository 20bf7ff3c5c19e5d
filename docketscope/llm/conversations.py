"""Conversation structure repair: the cheapest edits that make the turns alternate, and what was wrong.

A conversation's rows are taken by turn (nulls first), then role and text. Rows are coded by their first fault (blank,
duplicate, truncated), and the edits are found by a bidirectional search (``edits``). Conversations of at most
``LARGE_ROWS`` rows and ``LARGE_BYTES`` bytes are met whole, in one pass over rows sorted by conversation. Longer
ones, of which one may hold a third of all rows, are dealt by ranges of turns: equal rows are counted instead of
repeated, first occurrences of a (role, text) are found by aggregation, every task searches its range in pieces
from each state to each other, and only these results (a few letters per row) meet by conversation. The repaired turns
of a long conversation stay in parts; nothing but a running digest and its letters ever sees the whole.

Cases: null roles and texts are one space; rows without id form one conversation; null turns come first and do
not count for gaps; a role is known by its first character, any other (or an empty role) must be given a new role or deleted;
ties are taken by role and text; a conversation whose rows are all dropped gives zeros and no letters;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketscope.llm import edits
from docketscope.llm.runtime import columns
from docketscope.operators.joins import checked_broadcast
from docketscope.session import cut_lineage

LARGE_ROWS = 4096
LARGE_BYTES = 8 << 20
# Rows and bytes of a part of a long conversation.
PART_ROWS = 256
PART_BYTES = 1 << 20
OUT_ROWS = 512

BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL_PAIRS = {"su", "ua", "au"}

_TURNS = "array<struct<role:string,text:string>>"
_PARTS = "key string, part long, parts long, " + ", ".join(f"{c} long" for c in COUNTS) + f", cost long, audit string, turns {_TURNS}"
_TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PART_SCHEMA = pa.schema(
    [("key", pa.string()), ("part", pa.int64()), ("parts", pa.int64())] + [(c, pa.int64()) for c in COUNTS]
    + [("cost", pa.int64()), ("audit", pa.string()), ("turns", _TURN_TYPE)]
)


def damage(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by a hash of their place; dropped rows have no copies."""
    given = columns(
        conversations, conv_id=id_col, turn=F.col("`turn`").cast("long"), role=F.coalesce(F.col("`role`"), F.lit(" ")),
        text=F.coalesce(F.col("`text`"), F.lit(" ")),
    )
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return given.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _fault(text: str) -> str:
    """'b'lank, 't'runcated or '' by the text alone."""
    text = text.rstrip(BLANKS)
    return "b" if not text else "" if text[-1] in ".!?" else "t"


@dataclass
class Facts:
    """What is wrong with consecutive rows; facts of neighbouring ranges can be added."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    least: int | None = None
    most: int | None = None
    first: str | None = None
    last: str | None = None

    def see(self, turn: int | None, role: str, fault: str, copies: int = 1) -> str:
        """Count a row and those equal to it; returns their codes."""
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL_PAIRS
        self.illegal += copies - 1  # an initial next to itself
        self.last = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if fault == "b":
            self.blank += copies
            return "d" * copies
        self.duplicate += copies - (fault != "d")
        if fault == "d":
            return "d" * copies
        code = initial if initial and initial in "sua" else "x"
        self.truncated += fault == "t"
        return (code.upper() if fault == "t" else code) + "d" * (copies - 1)

    def add(self, later: Facts) -> None:
        """Take in the facts of the rows that follow."""
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(later, name))
        if self.last is not None and later.first is not None:
            self.illegal += self.last + later.first not in LEGAL_PAIRS
        self.turns += later.turns - (later.least is not None and later.least == self.most)
        self.first = later.first if self.first is None else self.first
        self.last = later.last if later.last is not None else self.last
        self.least = later.least if self.least is None else self.least
        self.most = later.most if later.most is not None else self.most

    def counts(self) -> list[int]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = OUT_ROWS, most_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; the last cell of a row may be a list of turns."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t[1]) for t in row[-1] or ())
        if len(held) == most or size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], f.type) for k, f in enumerate(schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], f.type) for k, f in enumerate(schema)], schema=schema)


def _whole(rows: DataFrame) -> DataFrame:
    """One part per conversation (_PARTS), from rows sorted by conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repaired() -> Iterator[tuple]:
            key, held = None, []
            for k, *row in _rows_of(batches):
                if k != key and key is not None:
                    yield close(key, held)
                    held = []
                key = k
                held.append(row)
            if key is not None:
                yield close(key, held)

        def close(key: str, held: list) -> tuple:
            facts, seen, codes, kept = Facts(), set(), [], []
            for turn, role, text, copies in held:
                if copies:
                    fault = _fault(text)
                    if fault != "b" and (role, text) in seen:
                        fault = "d"
                    seen.add((role, text))
                    codes.append(facts.see(turn, role, fault, copies))
                    kept.extend([(role, text)] * copies)
            code = "".join(codes)
            letters = edits.repair_letters(code) if code else ""
            turns = edits.apply(letters, edits.START, kept, code)
            return (key, 0, 1, *facts.counts(), edits.price_of(letters, code), letters, turns)

        yield from _in_batches(repaired(), _PART_SCHEMA)

    return rows.mapInArrow(run, _PARTS)


def _order() -> list:
    return ["key", F.asc_nulls_first("turn"), "role", "text"]


_PIECE_SCHEMA = pa.schema(
    [("key", pa.string()), ("range", pa.int64()), ("part", pa.int64()), ("codes", pa.string()), ("node", pa.binary()), ("turns", _TURN_TYPE)]
)


def _ranges(rows: DataFrame) -> DataFrame:
    """Parts of long conversations, and one node per conversation and task: facts and edits between all states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()

        def found() -> Iterator[tuple]:
            key, facts, parts, codes, turns, size = None, Facts(), [], "", [], 0

            def part() -> tuple:
                nonlocal codes, turns, size
                row = (key, here, len(parts), codes, None, turns)
                parts.append(codes)
                codes, turns, size = "", [], 0
                return row

            def node() -> tuple:
                paths = {s: edits.begin(s) for s in edits.STATES}
                for piece in edits.pieces("".join(parts)):
                    step = edits.matrix(piece)
                    paths = {s: edits.extend(p, step) for s, p in paths.items()}
                table = {(s, e): (p.price, "".join(x for _, x in edits.letters_of(p))) for s, ps in paths.items() for e, p in ps.items()}
                return (key, here, -1, None, zlib.compress(pickle.dumps((facts, parts, table)), 1), None)

            for k, turn, role, text, copies, again in _rows_of(batches):
                if k != key and key is not None:
                    if codes:
                        yield part()
                    yield node()
                    facts, parts = Facts(), []
                key = k
                fault = _fault(text)
                more = facts.see(turn, role, "d" if again and fault != "b" else fault, copies)
                for n, code in enumerate(more):
                    codes += code
                    turns.append((role, text) if n == 0 and code != "d" else ("", ""))
                    size += len(turns[-1][1])
                    if len(codes) == PART_ROWS or size > PART_BYTES:
                        yield part()
            if key is not None:
                if codes:
                    yield part()
                yield node()

        yield from _in_batches(found(), _PIECE_SCHEMA)

    return rows.mapInArrow(run, "key string, range long, part long, codes string, node binary, turns " + _TURNS)


_SLICES = "key string, range long, at long, state int, letters string, part long, parts long, " + ", ".join(f"{c} long" for c in COUNTS)
_SLICE_SCHEMA = pa.schema(
    [("key", pa.string()), ("range", pa.int64()), ("at", pa.int64()), ("state", pa.int32()), ("letters", pa.string()),
     ("part", pa.int64()), ("parts", pa.int64())] + [(c, pa.int64()) for c in COUNTS]
)


def _slices(nodes: DataFrame) -> DataFrame:
    """The state before and the letters of every part, from the nodes of its conversation in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: str, held: list) -> Iterator[tuple]:
            paths, facts = edits.begin(edits.START), Facts()
            for _, (own, _, table) in held:
                paths = edits.extend(paths, table)
                facts.add(own)
            chosen = edits.letters_of(edits.finish(paths))
            total, number = sum(len(parts) for _, (_, parts, _) in held), 0
            for (place, (_, parts, _)), (state, letters) in zip(held, chosen, strict=True):
                for at, (before, own) in enumerate(edits.cut(letters, state, parts)):
                    # counts add up over a conversation's parts
                    yield (key, place, at, before, own, number, total, *(facts.counts() if number == 0 else [0] * len(COUNTS)))
                    number += 1

        def found() -> Iterator[tuple]:
            key, held = None, []
            for k, place, node in _rows_of(batches):
                if k != key and key is not None:
                    yield from close(key, held)
                    held = []
                key = k
                held.append((place, pickle.loads(zlib.decompress(node))))
            if key is not None:
                yield from close(key, held)

        held = []
        for row in found():
            held.append(row)
            if len(held) == OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], f.type) for k, f in enumerate(_SLICE_SCHEMA)], schema=_SLICE_SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], f.type) for k, f in enumerate(_SLICE_SCHEMA)], schema=_SLICE_SCHEMA)

    return nodes.mapInArrow(run, _SLICES)


def _applied(parts: DataFrame) -> DataFrame:
    """Repaired parts (_PARTS) from parts joined with their letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for key, part, total, *counts, state, letters, codes, turns in _rows_of(batches):
                rows = [(t["role"], t["text"]) for t in turns]
                yield (key, part, total, *counts, edits.price_of(letters, codes), letters, edits.apply(letters, state, rows, codes))

        yield from _in_batches(found(), _PART_SCHEMA)

    return parts.select("key", "part", "parts", *COUNTS, "state", "letters", "codes", "turns").mapInArrow(run, _PARTS)


def _long(rows: DataFrame) -> DataFrame:
    """Parts (_PARTS) of long conversations."""
    once = cut_lineage(rows.where("copies > 0").groupBy("key", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies")))
    same = ["key", "role", "digest"]
    marked = once.withColumn("digest", F.md5("text"))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first")
    repeated = marked.groupBy(*same).agg(first, F.count("*").alias("rows")).where(F.col("rows") > 1)
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    coded = marked.join(checked_broadcast(repeated.drop("rows")), same, "left").withColumn("again", again)
    near = F.substring("text", 1, 256)  # bounds of ranges are short; texts alike beyond that stay together
    dealt = (
        coded.select("key", "turn", "role", "text", "copies", "again")
        .repartitionByRange("key", F.asc_nulls_first("turn"), "role", near).sortWithinPartitions(*_order())
    )
    stored = cut_lineage(_ranges(dealt))
    nodes = stored.where(F.col("node").isNotNull()).select("key", "range", "node")
    slices = _slices(nodes.repartition("key").sortWithinPartitions("key", "range"))
    parts = stored.where(F.col("node").isNull()).select("key", "range", F.col("part").alias("at"), "codes", "turns")
    return _applied(parts.join(slices, ["key", "range", "at"]))


class Repaired(NamedTuple):
    """Parts (conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, turns) of conversations.

    A whole conversation is one part; a long one has several: counts and cost add up over its parts, letters and turns
    follow one another by part. ``long`` is None if there is no long conversation.
    """

    whole: DataFrame
    long: DataFrame | None

    def parts(self) -> DataFrame:
        return self.whole if self.long is None else self.whole.unionByName(self.long)


def repair(rows: DataFrame, id_col: str = "conv_id") -> Repaired:
    """The repaired conversations.

    ``rows`` has conv_id, turn, role, text and, optionally, copies: how often a row is there (0: not at all, but its
    conversation is reported).
    """
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    kind = dict(rows.dtypes)[id_col]
    key = F.when(F.col(f"`{id_col}`").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(f"`{id_col}`").cast("string")))
    given = columns(
        rows, key=key, turn=F.col("`turn`").cast("long"), role=F.coalesce(F.col("`role`"), F.lit(" ")),
        text=F.coalesce(F.col("`text`"), F.lit(" ")), copies=copies,
    )
    sizes = given.groupBy("key").agg(F.sum("copies").alias("rows"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    large = checked_broadcast(sizes.where((F.col("rows") > LARGE_ROWS) | (F.col("bytes") > LARGE_BYTES)).select("key"))
    conv_id = F.when(F.startswith("key", F.lit("v")), F.substring("key", 2, 1 << 30).cast(kind)).alias("conv_id")

    def named(parts: DataFrame) -> DataFrame:
        return parts.select(conv_id, *[c for c in parts.columns if c != "key"])

    none = large.isEmpty()
    small = given if none else given.join(large, "key", "left_anti")
    whole = _whole(small.repartition("key").sortWithinPartitions(*_order()))
    return Repaired(named(whole), None if none else named(_long(given.join(large, "key", "left_semi"))))


def summarise(repaired: Repaired) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    Whole conversations are digested where they are; the parts of a long one are hashed in order, one after the other.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    whole = repaired.whole.select(
        "conv_id", *COUNTS, "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256")
    )
    if repaired.long is None:
        return whole
    kind = dict(repaired.long.dtypes)["conv_id"]
    names = ["conv_id", "part", *COUNTS, "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            values = [[key], *[[n] for n in numbers], ["".join(letters)], [digest.hexdigest()]]
            kinds = [key_type, *[pa.int64()] * len(numbers), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
            )

        key, key_type, began = None, None, False
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for k, _, *own, audit, text, some in _rows_of([batch]):
                if not began or k != key:
                    if began:
                        yield close()
                    key, began, numbers, letters, digest, empty = k, True, [0] * len(own), [], hashlib.sha256(), True
                numbers = [a + b for a, b in zip(numbers, own, strict=True)]
                letters.append(audit)
                if some:
                    digest.update(text.encode() if empty else b"\n" + text.encode())
                    empty = False
        if began:
            yield close()

    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string, repaired_sha256 string"
    parts = repaired.long.select(*names, lines.alias("text"), (F.size("turns") > 0).alias("some"))
    streamed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)
    return whole.unionByName(streamed)
