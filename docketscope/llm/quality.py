"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gives a few ratios. Per language and source the ratios are counted in logarithmic
buckets (relative error ``ACCURACY``): such sketches merge by adding counts, so they are one
pre-aggregated ``groupBy``, come out the same in any order and after any retry, and have a size that
does not depend on the number of rows. A group with fewer than ``LEAST_ROWS`` documents takes the
merged sketch of its language, and that of all documents where the language is as small.
From the quartiles follow fences, quartile +- REACH * spread; a document outside any fence of its group
goes. The spread is at least the feature's ``slack``, so that a constant feature rejects only what is far off;
REACH * slack of the repeated words is less than the base's cutoff, so that a group without any has a fence below it.

Two fixed rules come first (``base_failed``): fewer than 20 words, or more than 30% of the words
inside 8-word windows that occur more than once in the text.

Cases: null and empty texts have no words and fail the base; texts of any length are read
whole; null languages and sources are groups of their own; null ids and repeated rows are kept, each
judged alone; an empty table gives no rows; other columns are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketscope.llm.runtime import columns, ship, slices
from docketscope.llm.textbytes import Texts, mix, ngrams
from docketscope.operators.joins import checked_broadcast
from docketscope.session import cut_lineage

LEAST_WORDS = 20
MOST_REPEATED = 0.30
WINDOW = 8
ACCURACY = 0.01
REACH = 8.0
LEAST_ROWS = 200
# Rows of about 150 bytes that are broadcast at most.
MOST_BROADCAST = 100_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_echoes")

# feature -> (numerator, denominator, least spread, fences: +1 upper only, 0 both)
FEATURES = {
    "symbols": ("n_symbols", "n_words", 0.02, 1),
    "duplicate_lines": ("n_dup_lines", "n_lines", 0.05, 1),
    "repeated_words": ("n_repeat_words", "n_words", 0.03, 1),
    "echoes": ("n_echoes", "n_words", 0.02, 1),
    "upper_case": ("n_upper", "word_chars", 0.05, 1),
    "marks": ("n_marks", "n_words", 0.05, 1),
    "word_length": ("word_chars", "n_words", 0.4, 0),
}


def _mask(codes: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int8)
    table[list(codes)] = 1
    return table


_SYMBOLS = _mask(b"#*$%&|<>")
_UPPER = _mask(bytes(range(65, 91)))
_MARKS = _mask(b"!?")
# bytes that begin a character that is no white space
_CHARS = np.array([not (128 <= b < 192 or b in b" \t\n\x0b\x0c\r") for b in range(256)], dtype=np.int8)


def _per_text(texts: Texts, table: np.ndarray) -> np.ndarray:
    """Sum of the table's values over each text's bytes."""
    sums = np.concatenate(([0], np.cumsum(table[texts.data], dtype=np.int64)))
    return np.diff(sums[texts.offsets])


def _lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier line)."""
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text inside windows that occur twice or more in that text."""
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(bounds[1:], counts)
    whole = np.flatnonzero(np.arange(len(words)) + window <= ends)
    if not len(whole):
        return np.zeros(len(counts), dtype=np.int64)
    grams = np.zeros(len(words), dtype=np.uint64)
    hashes, _ = ngrams(words, bounds, window)
    starts = (np.arange(len(words)) + window <= ends) | (np.arange(len(words)) == np.repeat(bounds[:-1], counts))
    grams[starts] = hashes
    keys = mix(grams[whole] + mix(text[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begins = np.zeros(len(words) + 1, dtype=np.int64)
    begins[whole[twice]] = 1
    sums = np.cumsum(begins)
    inside = sums[:-1].copy()
    inside[window:] -= sums[: max(len(words) - window, 0)]
    covered = np.concatenate(([0], np.cumsum(inside > 0)))
    return np.diff(covered[bounds])


def echoes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that equal the word before them."""
    same = np.zeros(len(words), dtype=np.int64)
    same[1:] = words[1:] == words[:-1]
    heads = bounds[:-1]
    same[heads[heads < len(words)]] = 0
    return np.diff(np.concatenate(([0], np.cumsum(same)))[bounds])


def measure(column: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text."""
    texts = Texts.of(column)
    words, bounds = texts.words()
    raw = texts.data.tobytes()
    lines = np.array(
        [_lines(raw[a:b]) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)], dtype=np.int64
    ).reshape(-1, 2)
    return [
        np.diff(bounds).astype(np.int64), _per_text(texts, _CHARS), _per_text(texts, _SYMBOLS), lines[:, 1],
        repeated_words(words, bounds), lines[:, 0], _per_text(texts, _UPPER), _per_text(texts, _MARKS),
        echoes(words, bounds),
    ]


def add_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... (positions, so that names cannot clash) and the COUNTS."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    work = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kept = [k for k in range(len(docs.columns)) if keep_text or k != place]
    schema = ", ".join([f"c{k} {work.schema[k].dataType.simpleString()}" for k in kept] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{place}"):
            found = [pa.array(a, pa.int64()) for a in measure(part.column(place))]
            names = [f"c{k}" for k in kept] + list(COUNTS)
            yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + found, names)

    return work.mapInArrow(run, schema)


def _ratio(feature: str) -> Column:
    over, under, _, _ = FEATURES[feature]
    return F.coalesce(F.try_divide(F.col(over), F.col(under)), F.lit(0.0))


def base_failed() -> Column:
    """The two fixed rules."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))


def thresholds(counted: DataFrame, lang: str, source: str) -> DataFrame:
    """(t_lang, t_source, <feature>_low, <feature>_high) for each language and source.

    The sketches take the documents that pass the base; the groups are those of all documents.
    """
    growth = log((1 + ACCURACY) / (1 - ACCURACY))
    items = F.array(*[F.struct(F.lit(f).alias("feature"), _ratio(f).alias("x")) for f in FEATURES])
    bucket = F.when(F.col("i.x") > 0, F.ceil(F.log("i.x") / growth).cast("int"))
    sketch = (
        counted.where(~base_failed())
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(items).alias("i"))
        .groupBy("lang", "source", F.col("i.feature").alias("feature"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    # merged sketches: level 0 one source of a language, 1 the language, 2 everything
    levels = F.array(*[F.struct(F.lit(v).alias("level"), a.alias("lang"), b.alias("source")) for v, a, b in (
        (0, F.col("lang"), F.col("source")), (1, F.col("lang"), F.lit(None).cast("string")),
        (2, F.lit(None).cast("string"), F.lit(None).cast("string")))])
    merged = (
        sketch.select(F.explode(levels).alias("g"), "feature", "bucket", "n")
        .groupBy("g.level", "g.lang", "g.source", "feature", "bucket").agg(F.sum("n").alias("n"))
    )
    pairs = F.transform(
        F.array_sort(F.collect_list(F.struct(F.coalesce("bucket", F.lit(-(1 << 30))).alias("bucket"), "n"))), lambda p: p
    )
    # one list per group and feature: as long as the sketch has buckets, whatever the number of rows
    lists = merged.groupBy("level", "lang", "source", "feature").agg(pairs.alias("p"), F.sum("n").alias("rows"))

    def quantile(q: float) -> Column:
        reached = F.aggregate(
            F.col("p"),
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("at")),
            lambda acc, p: F.struct(
                (acc["sum"] + p["n"]).alias("sum"),
                F.when(acc["at"].isNull() & (acc["sum"] + p["n"] >= q * F.col("rows")), p["bucket"]).otherwise(acc["at"]).alias("at"),
            ),
        )["at"]
        middle = F.exp(reached * growth) * (1 - ACCURACY)
        return F.when(reached == -(1 << 30), F.lit(0.0)).otherwise(middle)

    quartiles = lists.select("level", "lang", "source", "feature", "rows", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    slack = F.create_map(*[x for f, (_, _, s, _) in FEATURES.items() for x in (F.lit(f), F.lit(s))])
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), slack[F.col("feature")])
    fences = quartiles.select(
        "level", "lang", "source", "feature", "rows", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high")
    )
    wide = fences.groupBy("level", "lang", "source").agg(
        F.max("rows").alias("rows"),
        *[F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"{f}_{s}") for f in FEATURES for s in ("low", "high")],
    )
    wide = cut_lineage(wide)
    names = [f"{f}_{s}" for f in FEATURES for s in ("low", "high")]

    def level(k: int) -> DataFrame:
        return wide.where((F.col("level") == k) & (F.col("rows") >= LEAST_ROWS)).select(
            F.col("lang").alias(f"l{k}"), F.col("source").alias(f"s{k}"), F.lit(True).alias(f"has{k}"),
            *[F.col(n).alias(f"{n}{k}") for n in names],
        )

    groups = counted.select(F.col(lang).alias("t_lang"), F.col(source).alias("t_source")).distinct()
    groups = groups.join(level(0), F.col("t_lang").eqNullSafe(F.col("l0")) & F.col("t_source").eqNullSafe(F.col("s0")), "left")
    groups = groups.join(level(1), F.col("t_lang").eqNullSafe(F.col("l1")), "left")
    whole = wide.where("level = 2").first()  # one row of numbers
    chosen = [
        F.when(F.col("has0"), F.col(f"{n}0")).when(F.col("has1"), F.col(f"{n}1"))
        .otherwise(F.lit(whole[n] if whole else None).cast("double")).alias(n)
        for n in names
    ]
    # one row per language and source: broadcast up to a checked size, joined by shuffle beyond
    return checked_broadcast(groups.select("t_lang", "t_source", *chosen), MOST_BROADCAST)


def outside() -> Column:
    """True where a ratio lies beyond a fence of the document's group."""
    tests = []
    for f, (_, _, _, sides) in FEATURES.items():
        tests.append(F.coalesce(_ratio(f) > F.col(f"{f}_high"), F.lit(False)))
        if sides == 0:
            tests.append(F.coalesce(_ratio(f) < F.col(f"{f}_low"), F.lit(False)))
    return F.array_contains(F.array(*tests), True)


def _judged(counted: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    joined = counted.join(
        limits, F.col(lang).eqNullSafe(F.col("t_lang")) & F.col(source).eqNullSafe(F.col("t_source")), "left"
    )
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~outside())


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept), one row per document row; each text is read once."""
    narrow = columns(docs, doc_id=id_col, lang=lang_col, source=source_col, text=text_col)
    counted = cut_lineage(add_counts(narrow, keep_text=False))
    return _judged(counted, thresholds(counted, "c1", "c2"), "c1", "c2").select(
        F.col("c0").alias("doc_id"), *COUNTS, "base_failed", "kept"
    )


def keep_good(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    lang, source = (f"c{docs.columns.index(c)}" for c in (lang_col, source_col))
    counted = cut_lineage(add_counts(docs, text_col, keep_text=False))
    limits = thresholds(counted, lang, source)
    kept = _judged(add_counts(docs, text_col), limits, lang, source).where("kept")
    return kept.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)])
