"""Mixing sources to target weights: subset-sum budget fitting over exact lengths.

1. One pass counts the words of every document; equal narrow rows are counted together.
2. Sources share the total by weight. A target stops at ``most`` times its source's size and
   the excess is shared again by weight: a water level found with running sums.
3. Each document is taken whole as often as the target holds its source. For the budget that is
   left, a source's documents are counted by length: every length gives its proportional share, and
   a bounded-knapsack dynamic program over the lengths fills what remains exactly, where the
   lengths allow it.
4. The documents of a length are ordered by a seeded hash; the first ones are taken once more.

A source's task gets one row per distinct length, never its documents. Ranks inside a length are
counted in hash ranges of bounded size, so a length or a row that occurs very often is split.

Cases: a null text has no words; a document without words is taken with 0 words; null sources form
the last source; null ids and repeated rows are kept, each with its own decision; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketscope.llm.runtime import columns, ship, slices
from docketscope.llm.textbytes import Texts
from docketscope.session import cut_lineage

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
SEED = 20
# The dynamic program runs over budgets up to this many words; greater ones are first reduced by whole documents.
DP_BUDGET = 1 << 16
# Rows of one length ranked together.
RANKED_ROWS = 50_000


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sizes = pa.array(Texts.of(part.column("text")).word_counts(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), sizes], ["doc_id", "source", "size"]
            )

    return docs.mapInArrow(run, "doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    The only step over all sources at once; it handles one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    caps = (
        sizes.withColumn("place", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    levels = caps.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything)
    return levels.select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap"))).alias("target")
    )


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``.

    At most ``counts``; the sum is the reachable one nearest to the budget, below or above it, among the choices
    that keep the proportional shares and the documents taken before the program.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64).copy()
    share = counts * (budget / total)
    taken = np.minimum(np.floor(share).astype(np.int64), counts)
    taken[lengths == 0] = 0
    left = budget - int((lengths * taken).sum())
    # largest remainders first, as long as the budget is too great for the program
    for k in np.argsort(-(share - np.floor(share)), kind="stable"):
        if left <= DP_BUDGET:
            break
        if 0 < lengths[k] <= left and taken[k] < counts[k]:
            taken[k] += 1
            left -= int(lengths[k])
    for k in np.argsort(-lengths, kind="stable"):
        if left <= DP_BUDGET or lengths[k] == 0:
            break
        more = min(int(counts[k] - taken[k]), -((DP_BUDGET - left) // int(lengths[k])), left // int(lengths[k]))
        taken[k] += more
        left -= more * int(lengths[k])
    if left <= 0:
        return taken
    if left > DP_BUDGET:  # every document still free is longer than what is left: the shortest of them or none
        free = np.flatnonzero((taken < counts) & (lengths > 0))
        least = free[np.argmin(lengths[free])]
        if lengths[least] - left < left:
            taken[least] += 1
        return taken
    # a sum of more than twice the goal is farther from it than none at all
    goal, span = left, 2 * left
    # bounded knapsack: each length in pieces of 1, 2, 4, ... documents; the piece that first reaches a sum
    first = np.full(span + 1, -1, dtype=np.int64)
    reached = np.zeros(span + 1, dtype=bool)
    reached[0] = True
    pieces: list[tuple[int, int]] = []
    for k in np.argsort(lengths, kind="stable"):
        size = int(lengths[k])
        if size == 0:
            continue
        if size > span or reached[goal]:
            break
        free, many = min(int(counts[k] - taken[k]), span // size), 1
        while free > 0 and not reached[goal]:
            use = min(many, free)
            step = use * size
            if step <= span:
                new = reached[:-step] & ~reached[step:]
                first[step:][new] = len(pieces)
                reached[step:] |= new
                pieces.append((int(k), use))
            free -= use
            many *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at > 0:
        k, use = pieces[first[at]]
        taken[k] += use
        at -= use * int(lengths[k])
    return taken


def _plan(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, whole, extra, rows): whole takes of every document, and documents taken once more."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        total, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        whole = int(target // total) if total else 0
        budget = round(target - whole * total)
        extra = fit_lengths(part["size"].to_numpy(), part["rows"].to_numpy(), budget)
        return pd.DataFrame(
            {
                "source": part["source"], "size": part["size"], "rows": part["rows"], "source_size": total,
                "target": target, "whole": whole, "extra": extra,
            }
        )

    joined = lengths.join(
        targets.withColumnRenamed("source", "s"), lengths["source"].eqNullSafe(F.col("s")), "inner"
    ).drop("s")
    return joined.groupBy("source").applyInPandas(
        run, "source string, size long, rows long, source_size long, target double, whole long, extra long"
    )


def _decide(
    sized: DataFrame, weights: tuple[float, ...], most: int, seed: int
) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, whole, again): of n equal rows, ``again`` are taken once more."""
    rows = cut_lineage(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    lengths = rows.groupBy("source", "size").agg(F.sum("n").alias("rows"))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    plan = cut_lineage(_plan(lengths, source_targets(totals, weights, most)))
    keyed = plan.withColumnsRenamed({"source": "plan_source", "size": "plan_size"})
    rows = rows.join(
        keyed, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("size") == F.col("plan_size"))
    ).drop("plan_source", "plan_size")
    ranges = F.ceil(F.col("rows") / RANKED_ROWS)
    rows = rows.withColumn("range", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * ranges))
    key = ["source", "size"]
    so_far = Window.unboundedPreceding, -1
    none = F.lit(0).cast("long")
    before = rows.groupBy(*key, "range").agg(F.sum("n").alias("m")).select(
        F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("range").alias("b_range"),
        F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy("range").rowsBetween(*so_far)), none).alias("before"),
    )
    inside = Window.partitionBy(*key, "range").orderBy("order", "doc_id").rowsBetween(*so_far)
    ranked = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), none)).join(
        before,
        F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("range") == F.col("b_range")),
    )
    left = F.col("extra") - F.col("before") - F.col("inside")
    return ranked.select(
        "doc_id", "source", "size", "n", "source_size", "target", "whole", F.greatest(F.least(left, F.col("n")), none).alias("again")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per document row."""
    sized = word_sizes(columns(docs, doc_id=id_col, text=text_col, source=F.col(f"`{source_col}`").cast("string")))
    rows = _decide(sized, weights, most, seed)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("whole") + (F.col("copy") <= F.col("again")).cast("long")
    return rows.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeat_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    names = docs.columns
    work = docs.toDF(*[f"c{k}" for k in range(len(names))])
    key, text, source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    ship(docs.sparkSession)
    schema = ", ".join([f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)] + ["size long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            sizes = pa.array(Texts.of(part.column(text)).word_counts(), pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, sizes], [*part.schema.names, "size"])

    sized = word_sizes(columns(docs, doc_id=id_col, text=text_col, source=F.col(f"`{source_col}`").cast("string")))
    plan = _decide(sized, weights, most, seed).select(
        F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "whole", "again"
    )
    met = work.mapInArrow(run, schema).join(
        plan,
        F.col(key).eqNullSafe(F.col("p_id")) & F.col(source).eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")),
    )
    # Equal rows of which only some are taken once more are told apart by their place among them.
    order = Window.partitionBy("p_id", "p_source", "p_size").orderBy(F.xxhash64(text))
    split = (F.col("again") > 0) & (F.col("again") < F.col("n"))
    alike = met.where(~split).withColumn("copies", F.col("whole") + (F.col("again") > 0).cast("long"))
    apart = met.where(split).withColumn("place", F.row_number().over(order))
    apart = apart.withColumn("copies", F.col("whole") + (F.col("place") <= F.col("again")).cast("long")).drop("place")
    taken = alike.unionByName(apart).where("copies > 0")
    repeated = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
