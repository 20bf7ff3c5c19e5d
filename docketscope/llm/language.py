"""Language of web pages: Bayesian fusion of text, markup, address and host evidence.

Text likelihoods come from byte trigrams (hashed to 2**TRIGRAM_BITS) counted per language over at most
``most`` labelled documents, the bound being a parameter; the log likelihood is tempered, because
neighbouring trigrams repeat one another. The language declared in the markup and the one an address names
(country suffix, or a language code as a path segment) are right with given probabilities. Host priors
are smoothed in steps: the counts of a host lean on those of its site, these on all pages. Counts are sums
of the pages' own probabilities in one grouped aggregation per level; a page's own part is taken out
of its prior. Only sums per language are kept per host; no host's pages are collected.

Cases: null html is an empty text, null address has no host and only the prior of all pages; pages without
any evidence get that prior; texts of any length are read whole; repeated rows and null ids are kept; without
labelled documents there are no languages and the language is null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketscope.llm.runtime import columns, slices
from docketscope.llm.textbytes import PLAIN, Texts
from docketscope.session import cut_lineage

TRIGRAM_BITS = 14
MOST_LABELLED = 8_000
TEMPER = 0.2
DECLARED_RIGHT = 0.9
ADDRESS_RIGHT = 0.85
SMOOTHING = 5.0
SEED = 8

# Country suffixes with one main language.
SUFFIXES = {
    "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es",
    "ar": "es", "cl": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "dk": "da", "fi": "fi",
}

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible_text(page: str | None) -> str:
    """Text outside tags, comments, scripts and styles."""
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def declared_language(page: str | None) -> str | None:
    """Primary language of the html element's lang attribute, lower case."""
    found = _LANG.search(page or "")
    return found[1].lower() if found else None


def host_of(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, site, language named by the address)."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return None, None, None
    if not host:
        return None, None, None
    labels = host.split(".")
    named = SUFFIXES.get(labels[-1])
    for segment in parts.path.split("/")[1:3]:
        if re.fullmatch(r"[a-z]{2}([-_][A-Za-z]{2})?", segment):
            named = segment[:2]
            break
    return host, ".".join(labels[-3:] if len(labels) > 2 and len(labels[-2]) <= 3 else labels[-2:]), named


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash bucket of each byte trigram, bounds per text); runs of blanks do not count."""
    texts = Texts.of(column, PLAIN)
    data = texts.data.astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    at = np.arange(len(data) - 2)
    ends = np.repeat(texts.offsets[1:], np.diff(texts.offsets))[:-2]
    keep = (at + 3 <= ends) & ~((data[:-2] == 32) & (data[1:-1] == 32)) & ~((data[1:-1] == 32) & (data[2:] == 32))
    code = (data[:-2] * np.uint32(65599) + data[1:-1]) * np.uint32(65599) + data[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)
    places = np.flatnonzero(keep)
    return code[places].astype(np.int64), places.searchsorted(texts.offsets)


def fit(docs: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram bucket per language) from (doc_id, text, lang)."""
    size = 1 << TRIGRAM_BITS
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sample = labelled.select("doc_id").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most).distinct()
    # at most ``most`` ids
    met = labelled.join(F.broadcast(sample), "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            names = part.column("lang").to_pylist()
            code, bounds = trigrams(part.column("text"))
            for k, name in enumerate(names):
                sums.setdefault(name, np.zeros(size, dtype=np.int64))
                sums[name] += np.bincount(code[bounds[k] : bounds[k + 1]], minlength=size)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in batches:
            for name, counts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"]
            )

    kind = "lang string, counts binary"
    tables = met.mapInArrow(count, kind).repartition(8, "lang").mapInArrow(add, kind).collect()
    tables.sort(key=lambda r: r["lang"])
    logs = []
    for row in tables:
        counts = np.frombuffer(row["counts"], np.int64) + 0.5
        logs.append(np.log(counts / counts.sum()))
    return [r["lang"] for r in tables], np.array(logs).reshape(-1, size)


def _evidence(pages: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """(page_id, host, site, declared, named, e0, e1, ...): log evidence of each page, without priors."""
    shared = pages.sparkSession.sparkContext.broadcast(logs)
    n = len(languages)

    def attach(score: np.ndarray, found: str | None, right: float) -> None:
        if found in languages and n > 1:
            score += np.log([(right if name == found else (1 - right) / (n - 1)) for name in languages])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for part in slices(batches, "html"):
            pages_ = part.column("html").to_pylist()
            code, bounds = trigrams(pa.array([visible_text(p) for p in pages_], pa.string()))
            sums = np.zeros((n, len(code) + 1))
            np.cumsum(tables[:, code], axis=1, out=sums[:, 1:])
            scores = TEMPER * np.diff(sums[:, bounds], axis=1).T
            hosts = [host_of(u) for u in part.column("url").to_pylist()]
            declared = [declared_language(p) for p in pages_]
            for k in range(len(pages_)):
                attach(scores[k], declared[k], DECLARED_RIGHT)
                attach(scores[k], hosts[k][2], ADDRESS_RIGHT)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id")]
                + [pa.array([h[i] for h in hosts], pa.string()) for i in (0, 1)]
                + [pa.array(declared, pa.string()), pa.array([h[2] for h in hosts], pa.string())]
                + [pa.array(scores[:, i] - scores.max(axis=1), pa.float64()) for i in range(n)],
                ["page_id", "host", "site", "declared", "named", *[f"e{i}" for i in range(n)]],
            )

    kind = "page_id long, host string, site string, declared string, named string" + "".join(f", e{i} double" for i in range(n))
    return pages.mapInArrow(run, kind)


def identify_languages(
    pages: DataFrame,
    docs: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    most: int = MOST_LABELLED,
) -> DataFrame:
    """(page_id, host, declared, named, lang, probability), one row per page row."""
    given = columns(pages, page_id=id_col, url=url_col, html=html_col)
    languages, logs = fit(columns(docs, doc_id="doc_id", text="text", lang="lang"), most)
    n = len(languages)
    if n == 0:
        return given.select(
            "page_id", *[F.lit(None).cast("string").alias(c) for c in ("host", "declared", "named", "lang")],
            F.lit(None).cast("double").alias("probability"),
        )
    rows = cut_lineage(_evidence(given, languages, logs))
    whole = sum((F.exp(f"e{i}") for i in range(1, n)), F.exp("e0"))
    rows = rows.withColumns({f"p{i}": F.exp(f"e{i}") / whole for i in range(n)})
    # exact decimals: sums do not depend on the order of rows
    parts = [F.col(f"p{i}").cast("decimal(20,12)") for i in range(n)]
    hosts = cut_lineage(
        rows.where("host is not null").groupBy("host", "site").agg(*[F.sum(p).alias(f"h{i}") for i, p in enumerate(parts)])
    )
    sites = hosts.groupBy("site").agg(*[F.sum(f"h{i}").alias(f"s{i}") for i in range(n)])
    total = rows.agg(*[F.coalesce(F.sum(p), F.lit(0)).cast("double").alias(f"t{i}") for i, p in enumerate(parts)]).first()
    overall = np.array([total[f"t{i}"] + 1.0 for i in range(n)])
    overall = overall / overall.sum()
    met = rows.join(hosts.drop("site"), "host", "left").join(sites, "site", "left")

    def less_own(letter: str, i: int) -> Column:
        return F.greatest(F.coalesce(F.col(f"{letter}{i}").cast("double") - F.col(f"p{i}"), F.lit(0.0)), F.lit(0.0))

    def smoothed(letter: str, lean: list) -> list:
        counts = [less_own(letter, i) for i in range(n)]
        size = sum(counts[1:], counts[0])
        return [(c + SMOOTHING * p) / (size + SMOOTHING) for c, p in zip(counts, lean, strict=True)]

    met = met.withColumns({f"q{i}": p for i, p in enumerate(smoothed("s", [F.lit(float(p)) for p in overall]))})
    met = met.withColumns({f"r{i}": p for i, p in enumerate(smoothed("h", [F.col(f"q{i}") for i in range(n)]))})
    met = met.withColumns({f"f{i}": F.col(f"e{i}") + F.log(f"r{i}") for i in range(n)})
    best = F.greatest(*[F.col(f"f{i}") for i in range(n)]) if n > 1 else F.col("f0")
    met = met.withColumn("best", best)
    share = 1 / sum((F.exp(F.col(f"f{i}") - F.col("best")) for i in range(1, n)), F.exp(F.col("f0") - F.col("best")))
    name = F.coalesce(*[F.when(F.col(f"f{i}") == F.col("best"), F.lit(languages[i])) for i in range(n)])
    return met.select("page_id", "host", "declared", "named", name.alias("lang"), share.alias("probability"))
