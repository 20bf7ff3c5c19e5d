"""Two-level index of captures: compressed blocks of sorted keys, and a sparse directory of the blocks.

Captures are sorted by reversed-host key and page over the cluster. Each task writes its range as blocks of
lines, one gzip member each, and returns a directory entry per block: its place and its first and last key. A
lookup searches the directory by bisection for the blocks that can hold its key, reads those ranges alone, and
searches their lines by bisection. The directory holds at most MOST_BLOCKS entries and one more per task of the build,
as blocks grow with the number of captures; this is what is broadcast. A key with very many captures spans
blocks, which are looked up one by one in different tasks.
"""

from __future__ import annotations

import gzip
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketscope.llm import store
from docketscope.llm.runtime import columns
from docketscope.llm.warc import CAPTURE, sort_key
from docketscope.session import cut_lineage

BLOCK_LINES = 1024
MOST_BLOCKS = 200_000

ENTRY = "first_key string, last_key string, file string, offset long, length long, lines int"


def _block(lines: list[tuple]) -> bytes:
    text = "".join(f"{key} {json.dumps(rest)}\n" for key, *rest in lines)
    return gzip.compress(text.encode(), 6, mtime=0)


def _lines_of(member: bytes) -> tuple[list[bytes], list[bytes]]:
    """(keys, rests) of a block's lines, in order."""
    pairs = [line.split(b" ", 1) for line in gzip.decompress(member).split(b"\n")[:-1]]
    return [p[0] for p in pairs], [p[1] for p in pairs]


@dataclass(frozen=True)
class CaptureIndex:
    """The folder of the blocks and the directory (ENTRY), stored."""

    folder: str
    directory: DataFrame

    @classmethod
    def build(cls, captures: DataFrame, folder: str) -> CaptureIndex:
        """Sort captures (CAPTURE) into blocks under ``folder``."""
        most = max(BLOCK_LINES, ceil(captures.count() / MOST_BLOCKS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, out, at, lines = f"captures-{uuid.uuid4().hex}.cdx.gz", None, 0, []

            def flush() -> pa.RecordBatch:
                nonlocal out, at, lines
                out = out or store.create(folder, name)
                member = _block(lines)
                out.write(member)
                row = [lines[0][0], lines[-1][0], name, at, len(member), len(lines)]
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
                at, lines = at + len(member), []
                return pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                    ["first_key", "last_key", "file", "offset", "length", "lines"],
                )

            try:
                for batch in batches:
                    for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        lines.append(row)
                        if len(lines) == most:
                            yield flush()
                if lines:
                    yield flush()
            finally:
                if out is not None:
                    out.close()

        order = ["key", F.asc_nulls_first("page_id"), "archive", "offset"]
        dealt = captures.select("key", "page_id", "archive", "offset", "length").repartitionByRange(*order)
        return cls(folder, cut_lineage(dealt.sortWithinPartitions(*order).mapInArrow(run, ENTRY)))

    def lookup(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """All captures (CAPTURE) of the given addresses; each address counts once, absent ones give nothing."""
        spark: SparkSession = urls.sparkSession
        entries = sorted(
            (r["first_key"].encode(), r["last_key"].encode(), r["file"], r["offset"], r["length"])
            for r in self.directory.collect()
        )
        shared, folder = spark.sparkContext.broadcast(entries), self.folder

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, lasts = [e[0] for e in shared.value], [e[1] for e in shared.value]
            for batch in batches:
                keys, blocks = [], []
                for key in map(sort_key, batch.column("url").to_pylist()):
                    span = range(bisect_left(lasts, key.encode()), bisect_right(firsts, key.encode()))
                    keys.extend([key] * len(span))
                    blocks.extend(span)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(keys, pa.string())], ["block", "key"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, name, file, lines = None, None, None, ([], [])
            try:
                for batch in batches:
                    found = []
                    for block, key in zip(batch.column("block").to_pylist(), batch.column("key").to_pylist(), strict=True):
                        if block != held:
                            _, _, wanted, offset, length = shared.value[block]
                            if wanted != name:
                                if file is not None:
                                    file.close()
                                file, name = store.open_file(folder, wanted), wanted
                            lines, held = _lines_of(file.read_at(length, offset)), block
                        keys, rests = lines
                        at = bisect_left(keys, key.encode())
                        while at < len(keys) and keys[at] == key.encode():
                            found.append((key, *json.loads(rests[at])))
                            at += 1
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)],
                        ["key", "page_id", "archive", "offset", "length"],
                    )
            finally:
                if file is not None:
                    file.close()

        asked = columns(urls, url=url_col).distinct().mapInArrow(spans, "block int, key string").distinct()
        return asked.repartitionByRange("block", "key").sortWithinPartitions("block", "key").mapInArrow(search, CAPTURE)
