"""Token counts: a linear longest-match automaton over a vocabulary.

A word with its leading blank is cut greedily into the longest vocabulary pieces from the left. The
automaton is a trie of the vocabulary; a failure link leads to the node of what is left after the pieces
that are then certain, and each link stores how many pieces those are. A word is read byte by
byte once; no piece is ever built, only counts are added. At the end of a word another stored number
counts the pieces of what is still open. Counts of words already met are remembered up to a bound.

The vocabulary must hold every single byte (byte-level vocabularies do), so each word has pieces.

Cases: a null or empty text has 0 tokens; very long words are read like short ones; null ids and
repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from docketscope.llm import tokens
from docketscope.llm.runtime import columns, slices

# Words remembered per worker, and the longest of them.
REMEMBERED = 400_000
REMEMBERED_BYTES = 40


class Automaton:
    """Longest-match counting over ``vocabulary``, a collection of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                after = child[node].get(byte)
                if after is None:
                    after = child[node][byte] = len(child)
                    child.append({})
                    final.append(False)
                node = after
            final[node] = True
        size = len(child)
        fail, popped, close = [-1] * size, [0] * size, [0] * size
        queue = deque((0, byte, node) for byte, node in child[0].items())
        while queue:
            parent, byte, node = queue.popleft()
            if final[node]:
                fail[node], popped[node] = 0, 1
            else:
                count, at = popped[parent], fail[parent]
                while at >= 0 and byte not in child[at]:
                    count += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], popped[node] = child[at][byte], count
            if fail[node] < 0:
                raise ValueError("the vocabulary must hold every single byte of its pieces")
            close[node] = popped[node] + close[fail[node]]
            queue.extend((node, b, n) for b, n in child[node].items())
        self.child, self.fail, self.popped, self.close = child, fail, popped, close
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of one byte string."""
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for byte in word:
            after = child[node].get(byte)
            while after is None:
                if node == 0:
                    raise ValueError(f"byte {byte} is not in the vocabulary")
                total += popped[node]
                node = fail[node]
                after = child[node].get(byte)
            node = after
        return total + self.close[node]

    def text(self, text: bytes) -> tuple[int, int]:
        """(words, pieces) of a text; words are cut at white space and carry a leading blank."""
        known, words, total = self.known, text.split(), 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.count(b" " + word)
                if len(word) <= REMEMBERED_BYTES and len(known) < REMEMBERED:
                    known[word] = n
            total += n
        return len(words), total


@lru_cache(maxsize=2)
def automaton(ranks: str) -> Automaton:
    """One automaton per worker process."""
    return Automaton(tokens.read_ranks(public_tokenizers.path(ranks)))


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = tokens.RANKS
) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = automaton(ranks)
        for part in slices(batches, "text"):
            found = [counter.text(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
