"""Vectorised work on the UTF-8 bytes of many texts at once.

Words are maximal runs of bytes outside space, tab, line feed, vertical tab, form
feed and carriage return, which are the only separators everywhere in this package.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

WHITE = b" \t\n\x0b\x0c\r"

_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True

# lower case, and a space for every ASCII character that is no letter or digit
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    values[_IS_WHITE] = 0
    return values


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        inverse = pow(int(_BASE), -1, 1 << 64)
        for k, base in enumerate((int(_BASE), inverse)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


@dataclass
class Texts:
    """Bytes of consecutive texts; ``offsets`` has one entry more than there are texts."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, table: np.ndarray | None = None) -> Texts:
        """From an Arrow string array (null counts as empty); ``table`` maps each byte."""
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        n = len(column)
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        return cls(raw if table is None else table[raw], ends - ends[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def word_starts(self) -> np.ndarray:
        """Index of the first byte of each word; a text's first byte begins a word of its own."""
        solid = ~_IS_WHITE[self.data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        heads = self.offsets[:-1]
        heads = heads[heads < len(self.data)]
        first[heads] = solid[heads]
        return np.flatnonzero(first)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hash of each word, bounds): text i has the words bounds[i] to bounds[i + 1]."""
        starts = self.word_starts()
        bounds = starts.searchsorted(self.offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.uint64), bounds
        powers, inverses = _power_tables(len(self.data))
        hashes = np.add.reduceat(_byte_values()[self.data] * powers[: len(self.data)], starts)
        return mix(hashes * inverses[starts]), bounds

    def word_counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.word_starts().searchsorted(self.offsets)).astype(np.int64)


def ngrams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and their bounds per text.

    A text of 1 to n - 1 words has one gram, made of all its words.
    """
    counts = np.diff(bounds)
    ends = np.repeat(bounds[1:], counts)
    at = np.arange(len(words))
    total = np.zeros(len(words), dtype=np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * int(_BASE) % (1 << 64)
        part = np.zeros(len(words), dtype=np.uint64)
        part[: len(words) - k] = words[k:] * np.uint64(factor)
        total += np.where(at + k < ends, part, 0)
    keep = (at + n <= ends) | (at == np.repeat(bounds[:-1], counts))
    return mix(total[keep]), np.concatenate(([0], np.cumsum(keep)))[bounds]
