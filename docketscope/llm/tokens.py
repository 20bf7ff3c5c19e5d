"""Byte-level BPE ids of whole texts, with a bounded memory of pieces already seen."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
# Pieces remembered per worker and kind; further ones are encoded each time they occur.
REMEMBERED = 400_000

# A blank that touches another blank joins a longer run, which must be split as a whole.
_LONG_RUN = re.compile(r"\s[ \n]|[ \n]\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}


class _Pieces(dict):
    """piece -> ids of lead + piece, as little-endian unsigned 32-bit integers."""

    def __init__(self, lead: str, encode) -> None:
        super().__init__()
        self.lead, self.encode = lead, encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encode(self.lead + piece), dtype="<u4").tobytes()
        if len(self) < REMEMBERED and len(piece) < 40:
            self[piece] = ids
        return ids


class Encoder:
    """Ids equal to those of the JSON tokenizer without added special tokens.

    The vocabulary's splitting rule never joins a word to what follows a single blank
    or line feed, so a text whose blanks are all single is the concatenation of
    its pieces, each encoded once and remembered. Any other text (runs of blanks,
    the literal end-of-text marker) goes through the tokenizer whole.
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ranks = read_ranks(ranks)
        plain = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}
        )
        self.first, self.blank, self.line = (_Pieces(lead, plain.encode_ordinary) for lead in ("", " ", "\n"))

    def encode(self, text: str) -> bytes:
        """Ids of one text, little-endian unsigned 32-bit."""
        if _LONG_RUN.search(text) or any(s in text for s in self.special):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = []
        heads = self.first
        for line in text.split("\n"):
            pieces = line.split(" ")
            parts.append(heads[pieces[0]])
            parts.extend(map(self.blank.__getitem__, pieces[1:]))
            heads = self.line
        return b"".join(parts)

    def breaks(self) -> tuple[np.ndarray, np.ndarray]:
        """By id: does the token end a sentence, does the token begin with a blank."""
        size = max(self.ranks.values()) + 2
        ends, blank = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, i in self.ranks.items():
            ends[i] = token.rstrip()[-1:] in (b".", b"!", b"?")
            blank[i] = token[:1] in (b" ", b"\n")
        return ends, blank


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str) -> Encoder:
    """One encoder per worker process. Arguments are file names or absolute paths."""
    return Encoder(public_tokenizers.path(vocabulary), public_tokenizers.path(ranks))
