"""Plain per-document references for the operators, written from their contracts."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [
        ("card", m.start(), m.end()) for m in CARD.finditer(text)
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))
    ]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def span_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def base_sha(text):
    return hashlib.sha256(span_text(base_spans(text)).encode()).hexdigest()


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def greedy_pieces(word, vocabulary, longest):
    """Longest-match pieces of a byte string, one after the other."""
    n, at = 0, 0
    while at < len(word):
        size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        at += size
        n += 1
    return n


def crc(data):
    return zlib.crc32(data)


def shingle_list(text, n=5):
    """Runs of n words, with repetitions; shorter texts are one run."""
    words = WORD.findall(text or "")
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def shingles(text, n=5):
    return set(shingle_list(text, n))
