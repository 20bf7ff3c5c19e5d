"""Cheapest edits that give a conversation a legal order of roles, by a search from both ends.

The lattice has a node for each number of rows passed and each state of the legal order
``(s?(ua)+)?``. Keep, Rerole and Delete pass a row, Insert adds a turn between rows. Rows are given as codes: the
role's initial (``x`` for any other), upper case for a truncated row, ``d`` for a row that must be deleted.

Equal prices at one node come from different letters that pass the same rows, and a price is a function of the letters,
so neither is the beginning of the other and the smaller one stays smaller whatever follows. Long
conversations are therefore searched piece by piece, from each state to each other, and the pieces are composed.
"""

from __future__ import annotations

from functools import cache, lru_cache
from heapq import heappop, heappush
from typing import NamedTuple

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (START, ASSISTANT)
# Prices of the edits, and of a truncated row that stays.
PRICE = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
ROLES = {USER: "user", ASSISTANT: "assistant"}

# The state that an added or re-labelled turn leads to, and those that a kept initial leads to.
_GIVEN = (USER, USER, ASSISTANT, USER)
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})

PIECE_ROWS = 32


@cache
def _row_steps(code: str) -> tuple[tuple[int, str, int, int], ...]:
    """(state, letter, price, next state) of all ways to pass a row."""
    steps = [(s, "D", PRICE["D"], s) for s in STATES]
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        steps += [(s, "R", PRICE["R"] + more, _GIVEN[s]) for s in STATES]
        steps += [(s, "K", PRICE["K"] + more, to[code.lower()]) for s, to in enumerate(_KEPT) if code.lower() in to]
    return tuple(steps)


@cache
def _ahead(code: str, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, price, rows passed, next state) from a state before a row (none left: empty code)."""
    steps = [("I", PRICE["I"], 0, _GIVEN[state])]
    return tuple(steps + [(x, p, 1, to) for s, x, p, to in (_row_steps(code) if code else ()) if s == state])


@cache
def _behind(code: str, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, price, rows passed, earlier state) into a state after a row (none before: empty code)."""
    steps = [("I", PRICE["I"], 0, s) for s in STATES if _GIVEN[s] == state]
    return tuple(steps + [(x, p, 1, s) for s, x, p, to in (_row_steps(code) if code else ()) if to == state])


@lru_cache(maxsize=1 << 16)
def cheapest(codes: str, start: int, end: int) -> tuple[int, str] | None:
    """(price, letters) of the cheapest edits from one state to another; ties take the smaller letters.

    Both heaps are ordered by price, then rows passed: only kept rows are free, so a node's labels of equal
    price are all known when it is settled. The search ends when no unsettled node can lie on an equally cheap path.
    """
    n = len(codes)
    heaps = [[(0, 0, "", start)], [(0, 0, "", end)]]
    settled: list[dict] = [{}, {}]
    best: tuple[int, str] | None = None
    while heaps[0] or heaps[1]:
        tops = [h[0][0] if h else float("inf") for h in heaps]
        if best is not None and tops[0] + tops[1] > best[0]:
            break
        side = 0 if tops[0] <= tops[1] else 1
        price, passed, letters, state = heappop(heaps[side])
        mine, other = settled[side], settled[1 - side]
        if (passed, state) in mine:
            continue
        mine[passed, state] = price, letters
        if side == 0:
            steps = _ahead(codes[passed : passed + 1], state)
        else:
            steps = _behind(codes[n - passed - 1 : n - passed] if passed < n else "", state)
        for letter, more, rows, to in steps:
            own = letters + letter if side == 0 else letter + letters
            met = other.get((n - passed - rows, to))
            if met is not None:
                crossing = (price + more + met[0], own + met[1] if side == 0 else met[1] + own)
                best = crossing if best is None else min(best, crossing)
            if (passed + rows, to) not in mine:
                heappush(heaps[side], (price + more, passed + rows, own, to))
    return best


Matrix = dict[tuple[int, int], tuple[int, str]]


def matrix(codes: str) -> Matrix:
    """The cheapest edits of a piece between every two states."""
    found = {(a, b): cheapest(codes, a, b) for a in STATES for b in STATES}
    return {k: v for k, v in found.items() if v is not None}


class Path(NamedTuple):
    """Edits of consecutive pieces, as a chain that shares its beginning with other paths."""

    price: int
    before: Path | None
    start: int
    letters: str


def _chain(path: Path | None) -> list[Path]:
    steps = []
    while path is not None and path.before is not None:
        steps.append(path)
        path = path.before
    return steps[::-1]


def letters_of(path: Path) -> list[tuple[int, str]]:
    """(state before, letters) of each piece of a path."""
    return [(p.start, p.letters) for p in _chain(path)]


def _smaller(a: Path, b: Path) -> bool:
    """Whether a's letters come before b's; both have the same number of pieces and the same price."""
    tails: tuple[list[str], list[str]] = ([], [])
    while a is not b and a.before is not None and b.before is not None:
        tails[0].append(a.letters)
        tails[1].append(b.letters)
        a, b = a.before, b.before
    return "".join(reversed(tails[0])) < "".join(reversed(tails[1]))


def better(a: Path, b: Path | None) -> bool:
    return b is None or a.price < b.price or a.price == b.price and _smaller(a, b)


def begin(state: int) -> dict[int, Path]:
    return {state: Path(0, None, state, "")}


def extend(paths: dict[int, Path], piece: Matrix) -> dict[int, Path]:
    """The best path to each state after one more piece."""
    after: dict[int, Path] = {}
    for (a, b), (price, letters) in piece.items():
        if a in paths:
            path = Path(paths[a].price + price, paths[a], a, letters)
            if better(path, after.get(b)):
                after[b] = path
    return after


def finish(paths: dict[int, Path]) -> Path:
    """The best path that ends legally."""
    best = None
    for state in ENDS:
        if state in paths and better(paths[state], best):
            best = paths[state]
    return best


def pieces(codes: str) -> list[str]:
    return [codes[k : k + PIECE_ROWS] for k in range(0, len(codes), PIECE_ROWS)]


@lru_cache(maxsize=1 << 14)
def repair_letters(codes: str) -> str:
    """The least letters of the cheapest edits of a whole conversation."""
    paths = begin(START)
    for piece in pieces(codes):
        found = {(a, b): cheapest(piece, a, b) for a in paths for b in STATES}
        paths = extend(paths, {k: v for k, v in found.items() if v is not None})
    return "".join(x for _, x in letters_of(finish(paths)))


def price_of(letters: str, codes: str) -> int:
    """The price of letters that pass the rows of ``codes``."""
    total, at = 0, 0
    for x in letters:
        total += PRICE[x]
        if x != "I":
            total += TRUNCATED if x in "KR" and codes[at].isupper() else 0
            at += 1
    return total


def cut(letters: str, start: int, parts: list[str]) -> list[tuple[int, str]]:
    """(state before, letters) of each part of the rows; insertions at a border belong to the later part."""
    found, state, first, at = [], start, 0, 0
    for k, codes in enumerate(parts):
        before = state
        for code in codes:
            while letters[at] == "I":
                state, at = _GIVEN[state], at + 1
            x = letters[at]
            state = _GIVEN[state] if x == "R" else _KEPT[state][code.lower()] if x == "K" else state
            at += 1
        if k == len(parts) - 1:
            at = len(letters)
        found.append((before, letters[first:at]))
        first = at
    return found


def apply(letters: str, start: int, rows: list[tuple[str, str]], codes: str) -> list[tuple[str, str]]:
    """The repaired (role, text) turns."""
    turns, state, at = [], start, 0
    for x in letters:
        if x == "I":
            state = _GIVEN[state]
            turns.append((ROLES[state], ""))
            continue
        if x == "R":
            state = _GIVEN[state]
            turns.append((ROLES[state], rows[at][1]))
        elif x == "K":
            state = _KEPT[state][codes[at].lower()]
            turns.append(rows[at])
        at += 1
    return turns
