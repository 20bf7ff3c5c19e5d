import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketscope.llm import conversations, edits

LEGAL = re.compile(r"(s?(ua)+)?")
PREFIX = {p for k in range(6) for full in ("s" + "ua" * k, "ua" * k) for p in (full[:n] for n in range(len(full) + 1))}


def by_enumeration(codes):
    """All edits of rows up to the price of deleting everything: (least price, least letters)."""
    best = (3 * len(codes), "D" * len(codes))

    def go(at, price, letters, roles):
        nonlocal best
        if price > best[0] or roles not in PREFIX:
            return
        if at == len(codes) and LEGAL.fullmatch(roles):
            best = min(best, (price, letters))
        for new in "ua":
            go(at, price + 2, letters + "I", roles + new)
        if at < len(codes):
            code = codes[at]
            go(at + 1, price + 3, letters + "D", roles)
            if code != "d":
                extra = code.isupper()
                go(at + 1, price + extra, letters + "K", roles + code.lower())
                for new in "ua":
                    go(at + 1, price + 2 + extra, letters + "R", roles + new)

    go(0, 0, "", "")
    return best


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="suaxSUAXd", max_size=5))
def test_letters_are_least(codes):
    letters = edits.repair_letters(codes) if codes else ""
    assert (edits.price_of(letters, codes), letters) == by_enumeration(codes)


def by_program(codes):
    """A plain forward program over (state, price, letters), any length."""
    kept = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    to = (2, 2, 3, 2)
    best = {0: (0, "")}

    def settle(best):
        for _ in range(4):
            for s, (p, x) in list(best.items()):
                new = (p + 2, x + "I")
                if to[s] not in best or new < best[to[s]]:
                    best[to[s]] = new
        return best

    best = settle(best)
    for code in codes:
        after = {}
        for s, (p, x) in best.items():
            options = [(s, p + 3, x + "D")]
            if code != "d":
                options.append((to[s], p + 2 + code.isupper(), x + "R"))
                if code.lower() in kept[s]:
                    options.append((kept[s][code.lower()], p + code.isupper(), x + "K"))
            for t, q, y in options:
                if t not in after or (q, y) < after[t]:
                    after[t] = (q, y)
        best = settle(after)
    return min(best[s] for s in (0, 3) if s in best)


def test_long_conversations_are_composed():
    rng = random.Random(3)
    for n in (31, 32, 33, 64, 300):
        for alphabet in ("suaxSUAXd", "uaUA", "d", "uuuuad", "aA"):
            codes = "".join(rng.choice(alphabet) for _ in range(n))
            letters = edits.repair_letters(codes)
            assert (edits.price_of(letters, codes), letters) == by_program(codes)


def damaged(rows):
    """The contract's damage in plain Python: (conv_id, turn, role, text) lists by conversation."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = found.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return found


def by_hand(rows):
    result = []
    for conv, mine in damaged(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, codes, seen = {"b": 0, "d": 0, "t": 0}, "", set()
        for _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("b", "d") and fault else code.upper() if fault == "t" else code
        firsts = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        price, letters = by_program(codes)
        out, at, roles = [], 0, ""
        for x in letters:
            new = "a" if roles.endswith("u") else "u"
            role, text = (mine[at][1], mine[at][2]) if x != "I" else ("", "")
            at += x != "I"
            if x in "RI":
                role = {"u": "user", "a": "assistant"}[new]
            if x != "D":
                out.append(f"{role}:{text}")
                roles += role[0]
        assert LEGAL.fullmatch(roles)
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        result.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, price, letters, digest))
    return sorted(result, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, part int")
    got = conversations.summarise(conversations.repair(conversations.damage(df.repartition(3))))
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["Yes.", "No", "", " \n\t", "Why?", "Ünï. ", "done!\x0b", None, "a\nb.", "same.", "…", "\xa0"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "Ünknown"]
    made = [(c, rng.choice([None, *range(12)]) if c % 3 else t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    made += [(None, t, "user", f"text {t}.") for t in range(3)] + [(7, 3, "user", "w" * 30000 + "."), (7, 3, "user", "w" * 30000 + ".")]
    # a conversation that is long by rows, with repeated rows, null turns and ties
    made += [(500, rng.choice([None, *range(150)]), rng.choice(roles), rng.choice([*texts, f"{i}.", f"{i}"])) for i in range(400)]
    made += [(501, 5, "user", "hot.")] * 120 + [(502, None, "assistant", f"{i % 7}.") for i in range(130)]
    return made


def test_repairs_match_plain_python(spark, rows):
    assert run(spark, rows) == by_hand(rows)


def test_long_conversations_match_plain_python(spark, rows, monkeypatch):
    monkeypatch.setattr(conversations, "LARGE_ROWS", 40)
    monkeypatch.setattr(conversations, "LARGE_BYTES", 20000)
    monkeypatch.setattr(conversations, "PART_ROWS", 9)
    assert run(spark, rows) == by_hand(rows)


def test_every_conversation_is_reported(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(1, dropped, "user", "x.")]) == [(1, 0, 0, 0, 0, 0, 0, "", empty)]
    assert run(spark, []) == []


def test_turns_are_returned(spark):
    df = spark.createDataFrame([("c", 0, "user", "Hi."), ("c", 1, "user", "Bye."), ("d", 0, "system", "S.")], "conv_id string, turn int, role string, text string")
    parts = {r["conv_id"]: r for r in conversations.repair(df).parts().collect()}
    assert [tuple(t) for t in parts["c"]["turns"]] == [("user", "Hi."), ("assistant", "Bye.")] and parts["c"]["audit"] == "KR"
    assert parts["d"]["turns"] == [] and parts["d"]["audit"] == "D" and parts["d"]["cost"] == 3
