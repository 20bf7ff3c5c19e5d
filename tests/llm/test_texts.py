"""Packing, token counts, personal data and quality rules against plain references."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docketscope.llm import packing, pii, quality, queries, token_counts, tokens
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def given_texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(rows, texts, tokenizer, padding):
    """Every id once, checksums and totals right, sequences gapless and short."""
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == brute.crc(np.asarray(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    filled = 0
    for rows_of in places.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        filled += at
    assert filled >= (1 - padding) * 2048 * len(places) - 2048 * 8


def test_packing_query(spark, given_texts, tokenizer):
    check_packing(queries.op1_packing(spark, SF).collect(), given_texts, tokenizer, 0.02)


def test_packing_odd_texts(spark, odd_documents, no_documents, texts, tokenizer):
    from pyspark.sql import functions as F

    unique = odd_documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(unique).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, dict(enumerate(texts)), tokenizer, 1)
    whole = packing.pack(odd_documents).where("start = 0").count()
    assert whole == odd_documents.count()
    assert packing.pack(no_documents).count() == 0


def test_packing_keeps_order_across_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 300)
    ends, blank = np.zeros(10, bool), np.zeros(10, bool)
    ends[1], blank[2] = True, True
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 10, rng.integers(1, 400)).astype("<u4")) for k in range(60)]
    got = list(packing.pack_stream(docs, ends, blank, limit=64))
    assert [(g[4], g[5]) for g in got] == sorted((g[4], g[5]) for g in got)
    for key, ids in docs:
        assert np.array_equal(np.concatenate([g[2] for g in got if g[0] == key]), ids)
    assert [g[0] for g in got] == sorted(g[0] for g in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from([0.0, 2.0, 9.0])), min_size=1, max_size=9))
def test_cuts_are_the_cheapest(steps):
    at, penalty = [0], [0.0]
    for step, cost in steps:
        at.append(at[-1] + step)
        penalty.append(cost)
    limit = 8

    def price(cuts):
        return sum(limit - (at[b] - at[a]) + penalty[b] for a, b in zip(cuts, cuts[1:], strict=False))

    n, best = len(at), float("inf")
    for mask in range(1 << max(n - 2, 0)):
        cuts = [0] + [i for i in range(1, n - 1) if mask >> (i - 1) & 1] + [n - 1]
        if all(at[b] - at[a] <= limit for a, b in zip(cuts, cuts[1:], strict=False)):
            best = min(best, price(cuts))
    assert price(packing.best_cuts(at, penalty, limit)) == best


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t \r'.,!?aBé9Ⅷ-s")), max_size=30))
def test_ids_equal_the_tokenizer(tokenizer, text):
    coder = tokens.encoder(tokens.VOCABULARY, tokens.RANKS)
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == want


def test_ids_equal_the_tokenizer_on_documents(given_texts, texts, tokenizer):
    coder = tokens.encoder(tokens.VOCABULARY, tokens.RANKS)
    for text in [*given_texts.values(), *texts]:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text or ""), "<u4").tolist() == want


def test_token_counts_query(spark, given_texts):
    vocabulary = set(tokens.read_ranks(public_tokenizers.path(tokens.RANKS)))
    longest = max(map(len, vocabulary))
    for r in queries.op2_token_counts(spark, SF).collect():
        words = given_texts[r["doc_id"]].encode().split()
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(brute.greedy_pieces(b" " + w, vocabulary, longest) for w in words)


def test_token_counts_odd_texts(spark, odd_documents, no_documents, texts):
    vocabulary = set(tokens.read_ranks(public_tokenizers.path(tokens.RANKS)))
    longest = max(map(len, vocabulary))
    rows = token_counts.count_tokens(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if r["doc_id"] is not None:
            words = (texts[r["doc_id"]] or "").encode().split()
            assert r["n_tokens"] == sum(brute.greedy_pieces(b" " + w, vocabulary, longest) for w in words)
    assert token_counts.count_tokens(no_documents).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=2, max_size=6), max_size=12), st.text("abc", max_size=25))
def test_automaton_is_greedy(pieces, word):
    vocabulary = {p.encode() for p in pieces} | {b"a", b"b", b"c"}
    counter = token_counts.Automaton(sorted(vocabulary))
    assert counter.count(word.encode()) == brute.greedy_pieces(word.encode(), vocabulary, 6)


def base_of(spans):
    return [s for s in spans if s[0] in pii.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("0123456789....@@++--  ()ab_%:/é\n")), max_size=60))
def test_spans_equal_the_patterns(text):
    assert base_of(pii.find_spans(text)) == brute.base_spans(text)


def test_pii_query(spark, given_texts):
    rows = queries.op9_pii(spark, SF).collect()
    assert len(rows) == len(given_texts)
    for r in rows:
        base = brute.base_spans(given_texts[r["doc_id"]])
        assert r["base_sha256"] == brute.base_sha(given_texts[r["doc_id"]])
        for kind in pii.BASE_KINDS:
            assert r[f"n_{kind}"] == sum(s[0] == kind for s in base)
        assert r["spans"].startswith(brute.span_text(base))


def test_pii_odd_texts(spark, odd_documents, no_documents, texts):
    rows = pii.find_personal_data(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert base_of([tuple(s) for s in r["spans"]]) == brute.base_spans(texts[r["doc_id"]])
    assert pii.find_personal_data(no_documents).count() == 0


def test_beyond_the_base():
    text = "https://bob:pw@host.example.org/x token = \"abcdef0123456789\"; tokens = 12345678a"
    kinds = [(k, text[a:b]) for k, a, b in pii.find_spans(text) if k not in pii.BASE_KINDS]
    assert kinds == [("url", "https://bob:pw@host.example.org"), ("account", "abcdef0123456789")]


def test_redaction(spark, odd_documents, no_documents):
    assert pii.redact("mail a@b.co, now", pii.find_spans("mail a@b.co, now")) == "mail [EMAIL], now"
    clean = pii.redact_documents(odd_documents)
    assert clean.columns == odd_documents.columns and clean.count() == odd_documents.count()
    assert all(not brute.base_spans(r["text"]) for r in clean.collect())
    assert clean.where("text is null").count() == odd_documents.where("text is null").count()
    assert pii.redact_documents(no_documents).count() == 0


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_query(spark, given_texts):
    rows = queries.op10_quality(spark, SF).collect()
    assert len(rows) == len(given_texts)
    for r in rows:
        want = brute.quality_counts(given_texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_tells_labelled_documents_apart(spark):
    sf = "/root/testdata/sf0.01"
    judged = queries.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    good, bad = ({k: counts.get((q, k), 0) for k in (True, False)} for q in (1, 0))
    assert good[True] >= 0.97 * sum(good.values()) and bad[False] >= 0.95 * sum(bad.values())


def test_quality_odd_texts(spark, odd_documents, no_documents, texts):
    rows = quality.judge(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert tuple(r[c] for c in COUNTS) == brute.quality_counts(texts[r["doc_id"]])
    kept = quality.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum(r["kept"] for r in rows)
    assert quality.judge(no_documents).count() == 0 and quality.keep_good(no_documents).count() == 0


def test_thresholds_follow_language_and_source(spark):
    rows = [(i, "word " * 3 + " ".join(f"w{i}x{k}" for k in range(30)), "en", "plain") for i in range(300)]
    rows += [(1000 + i, " ".join(f"#v{i}x{k}" for k in range(30)), "en", "tagged") for i in range(300)]
    rows += [(5000, " ".join(f"#u{k}" for k in range(30)), "en", "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r["doc_id"] for r in quality.judge(docs).where("not kept").collect()}
    assert gone == {5000}


def test_repeated_words_have_a_fence_below_the_base(spark):
    def text(name, repeated):
        """80 words, ``repeated`` of them in a window that occurs twice."""
        window = [f"{name}r{k}" for k in range(repeated // 2)]
        return " ".join(window + [f"{name}w{k}" for k in range(80 - repeated)] + window)

    rows = [(i, text(f"t{i}", 0), "en", "tight") for i in range(300)]
    rows += [(1000 + i, text(f"l{i}", (0, 16, 18)[i % 3]), "en", "loose") for i in range(300)]
    rows += [(5000, text("a", 20), "en", "tight"), (5001, text("b", 20), "en", "loose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = quality.judge(docs).where("doc_id in (5000, 5001)").collect()
    assert {r["doc_id"]: (r["n_repeat_words"], r["n_words"], r["base_failed"], r["kept"]) for r in judged} == {
        5000: (20, 80, False, False), 5001: (20, 80, False, True)
    }


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_query_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    df = queries.op10_quality(spark, f"/root/testdata/{sf}")
    want = con.execute(queries.SQL["op10_quality"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())
