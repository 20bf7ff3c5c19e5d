import pytest

# Texts that every per-document operator must get through.
TEXTS = [
    None, "", " ", "\n", "a", "a b c", "one  two\t three\n\nfour \n five ", "Ünïcödé wörds — dash. Next! one?",
    "mail a.b+c@x-y.org, a@b@c.d.e and 'q'@nothing or x@y. z@w.co.", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4242424242424242. 12", "+1 (555) 010-1234 +49 30 1234567 +12 +1-2-3 +1+2+33 44 55 66 77",
    "token = \"abcdef0123456789\" password: hunter2hunter2 https://bob:pw@host.example.org/x http://example.org",
    "<|endoftext|> inside", "x" * 3000, "word " * 5000, "z. " * 4000, "it's we'll they'd 's", "１２３ ４５６ Ⅷ ٣٤",
    "Same line here.\nSame line here.\nother\nSame line here.\n\n", "a b c d e f g h a b c d e f g h a b c d e f g h i j k l",
    "nul\x00char and\x0bvertical\x0cfeed\r\nreturn", " nbsp  x", "@@@@ ....", "+", "+1", "1", "1.1", "9" * 40,
]


@pytest.fixture(scope="session")
def texts():
    return list(TEXTS)


@pytest.fixture()
def odd_documents(spark, texts):
    """All odd texts, repeated rows, null ids, languages and sources, and columns with clashing names."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3 - 1]) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "row without id", "en", "s1"), (None, None, None, None)]
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 1, "x", 2.0) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, c0 double",
    )


@pytest.fixture()
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
