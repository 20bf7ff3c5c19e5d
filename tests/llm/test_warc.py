import gzip
import hashlib
import os

import pytest

from docketscope.llm import capture_index, store, warc
from docketscope.llm.capture_index import CaptureIndex


def by_hand(rows):
    """(page_id, url, bytes, digest, type, refers_to) of every row, sorted."""
    seen, found = {}, []
    last = [(r[0] is None, r[0] or 0, r[1] is None, r[1] or "") for r in rows]
    for _, (page_id, url, html) in sorted(zip(last, rows), key=lambda x: x[0]):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        plain = None if url is None else warc.plain_address(url)
        if len(payload) >= 100 and digest in seen:
            found.append((page_id, plain, len(payload), digest, "revisit", seen[digest]))
        else:
            seen[digest] = page_id
            found.append((page_id, plain, len(payload), digest, "response", None))
    return sorted(found, key=repr)


@pytest.fixture()
def pages():
    long = "<p>" + "é page " * 40
    urls = ["http://a.example.com/x", "https://a.example.com:443/x?q=1", "http://example.com", "HTTP://B.Example.com/ü y\nz",
            None, "", "not an address", "http://[bad/", "http://a.example.com/" + "p" * 5000, "ftp://h:21/f"]
    rows = [(i, urls[i % len(urls)], ["", None, "x", "y" * 99, "z" * 100, long, f"{i}" * 60, "a\r\n\r\nb\0" * 30][i % 8]) for i in range(90)]
    rows += [rows[5], rows[5], (5, "other", long), (None, None, long), (None, "n", "w" * 200), (None, "n", "w" * 200), (None, None, "w" * 200)]
    rows += [(1000 + i, "http://hot.example.org/p", "h" * 500) for i in range(40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, size int")


@pytest.fixture()
def built(spark, pages, monkeypatch):
    monkeypatch.setattr(capture_index, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "READ_BYTES", 900)
    folder = store.new_folder(spark, "warc")
    captures = warc.write_archives(frame(spark, pages).repartition(3), folder)
    return folder, captures, CaptureIndex.build(captures, folder)


def test_every_page_comes_back(spark, pages, built):
    folder, _, index = built
    assert index.directory.count() > 20
    records = warc.read_records(index.lookup(frame(spark, pages)), folder).collect()
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records]
    assert sorted(got, key=repr) == by_hand(pages)
    texts = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in pages}
    assert all(r["payload"] == (texts[r["payload_digest"]] if r["record_type"] == "response" else None) for r in records)


def test_lookup_finds_exactly_the_key(spark, pages, built):
    _, captures, index = built
    for url in ["http://hot.example.org/p", "http://a.example.com/x", None, "", "http://example.com/", "absent", "zzz", "http://a.example.com/" + "p" * 5000]:
        asked = spark.createDataFrame([(url,), (url,)], "url string")
        want = sorted((tuple(r) for r in captures.collect() if r["key"] == warc.sort_key(url)), key=repr)
        assert sorted((tuple(r) for r in index.lookup(asked).collect()), key=repr) == want


def test_archives_are_plain_warc_files(spark, pages, built):
    folder, captures, _ = built
    _, path = store.store(folder)
    names = [n for n in os.listdir(path) if n.endswith(".warc.gz")]
    assert set(names) == {r["archive"] for r in captures.select("archive").distinct().collect()}
    records = 0
    for name in names:
        data = gzip.open(f"{path}/{name}").read()  # members one after the other are one stream
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: re")
            length = int(head.rsplit(b"Content-Length: ", 1)[1])
            assert rest[length : length + 4] == b"\r\n\r\n"
            data, records = rest[length + 4 :], records + 1
    assert records == len(pages)


def test_keys_sort_sites_together():
    assert warc.sort_key("https://blog.Example.com:443/a?b=1#c") == "com,example,blog)/a?b=1"
    assert warc.sort_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.sort_key("http://example.com/a b\n") == "com,example)/a%20b%0A"
    assert warc.sort_key(None) == "" and warc.sort_key("x y") == "x%20y"


def test_damaged_records_are_noticed():
    good = warc.build_record(1, "u", "response", None, b"abc", 3, hashlib.sha256(b"abc").hexdigest())
    assert warc.parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(gzip.decompress(good).replace(b"\r\n\r\nabc", b"\r\n\r\nabd")))


def test_no_pages(spark):
    folder = store.new_folder(spark, "warc")
    empty = frame(spark, [])
    index = CaptureIndex.build(warc.write_archives(empty, folder), folder)
    assert index.lookup(empty).count() == 0
    assert index.lookup(frame(spark, [(1, "http://a.example.com", "x")])).count() == 0
    assert warc.read_records(index.lookup(empty), folder).count() == 0
