"""WARC archives: exact round trip, revisits, damage."""
import base64
import gzip
import hashlib
import io
import zlib

import pytest

from hourcast.llm import warc

ROWS = [(5, "http://a/é\r\nX: y", "same", 1), (3, None, "same", 2), (9, "http://b", "same", 3), (1, "http://c", "", 4),
        (2, "http://d", None, 5), (7, "http://e", "ü" * 400_000, 6), (None, "http://f", "same", 7), (8, "http://g", "own", 8),
        (3, None, "same", 2), (None, "http://h", "alone", 9)]


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string, key int")


def test_round_trip(spark, pages, tmp_path):
    files = warc.write_archives(pages, str(tmp_path))
    got = warc.read_archives(spark, files).collect()
    assert len(got) == len(ROWS) and all(r.valid for r in got)
    smallest = {}
    for k, _, h, _ in ROWS:
        if k is not None:
            smallest[h or ""] = min(k, smallest.get(h or "", k))
    want = []
    for k, _, h, _ in ROWS:
        h = h or ""
        first = smallest.get(h)
        revisit = first is not None and k != first
        want.append((str(k), len(h.encode()), digest(h), "revisit" if revisit else "response", str(first) if revisit else "None"))
    assert sorted((str(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    for r in got:
        if r.record_type == "response":
            assert digest(bytes(r.payload).decode()) == r.payload_digest
    assert next(r.target_uri for r in got if r.record_id == "5") == "http://a/%C3%A9%0D%0AX:%20y"


def test_members_are_gzip(spark, pages, tmp_path):
    files = warc.write_archives(pages, str(tmp_path)).collect()
    raw = b"".join(gzip.open(f.file.removeprefix("file:")).read() for f in files)
    assert raw.count(b"WARC/1.1\r\n") == len(ROWS)


def test_threshold_keeps_small_payloads_apart(spark, pages, tmp_path):
    got = warc.read_archives(spark, warc.write_archives(pages, str(tmp_path), at_least=5)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_empty_table(spark, pages, tmp_path):
    files = warc.write_archives(pages.limit(0), str(tmp_path))
    assert files.count() == 0 and warc.read_archives(spark, files).count() == 0


def pack(*records):
    return b"".join(gzip.compress(r) for r in records)


def test_reader_in_small_steps(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 7)
    data = pack(*(warc.record_bytes(i, "u", b"x" * i * 50) for i in range(4)))
    got = list(warc.Records(io.BytesIO(data)))
    assert [len(b.partition(b"\r\n\r\n")[2]) for _, b in got] == [0, 50, 100, 150]


def test_damage():
    good = warc.record_bytes(1, "u", b"payload")
    with pytest.raises(ValueError):
        list(warc.Records(io.BytesIO(pack(good)[:-20])))
    with pytest.raises(ValueError):
        list(warc.Records(io.BytesIO(pack(good.replace(b"payload", b"paylo")))))
    changed = warc._parse("f", 0, *next(iter(warc.Records(io.BytesIO(pack(good.replace(b"payload", b"PAYLOAD")))))), True)
    assert changed[8] is False
    with pytest.raises((ValueError, zlib.error)):
        list(warc.Records(io.BytesIO(b"no gzip at all")))
