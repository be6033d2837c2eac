import base64
import hashlib
import struct

import pytest

from conftest import SF
from shoptrail.llm import warc
from shoptrail.llm.shared import folder

PAGES = "page_id long, url string, html string, records int"


def back(spark, rows, least=0):
    into = folder(spark, "warc-test")
    made = warc.write_archives(spark.createDataFrame(rows, PAGES), into, least)
    return made, warc.read_archives(made, into).collect()


def archive(records):
    a = warc.Archive()
    for r in records:
        a.add(r)
    return a.bytes()


def test_query_equals_brute_force(spark, rows):
    pages = rows("SELECT page_id, html FROM '@pages.parquet'")
    largest = {}
    for p, h in pages:
        largest[h] = max(p, largest.get(h, p))
    want = set()
    for p, h in pages:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.add((p, len(data), digest, "response" if largest[h] == p else "revisit", None if largest[h] == p else largest[h]))
    got = [tuple(r) for r in warc.op3(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert len(got) == len(want) and set(got) == want


def test_defined_cases(spark):
    rows = [(1, "http://a", None, 0), (2, None, "", 0), (None, "x\r\nWARC-Type: evil", "", 0), (5, "u", "abc", 0), (5, "u", "abc", 0),
            (4, "v", "abc", 0), (9, "w", "é" * 2_000_000, 0)]
    _, got = back(spark, rows)
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(1, "revisit", 2), (2, "response", None), (None, "revisit", 2), (5, "response", None), (5, "response", None),
         (4, "revisit", 5), (9, "response", None)], key=str)
    long = next(r for r in got if r.page_id == 9)
    assert bytes(long.payload).decode() == "é" * 2_000_000 and long.payload_bytes == 4_000_000
    assert {r.record_type for r in back(spark, rows[:6], least=4)[1]} == {"response"}
    assert back(spark, [])[1] == []


def test_many_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 4000)
    monkeypatch.setattr(warc, "SAMPLES", 2000)
    made, got = back(spark, [(i, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 9, 0) for i in range(400)])
    assert sorted(r.page_id for r in got) == list(range(400)) and sum(r.records for r in made.collect()) == 400


def test_broken_archives():
    records = [warc.record(i, f"http://h/{i}", b"payload %d" % i * 50, None) for i in range(20)]
    good = archive(records)
    assert list(warc.frames(good)) == records
    size = struct.unpack_from("<I", good, 4)[0]
    for bad in (good[8 + size:], good[:-3], good[:20], good + b"xx", good[:8 + size] + b"\0" + good[8 + size:]):
        with pytest.raises(warc.Broken):
            list(warc.frames(bad))
    r = records[3]
    for bad in (r.replace(b"WARC/1.1", b"WARC/9.9"), r.replace(b"payload 3", b"payload 4", 1), r[:-2], r.replace(b"WARC-Type: response\r\n", b""),
                r.replace(b"\r\nContent-Length: 450\r\n\r\npay", b"\r\nContent-Length: 451\r\n\r\npay"), r.replace(b"WARC-Record-ID: ", b"WARC-Record-IX: ")):
        with pytest.raises(warc.Broken):
            warc.parse(bad)
    assert warc.parse(r)[0] == 3 and warc.parse(warc.record(3, "u", b"x", 8))[3:5] == ("revisit", 8)
