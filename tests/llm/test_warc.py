import io
import os
import random

import oracle
import pytest
from meshwave.llm import queries, warc


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, digest string, size int")


def test_agrees_with_sql(spark, small):
    assert not oracle.difference(queries.QUERIES["op1_warc"](spark, small), oracle.connect(small), queries.ORACLE_SQL["op1_warc"])


@pytest.mark.parametrize("split", [37, 200, 1 << 20])
def test_round_trip_of_edge_cases(spark, split):
    """Nulls, empty payloads, ties, repeated rows, line breaks in urls, columns named like the operator's own; any split size."""
    long = "é" * 60
    data = [(1, "u", None), (2, None, long), (3, "a\r\nb", long), (None, "n", long), (4, "x", "y" * 99), (5, "x", "y" * 99), (2, None, long), (6, "x", "z" * 300_000), (7, "x", "\x1f\x8b WARC/1.1")]
    got = sorted([(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(rows(spark, [(*d, "other", 1) for d in data]), split=split).collect()], key=str)
    want = [(1, 0, "response", None), (2, 120, "response", None), (3, 120, "revisit", 2), (None, 120, "revisit", 2), (4, 99, "response", None), (5, 99, "response", None), (2, 120, "response", None), (6, 300_000, "response", None), (7, 12, "response", None)]
    assert got == sorted(want, key=str)


def test_payloads_come_back(spark):
    df = rows(spark, [(i, f"u{i}", "αβγ" * i, None, None) for i in range(30)])
    archives = warc.write_warc(df, warc.make_folder(spark, "warc"))
    back = warc.read_warc(warc.splits(spark, archives, 100)).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back if r["record_type"] == "response"} == {i: "αβγ" * i for i in range(30)}
    assert {r["url"] for r in back} == {f"u{i}" for i in range(30)}


def test_empty(spark):
    assert warc.round_trip(rows(spark, [])).count() == 0


def test_ranges_partition_the_records():
    """Gzip magic inside data does not begin a record, and each record has one owner, wherever ranges end."""
    body = b"".join(warc.record("response", i, "u", bytes([31, 139, 8]) * 50 + bytes(range(256)) * (i % 5), "0", 0, None) for i in range(12))
    noise = b"\x1f\x8b\x08\x00 noise " + body[:20] + body + b"\x1f\x8b\x08"
    whole = [p for p, _, _ in warc.read_range(io.BytesIO(noise), 0, len(noise))]
    assert len(whole) == 12
    for size in (1, 13, 97, 1000):
        assert [p for a in range(0, len(noise), size) for p, _, _ in warc.read_range(io.BytesIO(noise), a, min(a + size, len(noise)))] == whole


def test_an_archive_inside_a_record():
    """A record whose data holds WARC members, stored as they are, is one record, wherever ranges begin."""
    rng = random.Random(0)
    inner = warc.record("response", 77, "inner", b"inside", "0", 6, None)
    payload = rng.randbytes(60_000) + inner + rng.randbytes(60_000)
    body = b"".join(warc.record("response", i, "u", payload if i == 1 else b"plain" * i, "0", 0, None) for i in range(4))
    assert inner in body  # random bytes are stored
    for size in (1_000, 40_000, 10**6):
        got = [h["warc-record-id"] for a in range(0, len(body), size) for _, h, _ in warc.read_range(io.BytesIO(body), a, min(a + size, len(body)))]
        assert got == [f"<urn:page:{i}>" for i in range(4)]


def test_archives_roll_and_go(spark, monkeypatch):
    """Archives end at a size, all ranges go to few tasks, and release() deletes them."""
    from meshwave.llm import common

    monkeypatch.setattr(warc, "ARCHIVE", 500)
    df = rows(spark, [(i, f"u{i}", "αβγ" * i, None, None) for i in range(30)])
    mark = common.staged()
    folder = warc.make_folder(spark, "warc")
    archives = warc.write_warc(df, folder)
    assert archives.count() >= 4 and common.release(spark, mark) == 2 and not os.path.exists(folder.removeprefix("file:"))
