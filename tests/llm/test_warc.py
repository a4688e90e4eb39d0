"""Operator 13: round trips, and archives damaged in known places."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import warc

PAGES = "page_id long, url string, html string"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _records(n: int = 6) -> list[bytes]:
    return [warc.record(i, f"https://h.example/{i}", f"<p>page {i}</p>".encode() * (i + 1), _digest(f"<p>page {i}</p>".encode() * (i + 1)), None) for i in range(n)]


def _ids(reader) -> list[int]:
    return [int(r.headers["warc-record-id"].split(":")[2]) for _, r in reader.out]


def _rows(spark, rows):
    df = spark.createDataFrame(rows, PAGES)
    for name in ("page", "first", "digest", "payload", "k"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_round_trip(spark, tmp_path):
    big = "".join(chr(33 + i % 90) for i in range(17 << 20))
    rows = [(1, "https://a.example/x y\r\nz", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é 日本\x00"), (7, "u", "same"), (7, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (8, "u", big)]
    path = str(tmp_path / "out")
    warc.write_warc(_rows(spark, rows).repartition(3), path)
    read = warc.read_warc(spark, path).cache()
    assert read.where("problem is not null").count() == 0
    assert read.where("type = 'response'").where(warc.payload_digest(F.col("payload")) != F.col("payload_digest")).count() == 0
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None)
        kind = "response" if first is None or page == first else "revisit"
        want[warc.record_id(page, _digest(data)), len(data), _digest(data), kind, warc.record_id(first, _digest(data)) if kind == "revisit" else None] += 1
    got = read.select("record_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()
    assert Counter(map(tuple, got)) == want
    texts = {bytes(r.payload).decode() for r in read.where("type = 'response'").collect()}
    assert texts == {h or "" for _, _, h in rows}
    assert [r.uri for r in read.where("uri like '%a.example%'").collect()] == ["https://a.example/x%20y%0D%0Az"]


def test_small_payloads_and_no_rows(spark, tmp_path):
    rows = [(i, "u", "short") for i in range(3)] + [(i, "u", "a longer one") for i in range(3, 6)]
    warc.write_warc(_rows(spark, rows), str(tmp_path / "a"), least_bytes=6)
    assert Counter(r.type for r in warc.read_warc(spark, str(tmp_path / "a")).collect()) == {"response": 4, "revisit": 2}
    warc.write_warc(_rows(spark, rows).limit(0), str(tmp_path / "b"))
    assert warc.read_warc(spark, str(tmp_path / "b")).count() == 0


def test_files_are_gzip(spark, tmp_path):
    warc.write_warc(_rows(spark, [(1, "u", "x"), (2, "u", "y")]).coalesce(1), str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    members, rest = [], data
    while rest:
        d = zlib.decompressobj(31)
        members.append(d.decompress(rest))
        rest = d.unused_data
    assert len(members) == 2 and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)


def test_damaged_member_is_a_gap():
    members = [zlib.compress(r, 6, 31) for r in _records()]
    starts = [sum(map(len, members[:i])) for i in range(7)]
    data = bytearray(b"".join(members))
    data[starts[2] + len(members[2]) // 2] ^= 0xFF
    reader = warc.salvage(bytes(data))
    assert _ids(reader) == [0, 1, 3, 4, 5]
    assert reader.gaps == [(-1, starts[2], starts[3], "member")]


def test_junk_and_cut_end():
    members = [zlib.compress(r, 6, 31) for r in _records()]
    data = b"junk\x1f\x8b\x08junk" + b"".join(members[:3]) + b"\x00" * 50 + b"".join(members[3:])[:-8]
    reader = warc.salvage(data)
    assert _ids(reader) == [0, 1, 2, 3, 4, 5]  # the last is whole, only its trailer is cut
    assert [g[3] for g in reader.gaps] == ["version", "version", "member"]
    assert reader.gaps[0][:3] == (-1, 0, 11) and reader.gaps[1][2] - reader.gaps[1][1] == 50 and reader.gaps[2][2] == len(data)


@pytest.mark.parametrize(("find", "put", "why"), [(b"WARC-Type", b"WARC_Type", "headers"), (b"Content-Length: 1", b"Content-Length: x", "length"), (b"page 2", b"page 9", "block digest"), (b"WARC/1.1", b"WARX/1.1", "version")])
def test_damaged_plain_record(find, put, why):
    records = _records()
    whole = b"".join(records)
    records[2] = records[2].replace(find, put)
    reader = warc.salvage(b"".join(records))
    assert _ids(reader) == [0, 1, 3, 4, 5]
    at = len(records[0]) + len(records[1])
    assert reader.gaps == [(-1, at, at + len(records[2]), why)]
    assert _ids(warc.salvage(whole)) == list(range(6)) and not warc.salvage(whole).gaps


def test_one_member_of_many_records():
    records = _records()
    whole = b"".join(records)
    packed = zlib.compress(whole, 6, 31)
    assert _ids(warc.salvage(packed)) == list(range(6))
    records[3] = records[3].replace(b"page 3", b"page X")
    reader = warc.salvage(zlib.compress(b"".join(records), 6, 31))
    at = sum(map(len, records[:3]))
    assert _ids(reader) == [0, 1, 2, 4, 5] and reader.gaps == [(0, at, at + len(records[3]), "block digest")]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    cut = (stored.compress(whole) + stored.flush())[: len(whole) // 2]
    reader = warc.salvage(cut + packed)
    assert _ids(reader)[-6:] == list(range(6)) and 0 < len(_ids(reader)[:-6]) < 6
    assert reader.gaps == [(-1, 0, len(cut), "member")]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 5), st.binary(min_size=1, max_size=40), st.booleans(), st.floats(0, 1))
def test_other_records_survive(hit, junk, packed, where):
    """Bytes written over one record never cost another record, and never end the reading."""
    parts = [zlib.compress(r, 6, 31) if packed else r for r in _records()]
    at = int(where * (len(parts[hit]) - 1))
    parts[hit] = (parts[hit][:at] + junk + parts[hit][at + len(junk) :])[: len(parts[hit])]
    reader = warc.salvage(b"".join(parts))
    assert set(range(6)) - {hit} <= set(_ids(reader))
    covered = sum(e - s for m, s, e, _ in reader.gaps if m == -1)
    assert covered <= len(b"".join(parts))


def test_damaged_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    members = [zlib.compress(r, 6, 31) for r in _records()]
    (folder / "good.warc.gz").write_bytes(b"".join(members))
    (folder / "bad.warc.gz").write_bytes(members[0][:-9] + members[1])
    (folder / "empty.warc").write_bytes(b"")
    (folder / "plain.warc").write_bytes(b"".join(_records(2)))
    read = warc.read_warc(spark, str(folder)).collect()
    found = Counter((r.file.rsplit("/", 1)[1], r.problem) for r in read)
    assert found["good.warc.gz", None] == 6 and found["plain.warc", None] == 2
    assert found["bad.warc.gz", "member"] == 1 and found["bad.warc.gz", None] >= 1
