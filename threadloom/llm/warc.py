"""Operator 13: WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged archives.

Writer.  Every page is a record: the page with the least id of those with equal payloads is a `response`, the others are
`revisit` records that refer to it and hold its HTTP headers only; payloads of fewer than `least_bytes` bytes are all
responses.  Each record is a gzip member of its own.  Archives are written by Spark's own text writer, so they appear as a
whole or not at all, wherever Spark can write: a row is a member without its last byte, and that byte, always NUL, is the
line separator.  (A member ends with the upper byte of its length; a record of 16 MB or more is followed by an empty
member, which ends so, too.)

Reader.  A file is read from member to member (or, if it is not compressed, from version line to version line).  Each
record is checked: version, headers, length, the blank lines behind it, block and payload digest.  After a failed check
the reader looks for the next place where a gzip member holding a record, or a version line, begins, recovers the records
from there on, and logs the bytes between as a gap.  Records in a member that breaks off are recovered up to the break.
Gaps inside a member count its own, uncompressed bytes.  A file is one row, of up to 2 GB, read by one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table

# The format's version, its end of a record, the profile of revisits, and the alphabet of base 32.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The date of records without one.
DATE = "1970-01-01T00:00:00Z"
_GZIP = b"\x1f\x8b\x08"
_EMPTY = zlib.compress(b"", 6, 31)
#: Bytes that are decompressed or searched at once, and the most that headers may take.
_STEP = 1 << 20

RECORDS = (
    "file string, member long, start long, size long, type string, record_id string, uri string, date string, refers_to string, refers_to_uri string, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)
_FIELDS = [c.split()[0] for c in RECORDS.split(", ")]


def payload_digest(payload: Column) -> Column:
    """Base-32 SHA-1 of a binary column, without a Python worker: each five hexadecimal digits make four letters."""
    hex_ = F.sha1(payload)
    letters = []
    for i in range(8):
        number = F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


# -- writing -----------------------------------------------------------------------------------------------------------


def _address(url: str | None) -> str:
    """No white space or control characters, which would end a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = DATE) -> bytes:
    """The bytes of one record; `first` is the page that a revisit refers to."""
    uri = _address(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    headers = ["WARC-Type: " + ("response" if first is None else "revisit"), f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}"]
    if uri:
        headers.append(f"WARC-Target-URI: {uri}")
    if first is not None:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"]
    block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    headers += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{block_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(headers).encode() + END + block + END


def _members(batches):
    """One row for each record: its member without the NUL at its end."""
    for batch in batches:
        made, held = [], 0
        for page, url, payload, digest, first in zip(*(batch.column(c) for c in ("page", "url", "payload", "digest", "first")), strict=True):
            member = zlib.compress(record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), first.as_py()), 6, 31)
            member += _EMPTY if member[-1] else b""
            made.append(member[:-1])
            held += len(member)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])
                made, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page, digest, first): the pages whose payload a page with a smaller id has, and the least such id."""
    equal = pages.where(F.col("size") >= least_bytes).select("page", "digest").distinct()
    first = equal.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    return equal.join(first, "digest").where("page is null or page > first")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Writes archives (*.warc.gz by content) of pages(id, url, payload) into the folder `path`.

    A null payload is empty, a null address is left out; control characters and white space in an address are escaped.
    A page without an id is a revisit if any page with an id has its payload, or else a response; rows that share id and
    payload are records of one type.  An empty table makes a folder without records.  Other columns play no part.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": payload_digest(F.col("payload")), "size": F.octet_length("payload").cast("long")})
    # page and digest: many pages of one payload do not meet in one task
    first = first_pages(rows.select("page", "digest", "size"), least_bytes)
    known = first.select(F.coalesce("page", F.lit(-1)).alias("k"), F.col("page").isNull().alias("o"), "digest", "first")
    keyed = rows.withColumns({"k": F.coalesce("page", F.lit(-1)), "o": F.col("page").isNull()})
    placed = keyed.join(known, ["k", "o", "digest"], "left").select("page", "url", "payload", "digest", "first")
    members = placed.mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


# -- reading -----------------------------------------------------------------------------------------------------------


@dataclass
class Record:
    start: int
    size: int
    headers: dict[str, str]
    block: bytes
    payload: bytes | None = None
    told_bytes: int | None = None


@dataclass
class _Reader:
    """Records and gaps of one file, in order."""

    out: list[tuple[int, Record]] = field(default_factory=list)
    gaps: list[tuple[int, int, int, str]] = field(default_factory=list)

    def gap(self, member: int, start: int, end: int, why: str) -> None:
        if end > start:
            if self.gaps and self.gaps[-1][0] == member and self.gaps[-1][2] == start:
                member, start, _, why = self.gaps.pop()
            self.gaps.append((member, start, end, why))


_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_LENGTH = re.compile(r"\d{1,18}\Z")


def _headers(data: bytes) -> dict[str, str] | None:
    """Named fields, names in lower case; a line that starts with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return None
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def _told_digest(data: bytes, told: str | None) -> bool:
    """Whether data has the digest told; other kinds than SHA-1 are taken as they are."""
    if not told or not told.lower().startswith("sha1:"):
        return True
    value = told[5:]
    made = hashlib.sha1(data)
    return value.lower() == made.hexdigest() or value.upper() == base64.b32encode(made.digest()).decode()


def parse(data: bytes, at: int) -> Record | str:
    """The record that begins at a place, or which check failed."""
    line = _LINE.match(data, at)
    if not line:
        return "version"
    end = data.find(END, line.end() - 2, line.end() + _STEP)
    if end < 0:
        return "headers"
    headers = _headers(data[line.end() : end])
    if headers is None or "warc-type" not in headers or "warc-record-id" not in headers:
        return "headers"
    if not _LENGTH.match(headers.get("content-length", "")):
        return "length"
    begin = end + len(END)
    stop = begin + int(headers["content-length"])
    if stop > len(data):
        return "length"
    if data[stop : stop + len(END)] != END:
        return "end"
    made = Record(at, stop + len(END) - at, headers, data[begin:stop])
    if not _told_digest(made.block, headers.get("warc-block-digest")):
        return "block digest"
    http = "application/http" in headers.get("content-type", "").lower() and headers["warc-type"].lower() in ("response", "revisit")
    split = made.block.find(END) if http else -1
    made.payload = made.block[split + len(END) :] if split >= 0 else made.block
    length = re.search(rb"(?i)(?:\A|\r\n)content-length:[ \t]*(\d{1,18})[ \t]*\r\n", made.block[: split + 2]) if split >= 0 else None
    made.told_bytes = int(length[1]) if length else None
    if headers["warc-type"].lower() == "revisit":
        made.payload = None
    elif not _told_digest(made.payload, headers.get("warc-payload-digest")):
        return "payload digest"
    return made


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """(bytes, end in the file, whether all is well) of the member that begins at a place; of a broken one, what comes
    before the break."""
    inflater, parts, place = zlib.decompressobj(31), [], at
    while not inflater.eof and place < len(data):
        before = inflater.copy()
        try:
            parts.append(inflater.decompress(data[place : place + _STEP]))
        except zlib.error:
            more, broke = _up_to_break(before, data, place)
            return b"".join(parts + more), broke, False
        place = min(len(data), place + _STEP)
    if not inflater.eof:
        parts.append(inflater.flush())
    return b"".join(parts), place - len(inflater.unused_data), inflater.eof


def _up_to_break(inflater, data: bytes, at: int) -> tuple[list[bytes], int]:
    parts: list[bytes] = []
    while at < len(data):
        try:
            parts.append(inflater.decompress(data[at : at + 64]))
        except zlib.error:
            break
        at += 64
    return parts, at


def _starts_record(data: bytes, at: int) -> bool:
    """Whether a member begins here whose first bytes are those of a record."""
    if len(data) < at + 18 or data[at + 3] & 0xE0:
        return False
    inflater = zlib.decompressobj(31)
    try:
        return inflater.decompress(data[at : at + 4096], 5) == VERSION[:5]
    except zlib.error:
        return False


def _next_line(data: bytes, at: int) -> int:
    found = _LINE.search(data, at)
    return found.start() if found else len(data)


def _next_start(data: bytes, at: int, lines: int = 0) -> int:
    """The next place where a member with a record begins, or, from the place `lines` on, a version line."""
    while at < len(data):
        end = min(len(data), at + _STEP)
        line = _LINE.search(data, max(at, lines), end + 32) if lines < end else None
        stop = line.start() if line else end
        place = data.find(_GZIP, at, stop + 2)
        while place >= 0:
            if _starts_record(data, place):
                return place
            place = data.find(_GZIP, place + 1, stop + 2)
        if line:
            return stop
        at = end
    return len(data)


def _plain(reader: _Reader, member: int, data: bytes, at: int, whole: bool) -> None:
    """Records of the bytes of a member, from a place on; the rest of a member that broke off is part of its own gap."""
    while at < len(data):
        made = parse(data, at)
        if isinstance(made, Record):
            reader.out.append((member, made))
            at += made.size
            continue
        after = _next_line(data, at + 1)
        if after < len(data) or whole:
            reader.gap(member, at, after, made)
        at = after


def salvage(data: bytes) -> _Reader:
    """All records of a file that pass their checks, and the gaps between them."""
    reader, at = _Reader(), 0
    while at < len(data):
        if data.startswith(_GZIP, at):
            inner, end, well = _inflate(data, at)
            if well:
                _plain(reader, at, inner, 0, True)
                at = end
                continue
            _plain(reader, at, inner, 0, False)
            after = _next_start(data, at + 1, end)  # before its break, version lines are the member's own, stored as they are
            reader.gap(-1, at, after, "member")
        else:
            made = parse(data, at)
            if isinstance(made, Record):
                reader.out.append((-1, made))
                at += made.size
                continue
            after = _next_start(data, at + 1)
            reader.gap(-1, at, after, made)
        at = after
    return reader


def _rows(file: str, data: bytes, payloads: bool) -> Iterator[tuple]:
    reader = salvage(data)
    for member, r in reader.out:
        h = r.headers
        told = h.get("warc-payload-digest") or ""
        if r.payload is None:
            size, digest = r.told_bytes, told.partition(":")[2] if told.lower().startswith("sha1:") else None
        else:
            size, digest = len(r.payload), base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        named = (h[n] if n in h else None for n in ("warc-record-id", "warc-target-uri", "warc-date", "warc-refers-to", "warc-refers-to-target-uri"))
        yield (file, member, r.start, r.size, h["warc-type"].lower(), *named, size, digest, r.payload if payloads else None, None)
    for member, start, end, why in reader.gaps:
        yield (file, member, start, end - start, *[None] * 9, why)


def _read(payloads: bool):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _FIELDS)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for row in _rows(file.as_py(), content.as_py() or b"", payloads):
                    rows.append(row)
                    held += len(row[12] or b"")
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of the archives in a folder or file, compressed or not: records (problem is null) and gaps (problem says why).

    A record has its file, the place of its member (-1: none), start and size in it, headers, the size and digest of its
    payload (of a revisit, those of the payload it stands for) and the payload itself (null in revisits, and everywhere if
    `payloads` is false; digests are checked all the same).  Damaged bytes never end a job.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(payloads), RECORDS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = read_warc(spark, path, payloads=False).where("problem is null")
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?\\d*):", 1), F.lit("")).cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
