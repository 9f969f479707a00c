"""Web archives: legacy ARC files read by their declared lengths, and WARC files made of them.

ARC: a file begins with a version block, whose own text says which header line the
records have - five fields in version 1, ten in version 2.  A record is its header
line, then as many bytes as the line's last field says, whatever they look like.

WARC: a record gets an identifier, a timestamp, a type and digests made from what
the ARC record holds.  Of records with equal payloads one is a response; the others
revisit it and keep only their protocol headers.

Files are written by Spark's text writer, whose line end is the end of a record, so
they may lie wherever Spark writes.  Archives of any name below a folder are read,
plain or gzip, as one member or many; a record is known by its archive's path below
that folder and its offset.  A task holds the packed bytes of one file (up to the
2 GB that Spark gives it) and unpacks and parses them a record at a time.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fadeline.llm.text import SLICE_BYTES, SLICE_ROWS, slices
from fadeline.session import new_path, staged

# Fixed values of the formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF, WARC_END = b"\r\n", b"\r\n\r\n"
#: Payloads below this length are never revisits.
LEAST_SHARED = 100
FIRST_DATE = datetime.datetime(2001, 1, 1)


def write_lines(df: DataFrame, path: str, end: str) -> None:
    """Writes the binary column ``value`` as one file per task, with ``end`` after each value."""
    df.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).option("compression", "gzip").text(path)


def unpacked(data: bytes) -> Iterator[bytes]:
    """The content of a file that may be gzip, as one member or as one per record, in chunks.

    The first piece fed to a member is small and the next ones double, so what a
    member leaves over is no longer than the member itself.
    """
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        member, step = zlib.decompressobj(31), 512
        while at < len(view) and not member.eof:
            piece = view[at : at + step]
            if chunk := member.decompress(piece):
                yield chunk
            at += len(piece) - len(member.unused_data)
            step = min(2 * step, 1 << 20)
    for low in range(at, len(view), 1 << 20):
        yield bytes(view[low : low + (1 << 20)])


class Reader:
    """Reads chunks by length or up to a mark; ``at`` is the place in all of them."""

    def __init__(self, chunks: Iterable[bytes]):
        self._chunks, self._held, self._used, self.at = iter(chunks), b"", 0, 0

    def _more(self, wanted: int = 0) -> bool:
        """At least one chunk more, and as many as ``wanted`` bytes take; False if there is none."""
        parts = [self._held[self._used :]]
        n = len(parts[0])
        for chunk in self._chunks:
            parts.append(chunk)
            n += len(chunk)
            if n >= wanted:
                break
        self._held, self._used = b"".join(parts), 0
        return len(parts) > 1

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        if len(self._held) - self._used < n:
            self._more(n)
        out = self._held[self._used : self._used + n]
        self._used += len(out)
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> tuple[bytes, bool]:
        """The bytes before ``mark``, which is passed over, and whether it came."""
        begin = self._used
        while (end := self._held.find(mark, begin)) < 0:
            looked = max(0, len(self._held) - self._used - len(mark) + 1)
            if not self._more(2 * looked):
                return self.take(len(self._held)), False
            begin = looked
        out = self._held[self._used : end]
        self.at += end + len(mark) - self._used
        self._used = end + len(mark)
        return out, True

    def skip(self, characters: bytes) -> bool:
        """Passes over any of ``characters``; False at the end."""
        while True:
            rest = self._held[self._used : self._used + 64]
            kept = len(rest.lstrip(characters))
            self._used += len(rest) - kept
            self.at += len(rest) - kept
            if kept:
                return True
            if self._used >= len(self._held) and not self._more():
                return False


class ArcRecord(NamedTuple):
    offset: int
    version: int
    uri: str
    ip: str
    date: str
    mime: str
    block: bytes
    whole: bool  # False if the file ends before the declared length


def arc_line(version: int, uri: str, date: str, mime: str, block: bytes, offset: int, name: str) -> bytes:
    fields = [uri, "0.0.0.0", date, mime]
    if version == 2:
        fields += ["200", "-", "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block


def safe_uri(url: str | None) -> str:
    """A url as a field of a header line: white space and controls as %XX; ``-`` for none."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "") or "-"


def write_arc(pages: DataFrame, path: str) -> None:
    """Writes ``pages`` (page_id, url, html) as ARC files, of both versions in turn.

    A null html is an empty payload.  The page's id is a protocol header.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        version, name = 1 + number % 2, f"part-{number}.arc"
        about = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
        first = arc_line(version, f"filedesc://{name}", FIRST_DATE.strftime("%Y%m%d%H%M%S"), "text/plain", about, 0, name)
        offset = len(first) + 1
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], names=["value"])
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for page_id, url, html in zip(*(column.to_pylist() for column in part.columns)):
                    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if page_id is None else f"X-Page-Id: {page_id}\r\n")
                    block = head.encode() + CRLF + (html or "").encode("utf-8", "surrogatepass")
                    date = FIRST_DATE + datetime.timedelta(seconds=(page_id or 0) % 10**8)
                    out.append(arc_line(version, safe_uri(url), date.strftime("%Y%m%d%H%M%S"), "text/html", block, offset, name))
                    offset += len(out[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    write_lines(pages.select("page_id", "url", "html").mapInArrow(render, "value binary"), path, "\n")


def parse_arc(data: bytes | Iterable[bytes]) -> Iterator[ArcRecord]:
    """The records of an ARC file (its bytes, or chunks of them), the version block first."""
    reader, version = Reader([data] if isinstance(data, bytes) else data), 0
    while reader.skip(b"\r\n"):
        at = reader.at
        line = reader.until(b"\n")[0].rstrip(b"\r").decode("utf-8", "replace")
        try:
            length = int(line.rsplit(" ", 1)[1])
            block = reader.take(length)
            if not version:
                version = int(block.split(None, 1)[0])
            fields = line.rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
            uri, ip, date, mime = fields[:4]
        except (IndexError, KeyError, ValueError) as error:
            raise ValueError(f"not an ARC header line at {at}: {line[:200]!r}") from error
        yield ArcRecord(at, version, uri, ip, date, mime, block, len(block) == length)


def payload_of(uri: str, block: bytes) -> tuple[bytes, bytes]:
    """Protocol headers with their empty line, and the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, end, payload = block.partition(WARC_END)
    return head + end, payload


def header_of(head: bytes, name: str) -> str | None:
    for line in head.split(CRLF)[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.encode():
            return value.strip().decode("utf-8", "replace")
    return None


def iso_date(date: str) -> str:
    """A WARC timestamp from the digits of an ARC date, missing ones filled up."""
    digits = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else FIRST_DATE.strftime("%Y%m%d%H%M%S")
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def record_id(*parts: str) -> str:
    """An identifier that is the same whenever the same record is converted."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('\n'.join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


RECORDS = "archive string, offset long, uri string, ip string, date string, mime string, whole boolean, page_id long, record_id string, payload_digest string, payload_bytes long, block binary"


def arc_records(spark: SparkSession, path: str, with_block: bool, glob: str = "*") -> DataFrame:
    """A row per record of the ARC files below ``path`` whose names fit ``glob``, the
    version blocks left out.

    Without ``with_block`` the contents stay in the tasks.  ``archive`` is the file's
    path below ``path``, so files of one name in two folders are told apart and
    identifiers do not depend on where the folder lies.  A file that is no ARC file
    is an error; an empty one has no records.
    """
    types = pa.schema([
        ("archive", pa.string()), ("offset", pa.int64()), ("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("whole", pa.bool_()),
        ("page_id", pa.int64()), ("record_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary()),
    ])

    def row(archive: str, r: ArcRecord) -> dict:
        head, payload = payload_of(r.uri, r.block)
        page_id, digest = header_of(head, "x-page-id"), hashlib.sha256(payload).hexdigest()
        return {
            "archive": archive, "offset": r.offset, "uri": r.uri, "ip": r.ip, "date": iso_date(r.date), "mime": r.mime, "whole": r.whole,
            "page_id": None if page_id is None else int(page_id), "record_id": record_id(archive, str(r.offset), r.uri, r.date, digest),
            "payload_digest": digest, "payload_bytes": len(payload), "block": r.block if with_block else None,
        }

    def parse(archive: str, data: bytes) -> Iterator[tuple[dict, int]]:
        return ((row(archive, r), len(r.block)) for r in parse_arc(unpacked(data)) if not r.uri.startswith("filedesc:"))

    return parsed(spark, path, glob, parse, types, RECORDS)


def inside(path: str, root: str) -> str:
    """A file's path below the folder that is read; the whole path where that is a pattern."""
    bare = lambda p: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", p)
    return bare(path).removeprefix(bare(root).rstrip("/")).lstrip("/")


def parsed(spark: SparkSession, path: str, glob: str, parse: Callable[[str, bytes], Iterable[tuple[dict, int]]], types: pa.Schema, ddl: str) -> DataFrame:
    """The rows that ``parse`` makes of each file's path and content, with the bytes
    that each holds: given out a few at a time, whatever a file holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for row, size in parse(inside(name.as_py(), path), content.as_py()):
                    rows.append(row)
                    held += size
                    if held > SLICE_BYTES or len(rows) >= SLICE_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, types)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, ddl)


def warc_record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without the two line ends behind it."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + WARC_END + block


def write_warc(records: DataFrame, path: str) -> None:
    """Writes ``records`` (of ``arc_records``, with first_id, first_page, first_uri and
    first_date where a record revisits another) as WARC files, each with a record
    about the file first."""
    names = ["uri", "ip", "date", "mime", "whole", "page_id", "record_id", "payload_digest", "payload_bytes", "first_id", "first_page", "first_uri", "first_date", "block"]

    def one(uri, ip, date, mime, whole, page_id, own_id, digest, size, first_id, first_page, first_uri, first_date, block) -> bytes:
        head, _ = payload_of(uri, block)
        fields = {
            "WARC-Record-ID": own_id, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-IP-Address": ip, "WARC-Payload-Digest": f"sha256:{digest}", "Payload-Length": str(size),
            "Page-Id": None if page_id is None else str(page_id), "WARC-Truncated": None if whole else "length",
        }
        if first_id is not None:
            kind, block = "revisit", head
            fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": first_id, "WARC-Refers-To-Target-URI": first_uri, "WARC-Refers-To-Date": first_date, "Refers-To-Page-Id": None if first_page is None else str(first_page)}
        else:
            kind = "response" if head else "resource"
        fields["Content-Type"] = "application/http;msgtype=response" if head else mime
        fields["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
        return warc_record(kind, fields, block)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId()}.warc"
        about = {"WARC-Record-ID": record_id(path, name), "WARC-Date": iso_date(FIRST_DATE.strftime("%Y%m%d%H%M%S")), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
        yield pa.RecordBatch.from_arrays([pa.array([warc_record("warcinfo", about, b"format: WARC File Format 1.1\r\n")], pa.binary())], names=["value"])
        for batch in batches:
            for part in slices(batch, len(names) - 1):
                rows = zip(*(column.to_pylist() for column in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array([one(*r) for r in rows], pa.binary())], names=["value"])

    write_lines(records.select(*names).mapInArrow(render, "value binary"), path, WARC_END.decode())


def parse_warc(data: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in small letters) and block of each record, by its declared length."""
    reader = Reader([data] if isinstance(data, bytes) else data)
    while True:
        at = reader.at
        head, whole = reader.until(WARC_END)
        if not head and not whole:
            return
        lines = head.split(CRLF)
        if not whole or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record at {at}: {head[:100]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8", "replace").partition(":") for line in lines[1:])}
        block = reader.take(int(fields["content-length"]))
        if reader.take(len(WARC_END)) != WARC_END:
            raise ValueError(f"a WARC record at {at} does not end where it says")
        yield fields, block


WARC_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, uri string, warc_date string"


def warc_rows(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A row per record of the WARC files below ``path`` whose names fit ``glob``, those
    about files left out.

    Digests of blocks and payloads are worked out anew; a difference is an error.  A
    record without a page's id has a null page_id; empty payloads have length 0 and
    the digest of nothing; records that are equal are rows of their own.
    """
    types = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("record_id", pa.string()), ("refers_to_record", pa.string()), ("uri", pa.string()), ("warc_date", pa.string()),
    ])

    def row(fields: dict[str, str], block: bytes) -> dict:
        number = lambda name: int(fields[name]) if name in fields else None
        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), number("payload-length")
        _, payload = payload_of(fields["warc-target-uri"], block)
        wrong = fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}"
        if wrong or fields["warc-type"] != "revisit" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"digests of {fields['warc-record-id']} do not agree with its content")
        return {
            "page_id": number("page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("refers-to-page-id"),
            "record_id": fields["warc-record-id"], "refers_to_record": fields.get("warc-refers-to"), "uri": fields["warc-target-uri"], "warc_date": fields["warc-date"],
        }

    def parse(_, data: bytes) -> Iterator[tuple[dict, int]]:
        return ((row(f, block), len(f)) for f, block in parse_warc(unpacked(data)) if f["warc-type"] != "warcinfo")

    return parsed(spark, path, glob, parse, types, WARC_ROWS)


def convert(spark: SparkSession, arc_path: str, warc_path: str, glob: str = "*") -> None:
    """All ARC files below ``arc_path`` whose names fit ``glob`` to WARC files.

    Of records with equal payloads of LEAST_SHARED bytes or more the one with the
    smallest page_id is the response (none last; of equal ids the one that comes
    first by archive and place).  Payloads are read twice and not shuffled, but for
    the join with the shared ones where these are too many to be sent along.
    """
    digests = staged(arc_records(spark, arc_path, False, glob).drop("block"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "archive", "offset", "record_id", "uri", "date")
    shared = digests.filter(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")
    firsts = staged(shared.select(F.col("payload_digest").alias("shared"), *(F.col(f"first.{c}").alias(f"first_{n}") for n, c in (("id", "record_id"), ("page", "page_id"), ("uri", "uri"), ("date", "date")))))
    records = arc_records(spark, arc_path, True, glob)
    joined = records.join(firsts, (F.col("payload_digest") == F.col("shared")) & (F.col("record_id") != F.col("first_id")), "left")
    write_warc(joined, warc_path)


def report(pages: DataFrame) -> DataFrame:
    """Pages through ARC files and WARC files, read back.

    A null html is an empty payload, a null url ``-``; pages of equal ids are records
    of their own; other columns are left out.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return warc_rows(spark, warc)


ORACLE = r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to,
       CASE WHEN coalesce(url, '') = '' THEN '-' ELSE array_to_string(list_transform(string_split(url, ''), lambda c:
         CASE WHEN regexp_matches(c, '[\x{00}-\x{20}\x{7f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')
              THEN regexp_replace(hex(c), '(..)', '%\1', 'g') ELSE c END), '') END AS uri
FROM firsts
"""
