"""ARC archives, their conversion to WARC, and reading WARC back.

ARC files (version 1 or 2 header lines, one gzip member per record) are parsed
by header line and declared length. Each record becomes a WARC record with the
same block: the identifier is a UUID made from URL, date and place, the date is
the ARC's, digests are SHA-1. Of records with equal payloads one is the
response; the others are written as revisits that name it and have no payload.

Archives are files in a mounted folder. A task writes under a name of its own
and renames at the end, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import mounted, shared_folder, staged

# Header lines of the two ARC versions, and the fields of a version block.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_IP, _DATE = "0.0.0.0", "20260101000000"
_READ = 1 << 18
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
_ID_HEADER = "X-Page-Id"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Members:
    """Reads bytes and lines from a file of gzip members; ``place`` is where the next member starts."""

    def __init__(self, file: BinaryIO):
        self.file, self.raw, self.plain = file, b"", b""
        self.unzip, self.at, self.place = None, 0, 0

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(_READ)
            if not self.raw:
                return False
        if self.unzip is None:
            self.unzip = zlib.decompressobj(31)
        before = len(self.raw)
        self.plain += self.unzip.decompress(self.raw)
        self.raw = self.unzip.unused_data if self.unzip.eof else b""
        self.at += before - len(self.raw)
        if self.unzip.eof:
            self.unzip = None
        return True

    def read(self, size: int) -> bytes:
        parts, missing = [], size
        while missing > len(self.plain):
            parts.append(self.plain)
            missing -= len(self.plain)
            self.plain = b""
            if not self._more():
                raise EOFError("the archive ends inside a record")
        parts.append(self.plain[:missing])
        self.plain = self.plain[missing:]
        return b"".join(parts)

    def line(self) -> bytes | None:
        while (end := self.plain.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.plain = self.plain[:end], self.plain[end + 1 :]
        return out.rstrip(b"\r")


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, name: str, place: int) -> bytes:
    """A record: header line, block, line end. White space in a URL is escaped, as lines are cut at blanks."""
    url = "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url) or "-"
    fields = [url, _IP, date, kind]
    if version == 2:
        fields += ["200", sha1(block), "-", str(place), name]
    return " ".join([*fields, str(len(block))]).encode("utf-8", "surrogatepass") + b"\n" + block + b"\n"


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 lanewise\n{ARC_FIELDS[version]}\n\n".encode()
    fields = [f"filedesc://{name}", _IP, _DATE, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def parse_arc(file: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number, header fields, block) of the records of an ARC file; its version block says how lines read."""
    source, number = Members(file), 0
    head = source.line()
    if head is None:
        return
    body = source.read(int(head.rsplit(b" ", 1)[1]))
    version = int(body.split(b" ", 1)[0])
    names = ARC_FIELDS[version].split()
    while (line := source.line()) is not None:
        if not line:
            continue
        values = line.decode("utf-8", "surrogatepass").split(" ")
        if len(values) != len(names):
            raise ValueError(f"an ARC {version} header line has {len(names)} fields: {line[:200]!r}")
        fields = dict(zip(names, values, strict=True))
        yield number, fields, source.read(int(fields["Archive-length"]))
        number += 1


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_warc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    source = Members(file)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record starts with {line[:50]!r}")
        headers = {}
        while field := source.line():
            name, _, value = field.decode("utf-8", "surrogatepass").partition(": ")
            headers[name] = value
        yield headers, source.read(int(headers["Content-Length"]))


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = (x.partition(": ") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k: v for k, _, v in fields}, payload


class _Archive:
    """A file of gzip members that appears under its name when it is closed."""

    def __init__(self, folder: str, name: str):
        os.makedirs(folder, exist_ok=True)
        self.name, self.path = name, f"{folder}/{name}"
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.file, self.place = open(self.own, "wb"), 0  # noqa: SIM115

    def add(self, record: bytes) -> None:
        zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = zipped.compress(record) + zipped.flush()
        self.file.write(data)
        self.place += len(data)

    def close(self) -> None:
        self.file.close()
        os.replace(self.own, self.path)


def write_arcs(pages: DataFrame, folder: str, version: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as ARC files, one for each task; returns (file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, f"part-{TaskContext.get().partitionId():06d}.arc.gz"
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = _Archive(folder, name)
                    out.add(version_block(version, name))
                mark = "" if page is None else f"{_ID_HEADER}: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}\r\n".encode() + (html or b"")
                out.add(arc_record(version, url or "", _DATE, "text/html", block, name, out.place))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    rows = pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary"))
    return rows.mapInArrow(run, "file string")


def _warc_date(date: str) -> str:
    d = (date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record_id(url: str, date: str, file: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {file} {number}')}>"


def arc_index(files: DataFrame, folder: str) -> DataFrame:
    """(file, number, page_id, digest, record_id) of the records of ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with open(f"{folder}/{name}", "rb") as file:
                    for number, fields, block in parse_arc(file):
                        http, payload = http_parts(block)
                        page = int(http[_ID_HEADER]) if _ID_HEADER in http else None
                        record = _record_id(fields["URL"], fields["Archive-date"], name, number)
                        rows.append((name, number, page, sha1(payload), record))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.nulls(0, k) for k in kinds]
                yield pa.RecordBatch.from_arrays(columns, ["file", "number", "page_id", "digest", "record_id"])

    return files.mapInArrow(run, "file string, number long, page_id long, digest string, record_id string")


def convert(files: DataFrame, arcs: str, warcs: str) -> DataFrame:
    """Convert ARC files to WARC files; returns (file).

    Of records with equal payloads the one with the largest page_id (then the
    first by file and place) is the response, the others revisit it. Which
    records are revisits is told to the task of their file.
    """
    index = staged(arc_index(files, arcs), "arc-index")
    first = F.min_by(F.struct("file", "number", "record_id"), F.struct(-F.coalesce(F.col("page_id"), F.lit(-(1 << 62))), "file", "number"))
    best = index.groupBy("digest").agg(first.alias("best"), F.count("*").alias("n")).where("n > 1").select("digest", "best.*")
    later = (
        index.join(best.select("digest", F.col("file").alias("f"), F.col("number").alias("k"), F.col("record_id").alias("to")), "digest")
        .where("file <> f or number <> k")
        .groupBy("file")
        .agg(F.collect_list("number").alias("numbers"), F.collect_list("to").alias("targets"))
    )
    # An archive's records are bounded by the task that wrote it, and so is its list of revisits.
    todo = files.join(later, "file", "left")
    todo = todo.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, numbers, targets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = dict(zip(numbers or [], targets or [], strict=True))
                done = name.replace(".arc.gz", ".warc.gz")
                out = _Archive(warcs, done)
                info = f"software: lanewise\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
                head = {"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id("info", _DATE, name, -1), "WARC-Date": _warc_date(_DATE)}
                out.add(warc_record(head | {"WARC-Filename": done, "Content-Type": "application/warc-fields"}, info))
                with open(f"{arcs}/{name}", "rb") as file:
                    for number, fields, block in parse_arc(file):
                        _, payload = http_parts(block)
                        url, date = fields["URL"], fields["Archive-date"]
                        head = {
                            "WARC-Type": "revisit" if number in to else "response",
                            "WARC-Record-ID": _record_id(url, date, name, number),
                            "WARC-Date": _warc_date(date),
                            "WARC-Target-URI": url,
                            "WARC-IP-Address": fields["IP-address"],
                            "WARC-Payload-Digest": f"sha1:{sha1(payload)}",
                            "Content-Type": "application/http; msgtype=response",
                        }
                        if number in to:
                            block = block[: len(block) - len(payload)]
                            head |= {
                                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                                "WARC-Refers-To": to[number],
                                "WARC-Truncated": "length",
                                "X-Payload-Length": str(len(payload)),
                            }
                        head["WARC-Block-Digest"] = f"sha1:{sha1(block)}"
                        out.add(warc_record(head, block))
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([done])], ["file"])

    return todo.select("file", "numbers", "targets").mapInArrow(run, "file string")


def read_warcs(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id of the records of WARC files.

    A response's figures are computed from its payload and its digest header is
    checked; a revisit has those of its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with open(f"{folder}/{name}", "rb") as file:
                    for head, block in parse_warc(file):
                        if head["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, payload = http_parts(block)
                        page = int(http[_ID_HEADER]) if _ID_HEADER in http else None
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(head.get("X-Payload-Length", len(payload)))
                        if head["WARC-Type"] == "response" and sha1(payload) != digest:
                            raise ValueError(f"{head['WARC-Record-ID']} has another payload than its digest says")
                        rows.append((page, size, digest, head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                kinds = [pa.int64(), pa.int64()] + [pa.string()] * 4
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.nulls(0, k) for k in kinds]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _READ_SCHEMA.split(", ")])

    return files.mapInArrow(run, _READ_SCHEMA)


_READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string"


def archive_pages(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages to ARC, ARC to WARC, and per page what the WARC files say.

    page_id, payload_bytes, payload_digest, record_type and refers_to (the
    response's page_id, for revisits). Null html is an empty payload, a null
    url is written as ``-``; a null page_id stays null; rows that repeat a
    page_id are records of their own; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arcs, warcs = (mounted(shared_folder(spark, name)) for name in ("arc", "warc"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = staged(write_arcs(pages, arcs, version), "arc-files").repartition(parts, "file")
    converted = staged(convert(written, arcs, warcs), "warc-files").repartition(parts, "file")
    records = staged(read_warcs(converted, warcs), "records")
    named = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(named, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
