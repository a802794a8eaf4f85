"""WARC records in ZIP packages: writing, and range-reading without extraction."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.llm.common import Stages, filesystem, published

DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Signatures and fixed parts of the ZIP format.
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class Package:
    """The members of a ZIP file, found by its central directory; reads ranges of stored members.

    ``source`` is a random-access file (seek and read). Handles archive comments and
    ZIP64 directories, sizes and offsets; a compressed member is an error, since its
    records cannot be read by range.
    """

    def __init__(self, source, size: int):
        self.source, self.size, self.members = source, size, {}
        tail_at = max(0, size - 65_557 - 20)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("no ZIP directory")
        entries, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            place = tail[end - 20 : end]
            if place[:4] != LOCATOR:
                raise ValueError("no ZIP64 locator")
            record = self.read(struct.unpack("<Q", place[8:16])[0], 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 directory")
            entries, length, start = struct.unpack("<QQQ", record[32:56])
        directory, at = self.read(start, length), 0
        for _ in range(entries):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken ZIP directory")
            method, = struct.unpack("<H", directory[at + 10 : at + 12])
            packed, plain, names, extras, comments = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
            offset, = struct.unpack("<I", directory[at + 42 : at + 46])
            name = directory[at + 46 : at + 46 + names].decode("utf-8")
            extra = directory[at + 46 + names : at + 46 + names + extras]
            wide = self._zip64(extra)
            values = []
            for v in (plain, packed, offset):  # in this order, only those that don't fit
                if v == 0xFFFFFFFF and wide:
                    v, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
                values.append(v)
            self.members[name] = (method, values[2], values[1])
            at += 46 + names + extras + comments

    @staticmethod
    def _zip64(extra: bytes) -> bytes:
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                return extra[4 : 4 + n]
            extra = extra[4 + n :]
        return b""

    def read(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the file, and how many they are."""
        method, offset, length = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed")
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken member")
        names, extras = struct.unpack("<HH", head[26:30])
        return offset + 30 + names + extras, length

    def range(self, name: str, start: int, length: int) -> bytes:
        begin, size = self.stored(name)
        if start + length > size:
            raise ValueError("range beyond the member")
        return self.read(begin + start, length)


def record(kind: str, record_id: str, url: str, digest: str, http: bytes, payload: bytes, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP head of its response but no payload."""
    body = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http_head, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http_head.decode("latin-1").split("\r\n")[1:]), payload


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def urn_page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(value) if value not in ("", "none") else None


def _one_line(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")


def resolve_revisits(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", stages: Stages | None = None) -> DataFrame:
    """id, url, payload, digest, refers_to, revisit of each page.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
    largest id is the response (null ids come last; of repeated rows one), the others
    revisit it. Rows are numbered as they are staged, so both sides of the comparison
    see one numbering.
    """
    stages = stages or Stages(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = stages.table(rows.withColumn("digest", F.unhex(F.sha1("payload"))), "payloads")
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "row")).alias("last"), F.count(F.lit(1)).alias("n"))
    again = stages.table(groups.where("n > 1").select("digest", F.col("last.id").alias("last_id"), F.col("last.row").alias("last_row")), "repeated-payloads")
    return rows.join(again, "digest", "left").select(
        "id", "url", "payload", F.lower(F.hex("digest")).alias("digest"),
        (F.col("last_row").isNotNull() & (F.col("row") != F.col("last_row"))).alias("revisit"), F.col("last_id").alias("refers_to"))


def write_packages(resolved: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """One ZIP package for each partition; a row for each: path, records.

    A package stores a WARC file, each record its own gzip member, and an index with
    offset and length of each record. It is written under a name of the attempt's own
    and renamed, so a second attempt replaces the first. Records go out one by one;
    only the index is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = filesystem(folder)
        rows = (r for batch in batches for r in batch.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        fs.create_dir(base, recursive=True)
        name, lines, at = f"part-{TaskContext.get().partitionId():06d}.wacz", [], 0
        with published(fs, [f"{base}/{name}"]) as (sink,), zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
            with package.open(ARCHIVE, "w", force_zip64=True) as member:
                for r in itertools.chain([first], rows):
                    url, revisit = _one_line(r["url"]), r["revisit"]
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(r['payload'])}\r\n\r\n".encode()
                    data = record("revisit" if revisit else "response", page_urn(r["id"]), url, r["digest"], http, r["payload"], page_urn(r["refers_to"]) if revisit else None)
                    packed = gzip.compress(data, level, mtime=0)
                    member.write(packed)
                    lines.append(f"{url} {DATE} " + json.dumps({"filename": ARCHIVE, "offset": at, "length": len(packed), "digest": r["digest"]}))
                    at += len(packed)
            package.writestr(INDEX, "\n".join(lines) + "\n")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(lines)], pa.int64())})

    return resolved.mapInArrow(run, "path string, records long")


def _open(path: str):
    fs, name = filesystem(path)
    return Package(fs.open_input_file(name), fs.get_file_info(name).size)


def read_packages(packages: DataFrame, slice_records: int = 2048) -> DataFrame:
    """A row for each record of the packages (a column path): id, url, kind, digest, payload_bytes, refers_to, payload.

    First the directories and indexes are read, and slices of the index dealt out;
    then each slice's records are read by range. A response's digest and length are
    recomputed from its payload and must agree with the record.
    """
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                package = _open(path)
                text = package.range(INDEX, 0, package.stored(INDEX)[1]).decode()
                begin = package.stored(ARCHIVE)[0]
                entries = [json.loads(x.split(" ", 2)[2]) for x in text.splitlines()]
                for a in range(0, len(entries), slice_records):
                    part = entries[a : a + slice_records]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[begin + e["offset"] for e in part]], pa.list_(pa.int64())), pa.array([[e["length"] for e in part]], pa.list_(pa.int64()))], ["path", "offsets", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for s in batch.to_pylist():
                package, out = _open(s["path"]), []
                for offset, length in zip(s["offsets"], s["lengths"]):
                    fields, http, payload = parse_record(zlib.decompress(package.read(offset, length), 31))
                    digest, size, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"]), fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record in {s['path']} at {offset}")
                    out.append((urn_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, digest, size, urn_page(fields.get("WARC-Refers-To")), payload))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in out], schema=kinds)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in out], schema=kinds)

    slices = packages.select("path").mapInArrow(locate, "path string, offsets array<long>, lengths array<long>")
    slices = slices.repartition(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return slices.mapInArrow(fetch, "id long, url string, kind string, digest string, payload_bytes long, refers_to long, payload binary")


def archive_pages(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write every page (page_id, url, html) as a WARC record into packages in ``folder``; a row for each package.

    Null html is an empty payload, a null url ``urn:none``; null ids are written as
    such. White space and control characters of a url are percent-escaped. Repeated
    rows are each a record. An empty table writes no package.
    """
    stages = Stages(pages.sparkSession)
    packages = stages.table(write_packages(resolve_revisits(pages, stages=stages, **options), folder), "packages")
    stages.close("packages")
    return packages
