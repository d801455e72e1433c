"""Conversion of legacy ARC archives to WARC.

An ARC file opens with a version block that names the version of its record headers; each record is one header line, laid
out by that version, and as many bytes as the line declares. The converter reads such records and writes WARC records with
what ARC lacks: record identifiers (name-based, so that reruns agree), ISO timestamps, record types and digests.

1. write_arcs() packs pages into ARC files (for tables; archives that exist already start at step 2).
2. index_arcs() parses the archives: one narrow row for each record, with the payload's digest.
3. decide() finds, for equal payloads, the one record that stays a response: one partial aggregation and one join over
   narrow rows; payloads do not move.
4. convert() streams each ARC file to a WARC file, with revisits as decided.
5. read_warcs() parses the WARC files.

Files are written by tasks under names of their own and count once the committed table of files lists them. A file ends at
about ARCHIVE_BYTES, so memory is bounded by the largest record and by the revisits among one file's records.

Defined cases: a null payload is empty; a null URL becomes unknown:/; a record without an id is always a response; of
repeated ids with equal payloads one is the response and the others revisit it; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.shared import _filesystem, bound_batches, materialise, scratch, writing

#: The field lines of the ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC ------------------------------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    place: int
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    status: str | None
    body: bytes

    @property
    def iso_date(self) -> str:
        d = self.date
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def arc_url(url: str | None) -> str:
    """A URL as one field of a header line: what would end the field is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-￿]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "") or "unknown:/"


def write_arc_start(out, name: str, date: str, version: int) -> None:
    block = f"{version} 0 quillmere\n{ARC_FIELDS[version]}\n".encode()
    tail = f"text/plain {len(block)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(block)}"
    out.write(gzip.compress(f"filedesc://{name} 0.0.0.0 {date} {tail}\n".encode() + block + b"\n", 1, mtime=0))


def write_arc_record(out, name: str, version: int, url: str | None, date: str, body: bytes, offset: int) -> int:
    tail = f"text/html {len(body)}" if version == 1 else f"text/html 200 {hashlib.md5(body).hexdigest()} - {offset} {name} {len(body)}"
    data = gzip.compress(f"{arc_url(url)} 0.0.0.0 {date} {tail}\n".encode() + body + b"\n", 1, mtime=0)
    out.write(data)
    return len(data)


def parse_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC file (uncompressed stream), without the version block."""
    version, place = 0, -1
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not version:
            if not fields[0].startswith("filedesc://") or not fields[-1].isdigit():
                raise ValueError("an ARC file starts with a filedesc record")
            version = int(stream.read(int(fields[-1])).split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        rest = 6 if version == 2 else 1
        if len(fields) < 4 + rest or not fields[-1].isdigit() or not re.fullmatch(r"\d{14}", fields[2]):
            raise ValueError(f"not a header line of ARC version {version}: {line[:200]!r}")
        body = stream.read(length := int(fields[-1]))
        if len(body) != length:
            raise ValueError(f"{fields[0]} declares {length} bytes and has {len(body)}")
        place += 1
        # a content type may itself hold spaces; the fields after it are counted from the end
        yield ArcRecord(place, version, fields[0], fields[1], fields[2], " ".join(fields[3:-rest]), fields[-6] if version == 2 else None, body)


def split_http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names lower-cased), the head with its empty line, and the payload of an HTTP response."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    if not body.startswith(b"HTTP/") or not mark:
        return {}, b"", body
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}, head + mark, payload


# --- WARC -----------------------------------------------------------------------------------------------------------


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def to_warc(r: ArcRecord, refers: dict | None) -> bytes:
    """The WARC record of an ARC record; refers: of the response that it revisits (page_id, url, date, digest)."""
    http, head, payload = split_http(r.body)
    digest, key = sha1_base32(payload), http.get(ID_HEADER.lower(), "-")
    headers = {
        "WARC-Type": "revisit" if refers else "response",
        "WARC-Record-ID": record_id(r.url, r.iso_date, key, digest) if not refers else record_id(r.url, r.iso_date, key, digest, r.place, "revisit"),
        "WARC-Target-URI": r.url,
        "WARC-Date": r.iso_date,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    block = r.body
    if refers:
        block = head
        date = f"{refers['date'][:4]}-{refers['date'][4:6]}-{refers['date'][6:8]}T{refers['date'][8:10]}:{refers['date'][10:12]}:{refers['date'][12:14]}Z"
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Truncated": "length", "WARC-Refers-To": record_id(refers["url"], date, refers["page_id"], digest), "WARC-Refers-To-Target-URI": refers["url"], "WARC-Refers-To-Date": date, "X-Refers-To-Page": str(refers["page_id"])}
    headers["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
    return warc_record(headers, block)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n:
            raise ValueError("a WARC record ends early")
        yield headers, block


def opened(uri: str):
    """An uncompressed stream over a file of gzip members."""
    filesystem, path = _filesystem(uri)
    return io.BufferedReader(gzip.GzipFile(fileobj=filesystem.open_input_file(path)), 1 << 16)


# --- jobs -----------------------------------------------------------------------------------------------------------

_FILES = "uri string, n_records long"
_FILE_KIND = pa.schema([("uri", pa.string()), ("n_records", pa.int64())])


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


#: A task goes on with a new archive from so many bytes on.
ARCHIVE_BYTES = 1 << 30


def write_arcs(pages: DataFrame, date: str = "20240101000000", page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Packs pages into ARC files of about archive_bytes at most, version 1 and 2 in turn; returns the table of files."""
    bound_batches(pages.sparkSession)
    folder = scratch(pages.sparkSession, "arcs")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        records = (tuple(batch.column(c)[i].as_py() for c in range(3)) for batch in batches for i in range(batch.num_rows))
        held = next(records, None)
        version = 1 + TaskContext.get().partitionId() % 2
        while held is not None:
            name, n, at = f"{uuid.uuid4().hex}.arc.gz", 0, 0
            with writing(f"{folder}/{name}") as out:
                write_arc_start(out, name, date, version)
                while held is not None and at < archive_bytes:
                    key, where, payload = held[0], held[1], held[2] or b""
                    mark = f"{ID_HEADER}: {key}\r\n" if key is not None else ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n"
                    at += write_arc_record(out, name, version, where, date, head.encode() + payload, at)
                    n += 1
                    held = next(records, None)
            yield pa.RecordBatch.from_pylist([{"uri": f"{folder}/{name}", "n_records": n}], _FILE_KIND)
            version = 3 - version

    rows = pages.select(F.col(page_id).cast("long"), F.col(url), F.encode(F.col(html), "UTF-8"))
    return materialise(rows.mapInArrow(write, _FILES), "arc-files")


def _spread(files: DataFrame) -> DataFrame:
    return files.repartition(4 * max(1, files.sparkSession.sparkContext.defaultParallelism))


_INDEX = "arc string, place long, page_id long, url string, date string, digest string, payload_bytes long"
_INDEX_KIND = pa.schema([("arc", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64())])


def index_arcs(arcs: DataFrame) -> DataFrame:
    """One row for each record of the archives, without its payload."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    with opened(uri) as stream:
                        for r in parse_arc(stream):
                            http, _, payload = split_http(r.body)
                            key = http.get(ID_HEADER.lower())
                            yield {"arc": uri, "place": r.place, "page_id": int(key) if key else None, "url": r.url, "date": r.date, "digest": sha1_base32(payload), "payload_bytes": len(payload)}

        yield from _batches(rows(), _INDEX_KIND)

    return materialise(_spread(arcs.select("uri")).mapInArrow(index, _INDEX), "arc-index")


def decide(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The revisits among the records: arc, place and refers (page_id, url, date of the response)."""
    known = index.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_bytes))
    best = known.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "arc", "place", "url", "date")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = known.select("arc", "place", "digest", "payload_bytes").join(best, ["digest", "payload_bytes"])
    other = ~((F.col("arc") == F.col("best.arc")) & (F.col("place") == F.col("best.place")))
    return rows.where(other).select("arc", "place", F.struct("best.page_id", "best.url", "best.date").alias("refers"))


def convert(arcs: DataFrame, revisits: DataFrame) -> DataFrame:
    """Streams each ARC file to a WARC file; returns the table of files."""
    folder = scratch(arcs.sparkSession, "warcs")
    by_file = revisits.groupBy("arc").agg(F.collect_list(F.struct("place", "refers")).alias("revisits"))
    work = arcs.select(F.col("uri").alias("arc")).join(by_file, "arc", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                arc = batch.column(0)[i].as_py()
                refers = {x["place"]: x["refers"] for x in batch.column(1)[i].as_py() or ()}
                uri, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                with writing(uri) as out, opened(arc) as stream:
                    info = f"software: quillmere\r\nformat: WARC File Format 1.1\r\nconverted-from: {arc.rpartition('/')[2]}\r\n".encode()
                    out.write(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(arc), "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info))
                    for r in parse_arc(stream):
                        out.write(to_warc(r, refers.get(r.place)))
                        n += 1
                yield pa.RecordBatch.from_pylist([{"uri": uri, "n_records": n}], _FILE_KIND)

    return materialise(_spread(work).mapInArrow(write, _FILES), "warc-files")


_READ = "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string"
_READ_KIND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string())])


def read_warcs(warcs: DataFrame) -> DataFrame:
    """One row for each response and revisit. A response's digest and size are those of the bytes read; they must agree with its headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    with opened(uri) as stream:
                        for h, block in parse_warc(stream):
                            if h["warc-type"] == "warcinfo":
                                continue
                            http, _, payload = split_http(block)
                            digest, size, key = h["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]), http.get(ID_HEADER.lower())
                            if h["warc-type"] == "response" and (sha1_base32(payload), len(payload)) != (digest, size):
                                raise ValueError(f"the payload of {h['warc-record-id']} does not have its digest")
                            to = h.get("x-refers-to-page")
                            yield {"page_id": int(key) if key else None, "url": h["warc-target-uri"], "date": h["warc-date"], "record_id": h["warc-record-id"], "record_type": h["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": int(to) if to else None, "refers_to_id": h.get("warc-refers-to")}

        yield from _batches(rows(), _READ_KIND)

    return _spread(warcs.select("uri")).mapInArrow(read, _READ)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC; the table of WARC files."""
    arcs = write_arcs(pages)
    return convert(arcs, decide(index_arcs(arcs), least_bytes))
