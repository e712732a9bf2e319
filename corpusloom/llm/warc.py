"""Legacy archive converter: ARC files to WARC.

ARC (versions 1 and 2): a file begins with a version block, whose header line `filedesc://... ` declares its length and whose body
names the version and the fields of the header lines that follow. Each record is a header line (URL, address, 14-digit
date, content type, ... , length) and as many bytes as declared; here each record is a gzip member of its own. The
converter parses the header lines by the version's own field list and synthesises WARC records: identifiers,
timestamps, types, payload and block digests. Records whose payload another record holds become revisits.

Files are written to the shared folder under names that no other attempt uses, and only files that a finished task
reports are read. Which records are revisits is settled on rows without payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace, bound_arrow, text_slices

#: The field lists of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which an archive file is full.
FILE_BYTES = 1 << 26
DATE = "20240101000000"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_version_block(name: str, version: int = 1, date: str = DATE) -> bytes:
    body = f"{version} 0 corpusloom\n{FIELDS[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    head += f" 200 - - 0 {name}" if version == 2 else ""
    return f"{head} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, body: bytes, version: int = 1, date: str = DATE, kind: str = "text/html", name: str = "-", offset: int = 0) -> bytes:
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "urn:none"
    head = f"{url} 0.0.0.0 {date} {kind}" + (f" 200 - - {offset} {name}" if version == 2 else "")
    return f"{head} {len(body)}\n".encode() + body + b"\n"


def parse_arc_line(line: str, fields: str) -> dict[str, str]:
    """A header line by its version's fields; surplus blanks can only be in the URL."""
    names = fields.split()
    parts = line.rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC header line of {len(names)} fields: {line[:200]!r}")
    return dict(zip(names, parts, strict=True))


def read_arc(raw) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Number in the file, header fields and body of every record of a gzipped ARC file, the version block first."""
    with gzip.GzipFile(fileobj=raw) as f:
        line = f.readline().decode("utf-8", "replace").rstrip("\r\n")
        size = int(line.rpartition(" ")[2])
        body = f.read(size)
        lines = body.decode("utf-8", "replace").split("\n")
        version, fields = int(lines[0].split(" ")[0]), lines[1].strip()
        yield 0, parse_arc_line(line, FIELDS.get(version, fields) if line.count(" ") != 4 else FIELDS[1]), body
        k = 0
        while line := f.readline():
            if not line.strip():
                continue  # the newline that ends a record
            k += 1
            head = parse_arc_line(line.decode("utf-8", "replace").rstrip("\r\n"), fields)
            body = f.read(int(head["Archive-length"]))
            if len(body) < int(head["Archive-length"]):
                raise ValueError(f"record {k} is cut off")
            yield k, head, body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; without a head all is payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[: m.end()], body[m.end() :]) if m else (body, b"")


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("latin-1") if m else None


def record_id(name: str, k: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{k}')}>"


def iso_date(date: str) -> str:
    """A 14-digit ARC date (12 and 8 digits occur in old files) as WARC writes it."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(head: dict[str, str], body: bytes) -> str:
    if head["URL"].startswith("filedesc:"):
        return "warcinfo"
    return "response" if body.startswith(b"HTTP/") or head["URL"].startswith("dns:") else "resource"


def warc_record(head: dict[str, str], body: bytes, rid: str, refers: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; with refers (record, URL and date of the equal payload) a revisit without payload."""
    kind = warc_type(head, body)
    http, payload = split_http(body)
    fields = [("WARC-Type", "revisit" if refers else kind), ("WARC-Record-ID", rid), ("WARC-Date", iso_date(head["Archive-date"]))]
    if kind == "warcinfo":
        fields += [("WARC-Filename", head["URL"].partition("://")[2])]
    else:
        fields += [("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if refers:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2])]
        body = http
    mime = {"warcinfo": "application/warc-fields"}.get(kind) or ("application/http; msgtype=response" if http else head["Content-type"])
    fields += [("WARC-Block-Digest", f"sha1:{payload_digest(body)}"), ("Content-Type", mime), ("Content-Length", str(len(body)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + body + b"\r\n\r\n"


def read_warc(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record of a gzipped WARC file; block digests are checked."""
    with gzip.GzipFile(fileobj=raw) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:80]!r}")
            fields = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                fields[k] = v.strip()
            block = f.read(int(fields["Content-Length"]))
            if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
                raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
            yield fields, block


class _Files:
    """Gzip members written one after another to files of FILE_BYTES, in folder."""

    def __init__(self, folder: str, suffix: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.suffix, self.out, self.size, self.path = suffix, None, 0, ""

    def begin(self) -> str:
        self.path = f"{self.root}/{uuid.uuid4().hex}{self.suffix}"
        self.out, self.size = self.store.open_output_stream(self.path, compression=None), 0
        return self.path.rpartition("/")[2]

    def add(self, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.out.write(packed)
        self.size += len(packed)

    def end(self) -> str:
        self.out.close()
        self.out = None
        return self.path


def _paths(paths: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])


def write_arc(pages: DataFrame, folder: str, version: int = 2) -> DataFrame:
    """Write pages (page_id, url, html) as gzipped ARC files under folder; their paths.

    A page's record is an HTTP response that carries its page_id as a field. Null html is an empty payload, a null URL
    `urn:none`.
    """
    spark = pages.sparkSession
    bound_arrow(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name = _Files(folder, ".arc.gz"), ""
        for batch in batches:
            for part in text_slices(batch, "html"):
                for page, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    if not files.out:
                        name = files.begin()
                        files.add(arc_version_block(name, version))
                    payload = (html or "").encode()
                    own = f"X-Page-Id: {page}\r\n" if page is not None else ""
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n"
                    files.add(arc_record(url or "", http.encode() + payload, version, name=name, offset=files.size))
                    if files.size >= FILE_BYTES:
                        yield _paths([files.end()])
        if files.out:
            yield _paths([files.end()])

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string")


_SCAN = "path string, k long, page_id long, url string, date string, digest string, check string, payload_bytes long, rid string"


def scan_arc(paths: DataFrame, folder: str) -> DataFrame:
    """A row without payload for every record of ARC files: its place, WARC identifier, page_id (if it has one), URL, date, payload digest and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split(" ")[0] for x in _SCAN.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in _SCAN.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.open_input_file(path) as f:
                    for k, head, body in read_arc(f):
                        http, payload = split_http(body)
                        page = http_field(http, "X-Page-Id")
                        if not head["URL"].startswith("filedesc:"):
                            rows.append((path, k, int(page) if page else None, head["URL"], head["Archive-date"], payload_digest(payload), hashlib.sha256(payload).hexdigest(), len(payload), record_id(path.rpartition("/")[2], k)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    return paths.mapInArrow(run, _SCAN)


def mark_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """records with refers (rid, url, date of the record that holds the payload; null for that one itself).

    Of records with equal payloads of `least` bytes or more, the one with the largest page_id (then file and place) holds it.
    Payloads are equal if their SHA-1, SHA-256 and size are. A hot payload is one row of an aggregate that combines before its shuffle; the join back is split where it is hot.
    """
    place = F.struct(F.col("page_id"), F.col("path"), F.col("k"), F.col("rid"), F.col("url"), F.col("date"))
    holders = records.where(F.col("payload_bytes") >= least).groupBy("digest", "check", "payload_bytes").agg(F.max(place).alias("holder"))
    joined = records.join(holders, ["digest", "check", "payload_bytes"], "left")
    return joined.withColumn("refers", F.when(F.col("holder.rid") != F.col("rid"), F.struct("holder.rid", "holder.url", "holder.date"))).drop("holder")


def convert(records: DataFrame, folder: str) -> DataFrame:
    """Convert the ARC files that records (path, k, refers) name to gzipped WARC files under folder, one for each; their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        store = files.store
        path, source, raw = None, None, None
        for batch in batches:
            for now, k, refers in zip(*(batch.column(c).to_pylist() for c in ("path", "k", "refers")), strict=True):
                if now != path:
                    if path:
                        raw.close()
                        yield _paths([files.end()])
                    path, raw = now, store.open_input_file(now)
                    source = read_arc(raw)
                    files.begin()
                    name = path.rpartition("/")[2]
                    _, head, body = next(source)
                    files.add(warc_record(head, body, record_id(name, 0)))
                at, head, body = next(source)
                if at != k:
                    raise ValueError(f"{path}: record {at} where {k} was due")
                files.add(warc_record(head, body, record_id(name, k), (refers["rid"], refers["url"], iso_date(refers["date"])) if refers else None))
        if path:
            raw.close()
            yield _paths([files.end()])

    n = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return records.select("path", "k", "refers").repartition(n, "path").sortWithinPartitions("path", "k").mapInArrow(run, "path string")


_READ = "rid string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_rid string"


def read_records(paths: DataFrame, folder: str) -> DataFrame:
    """A row for every record of WARC files but their warcinfo. A revisit's size is that of its HTTP head; responses are checked against their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split(" ")[0] for x in _READ.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in _READ.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.open_input_file(path) as f:
                    for fields, block in read_warc(f):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, payload = split_http(block)
                        digest, kind, page = fields["WARC-Payload-Digest"].partition(":")[2], fields["WARC-Type"], http_field(http, "X-Page-Id")
                        if kind != "revisit" and payload_digest(payload) != digest:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
                        size = int(http_field(http, "Content-Length") or 0) if kind == "revisit" else len(payload)
                        rows.append((fields["WARC-Record-ID"], int(page) if page else None, size, digest, kind, fields.get("WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    return paths.mapInArrow(run, _READ)


def archive(pages: DataFrame, version: int = 2) -> DataFrame:
    """pages as ARC files, those converted to WARC, and these read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    refers_to is the page_id of the response that a revisit refers to. Null html is an empty payload. Of rows
    that repeat a page_id and payload one is the response. Other columns are left out; an empty table gives no rows.
    """
    space = Workspace(pages.sparkSession, "warc")
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = lambda df: df.repartition(n, "path")
    arcs = space.keep(write_arc(pages, f"{space.root}/arc", version), "arcs")
    marked = mark_revisits(space.keep(scan_arc(spread(arcs), space.root), "scanned"))
    warcs = space.keep(convert(marked, f"{space.root}/warc"), "warcs")
    found = space.keep(read_records(spread(warcs), space.root), "found")
    space.drop("arc")
    space.drop("scanned")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    held = found.where("record_type <> 'revisit'")
    named = held.select(F.col("rid").alias("refers_rid"), F.col("page_id").alias("refers_to"))
    revisits = found.where("record_type = 'revisit'").join(named, "refers_rid", "left").select(*out, "refers_to")
    return held.select(*out, F.lit(None).cast("bigint").alias("refers_to")).unionByName(revisits)  # responses refer to nothing, so they are not joined
