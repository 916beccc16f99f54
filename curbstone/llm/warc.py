"""WARC records in ZIP packages: written by tasks, found through the packages' directories and read by range."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstone.llm.common import keep, new_folder
from curbstone.llm.zips import data_offset, directory

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A package is closed when its archive has so many bytes.
PACKAGE_BYTES = 64 << 20
#: Smallest payload that may be a revisit.
LEAST_REVISIT = 0
SALTS = 32
#: Repeated digests up to which they are sent to all executors (about 100 bytes each), so that no payload is shuffled.
BROADCAST_DIGESTS = 50_000
#: Records that one reading task gets together.
READ_RUN = 512
#: Bytes of packages for each reading task: the rows dealt out are places only, so their own size says nothing.
READ_BYTES = 8 << 20
NONE = "none"
DATE = "2024-01-01T00:00:00Z"


def file_system(uri: str):
    """(pyarrow file system, path) of a folder given by URI or as a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC record, gzipped by itself; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{NONE if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{first}>"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of a gzipped record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Package:
    """A ZIP file with a stored archive and a stored index; it appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = file_system(folder)
        self.path, self.part = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(_Unseekable(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.member.write(data)
        self.index.append(f"{NONE if page_id is None else page_id} {self.size} {len(data)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.path, len(self.index), self.size


class _Unseekable(io.RawIOBase):
    """A stream that only goes forward, so that sizes and checksums follow the data and the directory has them."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row of pages to packages in folder: one row (path, records, bytes) for each package.

    Of records whose payloads of LEAST_REVISIT bytes or more are equal, those with the smallest key are responses and the
    others revisit it. Only digests that occur twice are joined back: up to BROADCAST_DIGESTS, counted first, by sending them to
    all executors, more over SALTS copies, so a payload that a third of all pages share is spread. Tasks stream their rows into packages of about PACKAGE_BYTES and rename each when it is
    whole; a retried task writes the same names again.

    A null payload is empty, a null URL is empty, null keys come after all others and, alone, are responses. Equal rows with
    the smallest key are all responses. Other columns aren't read. An empty table gives no package.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = keep(same.filter("n > 1").drop("n"))
    if same.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(same), "digest", "left")
    else:
        same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(same, ["digest", "salt"], "left")
    rows = rows.select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, package, made = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for page_id, address, data, first in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    package = _Package(folder, f"part-{task:06d}-{count:05d}.wacz")
                    count += 1
                revisit = first is not None and first != page_id
                address = address.replace("\r", "%0D").replace("\n", "%0A")
                package.add(page_id, record(page_id, address, data, base32_sha1(data), first, revisit))
                if package.size >= PACKAGE_BYTES:
                    made.append(package.close())
                    package = None
        if package is not None:
            made.append(package.close())
        yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "records": [m[1] for m in made], "bytes": [m[2] for m in made]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    return keep(rows.mapInArrow(run, "path string, records long, bytes long"))


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each record in the packages.

    First each package's directory gives its archive and its index, and the index a row (path, offset, length)
    for each record; those rows are dealt out in runs that lie together, and each run reads its records by range.
    A response's payload is checked against its digest. A revisit has no payload, its length is in its HTTP header.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    read_at = lambda at, n: f.read_at(n, at)
                    members = {m.name: m for m in directory(read_at, f.size())}
                    begin, index = data_offset(read_at, members[ARCHIVE]), members[INDEX]
                    lines = read_at(data_offset(read_at, index), index.size).decode().splitlines()
                found = [tuple(map(int, x.split()[1:])) for x in lines]
                yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "run": [k // READ_RUN for k in range(len(found))], "at": [begin + a for a, _ in found], "n": [n for _, n in found]}, pa.schema([("path", pa.string()), ("run", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        path, f = None, None
        for batch in batches:
            out: list[tuple] = []
            for p, _, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if p != path:
                    if f:
                        f.close()
                    path, f = p, fs.open_input_file(p)
                out.append(_row(f.read_at(n, at)))
                if len(out) >= READ_RUN:
                    yield _batch(out)
                    out = []
            yield _batch(out)
        if f:
            f.close()

    places = packages.select("path").repartition("path").mapInArrow(locate, "path string, run long, at long, n long")
    tasks = 1 + (packages.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES
    places = places.repartition(tasks, "path", "run").sortWithinPartitions("path", "at")
    return places.mapInArrow(fetch, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


def _number(urn: str | None) -> int | None:
    value = (urn or NONE).strip("<>").rpartition(":")[2]
    return None if value == NONE else int(value)


def _row(data: bytes) -> tuple:
    fields, block = parse(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} doesn't match its digest")
    return _number(fields["warc-record-id"]), fields["warc-target-uri"], kind, size, digest, _number(fields.get("warc-refers-to")), payload if kind == "response" else None


def archive_folder(spark: SparkSession) -> str:
    """A new folder for packages in the shared folder; it is deleted when the session's program ends."""
    return new_folder(spark, "warc-")
