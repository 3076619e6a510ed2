"""WARC records in ZIP packages, written by partition and read back by range, without extraction.

A package holds two stored members: ``archive/data.warc.gz``, a run of gzipped records, and ``indexes/index.jsonl``,
a line a record with its member, offset and length in that. A reader takes the package's directory from its end, then
all members below ``indexes/``, then each record by its range; so it reads packages of other names for members too. Of records with equal payloads the one with the smallest page id is a
response and the others revisit it: their block is the HTTP header alone, which still tells the payload's length, and
the record header its digest.

Packages are written by tasks to a shared folder, each under a name of its own attempt; the returned list names only
those of attempts that ended well. A package is closed at ``PACKAGE_BYTES`` or ``PACKAGE_RECORDS``, so its index fits in memory.

Defined results: a null payload is empty; empty payloads are equal payloads like any other; a null id is never the
smallest, and a group of payloads without ids has no revisits; repeated ids make records of their own, alike
response or revisit, and share their record id; an empty table gives no packages; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import PIECE_BYTES, materialize, pieces
from framelake.llm.zip_archive import members, read_range, stored_at

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PACKAGE_BYTES, PACKAGE_RECORDS = 512 << 20, 50_000
#: Index lines that a task hands on at once.
SLICE = 5000
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join((url or "urn:unknown").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's headers (``warc``), its HTTP headers (``http``) and payload; a length that doesn't fit raises ValueError."""
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    warc = fields(lines)
    n = int(warc["content-length"])
    if not first.startswith("WARC/") or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return {"warc": warc, "http": fields(http.decode("latin-1").split("\r\n")[1:]), "payload": payload}


class _Package:
    """One ZIP package being written; ``add`` takes records."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.out = fs.open_output_stream(path, buffer_size=1 << 20)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data, self.offset, self.index = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, record: bytes, page_id: int | None, url: str | None) -> None:
        packed = gzip.compress(record, LEVEL, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"id": page_id, "url": url, "filename": DATA.rpartition("/")[2], "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.out.close()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        package, name = None, ""
        for batch in pieces(batches, 2):
            done = []
            for page_id, url, html, first, revisit in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    package = _Package(fs, f"{path}/{name}")
                package.add(warc_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), first, revisit), page_id, url)
                if package.offset >= PACKAGE_BYTES or len(package.index) >= PACKAGE_RECORDS:
                    package.close()
                    done.append((name, len(package.index)))
                    package = None
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["package", "records"])
        if package is not None:
            package.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(package.index)], pa.int64())], ["package", "records"])

    return run


def with_revisits(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``html``, ``first`` (the id of the response to a record's payload) and ``revisit``.

    First ids are minima by digest, summed map-side; the join with them can split a payload of very many pages.
    """
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # written first: with its size known, Spark broadcasts it if it is small, and pages are not shuffled at all
    firsts = materialize(firsts.where("n > 1 AND first IS NOT NULL").drop("n"))
    joined = rows.join(firsts, "digest", "left")
    return joined.select("page_id", "url", "html", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))


def write_packages(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Writes the packages and ``folder/packages``, a Parquet list of them, which is returned."""
    spark = pages.sparkSession
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with_revisits(pages, **columns).mapInArrow(_writer(folder), "package string, records bigint").write.parquet(f"{folder}/packages")
    return spark.read.parquet(f"{folder}/packages")


_ENTRIES = "package string, id bigint, url string, start bigint, length bigint"


def _indexer(folder: str):
    """Reads each package's directory and index: where in the package every record lies."""

    def entries(name: str, archives: dict[str, int], lines: list[dict]) -> pa.RecordBatch:
        starts = [archives[x["filename"]] + int(x["offset"]) for x in lines]
        columns = [[name] * len(lines), [x.get("id") for x in lines], [x.get("url") for x in lines], starts, [int(x["length"]) for x in lines]]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _ENTRIES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{name}") as source:
                    held = members(source, source.size())
                    archives = {m.name.rpartition("/")[2]: stored_at(source, m) for m in held if m.name.startswith("archive/")}
                    indexes = [(m, read_range(source, stored_at(source, m), m.size)) for m in held if m.name.startswith("indexes/")]
                for m, index in indexes:
                    if zlib.crc32(index) != m.crc:
                        raise ValueError(f"{name}: broken index {m.name}")
                    lines = [x for x in index.split(b"\n") if x.strip()]
                    for at in range(0, len(lines), SLICE):
                        yield entries(name, archives, [json.loads(x) for x in lines[at : at + SLICE]])

    return run


_RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def _reader(folder: str, payloads: bool):
    number = lambda uri: int(x) if (x := uri.strip("<>").rpartition(":")[2]) else None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        open_, source = "", None
        for batch in batches:
            rows, held = [], 0
            for name, url, start, length in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                if name != open_:
                    if source is not None:
                        source.close()
                    open_, source = name, fs.open_input_file(f"{path}/{name}")
                record = parse_record(gzip.decompress(read_range(source, start, length)))
                warc, kind = record["warc"], record["warc"]["warc-type"]
                digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(record["http"]["content-length"])
                if kind == "response" and (payload_digest(record["payload"]) != digest or len(record["payload"]) != size):
                    raise ValueError(f"{name}: the payload at {start} does not match its digest")
                refers = number(warc["warc-refers-to"]) if kind == "revisit" else None
                rows.append((number(warc["warc-record-id"]), url, kind, digest, size, refers, record["payload"] if payloads and kind == "response" else None))
                held += len(record["payload"]) if payloads else 0
                if held >= PIECE_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)
        if source is not None:
            source.close()

    return run


def read_packages(spark: SparkSession, folder: str, wanted: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of the packages that ``wanted`` (default: the written list) names; a revisit's payload is null.

    Packages are dealt out evenly; a task reads a package's directory and index, then its records by range.
    """
    packages = (spark.read.parquet(f"{folder}/packages") if wanted is None else wanted).select("package")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = packages.repartition(n).mapInArrow(_indexer(folder), _ENTRIES)
    return entries.mapInArrow(_reader(folder, payloads), _RECORDS)
