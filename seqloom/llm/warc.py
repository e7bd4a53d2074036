"""Legacy archives: ARC files (versions 1 and 2) are written, parsed and converted to WARC.

An ARC file starts with a version block whose second line names the version; each record is a
header line, whose fields depend on the version, then as many bytes as its last field declares and
a line end. The converter synthesises what ARC lacks: record identifiers, ISO timestamps, record
types, block and payload digests. Of records with equal payloads one stays a response and the
others become revisits that refer to it.

Archives are compressed record by record, so each record can be read by itself.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_file, small_batches, task, write_file

# Fixed values of the formats: the header fields of either version, and the profile of revisits.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Bytes of records after which a writer closes its archive.
ARCHIVE_BYTES = 24_000_000
#: Payloads below this size are never made revisits.
REVISIT_BYTES = 100
#: The HTTP header that carries a row's key through the archives.
KEY_HEADER = b"X-Archive-Key"
PIECE = 65_536


@dataclass
class ArcRecord:
    archive: str
    offset: int
    version: int
    fields: dict[str, str]
    content: bytes
    truncated: bool = False


def gzip_member(data: bytes) -> bytes:
    zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipper.compress(data) + zipper.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The gzip members of an archive with their offsets; one that isn't compressed is one member.

    The bytes of a member that ends early are given as far as they come.
    """
    if data[:2] != b"\x1f\x8b":
        if data:
            yield 0, data
        return
    view, start, at = memoryview(data), 0, 0
    unzip, parts = zlib.decompressobj(31), []
    while at < len(data):
        piece = view[at : at + PIECE]
        parts.append(unzip.decompress(piece))
        at += len(piece) - len(unzip.unused_data)
        if unzip.eof:
            yield start, b"".join(parts)
            start, unzip, parts = at, zlib.decompressobj(31), []
    if parts:
        yield start, b"".join(parts)


def arc_records(archive: str, data: bytes) -> Iterator[ArcRecord]:
    """The URL records of an ARC file, the version block left out.

    A header line is split from its right end, as only the first field may hold spaces. A record
    that declares more bytes than there are is marked truncated; a line that isn't a header of
    the file's version is an error.
    """
    version = 0
    for offset, block in members(data):
        at = 0
        while at < len(block):
            if block[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = block.find(b"\n", at)
            end = len(block) if end < 0 else end
            line = block[at:end].decode("utf-8", "replace").rstrip("\r")
            names = ARC_FIELDS.get(version, ())
            values = line.rsplit(" ", len(names) - 1) if version else line.rsplit(" ", 1)
            if version and len(values) != len(names) or not values[-1].isdigit():
                raise ValueError(f"{archive}: no ARC header line at {offset}: {line[:80]!r}")
            size, start = int(values[-1]), end + 1
            content = block[start : start + size]
            if version:
                yield ArcRecord(archive, offset + at, version, dict(zip(names, values)), content, len(content) < size)
            else:
                version = int(content.split(b" ", 1)[0] or 0)
                if version not in ARC_FIELDS:
                    raise ValueError(f"{archive}: version {version} isn't known")
            at = start + size


def arc_file(name: str, version: int, date: str, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC file of records (URL, content type, content)."""
    about = f"{version} 0 Archive\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    extra = {1: "", 2: " 200 - - 0 -"}[version]
    out = [gzip_member(f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(about)}\n".encode() + about + b"\n")]
    at = len(out[0])
    for url, kind, content in records:
        more = {1: "", 2: f" 200 {hashlib.md5(content).hexdigest()} - {at} {name}"}[version]
        out.append(gzip_member(f"{url} 0.0.0.0 {date} {kind}{more} {len(content)}\n".encode() + content + b"\n"))
        at += len(out[-1])
    return b"".join(out)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP response, its blank line included, and its payload; no head if it isn't one."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def http_header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def iso_date(date: str) -> str:
    """An ARC date of 4 to 14 digits as the WARC's; missing parts are the first of their kind."""
    full = date[:14] + "00000101000000"[len(date) :] if date.isdigit() and len(date) >= 4 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    """The identifier of what stands there: by the archive's file name, so the same wherever it lies."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive.rsplit('/', 1)[-1]}#{offset}')}>"


def warc_record(record: ArcRecord, refers_to: tuple[str, int] | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit without payload where it refers to another."""
    head, payload = split_http(record.content)
    url, kind = record.fields["URL"], record.fields["Content-type"]
    block = head if refers_to else record.content
    headers = [("WARC-Type", "revisit" if refers_to else "response" if head else "resource"), ("WARC-Record-ID", record_id(record.archive, record.offset)), ("WARC-Date", iso_date(record.fields["Archive-date"]))]
    if url != "-":
        headers.append(("WARC-Target-URI", url))
    if record.fields["IP-address"] != "0.0.0.0":
        headers.append(("WARC-IP-Address", record.fields["IP-address"]))
    headers += [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*refers_to)), ("WARC-Truncated", "length")]
    elif record.truncated:
        headers.append(("WARC-Truncated", "disconnect"))
    headers += [("Content-Type", "application/http; msgtype=response" if head else kind), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file: named fields and block."""
    for _, member in members(data):
        at = 0
        while at < len(member):
            end = member.find(b"\r\n\r\n", at)
            if not member.startswith(b"WARC/", at) or end < 0:
                raise ValueError("no WARC record")
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in member[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
            start = end + 4
            block = member[start : start + int(fields["Content-Length"])]
            yield fields, block
            at = start + len(block) + 4


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20000101000000", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write an ARC record for each row and return the files: path.

    The content is an HTTP response that carries the row's id; a null html is an empty payload, a
    null url is "-", and white space in a url is escaped. A task's files alternate between the
    versions. Other columns aren't read; an empty table gives no file.
    """
    slim = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.encode(html_col, "UTF-8"))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{seq:06d}.arc.gz"
            write_file(f"{path}/{name}", arc_file(name, 1 + (task + seq) % 2, date, held))
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"]})

        for batch in batches:
            for key, url, html in zip(*(c for c in batch.columns)):
                payload = html.as_py() or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + (KEY_HEADER + b": %d\r\n" % key.as_py() if key.is_valid else b"") + b"Content-Length: %d\r\n\r\n" % len(payload)
                held.append((quote(url.as_py() or "", safe="!#$%&'()*+,/:;=?@[]~") or "-", "text/html", head + payload))
                size += len(held[-1][2])
                if size >= archive_bytes:
                    yield close()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield close()

    return slim.mapInArrow(run, "path string")


def index_arc(archives: DataFrame) -> DataFrame:
    """A slim row for each record of the ARC files in archives(path): archive, offset, key, payload_bytes, digest."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for record in arc_records(path, read_file(path)):
                    head, payload = split_http(record.content)
                    key = http_header(head, KEY_HEADER)
                    rows.append({"archive": path, "offset": record.offset, "key": None if key is None else int(key), "payload_bytes": len(payload), "digest": hashlib.sha256(payload).digest()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("key", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.binary())]))

    return _spread(archives).mapInArrow(run, "archive string, offset long, key long, payload_bytes long, digest binary")


def _spread(archives: DataFrame) -> DataFrame:
    """A few archives for each task."""
    files = archives.count()
    return archives.repartition(max(1, files)) if files < 10_000 else archives.repartition(10_000)


def convert(archives: DataFrame, path: str, *, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Convert the ARC files in archives(path) to WARC files below path and return those: path.

    Of records with equal payloads of at least revisit_bytes, the one with the smallest key (null
    last; ties by archive and offset) is written whole, the others refer to it. The payloads
    aren't shuffled: only their digests are, and each archive is then converted by one task that
    knows which of its records are revisits.
    """
    scratch = Scratch(archives.sparkSession, "warc")
    index = scratch.keep(index_arc(archives), "index")
    place = F.struct(F.col("key").isNull().alias("unkeyed"), "key", "archive", "offset")
    large = index.where(F.col("payload_bytes") >= revisit_bytes)
    firsts = large.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = scratch.keep(firsts, "firsts")
    others = large.join(firsts, "digest").where(~((F.col("archive") == F.col("first.archive")) & (F.col("offset") == F.col("first.offset"))))
    revisits = others.groupBy("archive").agg(F.collect_list(F.struct("offset", F.col("first.archive").alias("to_archive"), F.col("first.offset").alias("to_offset"))).alias("revisits"))
    work = archives.select(F.col("path").alias("archive")).join(revisits, "archive", "left")

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                to = {x["offset"]: (x["to_archive"], x["to_offset"]) for x in revisits or ()}
                out = [gzip_member(warc_record(record, to.get(record.offset))) for record in arc_records(archive, read_file(archive))]
                name = archive.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".arc")
                write_file(f"{path}/{name}.warc.gz", b"".join(out))
                yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}.warc.gz"]})

    return _spread(scratch.keep(work, "work")).mapInArrow(run, "path string")


def read_warc(archives: DataFrame) -> DataFrame:
    """The records of the WARC files in archives(path).

    key, record_type, record_id, refers_to_id, url, date, payload (null for revisits), payload_bytes
    and payload_digest (hex). A response's digest is taken of its payload and must be the one that
    its header states; a revisit has its digest and size from its headers.
    """

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "record_type", "record_id", "refers_to_id", "url", "date", "payload", "payload_bytes", "payload_digest"]
        types = pa.schema(list(zip(names, [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string()])))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for fields, block in warc_records(read_file(path)):
                    head, payload = split_http(block)
                    key, revisit = http_header(head, KEY_HEADER), fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} doesn't have its digest")
                    n = int(http_header(head, b"Content-Length") or 0) if revisit else len(payload)
                    rows.append((None if key is None else int(key), fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields.get("WARC-Target-URI"), fields["WARC-Date"], None if revisit else payload, n, digest))
                    size += len(payload)
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], schema=types)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], schema=types)

    return _spread(archives).mapInArrow(run, "key long, record_type string, record_id string, refers_to_id string, url string, date string, payload binary, payload_bytes long, payload_digest string")


def with_referred_key(records: DataFrame) -> DataFrame:
    """records with refers_to, the key of the record that a revisit refers to.

    records: a written table. Many revisits may refer to one record, so its side of the join is
    read from its own table and Spark may split the other.
    """
    responses = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("_to"), F.col("key").alias("refers_to"))
    plain = records.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.unionByName(records.where("refers_to_id IS NOT NULL").join(responses, F.col("refers_to_id") == F.col("_to"), "left").drop("_to"))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages through ARC and WARC archives and back: a row per record, without the payloads."""
    scratch = Scratch(spark, "archives")
    small_batches(spark)
    arcs = scratch.keep(write_arc(pages, scratch.path("arc")), "arcs")
    warcs = scratch.keep(convert(arcs, scratch.path("warc")), "warcs")
    records = scratch.keep(read_warc(warcs).drop("payload"), "records")
    for name in ("arc", "arcs", "warc", "warcs"):
        scratch.drop(name)
    return with_referred_key(records)
