"""WARC archives in ZIP packages: written by Spark tasks, read by range without extraction.

A package holds stored WARC files under ``archive/`` and an index with the place of each
record under ``indexes/``. The reader parses the central directory (ZIP64 included),
finds the index and the stored members, and reads only the bytes of the records asked
for. Packages are listed by a manifest table that Spark commits, so files that a lost or
repeated task has left behind are never read.

Defined cases: a null html is an empty payload; a null url is left out; a null page_id
counts as the largest, and equal payloads of null ids only are all responses; repeated
rows with the smallest id are all responses; an empty table gives an empty result; other
columns are ignored. A digest that doesn't fit its payload, or an archive member that
isn't stored, is an error.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.storage import new_path, stored

#: Payloads below this are never revisits.
LEAST_REVISIT_BYTES = 100
PACKAGE_BYTES = 128 << 20
#: Bytes of records that a reading task takes, about.
READ_BYTES = 32 << 20
DATE = "2020-01-01T00:00:00Z"
#: Head field of records whose address is percent-encoded.
ENCODED = "Target-URI-Encoding"
ARCHIVE, INDEX = "archive/data.warc", "indexes/index.cdxj"


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def directory(f, length: int) -> list[Member]:
    """Members of the ZIP file ``f`` (seek and read), from its central directory."""
    tail_at = max(0, length - 22 - 65_535 - 20)
    f.seek(tail_at)
    tail = f.read(length - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    entries, size, start = struct.unpack_from("<H2L", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        f.seek(end64)
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of the central directory where its locator points")
        entries, size, start = struct.unpack_from("<3Q", record, 32)
    f.seek(start)
    data, found, p = f.read(size), [], 0
    for _ in range(entries):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<2H", data, p + 8)
        packed, full, n, extra, comment = struct.unpack_from("<2L3H", data, p + 20)
        (header,) = struct.unpack_from("<L", data, p + 42)
        name = data[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        q, end = p + 46 + n, p + 46 + n + extra
        while q + 4 <= end:
            kind, width = struct.unpack_from("<2H", data, q)
            if kind == 1:  # 64-bit values, only of the fields that don't fit, in this order
                values = iter(struct.unpack_from(f"<{min(width // 8, 3)}Q", data, q + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            q += 4 + width
        found.append(Member(name, method, packed, full, header))
        p = end + comment
    return found


def data_offset(f, member: Member) -> int:
    """Where the member's bytes begin; the local header's own lengths count."""
    f.seek(member.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    name, extra = struct.unpack_from("<2H", head, 26)
    return member.header + 30 + name + extra


def member_bytes(f, member: Member) -> bytes:
    f.seek(data_offset(f, member))
    data = f.read(member.packed)
    return data if member.method == 0 else zlib.decompress(data, -15)


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:  # as it is; only one that would break the head is encoded, and says so
        plain = url.isprintable() and url == url.strip()
        lines += [f"WARC-Target-URI: {url if plain else quote(url, safe=':/?#[]@!$&()*+,;=')}"] + ([] if plain else [f"{ENCODED}: percent"])
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{refers_to}>"] if kind == "revisit" else []
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Type, ids, url, digest, payload and its size of one record's bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(":")[1] for line in http.decode().split("\r\n") if line.lower().startswith("content-length:")))
    number = lambda urn: int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    refers_to = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    url = fields.get("WARC-Target-URI")
    url = unquote(url) if ENCODED in fields else url
    return {"page_id": number(fields["WARC-Record-ID"]), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers_to, "payload": payload if kind == "response" else None}


def record_types(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to; the last is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least_bytes
    first = rows.filter(large).groupBy(F.col("payload_digest").alias("same")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = stored(first, "first_ids")  # its file size decides whether pages move for the join
    joined = rows.join(first, large & (F.col("payload_digest") == F.col("same")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_packages(pages: DataFrame, path: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the archives under ``path`` (a URI that all executors reach) and returns the manifest: (package, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(path)
        system.create_dir(root, recursive=True)
        rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
        row = next(rows, None)
        while row is not None:
            name, index, at = f"{uuid.uuid4().hex}.wacz", [], 0
            with system.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(ARCHIVE, "w", force_zip64=True) as archive:
                    while row is not None and at < package_bytes:
                        batch, i = row
                        page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                        data = record(page_id, url, "response" if refers_to is None else "revisit", payload, len(payload), digest, refers_to)
                        archive.write(data)
                        index.append(f"{quote(url or '-', safe=':/')} {DATE} {json.dumps({'filename': ARCHIVE, 'offset': at, 'length': len(data)})}\n")
                        at += len(data)
                        row = next(rows, None)
                package.writestr(INDEX, "".join(index))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([at], pa.int64())], ["package", "records", "bytes"])

    typed = record_types(pages).select("page_id", "url", "payload", "payload_digest", "refers_to")
    return stored(typed.mapInArrow(run, "package string, records bigint, bytes bigint"), "manifest").withColumn("package", F.concat(F.lit(f"{path}/"), F.col("package")))


def read_index(packages: DataFrame) -> DataFrame:
    """(package, nth, offset, length): the place of every record of the packages, from directories and indexes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, name = _open(uri)
                with system.open_input_file(name) as f:
                    members = {m.name: m for m in directory(f, f.size())}
                    starts, rows = {}, []
                    for m in members.values():
                        if m.name.startswith("indexes/"):
                            for line in member_bytes(f, m).decode().splitlines():
                                place = json.loads(line.split(" ", 2)[2])
                                held = members[place["filename"]]
                                if held.method:
                                    raise ValueError(f"{held.name} of {uri} isn't stored")
                                if held.name not in starts:
                                    starts[held.name] = data_offset(f, held)
                                rows.append((starts[held.name] + place["offset"], place["length"]))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["package", "nth", "offset", "length"])

    return packages.select("package").mapInArrow(run, "package string, nth bigint, offset bigint, length bigint")


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_records(places: DataFrame, n_tasks: int, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records at ``places`` (package, nth, offset, length), each by a read of its range.

    Places are few bytes and records many, so the number of tasks is given, not left to
    what the shuffle holds.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, f = None, None
        for batch in batches:
            rows, held = [], 0
            for package, offset, length in zip(*(batch.column(c).to_pylist() for c in ("package", "offset", "length")), strict=True):
                if package != uri:
                    if f is not None:
                        f.close()
                    system, name = _open(package)
                    uri, f = package, system.open_input_file(name)
                f.seek(offset)
                rows.append(parse_record(f.read(length)))
                held += length
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if f is not None:
            f.close()

    slices = places.withColumn("slice", F.floor(F.col("offset") / read_bytes)).repartition(n_tasks, "package", "slice").sortWithinPartitions("package", "offset")
    return slices.select("package", "offset", "length").mapInArrow(run, RECORD)


def read_packages(manifest: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """All records of the packages of a manifest."""
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    return read_records(read_index(manifest), 2 * (total // read_bytes) + 1, read_bytes)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "archives"))
    return read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha256(t) AS payload_digest,
       CASE WHEN octet_length(encode(t)) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(t)) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, t, min(page_id) OVER (PARTITION BY t) AS first_id
      FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""
