"""mzML as a Spark data source whose files are split: each task reads a range of bytes.

    spark.dataSource.register(MzmlSource)
    spark.read.format("mzml").option("splitBytes", 16 << 20).load(path)

Splits are planned from the index at the end of each file: a split begins at a spectrum's
offset, the first one at or after each multiple of ``splitBytes``. A file without an index
(or with one that doesn't fit it) is cut at the multiples themselves. Either way a task
reads from its first byte on, skips to the first spectrum that begins there, and stops at
the first that begins in the next split, so each spectrum is read once. A task holds one
chunk of bytes and one spectrum.

Paths are files or folders in stores that Arrow opens (local, S3, GCS, HDFS).
``sources.spectra.read_mzml`` reads whole files from any store that Spark reads.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.sources.spectra import SCHEMA, spectrum

SPLIT_BYTES = 16 << 20
CHUNK = 1 << 20
#: The index is looked for in so many bytes at the end of a file.
TAIL = 4096
ROWS = 500
BEGIN, END = re.compile(rb"<spectrum\s"), b"</spectrum>"


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the mzML files at a path, sorted; paths keep the scheme they were given with."""
    store, inner = opened(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in store.get_file_info(fs.FileSelector(inner)) if i.is_file and i.path.lower().endswith(".mzml")]
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((scheme + i.path if not i.path.startswith(scheme) else i.path, i.size) for i in found)


def index_offsets(path: str, size: int) -> Iterator[int]:
    """Offsets of spectra as the file's index has them, a chunk of the index at a time; none without a sound index."""
    store, inner = opened(path)
    with store.open_input_file(inner) as f:
        f.seek(max(0, size - TAIL))
        place = re.search(rb"<indexListOffset>\s*(\d+)\s*</indexListOffset>", f.read(TAIL))
        at = int(place.group(1)) if place else size
        rest, inside = b"", False
        while at < size:
            f.seek(at)
            chunk = f.read(min(CHUNK, size - at))
            if not chunk:
                return
            at += len(chunk)
            rest += chunk
            if not inside:
                head = re.search(rb'<index\s[^>]*name="spectrum"[^>]*>', rest)
                if not head:
                    rest = rest[-TAIL:]
                    continue
                inside, rest = True, rest[head.end() :]
            ends = rest.find(b"</index>")
            part = rest if ends < 0 else rest[:ends]
            last = 0
            for m in re.finditer(rb"<offset\b[^>]*>\s*(\d+)\s*</offset>", part):
                yield int(m.group(1))
                last = m.end()
            if ends >= 0:
                return
            rest = rest[last:]


def splits(path: str, size: int, split_bytes: int) -> list[Split]:
    """Splits of a file that cover it; they begin at indexed spectra where there is an index."""
    starts, wanted = [0], split_bytes
    for offset in index_offsets(path, size):
        if offset < starts[-1] or offset >= size:  # not this file's index
            starts = [0]
            break
        if offset >= wanted:
            starts.append(offset)
            wanted = (offset // split_bytes + 1) * split_bytes
    if len(starts) == 1:
        starts = list(range(0, max(size, 1), split_bytes))
    return [Split(path, a, b) for a, b in zip(starts, [*starts[1:], size], strict=True)]


def elements(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The text of each spectrum element that begins in the range."""
    store, inner = opened(path)
    with store.open_input_file(inner) as f:
        f.seek(start)
        held, at, done = b"", start, False  # ``at``: where ``held`` begins in the file

        def more() -> bool:
            nonlocal held, done
            chunk = b"" if done else f.read(CHUNK)
            done = not chunk
            held += chunk
            return not done

        while True:
            begin = BEGIN.search(held)
            while begin is None:
                if at + len(held) - len(b"<spectrum") > stop:
                    return
                cut = max(0, len(held) - len(b"<spectrum "))
                held, at = held[cut:], at + cut
                if not more():
                    return
                begin = BEGIN.search(held)
            held, at = held[begin.start() :], at + begin.start()
            if at >= stop:
                return
            seen = 0
            while (end := held.find(END, seen)) < 0:
                seen = max(0, len(held) - len(END))
                if not more():
                    return  # a file that was cut off ends in part of a spectrum
            end += len(END)
            yield held[:end]
            held, at = held[end:], at + end


class MzmlReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        return [s for path, size in files(self.path) for s in splits(path, size, self.split_bytes)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        name = split.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
        rows: list[dict] = []
        for text in elements(split.path, split.start, split.stop):
            element = ET.fromstring(text)
            row = spectrum(element, int(element.get("index", "-1")))
            if row is not None:
                rows.append({"file_name": name, **row})
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class MzmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MzmlReader:
        return MzmlReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))
