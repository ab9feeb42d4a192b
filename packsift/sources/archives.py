"""Data source of extension packages: ``spark.read.format("extension_packages").load(folder)`` and its stream.

Archives are read by range: a task opens its archive, reads the directory at the end, and then only the entries that begin in its
byte range. Large archives are read by several tasks, small ones share one. Any file system that Arrow knows will do. Rows are
entries, or reasons why a package or an entry cannot be read.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .packages import BATCH_BYTES, escapes

FORMAT = "extension_packages"
SCHEMA = "package string, name string, directory_sha256 string, path string, content binary, reject string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.binary() if c.endswith("binary") else pa.string() for c in SCHEMA.split(", ")]
_PACKAGE = re.compile(r"\.(crx|zip)$", re.I)
SPLIT_BYTES = 32 << 20


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if re.match(r"file:/(?!//)", path):
        path = "file:///" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def listed(folder: str) -> list[tuple[str, int]]:
    """(path, size) of the package files of a folder, by name."""
    system, path = file_system(folder)
    found = system.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and _PACKAGE.search(f.base_name))


class Ranges(InputPartition):
    """(path, first, last): entries of an archive that begin from first up to last (excluded)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(None)
        self.ranges = ranges


def ranges_of(files: list[tuple[str, int]], split: int) -> list[Ranges]:
    """Large archives cut into ranges, small ones put together, up to about ``split`` bytes each."""
    out, held, size = [], [], 0
    for path, length in files:
        cuts = list(range(0, max(length, 1), split))
        for first in cuts:
            last = first + split if first != cuts[-1] else 1 << 62
            held.append((path, first, last))
            size += min(split, length - first)
            if size >= split or len(held) >= 10_000:
                out.append(Ranges(held))
                held, size = [], 0
    return [*out, Ranges(held)] if held else out


class RangeFile(io.RawIOBase):
    """A file of Arrow's file systems that raises the errors of Python's files."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + (0, self.file.tell(), self.size)[whence]
        if place < 0:
            raise OSError(f"position {place}")
        return self.file.seek(place)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)


def directory_digest(archive: zipfile.ZipFile) -> str:
    """Digest of names, sizes and checksums of all entries: what an archive holds, without reading it."""
    digest = hashlib.sha256()
    for info in archive.infolist():
        digest.update(f"{info.filename}\0{info.file_size}\0{info.CRC:08x}\n".encode())
    return digest.hexdigest()


def members(file, first: int, last: int) -> Iterator[tuple[str | None, str | None, bytes | None, str | None]]:
    """(directory digest, path, content, reject) of the entries that begin in a range; what concerns the package is said by the first range."""
    try:
        archive = zipfile.ZipFile(file)
        names = [n for n in archive.namelist() if not n.endswith("/")]
        digest = directory_digest(archive)
    except Exception:  # damaged directories raise errors of many kinds
        if first == 0:
            yield None, None, None, "not a zip archive"
        return
    unsafe = next((n for n in names if escapes(n)), None)
    if unsafe is not None:
        if first == 0:
            yield digest, unsafe, None, "unsafe path"
        return
    for name in dict.fromkeys(names):
        info = archive.getinfo(name)
        if first <= info.header_offset < last:
            try:
                content = archive.read(info)
            except Exception as error:  # checksum, encryption, compression method, truncation
                yield digest, name, None, f"unreadable entry ({type(error).__name__})"
            else:
                yield digest, name, content, None


def entries_of(ranges: list[tuple[str, int, int]], folder: str) -> Iterator[pa.RecordBatch]:
    system, _ = file_system(folder)
    rows, held = [], 0
    for path, first, last in ranges:
        with system.open_input_file(path) as file:
            name = _PACKAGE.sub("", path.rsplit("/", 1)[-1])
            for digest, entry, content, reject in members(io.BufferedReader(RangeFile(file), 1 << 16), first, last):
                rows.append((path, name, digest, entry, content, reject))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _COLUMNS)


class PackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Ranges]:
        return ranges_of(listed(self.folder), self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from entries_of(partition.ranges, self.folder)


class ArrivalReader(DataSourceStreamReader):
    """Packages as they arrive in a folder.

    Files not seen before become the next entry of a log beside the checkpoint (option ``log``); an offset is a number of
    that log. Entries never change, so a batch that is run again reads the same files, whatever has arrived since.
    """

    def __init__(self, options: dict):
        self.folder, self.log = options["path"], options["log"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def _entries(self) -> dict[int, list]:
        system, path = file_system(self.log)
        found = system.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
        out = {}
        for f in found:
            if f.base_name.endswith(".json"):
                with system.open_input_stream(f.path) as stream:
                    out[int(f.base_name[:-5])] = json.loads(stream.readall())
        return out

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        known = self._entries()
        last = max(known, default=0)
        seen = {path for files in known.values() for path, _ in files}
        fresh = [f for f in listed(self.folder) if f[0] not in seen]
        if fresh:
            system, path = file_system(self.log)
            system.create_dir(path, recursive=True)
            last += 1
            with system.open_output_stream(f"{path}/{last:08d}.part") as stream:
                stream.write(json.dumps(fresh).encode())
            system.move(f"{path}/{last:08d}.part", f"{path}/{last:08d}.json")
        return {"entry": last}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        known = self._entries()
        files = [tuple(f) for n in range(start["entry"] + 1, end["entry"] + 1) for f in known[n]]
        return ranges_of(files, self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from entries_of(partition.ranges, self.folder)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackageReader:
        return PackageReader(self.options)

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Entries and rejects of the packages of a folder."""
    spark.dataSource.register(PackageSource)
    return spark.read.format(FORMAT).options(**options).load(folder)


def arriving(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(PackageSource)
    return spark.readStream.format(FORMAT).option("log", log).load(folder)


# --- writing -----------------------------------------------------------------------------------


def archive_bytes(files: list[tuple[str, bytes]], stored: frozenset[str] = frozenset()) -> bytes:
    """A ZIP of (path, content), the same bytes for the same files. Paths in ``stored`` are not compressed."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path, content in files:
            info = zipfile.ZipInfo(path)
            archive.writestr(info, content, zipfile.ZIP_STORED if path in stored else zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def write_archives(files: DataFrame, folder: str, finish=lambda key, data: data, stored: frozenset[str] = frozenset()) -> DataFrame:
    """One archive per ext_id of (ext_id, path, text): rows of ext_id, file and size. ``finish`` may change the bytes.

    A package is built by one task, as a ZIP can only be written from front to back; a repeated task writes the same bytes
    under the same name.
    """
    def build(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        order = sorted(zip(table["path"].to_pylist(), table["text"].to_pylist()))
        data = finish(name, archive_bytes([(p, (t or "").encode()) for p, t in order], stored))
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}.zip") as out:
            out.write(data)
        return pa.table({"ext_id": [name], "file": [f"{path}/{name}.zip"], "size": pa.array([len(data)], pa.int64())})

    return files.select("ext_id", "path", "text").groupBy("ext_id").applyInArrow(build, "ext_id string, file string, size long")
