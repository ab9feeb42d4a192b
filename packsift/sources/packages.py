"""Extension packages (CRX2, CRX3, ZIP) to file rows."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import resource_type

__all__ = ["ENTRY_SCHEMA", "PACKAGE_GLOB", "distinct_packages", "entries", "escapes", "read_packages", "resource_type", "unpack", "with_package_key", "zip_offset"]

ENTRY_SCHEMA = (
    "ext_id string, package_sha256 string, path string, content binary, reject string"
)


PACKAGE_GLOB = "*.{[cC][rR][xX],[zZ][iI][pP]}"


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Package blobs; the extension id is the content hash, the file's base name a column."""
    return with_package_key(spark.read.format("binaryFile").option("pathGlobFilter", PACKAGE_GLOB).load(folder))


def with_package_key(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.sha2("content", 256)
    return files.select(
        digest.alias("ext_id"), digest.alias("package_sha256"), F.regexp_replace(name, r"(?i)\.(crx|zip)$", "").alias("name"), "path", "content")


def distinct_packages(blobs: DataFrame) -> DataFrame:
    """One blob per content: that with the smallest path. Only keys are grouped, never blobs."""
    first = blobs.groupBy("ext_id").agg(F.min("path").alias("path"))
    return blobs.join(first, ["ext_id", "path"], "left_semi")


def zip_offset(blob: bytes) -> int:
    """Start of the ZIP data behind an optional CRX header."""
    if len(blob) > 16 and blob[:4] == b"Cr24":
        version, first, second = struct.unpack_from("<III", blob, 4)
        if version == 3:
            return 12 + first
        if version == 2:
            return 16 + first + second
    return 0


BATCH_BYTES = 8 << 20


def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of package blobs. What cannot be read is a row with the reason: of the whole
    package if it is no archive or leaves its root, else of the entry alone."""
    columns = ["ext_id", "package_sha256", "path", "content", "reject"]
    rows, held = [], 0
    for batch in batches:
        for ext_id, sha, blob in zip(batch["ext_id"], batch["package_sha256"], batch["content"]):
            for name, content, reject in _members(blob):
                rows.append((ext_id, sha, name, content, reject))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= 10_000:  # by bytes: a package never sits in memory unpacked
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _members(blob: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(path, content, reject) of one package."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(blob[zip_offset(blob):]))
        names = [n for n in archive.namelist() if not n.endswith("/")]
    except Exception:  # damaged directories raise errors of many kinds
        yield None, None, "not a zip archive"
        return
    unsafe = [n for n in names if escapes(n)]
    if unsafe:
        yield unsafe[0], None, "unsafe path"
        return
    for name in dict.fromkeys(names):
        try:
            content = archive.read(name)
        except Exception as error:  # checksum, encryption, compression method, truncation
            yield name, None, f"unreadable entry ({type(error).__name__})"
        else:
            yield name, content, None


def escapes(name: str) -> bool:
    clean = posixpath.normpath(name.replace("\\", "/"))
    return clean.startswith(("/", "../")) or clean == ".."


def unpack(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rejects). A package with a path outside its root is refused whole."""
    rows = packages.mapInPandas(entries, ENTRY_SCHEMA)
    return rows.filter("reject is null").drop("reject"), rows.filter("reject is not null").drop("content")
