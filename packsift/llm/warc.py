"""WARC archives: a writer with revisit records and a splittable reader.

``write_warc`` writes one gzip member per record. Payloads of ``MIN_REVISIT`` bytes or more that occur more than once are
stored with the smallest id only; the others become revisit records that refer to it. Every task writes files of its
own and reports them when they are closed, so the listing holds only files of finished attempts.

``read_warc`` cuts the files into byte ranges, each a task's work whatever the file's size. A task looks for the gzip magic
in its range, takes a candidate for a member only if it decodes to a WARC header, and owns the records that start inside
its range; the last of them may end behind it. After a record the next one starts where its member ended. What is no
member, or ends early, is passed over.

Files are opened by their URI (local, S3, GCS or HDFS). Nulls: a null html is an empty payload, a null URL has no target.
Rows with a null id are responses without an id. Equal rows (same id, same payload) are records of their own. A payload of any length
is one member, held whole by one task. An empty table gives no archives and no records; further columns are not read. A range that
begins inside a member whose stored content is itself a WARC member takes that for a record; members of text do not hold any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, staged_path
from .shared import small

MIN_REVISIT = 100
FILE_BYTES = 128 << 20  # a file is closed when it is as large as that
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, body: bytes, digest: str, refers_to) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload is stored with a smaller id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = cut_lineage(pages.select("page_id", F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("digest")).filter(f"n >= {least}").select("page_id", "digest"))
    first = cut_lineage(facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return cut_lineage(facts.join(first, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct())


def write_warc(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages (page_id, url, html); returns path, bytes and records of each file."""
    folder = folder or staged_path(pages.sparkSession)
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("body"), F.sha2(payload, 256).alias("digest"))
    rows = rows.join(small(revisits(pages)), ["page_id", "digest"], "left").select("page_id", "url", "body", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]):
        store, base = open_folder(folder)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, number, size, count, done = None, 0, 0, 0, []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("page_id", "url", "body", "digest", "refers_to")]
            for row in zip(*columns):
                if out is None:
                    out, size, count = store.open_output_stream(f"{name}-{number:05d}.warc.gz", compression=None), 0, 0
                member = record(*row)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:05d}.warc.gz", size, count))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            done.append((f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:05d}.warc.gz", size, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], ["path", "bytes", "records"])

    return cut_lineage(rows.mapInArrow(run, "path string, bytes long, records long"))


def list_warc(spark, pattern: str) -> DataFrame:
    """path and bytes of the files of a glob pattern."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


class Range:
    """Bytes of a file from one position on, read in blocks as they are asked for."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block = file, size, block
        self.at, self.data = 0, b""

    def bytes(self, start: int, count: int) -> bytes:
        if not (self.at <= start and start + count <= self.at + len(self.data)):
            self.at, self.data = start, self.file.read_at(min(max(count, self.block), max(self.size - start, 0)), start)
        return self.data[start - self.at:start - self.at + count]

    def find(self, start: int, stop: int) -> int:
        """The first gzip magic from ``start`` that begins before ``stop``, or -1."""
        while start < stop:
            part = self.bytes(start, min(self.block, stop - start + 2))
            hit = part.find(MAGIC)
            if hit >= 0 and start + hit < stop:
                return start + hit
            start += max(len(part) - 2, 1)
        return -1

    def member(self, start: int) -> tuple[bytes, int] | None:
        """The content of the gzip member at ``start`` and where it ends; None if it is no WARC record."""
        unpack, out, at = zlib.decompressobj(31), [], start
        seen = b""
        try:
            while not unpack.eof:
                part = self.bytes(at, 16 << 10)
                if not part:
                    return None
                at += len(part)
                out.append(unpack.decompress(part))
                if len(seen) < 5:  # validated before the rest is decoded
                    seen = b"".join(out)[:5]
                    if not b"WARC/".startswith(seen) and seen != b"WARC/":
                        return None
        except zlib.error:
            return None
        content = b"".join(out)
        return (content, at - len(unpack.unused_data)) if content.startswith(b"WARC/") and b"\r\n\r\n" in content else None


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, headers, http and payload of every record of the files (path, bytes)."""
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("begin"))
    many = max(files.sparkSession.sparkContext.defaultParallelism, int(files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).collect()[0][0] or 1))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, size, begin in zip(*(batch[c].to_pylist() for c in ("path", "bytes", "begin"))):
                store, name = open_folder(path if "://" in path else path.replace("file:/", "file:///", 1))
                with store.open_input_file(name) as file:
                    source, stop, rows, held = Range(file, size), min(begin + range_bytes, size), [], 0
                    at = source.find(begin, stop)
                    while at >= 0:
                        found = source.member(at)
                        if found:
                            head, _, block = found[0].partition(b"\r\n\r\n")
                            headers = _headers(head)
                            length = int(headers.get("content-length", "0")) if headers.get("content-length", "0").isdigit() else 0
                            block = block[:length]
                            http = {}
                            if headers.get("content-type", "").startswith("application/http"):
                                answer, _, block = block.partition(b"\r\n\r\n")
                                http = _headers(answer)
                            rows.append((path, at, list(headers.items()), list(http.items()), block))
                            held += len(block)
                            if held > 4 << 20:
                                yield _batch(rows)
                                rows, held = [], 0
                        at = source.find(found[1] if found else at + 1, stop)
                    if rows:
                        yield _batch(rows)

    return ranges.repartition(min(many, 100_000), "path", "begin").mapInArrow(
        run, "path string, start long, headers map<string,string>, http map<string,string>, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "start", "headers", "http", "payload"])


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that ``write_warc`` wrote.

    Digest and size of a response are those of the bytes that were read; a revisit has those of its headers.
    """
    header = lambda name: F.col("headers")[name]
    ident = lambda c: F.regexp_extract(c, "<urn:page:(.*)>", 1).try_cast("long")
    kept = header("warc-type") == "response"
    return records.select(
        ident(header("warc-record-id")).alias("page_id"),
        F.when(kept, F.octet_length("payload")).otherwise(F.col("http")["content-length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(kept, F.sha2("payload", 256)).otherwise(F.regexp_replace(header("warc-payload-digest"), "^sha256:", "")).alias("payload_digest"),
        header("warc-type").alias("record_type"), ident(header("warc-refers-to")).alias("refers_to"))
