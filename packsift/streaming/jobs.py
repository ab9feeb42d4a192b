"""Structured Streaming jobs: arrivals, request rates, expiring reputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import findings as K
from ..sources.packages import PACKAGE_GLOB, distinct_packages, with_package_key


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of package blobs appearing in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", PACKAGE_GLOB).load(folder)
    return with_package_key(files)


def audit_arrivals(spark: SparkSession, folder: str, store: str, checkpoint: str,
                   audit: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Audit each new package once. Results are keyed by content hash and written per
    batch id, so a replayed batch overwrites its own output and a known hash is skipped.
    Copies are told apart by hash and path alone; no blob enters an aggregate."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = distinct_packages(batch)
        if _exists(spark, store):
            known = spark.read.parquet(store).filter(F.col("batch") != batch_id).select("package_sha256").distinct()
            fresh = fresh.join(known, "package_sha256", "left_anti")
        audit(fresh).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return (
        arrivals(spark, folder).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def over_limit(requests: DataFrame, duration: str, limit: int, client: str = "client", delay: str = "10 minutes") -> DataFrame:
    """Windows in which a client exceeds its request limit. Works on streams and tables;
    events later than the delay are dropped by the watermark."""
    source = requests.withWatermark("ts", delay) if requests.isStreaming else requests
    return (
        source.groupBy(F.window("ts", duration), F.col(client)).agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select(F.col("window.start").alias("window_start"), client, "requests")
    )


def rate_limits(requests: DataFrame, client: str = "client") -> list[DataFrame]:
    return [over_limit(requests, duration, limit, client) for duration, limit in K.RATE_LIMITS]


def first_answers(results: DataFrame, ttl: str = "86400 seconds") -> DataFrame:
    """First reputation answer per (domain, provider) within the time to live."""
    return results.withWatermark("queried_at", ttl).dropDuplicatesWithinWatermark(["domain", "provider"])
