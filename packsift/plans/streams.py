"""Streaming queries run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import findings as K
from ..session import staged_path
from ..sources.archives import arriving, write_archives
from ..sources.commits import committed, write_once
from ..streaming.expiry import TIMELINE, rocks_state, timeline
from ..streaming.jobs import over_limit


def run_request_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Stream the event file through the 60-second limit into Parquet and read it back.

    The closing row is a far later request: it moves the watermark past the last window,
    so every window is final when the stream ends.
    """
    duration, limit = K.RATE_LIMITS[1]
    base = staged_path(spark)
    source, out = f"{base}/in", f"{base}/out"
    clock = F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000
    spark.read.parquet(f"{folder}/events.parquet").select(
        F.timestamp_seconds(F.floor(clock)).alias("ts"), F.col("event_type").alias("client")).write.parquet(f"{source}/part=0")
    spark.sql("select timestamp'2100-01-01' as ts, 'end' as client").write.parquet(f"{source}/part=1")
    stream = (
        spark.readStream.schema("ts timestamp, client string, part int").option("maxFilesPerTrigger", 1000)
        .parquet(source).drop("part")
    )
    query = (
        over_limit(stream, duration, limit, delay="365 days").writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination()
    schema = "window_start timestamp, client string, requests bigint"
    return spark.read.schema(schema).parquet(out).withColumn("window_start", F.unix_seconds("window_start"))


def run_reputation_timeline(spark: SparkSession, answers: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """Stream answers (domain, provider, queried_at) through the expiring cache and read what it says.

    The stream ends with its data: answers that would expire after the last watermark have not expired.
    """
    base = staged_path(spark)
    rows = answers.select("domain", "provider", "queried_at")
    rows.write.parquet(f"{base}/in")
    with rocks_state(spark):
        stream = timeline(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), ttl_seconds, delay)
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(
            availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(TIMELINE).parquet(f"{base}/out")


def run_arrivals(spark: SparkSession, waves: list[DataFrame], finish, stored: frozenset[str]) -> DataFrame:
    """Packages that arrive in waves, read by a stream into committed batches: rows of package, path, size, digest and reject."""
    base = staged_path(spark)
    schema = "name string, path string, n_bytes long, sha256 string, reject string"

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.select("name", "path", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "reject")
        write_once(rows, f"{base}/store", number)

    for files in waves:
        write_archives(files, f"{base}/inbox", finish, stored).write.format("noop").mode("overwrite").save()
        arriving(spark, f"{base}/inbox", f"{base}/log").writeStream.foreachBatch(keep).option(
            "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return committed(spark, f"{base}/store", schema)
