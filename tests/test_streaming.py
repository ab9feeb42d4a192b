"""Streaming jobs against their batch results."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from packsift.operators import reputation
from packsift.streaming import jobs


def make_zip(name):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr(name, "x")
    return buffer.getvalue()


def test_arrivals_are_audited_once(spark, tmp_path):
    inbox, store, state = tmp_path / "in", tmp_path / "store", tmp_path / "state"
    inbox.mkdir()
    audit = lambda blobs: blobs.select("ext_id", "package_sha256")
    same = make_zip("a")
    (inbox / "a.zip").write_bytes(same)
    (inbox / "copy.zip").write_bytes(same)
    jobs.audit_arrivals(spark, str(inbox), str(store), str(state), audit).awaitTermination()
    (inbox / "b.zip").write_bytes(make_zip("b"))
    (inbox / "again.zip").write_bytes(same)
    jobs.audit_arrivals(spark, str(inbox), str(store), str(state), audit).awaitTermination()
    rows = spark.read.parquet(str(store))
    assert rows.count() == 2 and rows.select("package_sha256").distinct().count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from packsift.plans.streams import run_request_limits

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i), 1, "click", 1.0, "{}") for i in range(3000)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    streamed = run_request_limits(spark, str(tmp_path))
    clock = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000))
    requests = spark.read.parquet(str(tmp_path / "events.parquet")).select(clock.alias("ts"), F.col("event_type").alias("client"))
    batch = jobs.over_limit(requests, "60 seconds", 20).withColumn("window_start", F.unix_seconds("window_start"))
    assert batch.count() > 0 and sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_first_answer_within_ttl(spark, tmp_path):
    rows = [("d", "p", 1, dt.datetime(2024, 1, 1)), ("d", "p", 2, dt.datetime(2024, 1, 1, 1)), ("d", "q", 3, dt.datetime(2024, 1, 1)),
            ("e", "p", 4, dt.datetime(2024, 1, 1))]
    schema = "domain string, provider string, n int, queried_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = jobs.first_answers(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.domain, r.provider) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("d", "p"), ("d", "q"), ("e", "p")} and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_rate_limit_boundary(spark):
    base = dt.datetime(2024, 1, 1)
    five, six = [(base, "five")] * 5, [(base, "six")] * 6
    df = spark.createDataFrame(five + six, "ts timestamp, client string")
    assert [r.client for r in jobs.over_limit(df, "10 seconds", 5).collect()] == ["six"]


def test_reputation_rules(spark):
    df = spark.createDataFrame([("a", 1, 0, 9, 0), ("b", 0, 2, 8, 0), ("c", 0, 3, 7, 0), ("d", 0, 0, 0, 0)],
                               "domain string, malicious int, suspicious int, harmless int, undetected int")
    got = {r.domain: (r.score, r.is_malicious) for r in reputation.engine_score(df).collect()}
    assert got == {"a": (0.1, True), "b": (0.2, False), "c": (0.3, True), "d": (0.0, False)}


def test_cache_and_retention(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    stamp = lambda text: F.lit(text).cast("timestamp")
    cache = spark.range(1).select(F.explode(F.array(F.struct(F.lit("x").alias("domain"), stamp("2024-06-02").alias("expires_at")),
                                                    F.struct(F.lit("y").alias("domain"), stamp("2024-05-01").alias("expires_at")))).alias("r")).select("r.*")
    hits, misses = reputation.lookup(spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "domain string"), cache, now)
    assert {r.domain for r in hits.collect()} == {"x"} and {r.domain for r in misses.collect()} == {"y", "z"}
    assert [r.domain for r in reputation.purge_cache(cache, now).collect()] == ["x"]
    jobs_ = spark.createDataFrame([(1, "h1", "r1"), (2, "h2", "r2")], "id int, sha256 string, report string").withColumn(
        "created_at", F.when(F.col("id") == 1, stamp("2023-05-31")).otherwise(stamp("2023-06-01")))
    assert {r.id: (r.sha256, r.report) for r in reputation.retire_reports(jobs_, now).collect()} == {1: ("h1", None), 2: ("h2", "r2")}
