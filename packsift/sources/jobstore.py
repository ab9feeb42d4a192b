"""Job table with upserts and point reads: hash buckets, copied on write.

A job lives in the bucket of its id. An upsert rewrites the buckets that it touches and no others; a commit names the folder of every
bucket, so readers see the state before or after an upsert. A point read scans one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog

SCHEMA = "job_id long, status string, created_at timestamp, updated_at timestamp, event_id long, n_events long"


class JobStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.buckets, self.log = spark, buckets, CommitLog(spark, folder)

    def _bucket(self, job_id: Column) -> Column:
        return F.pmod(F.xxhash64(job_id.cast("long")), F.lit(self.buckets)).cast("int")

    def _state(self) -> tuple[int, dict[str, str]]:
        numbers = self.log.numbers()
        return (numbers[-1], self.log.read(numbers[-1])) if numbers else (0, {})

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.log.folder}/{f}" for f in folders])

    def upsert(self, changes: DataFrame) -> list[int]:
        """Apply status events (job_id, status, updated_at, event_id); the buckets that were rewritten."""
        changes = changes.withColumn("bucket", self._bucket(F.col("job_id")))
        touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most one row a bucket
        if not touched:
            return []
        while True:
            number, state = self._state()
            before = self._read([state[str(b)] for b in touched if str(b) in state]).withColumn("bucket", self._bucket(F.col("job_id")))
            rows = changes.select("bucket", "job_id", "status", F.col("updated_at").alias("created_at"), "updated_at", "event_id", F.lit(1).cast("long").alias("n_events"))
            merged = rows.unionByName(before).groupBy("bucket", "job_id").agg(
                F.max(F.struct("updated_at", "event_id", "status")).alias("last"), F.min("created_at").alias("created_at"), F.sum("n_events").alias("n_events"))
            merged = merged.select("bucket", "job_id", "last.status", "created_at", "last.updated_at", "last.event_id", "n_events")
            path = self.log.fresh()
            merged.repartition("bucket").write.partitionBy("bucket").parquet(path)
            inside = path[len(self.log.folder) + 1:]
            if self.log.commit(number + 1, state | {str(b): f"{inside}/bucket={b}" for b in touched}):
                return sorted(touched)
            # another writer was first: merge with what it wrote

    def jobs(self) -> DataFrame:
        """The current row of every job."""
        return self._read(sorted(self._state()[1].values()))

    def job(self, job_id: int) -> DataFrame:
        """The row of one job, from its bucket alone."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(job_id))).collect()[0][0]
        folder = self._state()[1].get(str(bucket))
        return self._read([folder] if folder else []).filter(F.col("job_id") == job_id)
