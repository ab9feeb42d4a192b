"""Domain reputation: provider scores, cache lookup and query caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import findings as K


def engine_score(counters: DataFrame) -> DataFrame:
    """Share of engines that flag a domain; malicious from one hit or three suspicions."""
    flagged = F.col("malicious") + F.col("suspicious")
    total = flagged + F.col("harmless") + F.col("undetected")
    return counters.withColumn("score", F.when(total > 0, flagged / total).otherwise(0.0)).withColumn(
        "is_malicious", (F.col("malicious") > 0) | (F.col("suspicious") > 2))


def scan_score(scans: DataFrame) -> DataFrame:
    """Share of malicious scans per domain."""
    return scans.groupBy("domain").agg(
        F.count("*").alias("total_scans"), F.count_if("scan_malicious").alias("malicious_scans")
    ).withColumn("score", F.col("malicious_scans") / F.col("total_scans")).withColumn(
        "is_malicious", F.col("malicious_scans") > 0)


def abuse_score(confidence: Column) -> Column:
    return confidence / 100


def best_per_domain(results: DataFrame) -> DataFrame:
    """Highest score per domain over providers."""
    return results.groupBy("domain").agg(
        F.max(F.struct("score", "provider")).alias("top"), F.bool_or("is_malicious").alias("is_malicious"),
    ).select("domain", "top.score", "top.provider", "is_malicious")


def expiry(queried_at: Column, ttl_seconds: int = K.CACHE_TTL_SECONDS) -> Column:
    return queried_at + F.make_dt_interval(secs=F.lit(ttl_seconds))


def lookup(wanted: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(answers from unexpired cache rows, domains to query). Domains are made distinct
    first, so a domain wanted by many packages is looked up once."""
    distinct = wanted.select("domain").distinct()
    live = cache.filter(F.col("expires_at") > now)
    return distinct.join(live, "domain"), distinct.join(live, "domain", "left_anti")


def capped(misses: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Domains to query per job within the global and the provider cap."""
    window = Window.partitionBy(key).orderBy(*order)
    return misses.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= K.LOOKUP_CAP).withColumn(
        "for_provider", F.col("rank") <= K.PROVIDER_CAP)


def retire_reports(jobs: DataFrame, now: Column, months: int = K.RETENTION_MONTHS) -> DataFrame:
    """Jobs with reports older than the retention period emptied; the hash stays."""
    cutoff = F.add_months(now, -months)
    return jobs.withColumn("report", F.when(F.col("created_at") >= cutoff, F.col("report")))


def purge_cache(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") >= now)
