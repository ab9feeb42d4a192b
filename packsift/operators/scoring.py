"""Risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import findings as K
from ..functions.text import first_of
from ..functions.urls import url_points


def band(confidence: Column) -> Column:
    """Weight of a confidence: itself when high, half when fair, a fifth below."""
    return F.when(confidence >= K.BAND_FULL, confidence).when(confidence >= K.BAND_HALF, 0.5).otherwise(0.2)


def one_decimal(total: Column) -> Column:
    """Rounded half up to one decimal. The decimal step removes the noise of summing doubles
    in any order, so ties round the same way on every run."""
    return F.round(total.cast("decimal(20,6)"), 1).cast("double")


def level(score: Column, steps: list[tuple[int, str]]) -> Column:
    return first_of([*[(score >= limit, name) for limit, name in steps], (F.lit(True), "low")])


def weighted_impact(rows: DataFrame, key: str = "ext_id") -> DataFrame:
    """Sum of impact times band per key."""
    return rows.groupBy(key).agg(
        F.sum(F.coalesce("impact", F.lit(0.0)) * band(F.coalesce("confidence", F.lit(0.5)))).alias("weighted"))


def audit_score(packages: DataFrame, findings: DataFrame, urls: DataFrame, domains: DataFrame) -> DataFrame:
    """Score, level and parts per package.

    Three narrow aggregates joined on the package key: findings, URL classes, and domains
    (capped together).
    """
    domain_part = domains.groupBy("ext_id").agg(
        F.least(F.lit(K.DOMAIN_CAP), F.sum(F.when(F.col("category") == "unknown", 1).otherwise(2))).alias("domain_points"))
    url_part = urls.groupBy("ext_id").agg(F.sum(url_points(F.col("url_class"))).alias("url_points"))
    scored = (
        packages.join(weighted_impact(findings), "ext_id", "left").join(url_part, "ext_id", "left")
        .join(domain_part, "ext_id", "left").fillna(0, ["weighted", "url_points", "domain_points"])
    )
    total = one_decimal(F.col("weighted") + F.col("url_points") + F.col("domain_points"))
    return scored.withColumn("score", total).withColumn("level", level(F.col("score"), K.AUDIT_LEVELS))


def top_reasons(findings: DataFrame, limit: int = K.REASON_LIMIT) -> DataFrame:
    """First distinct reasons per package, for impacts of weight and fair confidence."""
    strong = (
        findings.filter((F.col("impact") >= 5) & (F.col("confidence") >= K.CONFIRM_AT))
        .groupBy("ext_id", F.concat_ws(": ", "kind", "detail").alias("reason")).agg(F.min("ord").alias("ord"))
    )
    return top_rows(strong, ["ext_id"], [F.col("ord")], limit)


_SALTS = 64


def top_rows(rows: DataFrame, key: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First rows per key.

    The limit is first taken within salted parts of each key, so no task sorts more than one
    part of a hot key, whatever the limit; then within the key.
    """
    def first(source: DataFrame, by: list[str], name: str) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return source.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)

    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS)))
    return first(first(salted, [*key, "salt"], "part_rank").drop("salt", "part_rank"), key, rank)


def report_score(packages: DataFrame, verdicted: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Impact of confirmed findings; null when zero; a reviewer's level overrides."""
    confirmed = verdicted.filter(F.col("verdict") == "confirmed").groupBy("ext_id").agg(F.sum("impact").alias("total"))
    scored = packages.join(confirmed, "ext_id", "left").withColumn(
        "report_score", F.when(F.col("total") > 0, F.col("total")))
    own = F.when(F.col("report_score").isNotNull(), level(F.col("report_score"), K.REPORT_LEVELS))
    if reviews is None:
        return scored.withColumn("report_level", own).drop("total")
    return (
        scored.join(reviews.select("ext_id", "review_level"), "ext_id", "left")
        .withColumn("report_level", F.when(F.col("report_score").isNotNull(), F.coalesce("review_level", own)))
        .drop("total", "review_level")
    )
