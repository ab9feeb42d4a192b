"""Declared permissions: risk, use, and manifest structures open to abuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import domains as D
from ..catalog import permissions as M
from ..functions.urls import host_from_filter, host_from_pattern
from ..session import growing
from ..sources.manifests import EXPOSED_SCHEMA, line_of
from .domains import classify


def catalogue(spark) -> DataFrame:
    """The permission catalogue: 70 fixed rows."""
    return spark.createDataFrame(
        M.PERMISSION_ROWS, "permission string, known_category string, known_weight int, known_sensitive boolean")


def declared(manifests: DataFrame) -> DataFrame:
    """One row per declared permission with its manifest key and line. Lines are found where the text is, so no row carries it."""
    def tagged(column: str, source: str) -> Column:
        return F.transform(column, lambda p: F.struct(p.alias("permission"), F.lit(source).alias("source"), line_of(F.col("raw"), p).alias("line")))

    every = F.concat(tagged("api_perms", "permissions"), tagged("optional_perms", "optional_permissions"),
                     tagged("host_perms", "host_permissions"))
    return manifests.select("ext_id", F.explode(every).alias("p")).select("ext_id", "p.*")


def permission_risk(permissions: DataFrame) -> DataFrame:
    """Category, weight and host sensitivity of each permission row."""
    p = F.col("permission")
    every_site, any_host = p.isin(M.EVERY_SITE), p.rlike(M.SCHEME_PATTERN)
    return (
        permissions.join(F.broadcast(catalogue(permissions.sparkSession)), "permission", "left")
        .withColumn("category", F.when(every_site, "critical").when(any_host, "medium")
                    .otherwise(F.coalesce("known_category", F.lit("medium"))))
        .withColumn("weight", F.when(every_site, 10).when(any_host, 2).otherwise(F.coalesce("known_weight", F.lit(2))))
        .withColumn("host_sensitive", F.when(every_site | any_host, True)
                    .otherwise(F.coalesce("known_sensitive", F.lit(False))))
        .drop("known_category", "known_weight", "known_sensitive")
    )


def used_permissions(api_refs: DataFrame) -> DataFrame:
    """Permission roots exercised in code."""
    return api_refs.select("ext_id", F.col("root").alias("permission")).distinct()


def permission_use(manifests: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declared and used, declared and unused) API permissions."""
    placed = F.transform("api_perms", lambda p: F.struct(p.alias("permission"), line_of(F.col("raw"), p).alias("line")))
    wanted = manifests.select("ext_id", F.explode(F.array_distinct(placed)).alias("p")).select("ext_id", "p.permission", "p.line")
    return (wanted.join(used, ["ext_id", "permission"], "left_semi"),
            wanted.join(used, ["ext_id", "permission"], "left_anti"))


def describe_unused(unused: DataFrame, risk: DataFrame) -> DataFrame:
    """Category and sentence of each unused permission."""
    texts = unused.sparkSession.createDataFrame(
        M.DESCRIPTION_ROWS, "permission string, text_category string, sentence string")
    own = risk.groupBy("ext_id", "permission").agg(F.min("category").alias("own_category"))
    return (
        unused.join(own, ["ext_id", "permission"], "left").join(F.broadcast(texts), "permission", "left")
        .select("ext_id", "permission",
                F.coalesce("own_category", "text_category", F.lit("medium")).alias("category"),
                F.coalesce("sentence", F.concat(F.lit("Permission "), "permission",
                                                F.lit(" is declared but was not seen in code."))).alias("description"))
    )


def broad_hosts(manifests: DataFrame) -> DataFrame:
    """Host patterns that reach every site, by where they are declared."""
    rows = manifests.select("ext_id", F.explode(F.concat(
        F.transform("host_perms", lambda p: F.struct(p.alias("pattern"), F.lit("host_permissions").alias("source"))),
        F.transform("matches", lambda p: F.struct(p.alias("pattern"), F.lit("content_scripts").alias("source"))),
    )).alias("h")).select("ext_id", "h.*")
    return rows.filter(F.col("pattern").isin(M.BROAD_HOSTS))


# --- fixed values: manifest structure tests -----------------------------------------------
_BROAD_ORIGIN = r"<all_urls>|\*://\*|\*\.|https?://\*"
_BROAD_MATCH = r"<all_urls>|\*://\*"
_EXECUTABLE = r"(?i)\.(js|mjs|html?)$"
_EXTERNAL_HANDLER = r"chrome\.runtime\.onMessageExternal\.addListener"
_PAGE_RESOURCES = r"main_frame|sub_frame|xmlhttprequest|script"
_BROAD_FILTER = r"\*://\*/\*|<all_urls>|\|\|"


def external_connections(manifests: DataFrame, lines: DataFrame) -> DataFrame:
    """Packages that accept messages from broad origins or register an external handler."""
    handlers = lines.filter(F.col("text").rlike(_EXTERNAL_HANDLER)).select("ext_id").distinct().withColumn(
        "handler", F.lit(True))
    matches = F.coalesce(F.from_json("connectable", "matches array<string>")["matches"],
                         F.expr("cast(array() as array<string>)"))
    return (
        manifests.filter(F.col("connectable").isNotNull())
        .select("ext_id", "raw", matches.alias("origins"))
        .join(handlers, "ext_id", "left")
        .withColumn("handler", F.coalesce("handler", F.lit(False)))
        .withColumn("broad", F.exists("origins", lambda m: m.rlike(_BROAD_ORIGIN)))
        .filter(F.col("broad") | F.col("handler"))
        .select(
            "ext_id", F.lit("manifest.json").alias("path"),
            F.concat(F.lit("externally_connectable accepts "),
                     F.when(F.size("origins") > 0, F.array_join("origins", ", ")).otherwise("external origins"),
                     F.when(F.col("handler"), F.lit(" and code registers onMessageExternal")).otherwise("")).alias("detail"),
            line_of(F.col("raw"), F.lit("externally_connectable")).alias("line"),
            F.when(F.col("broad"), "high").otherwise("medium").alias("severity"),
            F.when(F.col("broad") & F.col("handler"), 0.86).otherwise(0.7).alias("confidence"))
    )


def exposed_executables(manifests: DataFrame) -> DataFrame:
    """Executable resources exposed to broad page matches."""
    empty = F.expr("cast(array() as array<string>)")
    return (
        manifests.filter(F.col("exposed").contains("{"))
        .select("ext_id", "raw", F.explode(F.from_json("exposed", EXPOSED_SCHEMA)).alias("e"))
        .select("ext_id", "raw", F.coalesce("e.resources", empty).alias("resources"),
                F.coalesce("e.matches", empty).alias("matches"))
        .filter(F.exists("resources", lambda r: r.rlike(_EXECUTABLE))
                & F.exists("matches", lambda m: m.rlike(_BROAD_MATCH)))
        .select(
            "ext_id", F.lit("manifest.json").alias("path"),
            F.concat(F.lit("web_accessible_resources exposes executable resources ("), F.array_join("resources", ", "),
                     F.lit(") to broad page matches ("), F.array_join("matches", ", "), F.lit(")")).alias("detail"),
            line_of(F.col("raw"), F.element_at("resources", 1)).alias("line"),
            F.lit("high").alias("severity"), F.lit(0.78).alias("confidence"))
    )


def network_rule_findings(rules: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Redirects to unknown or sensitive hosts, and broad header or redirect rules."""
    hosts = (
        rules.withColumn("redirect_host", host_from_pattern(F.col("redirect")))
        .withColumn("source_host", host_from_filter(F.col("url_filter")))
    )
    wanted = (
        hosts.select("ext_id", "name", "author", F.explode(F.array_compact(F.array("redirect_host", "source_host"))).alias("domain"))
        .distinct()
    )
    classes = growing(classify(wanted).select("ext_id", "domain", "category"))
    known = (
        hosts.join(classes.toDF("ext_id", "redirect_host", "redirect_class"), ["ext_id", "redirect_host"], "left")
        .join(classes.toDF("ext_id", "source_host", "source_class"), ["ext_id", "source_host"], "left")
        .withColumn("line", line_of(F.col("text"), F.when(F.col("redirect") != "", F.col("redirect")).otherwise(F.col("url_filter"))))
        .withColumn("from_sensitive", F.coalesce(F.col("source_class").isin(D.SENSITIVE), F.lit(False)))
    )
    redirects = known.filter(
        (F.col("action") == "redirect") & F.col("redirect_host").isNotNull()
        & (F.col("redirect_class").isin("unknown", *D.SENSITIVE) | F.col("from_sensitive"))
    ).select(
        "ext_id", "path",
        F.concat(F.lit("declarativeNetRequest redirects "),
                 F.when(F.col("url_filter") != "", F.col("url_filter")).otherwise("matched traffic"),
                 F.lit(" to "), "redirect_host", F.lit(" ("), "redirect_class", F.lit(")")).alias("detail"),
        "line", F.when(F.col("from_sensitive"), "critical").otherwise("high").alias("severity"),
        F.when(F.col("from_sensitive"), 0.93).otherwise(0.84).alias("confidence"),
        F.lit("correlation").alias("kind"))
    broad = known.filter(
        F.col("action").isin("modifyHeaders", "redirect") & F.col("resource_types").rlike(_PAGE_RESOURCES)
        & F.col("url_filter").rlike(_BROAD_FILTER)
    ).select(
        "ext_id", "path",
        F.concat(F.lit("broad declarativeNetRequest "), "action", F.lit(" rule applies to "), "resource_types").alias("detail"),
        "line", F.lit("high").alias("severity"), F.lit(0.78).alias("confidence"), F.lit("correlation").alias("kind"))
    broken = unreadable.select(
        "ext_id", "path", F.concat(F.lit("declarativeNetRequest rule file could not be parsed: "), "path").alias("detail"),
        F.lit(1).alias("line"), F.lit("medium").alias("severity"), F.lit(0.72).alias("confidence"),
        F.lit("unresolved_dependency").alias("kind"))
    return redirects.unionByName(broad).unionByName(broken)
