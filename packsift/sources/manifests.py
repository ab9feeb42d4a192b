"""Manifests, localised names and network-rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import permissions as M
from ..functions.text import line_at
from ..session import growing

# Fields whose shape differs between manifest versions stay text and are read on use.
MANIFEST_SCHEMA = """
manifest_version string, name string, version string, description string, author string,
default_locale string, permissions array<string>, optional_permissions array<string>,
host_permissions array<string>,
content_scripts array<struct<matches: array<string>, js: array<string>, css: array<string>, run_at: string>>,
background struct<service_worker: string, scripts: array<string>, js: array<string>>,
action struct<default_popup: string>, browser_action struct<default_popup: string>,
page_action struct<default_popup: string>, options_ui struct<page: string>,
options_page string, devtools_page string, side_panel struct<default_path: string>,
sandbox struct<pages: array<string>>, chrome_url_overrides map<string, string>,
web_accessible_resources string, externally_connectable string,
declarative_net_request struct<rule_resources: array<struct<path: string>>>
"""
RULE_SCHEMA = (
    "array<struct<id: int, action: struct<type: string, redirect: struct<url: string, extensionPath: string>>, "
    "condition: struct<urlFilter: string, regexFilter: string, resourceTypes: array<string>>>>"
)
EXPOSED_SCHEMA = "array<struct<resources: array<string>, matches: array<string>>>"


def _array(column: Column) -> Column:
    return F.coalesce(column, F.expr("cast(array() as array<string>)"))


def parse_manifests(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests, rejects) from (ext_id, text). A manifest that is not a JSON object is
    rejected; the job goes on with the other packages."""
    checked = texts.withColumn(
        "ok", F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False)))
    rejects = checked.filter(~F.col("ok")).select("ext_id", F.lit("manifest is not a JSON object").alias("reject"))
    m = checked.filter("ok").select("ext_id", "text", F.from_json("text", MANIFEST_SCHEMA).alias("m"))
    declared = _array(F.col("m.permissions"))
    is_host = lambda p: p.rlike(M.HOST_PATTERN)
    scripts = F.col("m.content_scripts")
    gather = lambda part: F.flatten(F.transform(
        F.coalesce(scripts, F.from_json(F.lit("[]"), "array<struct<matches: array<string>, js: array<string>, css: array<string>, run_at: string>>")),
        lambda s: _array(s[part])))
    version = F.when(F.trim("m.manifest_version") == "3", 3).otherwise(2)
    manifests = m.select(
        "ext_id", version.alias("version"),
        F.coalesce("m.name", F.lit("")).alias("name"), F.coalesce("m.version", F.lit("")).alias("ext_version"),
        F.col("m.description").alias("description"),
        F.when(F.col("m.author").startswith("{"), F.get_json_object("m.author", "$.name"))
        .otherwise(F.col("m.author")).alias("author"),
        F.col("m.default_locale").alias("default_locale"),
        F.filter(declared, lambda p: ~is_host(p)).alias("api_perms"),
        F.when(version == 3, F.concat(_array(F.col("m.host_permissions")), F.filter(declared, is_host)))
        .otherwise(F.filter(declared, is_host)).alias("host_perms"),
        _array(F.col("m.optional_permissions")).alias("optional_perms"),
        gather("matches").alias("matches"), gather("js").alias("content_js"), gather("css").alias("content_css"),
        F.coalesce(F.size(scripts), F.lit(0)).alias("n_content_scripts"),
        F.coalesce(F.exists(scripts, lambda s: s["run_at"].isin("document_start", "document_end")), F.lit(False)).alias("auto_run"),
        _array(F.coalesce("m.background.scripts", "m.background.js")).alias("background"),
        F.col("m.background.service_worker").alias("service_worker"),
        F.coalesce("m.action.default_popup", "m.browser_action.default_popup", "m.page_action.default_popup").alias("popup"),
        F.coalesce("m.options_ui.page", "m.options_page").alias("options"),
        F.col("m.devtools_page").alias("devtools"),
        F.col("m.side_panel.default_path").alias("side_panel"),
        _array(F.col("m.sandbox.pages")).alias("sandbox"),
        _array(F.map_values("m.chrome_url_overrides")).alias("overrides"),
        _array(F.filter(F.transform("m.declarative_net_request.rule_resources", lambda r: r["path"]),
                        lambda p: F.coalesce(p != "", F.lit(False)))).alias("rule_files"),
        F.col("m.web_accessible_resources").alias("exposed"),
        F.col("m.externally_connectable").alias("connectable"),
        F.col("text").alias("raw"),
    )
    return manifests, rejects


def locale_messages(texts: DataFrame) -> DataFrame:
    """(ext_id, locale, key, message) from the ``_locales/*/messages.json`` texts."""
    return (
        texts.withColumn("locale", F.regexp_extract("path", r"^_locales/([^/]+)/messages\.json$", 1))
        .filter(F.col("locale") != "")
        .select("ext_id", "locale", F.explode(
            F.from_json("text", "map<string, struct<message: string>>")).alias("key", "value"))
        .select("ext_id", "locale", "key", F.col("value.message").alias("message"))
        .filter(F.coalesce(F.col("message"), F.lit("")) != "")
    )


def resolve_names(manifests: DataFrame, messages: DataFrame) -> DataFrame:
    """Replace ``__MSG_key__`` names: English, then the default locale, then any locale,
    else the key with blanks."""
    key = F.regexp_replace(F.regexp_replace("name", "^__MSG_", ""), "__$", "")
    wanted = manifests.filter(F.col("name").startswith("__MSG_")).select(
        "ext_id", "default_locale", key.alias("key"))
    rank = F.when(F.col("locale") == "en", 1).when(F.col("locale") == F.col("default_locale"), 2).otherwise(3)
    found = (
        wanted.join(growing(messages), ["ext_id", "key"])
        .groupBy("ext_id").agg(F.min(F.struct(rank, F.col("locale"), F.col("message"))).alias("best"))
        .select("ext_id", F.col("best.message").alias("localised"))
    )
    return (
        manifests.join(growing(found), "ext_id", "left")
        .withColumn("name", F.when(F.col("name").startswith("__MSG_"),
                                   F.coalesce("localised", F.regexp_replace(key, "_", " ")))
                    .otherwise(F.col("name")))
        .drop("localised")
    )


def network_rules(manifests: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, unreadable rule files) of the rule files named in the manifests."""
    named = manifests.select("ext_id", "name", "author", F.explode("rule_files").alias("path"))
    read = named.join(growing(texts.select("ext_id", "path", "text")), ["ext_id", "path"], "left").withColumn(
        "shape", F.schema_of_variant(F.try_parse_json("text")))
    unreadable = read.filter(F.col("shape").isNull()).select("ext_id", "path")
    rules = (
        read.filter(F.col("shape").startswith("ARRAY"))
        .select("ext_id", "path", "name", "author", "text", F.explode(F.from_json("text", RULE_SCHEMA)).alias("r"))
        .select(
            "ext_id", "path", "name", "author", "text",
            F.col("r.id").alias("rule_id"), F.coalesce("r.action.type", F.lit("")).alias("action"),
            F.coalesce("r.action.redirect.url", "r.action.redirect.extensionPath", F.lit("")).alias("redirect"),
            F.coalesce("r.condition.urlFilter", "r.condition.regexFilter", F.lit("")).alias("url_filter"),
            F.coalesce(F.array_join("r.condition.resourceTypes", ","), F.lit("")).alias("resource_types"),
        )
    )
    return rules, unreadable


def line_of(text: Column, needle: Column) -> Column:
    """Number of the first line holding the needle, 1 when there is none."""
    at = F.instr(text, needle)
    return F.when((at > 0) & (needle != ""), line_at(text, at)).otherwise(F.lit(1))
