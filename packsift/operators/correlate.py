"""Correlation rules: one flag row per package, rules as conditions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import domains as D
from ..catalog import findings as K
from ..catalog import patterns as P
from ..catalog import permissions as M
from ..catalog import signals as S
from ..functions.text import test
from ..session import growing

FILE = ["ext_id", "path"]


def manifest_flags(manifests: DataFrame) -> DataFrame:
    """Permission and surface flags per package."""
    every = F.concat("api_perms", "host_perms", "optional_perms")
    all_sites = F.exists(F.concat("host_perms", "matches"), lambda p: p.isin(M.EVERY_SITE))
    no_ui = (
        F.col("popup").isNull() & F.col("options").isNull() & (F.size("sandbox") == 0)
        & (F.size("overrides") == 0) & (F.col("n_content_scripts") > 0))
    return manifests.select(
        "ext_id", all_sites.alias("all_sites"), no_ui.alias("no_ui"),
        *[F.array_contains(every, p).alias(f"p_{p}") for p in K.CORRELATION_PERMISSIONS])


def _tests() -> dict[str, Column]:
    """Finding predicates the rules are built from."""
    kind, role, detail = F.col("kind"), F.col("role"), F.col("detail")
    return {
        "sink": detail.rlike(P.SINK_DETAIL),
        "dynamic_code": detail.rlike(P.EVAL_DETAIL),
        "secret": detail.rlike(P.PASSWORD_DETAIL),
        "cookie": kind == "cookie_read",
        "storage": kind == "storage_read",
        "listener": (kind == "input_listener") & role.isin("content_script", "background"),
        "page_injection": (kind == "dom_injection") & (role == "content_script"),
        "flow": kind == "data_flow",
        "message_flow": (kind == "data_flow") & detail.rlike(P.MESSAGE_DETAIL),
        "background_sink": (role == "background") & detail.rlike(P.SINK_DETAIL),
        "hidden_content": (kind == "obfuscated") & (role == "content_script"),
        "any_secret": detail.rlike(P.SECRET_DETAIL),
        "hook": kind == "api_hook",
        "spoof": kind == "api_spoof",
        "script_injection": (kind == "dom_injection") & detail.rlike(P.SCRIPT_INJECTION_DETAIL),
    }


# First finding of these predicates gives the place a correlation reports.
_PLACES = ["dynamic_code", "storage", "page_injection", "flow", "message_flow", "any_secret", "hook", "spoof",
           "script_injection"]
# Same-file pairs with a sink: flag name -> predicate.
_WITH_SINK = {"cookie_with_sink": "cookie", "listener_with_sink": "listener", "secret_with_sink": "secret",
              "obfuscated_with_sink": "hidden_content"}


def _place(condition: Column) -> Column:
    return F.min(F.when(condition, F.struct("ord", "path", "line", "role")))


def code_flags(findings: DataFrame) -> DataFrame:
    """Code flags per package, in two aggregations.

    First per file, where same-file co-occurrence is decided, then per package. Both
    combine before their shuffle, so a package with a third of all findings arrives as one
    row per task and file; findings are never joined with each other.
    """
    tests = _tests()
    by_file = findings.groupBy(*FILE).agg(
        *[F.bool_or(t).alias(f"has_{n}") for n, t in tests.items()],
        F.bool_or(tests["sink"] & ~test(F.col("path"), "(?i)polyfill")).alias("has_real_sink"),
        F.count_if(tests["any_secret"]).alias("n_secrets"),
        F.count_if(tests["script_injection"]).alias("n_script_injections"),
        *[_place(tests[n]).alias(f"at_{n}") for n in [*_PLACES, "cookie", "listener", "secret", "hidden_content"]])
    pairs = [F.min(F.when(F.col("has_sink"), F.col(f"at_{n}"))).alias(f"at_{flag}") for flag, n in _WITH_SINK.items()]
    flags = by_file.groupBy("ext_id").agg(
        *[F.bool_or(f"has_{n}").alias(n) for n in tests if n not in ("sink",)],
        F.bool_or("has_real_sink").alias("sink"), F.bool_or("has_sink").alias("sink_file"),
        F.sum("n_secrets").alias("n_secrets"), F.sum("n_script_injections").alias("n_script_injections"),
        *[F.min(f"at_{n}").alias(f"at_{n}") for n in _PLACES], *pairs)
    for flag in _WITH_SINK:
        flags = flags.withColumn(flag, F.col(f"at_{flag}").isNotNull())
    return flags.withColumn("secret_in_popup", F.coalesce(F.col("at_secret_with_sink.role") == "popup", F.lit(False)))


def url_flags(urls: DataFrame) -> DataFrame:
    """External and suspicious URL flags per package; expects the URL class."""
    return urls.groupBy("ext_id").agg(
        F.bool_or(F.col("url_class").isin(D.EXTERNAL_CLASSES)).alias("external_url"),
        F.bool_or(F.col("url_class").isin(D.SUSPICIOUS_CLASSES)).alias("suspicious_url"),
        F.bool_or(F.col("url_class").isin("raw_ip", "suspicious_tld")).alias("ip_or_tld_url"))


def platform_counts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct social platforms traced in the files that hook network functions."""
    hooked = findings.filter(F.col("kind") == "api_hook").select(*FILE).distinct()
    return (
        files.select(*FILE, "platform_bits").join(hooked, FILE, "left_semi").groupBy("ext_id")
        .agg(F.bit_count(F.bit_or("platform_bits")).alias("n_platforms"))
    )


def package_flags(manifests: DataFrame, findings: DataFrame, files: DataFrame, urls: DataFrame,
                  remote: DataFrame) -> DataFrame:
    """The wide flag row of every package; absent parts are false or zero."""
    obfuscation = files.groupBy("ext_id").agg(F.bool_or("is_obfuscated").alias("obfuscation"))
    remote_flag = remote.select("ext_id").distinct().withColumn("remote_script", F.lit(True))
    flags = manifest_flags(manifests)
    for part in (code_flags(findings), url_flags(urls), platform_counts(findings, files), obfuscation, remote_flag):
        flags = flags.join(growing(part), "ext_id", "left")
    fill = {f.name: False for f in flags.schema if f.dataType.typeName() == "boolean"}
    fill |= {f.name: 0 for f in flags.schema if f.dataType.typeName() in ("integer", "long")}
    return flags.fillna(fill)


def correlations(flags: DataFrame) -> DataFrame:
    """One row per package and satisfied rule.

    All rules are tested in one pass over the flag row: an array of the rules that hold,
    exploded.
    """
    def rule(name: str, condition: str, severity: str, confidence: float, detail: str, place: str | None) -> Column:
        at = F.col(f"at_{place}") if place else None
        return F.when(F.expr(condition), F.struct(
            F.lit(name).alias("rule"), F.lit(detail).alias("detail"), F.lit(severity).alias("severity"),
            F.lit(confidence).alias("confidence"),
            (F.coalesce(at["path"], F.lit("manifest.json")) if place else F.lit("manifest.json")).alias("path"),
            (F.coalesce(at["line"], F.lit(1)) if place else F.lit(1)).alias("line")))

    held = F.filter(F.array(*[rule(*r) for r in K.CORRELATION_RULES]), lambda r: r.isNotNull())
    return flags.select("ext_id", F.explode(held).alias("r")).select("ext_id", "r.*")
