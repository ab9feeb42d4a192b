"""The findings table: union, defaults, context filter, confidence, dedupe, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import findings as K
from ..catalog import patterns as P
from ..functions.text import first_of

FILE = ["ext_id", "path"]
COLUMNS = ["ext_id", "stage", "path", "role", "kind", "detail", "line", "snippet", "severity",
           "category", "confidence", "impact"]
_TYPES = {"stage": "int", "line": "int", "confidence": "double", "impact": "double"}


def stream(rows: DataFrame, stage: int, kind: str | Column, detail: Column, **given: Column | str | float) -> DataFrame:
    """One finding stream in the common shape; missing columns are null and get defaults."""
    values = {"stage": F.lit(stage), "kind": F.lit(kind) if isinstance(kind, str) else kind, "detail": detail}
    for name in COLUMNS:
        if name in given:
            value = given[name]
            values[name] = value if isinstance(value, Column) else F.lit(value)
        elif name not in values:
            values[name] = F.col(name) if name in rows.columns else F.lit(None)
    return rows.select(*[values[n].cast(_TYPES.get(n, "string")).alias(n) for n in COLUMNS])


def union(streams: list[DataFrame]) -> DataFrame:
    result = streams[0]
    for part in streams[1:]:
        result = result.unionByName(part)
    return result


def _by_kind(index: int) -> Column:
    """Default of a kind: literal branches, so no join and no shuffle."""
    return F.coalesce(*[F.when(F.col("kind") == row[0], F.lit(row[index])) for row in K.KIND_ROWS
                        if row[index] is not None])


def default_severity() -> Column:
    risky = F.when(F.col("detail").contains("critical"), "critical").when(
        F.col("detail").contains("high"), "high").otherwise("medium")
    return F.when(F.col("kind") == "permission_risky", risky).otherwise(F.coalesce(_by_kind(1), F.lit("medium")))


def default_impact() -> Column:
    """First match wins: kind, words of the detail, stated weight, severity."""
    kind, detail = F.col("kind"), F.col("detail")
    weight = F.regexp_extract(detail, "weight=(10|5|2|1)", 1)
    return (
        F.when(kind.isin([r[0] for r in K.KIND_ROWS if r[4] is not None]), _by_kind(4))
        .when(detail.contains("<all_urls>"), 2.0).when(detail.contains("cookies"), 4.0)
        .when(detail.contains("history"), 3.0).when(weight != "", weight.cast("double"))
        .when(detail.contains("eval") | detail.contains("new Function"), 5.0)
        .when(kind == "obfuscated", 4.0).when(F.lower(detail).contains("password"), 8.0)
        .when(kind == "correlation", 8.0)
        .otherwise(F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in K.SEVERITY_IMPACT.items()], F.lit(1.0)))
    )


def enrich(findings: DataFrame) -> DataFrame:
    """Fill severity, category, confidence and impact, and add the order key."""
    keep = [c for c in findings.columns if c not in ("severity", "category", "confidence", "impact")]
    defaulted = findings.select(
        *keep, F.coalesce("severity", default_severity()).alias("severity"),
        F.coalesce("category", _by_kind(2)).alias("category"),
        F.coalesce("confidence", _by_kind(3)).alias("confidence"), "impact")
    order = F.concat_ws("|", F.lpad(F.col("stage").cast("string"), 2, "0"), "path",
                        F.lpad(F.col("line").cast("string"), 8, "0"), "kind", "detail")
    return defaulted.withColumns({"impact": F.coalesce("impact", default_impact()), "ord": order})


def sink_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Files with a network sink: by a finding or by the file's own flags."""
    by_finding = findings.filter(
        F.col("detail").rlike(P.SINK_DETAIL) | F.col("kind").isin("data_flow", "sensitive_navigation"))
    by_flag = files.filter(F.col("uses_fetch") | F.col("uses_xhr"))
    return by_finding.select(*FILE).unionByName(by_flag.select(*FILE)).distinct()


def contextual_filter(findings: DataFrame) -> DataFrame:
    """Drop noise of UI surfaces. Expects ``role`` of the file and ``has_sink``."""
    quiet_ui = (
        F.col("kind").isin("input_listener", "dom_injection", "storage_read")
        & F.col("role").isin(K.UI_ROLES) & ~F.col("has_sink"))
    housekeeping = (F.col("kind") == "permission_unused") & (F.col("severity") == "low")
    loose_bundle = (F.col("kind") == "minified") & (F.col("role") == "unknown")
    return findings.filter(~(quiet_ui | housekeeping | loose_bundle))


def context_confidence(findings: DataFrame) -> DataFrame:
    """Confidence by kind, role and sink; unnamed kinds keep theirs. Clamped to 0..1."""
    kind, role, sink, detail = F.col("kind"), F.col("role"), F.col("has_sink"), F.col("detail")
    branches = []
    for k, r, s, value in K.CONTEXT_CONFIDENCE:
        condition = kind == k
        if r != "*":
            condition = condition & (role == r)
        if s == "y":
            condition = condition & sink
        branches.append(F.when(condition, F.lit(value)))
    content = role == "content_script"
    risky = F.when(detail.rlike("eval|new Function"), F.when(content, 0.90).otherwise(0.75)).when(
        sink & content, 0.80).otherwise(0.55)
    permission = F.when(detail.contains("critical"), 0.45).when(detail.contains("high"), 0.30).otherwise(0.15)
    value = F.coalesce(*branches, F.when(kind == "risky_call", risky),
                       F.when(kind == "permission_risky", permission), F.col("confidence"))
    return findings.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def dedupe(findings: DataFrame) -> DataFrame:
    """First finding per (package, path, line, kind, detail): a min aggregate, which
    combines before the shuffle and never sorts one package's rows in one task."""
    key = ["ext_id", "path", "line", "kind", "detail"]
    rest = [c for c in findings.columns if c not in key and c != "ord"]
    return (
        findings.groupBy(*key).agg(F.min(F.struct(
            "ord", F.col("confidence") * -1, F.coalesce("severity", F.lit("")), *rest)).alias("first"))
        .select(*key, "first.ord", *[F.col("first")[c].alias(c) for c in rest])
    )


def verdicts(findings: DataFrame) -> DataFrame:
    """Confirmed or dismissed, with the reason."""
    confirmed = F.col("confidence") >= K.CONFIRM_AT
    reason = first_of((F.col("kind") == kind, technical) for kind, technical, _ in K.KIND_REASONS)
    return findings.withColumn("verdict", F.when(confirmed, "confirmed").otherwise("dismissed")).withColumn(
        "reason", reason)


def domain_verdicts(domain_findings: DataFrame) -> DataFrame:
    """Domain findings are always confirmed; the reason names class and origin."""
    origin = F.when(F.col("kind") == "host_permission", "declared in host permissions").otherwise("seen in code")
    return domain_findings.withColumn("verdict", F.lit("confirmed")).withColumn(
        "reason", F.when(F.col("category") == "unknown", F.concat(F.lit("unknown domain, "), origin))
        .otherwise(F.concat(F.lit("sensitive domain: "), F.col("category"))))


def reader_reason(kind: Column) -> Column:
    """Reason in the wording shown to readers."""
    return first_of((kind == k, text) for k, _, text in K.KIND_REASONS)


def translate_reason(reason: Column) -> Column:
    """Technical reason to reader wording; unknown sentences stay as they are."""
    return F.coalesce(*[F.when(reason.contains(technical), F.replace(reason, F.lit(technical), F.lit(text)))
                        for _, technical, text in K.KIND_REASONS], reason)


def normalise_detail(detail: Column) -> Column:
    """Detail without repeated reads and with plain words for common sources."""
    short = F.regexp_replace(detail, r"(\.value)(\.value)+", ".value")
    plain = F.replace(short, F.lit("sensitive API source chrome.storage.session.get.value"),
                      F.lit("data read from session storage"))
    return F.replace(plain, F.lit("DOM selection via document.querySelector"), F.lit("page data read by selector"))


