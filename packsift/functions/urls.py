"""URL, host and domain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import domains as D
from .text import any_of, first_of

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute URL, null when there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, _HOST, 1), F.lit("")))


def scheme_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.lit("")))


def without_www(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def last_labels(domain: Column, n: int) -> Column:
    """Last n labels (all of them when there are fewer)."""
    return F.substring_index(domain, ".", -n)


def registrable_domain(domain: Column) -> Column:
    """Grouping domain: two labels, three under a two-label public suffix."""
    d = without_www(domain)
    return F.when(F.size(F.split(d, r"\.")) <= 2, d).when(
        last_labels(d, 2).rlike(D.TWO_LABEL_SUFFIX), last_labels(d, 3)
    ).otherwise(last_labels(d, 2))


def _under(host: Column, names: list[str]) -> Column:
    return any_of((host == n) | host.endswith("." + n) for n in names)


def _class_parts(url: Column, host: Column, scheme: Column) -> tuple[Column, Column]:
    """(category, reasons) of a URL with known host and scheme."""
    insecure = scheme != "https"
    raw_ip = host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
    local = host.isin("localhost", "127.0.0.1") | host.endswith(".local")
    tld = last_labels(host, 1)
    bad_tld = tld.isin(D.BAD_TLDS)
    namespace = host.isin(D.NAMESPACE_HOSTS)
    unparsed = host.isNull() | scheme.isNull()
    category = first_of([
        (url == "<dynamic>", "dynamic"), (unparsed, "dynamic"), (namespace, "trusted"),
        (_under(host, D.TRUSTED_HOSTS), "trusted"),
        (_under(host, D.ANALYTICS_HOSTS), "analytics"), (raw_ip, "raw_ip"),
        (local, "localhost"), (insecure, "non_https"), (bad_tld, "suspicious_tld"),
        (F.lit(True), "unknown"),
    ])
    reasons = F.when(url == "<dynamic>", F.array(F.lit("constructed at run time"))).when(
        unparsed, F.array(F.lit("cannot be parsed"))).when(
        namespace, F.array(F.lit("namespace, not an endpoint"))).otherwise(
        F.filter(
            F.array(
                F.when(insecure, F.lit("not https")), F.when(raw_ip, F.lit("raw IP address")),
                F.when(local, F.lit("local endpoint")),
                F.when(bad_tld, F.concat(F.lit("suspicious TLD ."), tld)),
            ),
            lambda r: r.isNotNull(),
        ))
    return category, reasons


def with_url_class(rows: DataFrame, url: str) -> DataFrame:
    """Add protocol, host, url_class and reasons of a URL column.

    Host and scheme are columns of their own first, so their patterns run once per URL
    however often the class refers to them.
    """
    split = rows.select("*", scheme_of(F.col(url)).alias("protocol"), host_of(F.col(url)).alias("host"))
    category, reasons = _class_parts(F.col(url), F.col("host"), F.col("protocol"))
    return split.select("*", category.alias("url_class"), reasons.alias("reasons"))


def url_points(category: Column) -> Column:
    """Risk points of a URL class."""
    return F.coalesce(*[F.when(category == name, F.lit(points))
                        for name, points in D.URL_POINTS.items()], F.lit(0))


def host_from_pattern(pattern: Column) -> Column:
    """Host of a match pattern, null when a wildcard remains."""
    cleaned = F.regexp_replace(pattern, r"^\*://", "https://")
    url = F.when(cleaned.contains("://"), cleaned).otherwise(F.concat(F.lit("https://"), cleaned))
    host = F.regexp_replace(host_of(url), r"^\*\.", "")
    return F.when(~host.contains("*") & ~host.rlike(r"[\s<>|^]"), F.nullif(host, F.lit("")))


def host_from_filter(pattern: Column) -> Column:
    """Host of a network-rule filter: match pattern, ``||host`` or a bare host."""
    anchored = F.nullif(F.regexp_extract(pattern, r"\|\|([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(pattern, r"([a-zA-Z0-9-]+\.[a-zA-Z0-9-](?:[a-zA-Z0-9.-]*[a-zA-Z0-9-])?)", 1), F.lit(""))
    return F.when(pattern != "", F.coalesce(host_from_pattern(pattern), F.lower(anchored), F.lower(bare)))


def host_from_literal(text: Column) -> Column:
    """Host of a string in code: any scheme or a bare host; XML namespaces dropped."""
    raw = F.trim(text)
    by_url = F.nullif(F.regexp_extract(raw, r"(?i)^[a-z][a-z0-9+.-]*://([a-zA-Z0-9][-a-zA-Z0-9.]*)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(
        raw, r"^([a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z0-9](?:[-a-zA-Z0-9.]*[-a-zA-Z0-9])?)(?:[/?#:]|$)", 1), F.lit(""))
    return F.when(by_url.isNotNull(),
                  F.when(~F.lower(by_url).isin(D.LITERAL_NAMESPACES), F.lower(by_url))
                  ).otherwise(F.lower(bare))


def entity(domain: Column) -> Column:
    """struct(entity, category): curated regional brand, else the registrable domain."""
    d = without_www(domain)
    return F.struct(
        F.coalesce(first_of((d.rlike(p), name) for p, name, _ in D.ENTITY_PATTERNS),
                   registrable_domain(d)).alias("entity"),
        F.coalesce(first_of((d.rlike(p), category) for p, _, category in D.ENTITY_PATTERNS),
                   F.lit("unknown")).alias("category"),
    )
