"""SQL functions for users who query the tables with ``spark.sql``.

The bodies are SQL expressions, so calls are inlined and optimised like any other column.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog import domains as D


def _under(host: str, names: list[str]) -> str:
    return " OR ".join(f"{host} = '{n}' OR endswith({host}, '.{n}')" for n in names)


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_URL_HOST = r"lower(nullif(regexp_extract(url, r'^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''))"
FUNCTIONS = {
    "url_host": ("url STRING", "STRING", _URL_HOST),
    "registrable_domain": (
        "domain STRING", "STRING",
        rf"""CASE WHEN size(split(regexp_replace(lower(domain), r'^www\.', ''), r'\.')) <= 2 THEN regexp_replace(lower(domain), r'^www\.', '')
        WHEN substring_index(lower(domain), '.', -2) RLIKE r'{D.TWO_LABEL_SUFFIX}' THEN substring_index(regexp_replace(lower(domain), r'^www\.', ''), '.', -3)
        ELSE substring_index(lower(domain), '.', -2) END"""),
    "url_risk_class": (
        "url STRING", "STRING",
        rf"""CASE WHEN url_host(url) IS NULL THEN 'dynamic' WHEN url_host(url) IN ({_in(D.NAMESPACE_HOSTS)}) THEN 'trusted'
        WHEN {_under('url_host(url)', D.TRUSTED_HOSTS)} THEN 'trusted' WHEN {_under('url_host(url)', D.ANALYTICS_HOSTS)} THEN 'analytics'
        WHEN url_host(url) RLIKE r'^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$' THEN 'raw_ip'
        WHEN url_host(url) IN ('localhost', '127.0.0.1') OR endswith(url_host(url), '.local') THEN 'localhost'
        WHEN NOT startswith(lower(url), 'https:') THEN 'non_https' WHEN substring_index(url_host(url), '.', -1) IN ({_in(D.BAD_TLDS)}) THEN 'suspicious_tld'
        ELSE 'unknown' END"""),
    "package_path": (
        "folder STRING, target STRING", "STRING",
        r"""CASE WHEN startswith(target, '/') THEN regexp_replace(substring(target, 2), r'\?.*$', '') ELSE array_join(aggregate(
        filter(split(concat_ws('/', nullif(folder, ''), regexp_replace(target, r'\?.*$', '')), '/'), p -> p NOT IN ('', '.')), cast(array() as array<string>),
        (done, p) -> CASE WHEN p = '..' AND size(done) > 0 AND coalesce(try_element_at(done, -1), '..') <> '..' THEN slice(done, 1, size(done) - 1) ELSE concat(done, array(p)) END), '/') END"""),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
