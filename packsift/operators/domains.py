"""Domain classification and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import domains as D
from ..functions.text import any_of, first_of
from ..functions.urls import entity, host_from_pattern, last_labels, without_www
from ..session import growing


def catalogue(spark) -> DataFrame:
    """The domain catalogue: a fixed table of under 200 rows."""
    return spark.createDataFrame(
        D.DOMAIN_ROWS, "known string, category string, platform string, rank int")


def _norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def is_own_domain(domain: Column, name: Column, author: Column) -> Column:
    """Whether the main label of the domain resembles the package name, a longer word of
    it, or the first word of the author. A name without three Latin letters or digits
    resembles nothing."""
    labels = F.split(domain, r"\.")
    base = _norm(F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, 1)))
    whole = _norm(F.coalesce(name, F.lit("")))
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), _norm),
                     lambda w: F.length(w) > 3)
    maker = _norm(F.element_at(F.split(F.coalesce(author, F.lit("")), r"\s+"), 1))
    alike = lambda a, b: F.contains(a, b) | F.contains(b, a)
    return (F.length(base) >= 3) & (
        ((F.length(whole) >= 3) & alike(whole, base)) | F.exists(words, lambda w: alike(w, base))
        | ((F.length(maker) > 3) & alike(maker, base)))


def classify(rows: DataFrame) -> DataFrame:
    """Add category, platform and visit priority for (domain, name, author).

    The catalogue is joined once on the host and once on the host without ``www.``; both
    sides are broadcast, as its size is fixed by the code. Catalogue rank decides between
    them, the order of the branches below between the heuristics.
    """
    known = catalogue(rows.sparkSession)
    by_host = F.broadcast(known.toDF("h_known", "h_category", "h_platform", "h_rank"))
    by_bare = F.broadcast(known.toDF("b_known", "b_category", "b_platform", "b_rank"))
    host, bare = F.lower("domain"), without_www(F.col("domain"))
    joined = (
        rows.join(by_host, host == F.col("h_known"), "left")
        .join(by_bare, bare == F.col("b_known"), "left")
    )
    use_host = F.coalesce("h_rank", F.lit(99)) <= F.coalesce("b_rank", F.lit(99))
    category = F.when(use_host, F.col("h_category")).otherwise(F.col("b_category"))
    platform = F.when(use_host, F.col("h_platform")).otherwise(F.col("b_platform"))
    infra = (category == "infrastructure") | any_of(host.endswith(s) for s in D.HOSTED_SUFFIXES)
    own = is_own_domain(bare, F.col("name"), F.col("author"))
    proxy = bare.isin(D.RESIDENTIAL_PROXIES) | last_labels(bare, 2).isin(D.RESIDENTIAL_PROXIES)
    brand = entity(F.col("domain"))
    result = first_of([
        (infra, "infrastructure"), (own, "own"), (category.isNotNull(), category),
        (bare.rlike(D.GOV_PATTERN), "government"), (proxy, "data_broker"),
        (F.lit(True), brand["category"]),
    ])
    listed = category.isNotNull() | bare.rlike(D.GOV_PATTERN) | proxy
    return joined.select(
        *rows.columns, result.alias("category"),
        F.when(F.coalesce(infra, F.lit(False)) | own, F.lit(None)).when(listed, platform)
        .otherwise(brand["entity"]).alias("platform"),
    ).withColumn("priority", visit_priority(F.col("category")))


def visit_priority(category: Column) -> Column:
    return F.coalesce(*[F.when(category == c, F.lit(p)) for c, p in D.VISIT_PRIORITY.items()])


def is_sensitive(category: Column) -> Column:
    return category.isin(D.SENSITIVE)


def classify_distinct(rows: DataFrame) -> DataFrame:
    """Classify each distinct (package, domain) once and join back."""
    distinct = rows.select("ext_id", "domain", "name", "author").distinct()
    return rows.drop("name", "author").join(
        growing(classify(distinct).drop("name", "author")), ["ext_id", "domain"])


def entity_summary(domain_findings: DataFrame, navigations: DataFrame, manifests: DataFrame) -> DataFrame:
    """Per package and entity: category, distinct hosts and the ways the entity is used."""
    way = F.when(F.col("kind") == "host_permission", "host_permissions").otherwise("url_in_code")
    from_findings = domain_findings.select("ext_id", "domain", way.alias("method"))
    nav_host = F.lower(F.regexp_extract("detail", r"(?i)https?://([a-zA-Z0-9][-a-zA-Z0-9.]+)", 1))
    from_nav = navigations.select("ext_id", nav_host.alias("domain"), F.lit("dom_href").alias("method")).filter(
        F.col("domain") != "")
    from_matches = manifests.select("ext_id", F.explode("matches").alias("m")).select(
        "ext_id", host_from_pattern(F.col("m")).alias("domain"), F.lit("content_scripts").alias("method")
    ).filter(F.col("domain").isNotNull())
    brand = entity(F.col("domain"))
    return (
        from_findings.unionByName(from_nav).unionByName(from_matches)
        .select("ext_id", "domain", "method", brand["entity"].alias("entity"), brand["category"].alias("category"))
        .groupBy("ext_id", "entity", "category")
        .agg(F.countDistinct("domain").alias("n_hosts"),
             F.array_sort(F.collect_set("method")).alias("methods"))
    )


def dedupe_domains(findings: DataFrame) -> DataFrame:
    """First finding per (package, domain, kind, category).

    A min aggregate, not a window: it combines before the shuffle, so a domain named by a
    third of all files is one row per task.
    """
    rest = [c for c in findings.columns if c not in ("ext_id", "domain", "kind", "category", "ord")]
    return (
        findings.groupBy("ext_id", "domain", "kind", "category")
        .agg(F.min(F.struct("ord", *rest)).alias("first"))
        .select("ext_id", "domain", "kind", "category", "first.*")
    )
