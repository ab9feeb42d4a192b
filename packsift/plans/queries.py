"""Named queries over the driver tables, one per audit operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import categories as C
from ..catalog import domains as D
from ..catalog import findings as K
from ..functions import paths, sqlfuncs, urls
from ..functions.text import entropy, is_minified, is_obfuscated, string_array
from ..operators import bindings, categories, correlate, dataflow, domains, evaluate, findings, graph, lexical, narrate, patterns
from ..operators import permissions, reports, reputation, review, scoring, signals
from ..session import growing, on_drop, staged_path
from ..sources import archives, jobstore, manifests, reportstore, stored
from ..streaming import jobs
from .corpus import Corpus, read, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_corpora: dict[tuple, Corpus] = {}


def corpus(spark: SparkSession, folder: str) -> Corpus:
    """The corpus tables of a folder, staged once per session and for the files that it holds."""
    files = tuple(sorted(f for t in ("documents", "pages", "customer", "events") for f in read(spark, folder, t).inputFiles()))
    key = (spark.sparkContext.applicationId, folder, files)
    if key not in _corpora:
        _corpora[key] = Corpus(spark, folder)
    return _corpora[key]


on_drop(_corpora.clear)  # staged tables go, so nothing may remember them


def _plain(df: DataFrame) -> DataFrame:
    """Integers widened and arrays joined, so results compare across engines."""
    def column(field):
        kind = field.dataType.typeName()
        if kind in ("integer", "short", "byte"):
            return F.col(field.name).cast("bigint").alias(field.name)
        if kind == "array":
            return F.array_join(field.name, ", ").alias(field.name)
        return F.col(field.name)

    return df.select(*[column(f) for f in df.schema])


def query(name: str):
    """Register a query over a folder of driver tables."""
    def register(fn):
        QUERIES[name] = lambda spark, folder: _plain(fn(spark, folder))
        return fn
    return register


def audit_query(name: str):
    """Register a query over the corpus tables."""
    def register(fn):
        QUERIES[name] = lambda spark, folder: _plain(fn(corpus(spark, folder)))
        return fn
    return register


# --- URLs and domains of pages ---------------------------------------------------------


@query("url_risk_by_domain")
def url_risk_by_domain(spark, folder):
    """Pages, class and risk points per host under its registrable domain, worst first."""
    return (
        urls.with_url_class(read(spark, folder, "pages").select("url"), "url")
        .groupBy(urls.registrable_domain(F.col("host")).alias("domain"), "host", "url_class")
        .agg(F.count("*").alias("n_pages"), F.sum(urls.url_points(F.col("url_class"))).alias("points"))
        .orderBy(F.desc("points"), "host", "url_class")
    )


@query("url_classes")
def url_classes(spark, folder):
    """URL class of every page address and of variants built from it."""
    pages = read(spark, folder, "pages").select("page_id", "url")
    host = urls.host_of(F.col("url"))
    variants = F.array(
        F.col("url"), F.concat(F.lit("https://"), host, F.lit(".top/x")),
        F.concat(F.lit("https://10.0."), (F.col("page_id") % 256).cast("string"), F.lit(".7/p")),
        F.concat(F.lit("http://node"), F.col("page_id").cast("string"), F.lit(".local/a")),
        F.concat(F.lit("https://api"), F.col("page_id").cast("string"), F.lit(".mixpanel.com/track")), F.lit("<dynamic>"),
        F.concat(F.lit("not a url "), F.col("page_id").cast("string")))
    rows = pages.select("page_id", F.posexplode(variants).alias("variant", "address"))
    return urls.with_url_class(rows, "address").drop("address")


@query("registrable_domains")
def registrable_domains(spark, folder):
    """Grouping domain of page hosts, also under longer public suffixes."""
    host = urls.host_of(F.col("url"))
    rows = read(spark, folder, "pages").select("page_id", F.explode(F.array(
        host, F.concat(F.lit("www."), host), F.concat(host, F.lit(".co.uk")), F.concat(host, F.lit(".ai")),
        F.element_at(F.split(host, r"\."), 1))).alias("host"))
    return rows.select("page_id", "host", urls.registrable_domain(F.col("host")).alias("domain"))


@query("sql_functions")
def sql_functions(spark, folder):
    """The SQL functions over page addresses."""
    sqlfuncs.register(spark)
    read(spark, folder, "pages").createOrReplaceTempView("packsift_pages")
    return spark.sql("""
        SELECT page_id, url_host(url) AS host, registrable_domain(url_host(url)) AS domain, url_risk_class(url) AS url_class,
          package_path('docs/en', concat('../', url_host(url), '/./x.js?v=1')) AS path FROM packsift_pages""")


@query("pattern_hosts")
def pattern_hosts(spark, folder):
    """Hosts of match patterns, network filters and code literals built from page hosts."""
    host = urls.host_of(F.col("url"))
    values = F.array(
        F.concat(F.lit("*://*."), host, F.lit("/*")), F.concat(F.lit("||"), host, F.lit("^")), F.concat(host, F.lit("/path?x=1")),
        F.lit("<all_urls>"), F.lit("*://*/*"), F.concat(F.lit("wss://"), F.upper(host), F.lit(":443/s")),
        F.lit("http://www.w3.org/2000/svg"), F.concat(F.lit("/relative/"), host))
    rows = read(spark, folder, "pages").select("page_id", F.posexplode(values).alias("variant", "value"))
    v = F.col("value")
    return rows.select("page_id", "variant", urls.host_from_pattern(v).alias("by_pattern"),
                       urls.host_from_filter(v).alias("by_filter"), urls.host_from_literal(v).alias("by_literal"))


@query("relative_paths")
def relative_paths(spark, folder):
    """Package paths that page links resolve to."""
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("href=\"([^\"]+)\""), F.lit(1))))
    rows = spread(read(spark, folder, "pages").select("page_id", "html"), "page_id").select("page_id", href.alias("href"))
    targets = F.array(F.col("href"), F.concat(F.lit("."), F.col("href")), F.concat(F.lit("../.."), F.col("href"), F.lit("/./x.js?v=1")),
                      F.concat(F.lit("a/../b"), F.col("href")), F.concat(F.lit("../../../up"), F.col("href")))
    every = rows.select("page_id", F.explode(targets).alias("target"))
    return every.select("page_id", "target", paths.resolve(F.lit("docs/en"), F.col("target")).alias("resolved"),
                        paths.is_local(F.col("target")).alias("is_local"),
                        paths.resource_type(F.col("target")).alias("type")).distinct()


@query("domain_categories")
def domain_categories(spark, folder):
    """Category of hosts seen in pages and of catalogue hosts under page-derived names."""
    known = sorted(row[0] for row in D.DOMAIN_ROWS)
    hosts = read(spark, folder, "pages").select(
        "page_id", urls.host_of(F.col("url")).alias("host"),
        F.get(string_array(known), (F.col("page_id") % len(known)).cast("int")).alias("pick"))
    rows = hosts.select("page_id", F.explode(F.array(
        F.col("host"), F.col("pick"), F.concat(F.lit("www."), F.col("pick")), F.concat(F.lit("x."), F.col("pick")),
        F.concat(F.lit("data"), F.col("page_id").cast("string"), F.lit(".gov.co")), F.lit("cdn.oxylabs.io"),
        F.lit("amazon.co.uk"), F.lit("app.run.app"))).alias("domain"))
    named = rows.withColumn("name", F.when(F.col("page_id") % 2 == 0, "Example Site Helper").otherwise("Thth Reader")).withColumn(
        "author", F.when(F.col("page_id") % 3 == 0, F.lit("Amazonia Team"))).withColumn(
        "name", F.when(F.col("page_id") % 5 == 4, "广告助手").otherwise(F.col("name")))
    return domains.classify(named).select("page_id", "domain", "category", "platform", "priority").distinct()


@query("store_category")
def store_category(spark, folder):
    """Store category of listing pages: page text with or without a breadcrumb."""
    crumb = F.concat(F.lit('<script type="application/ld+json">{"itemListElement":[{"name":"Home"},{"name":"Extensions"},{"name":"'),
                     F.when(F.col("page_id") % 2 == 0, "Developer Tools").otherwise("Shopping"), F.lit('"}]}</script>'))
    words = F.when(F.col("page_id") % 5 == 3, " Privacy & Security ").when(F.col("page_id") % 5 == 4, " Games Travel ").otherwise("")
    html = F.when(F.col("page_id") % 5 < 2, F.concat(crumb, F.col("html"))).otherwise(F.concat(F.col("html"), words))
    return read(spark, folder, "pages").select("page_id", stored.store_category(html).alias("category"))


# --- files ------------------------------------------------------------------------------


@audit_query("resource_inventory")
def resource_inventory(c: Corpus):
    """Type, size, line count and minified flag of every file."""
    return c.inventory


@audit_query("content_hashes")
def content_hashes(c: Corpus):
    """Content hash of every file and its safe name."""
    return c.all_files.select("ext_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
                              paths.safe_name(F.concat("path", F.lit(" (1).zip"))).alias("safe_name"))


@audit_query("unpacked_entries")
def unpacked_entries(c: Corpus):
    """Size and digest of every entry that the package source reads from the archives."""
    rows = archives.read_archives(c.spark, c.archives).filter("reject IS NULL")
    return rows.select("name", "path", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@audit_query("package_rejects")
def package_rejects(c: Corpus):
    """Packages and entries that the package source refuses, with the reason."""
    return archives.read_archives(c.spark, c.archives).filter("reject IS NOT NULL").select("name", "path", "reject")


@audit_query("arrived_packages")
def arrived_packages(c: Corpus):
    """Packages that arrive in two waves, read by a stream and committed batch by batch."""
    from .corpus import STORED, finished
    from .streams import run_arrivals

    late = F.pmod(F.crc32(F.col("ext_id").cast("binary")), F.lit(2)) == 1
    rows = run_arrivals(c.spark, [c.packed_files.filter(~late), c.packed_files.filter(late)], finished, STORED)
    return rows.groupBy("name").agg(F.count_if(F.col("reject").isNull()).alias("n_entries"), F.count("reject").alias("n_rejects"),
                                    F.sum("n_bytes").alias("n_bytes"), F.max("reject").alias("reject"))


@audit_query("nested_archives")
def nested_archives(c: Corpus):
    """Archives inside packages."""
    return c.inventory.filter(F.col("type") == "archive").select("ext_id", "path", "size_bytes")


@audit_query("manifest_facts")
def manifest_facts(c: Corpus):
    """Manifest fields with permissions split by kind and localised names."""
    return c.manifests.select(
        "ext_id", "version", "name", "ext_version", "author", "api_perms", "host_perms", "optional_perms", "matches",
        "content_js", "content_css", "n_content_scripts", "auto_run", "background", "service_worker", "popup", "options",
        "devtools", "side_panel", "sandbox", "overrides", "rule_files")


@audit_query("manifest_rejects")
def manifest_rejects(c: Corpus):
    """Manifests that cannot be read, among good texts and cut ones."""
    texts = c.manifest_texts.unionByName(c.manifest_texts.select(
        F.concat("ext_id", F.lit("-cut")).alias("ext_id"), F.substring("text", 1, 100).alias("text")))
    return manifests.parse_manifests(texts)[1]


@audit_query("locale_messages")
def locale_messages(c: Corpus):
    return manifests.locale_messages(c.extra_files)


@audit_query("file_roles")
def file_roles(c: Corpus):
    """Role of every script, with and without run-time promotion."""
    before = c.base_roles.withColumnRenamed("role", "base_role")
    return c.files.select("ext_id", "path", "role").join(before, ["ext_id", "path"])


@audit_query("file_flags")
def file_flags(c: Corpus):
    """Usage, obfuscation and minification flags per script."""
    return c.files.drop("role", "platform_bits", "shown_chars")


@audit_query("text_predicates")
def text_predicates(c: Corpus):
    """Obfuscation and minification tests and entropy of the whole raw text."""
    raw = F.col("raw")
    return c.scripts.select("ext_id", "path", is_obfuscated(raw).alias("indicated"), is_minified(raw).alias("minified"),
                            F.round(entropy(raw), 6).alias("entropy"))


@query("character_entropy")
def character_entropy(spark, folder):
    """Shannon entropy of every document and conversation turn."""
    docs = spread(read(spark, folder, "documents"), "doc_id").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), "text")
    turns = read(spark, folder, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    return docs.unionByName(turns).filter(F.length("text") > 0).select("source", "id", "part", F.round(entropy(F.col("text")), 6).alias("entropy"))


@audit_query("obfuscated_packages")
def obfuscated_packages(c: Corpus):
    return signals.obfuscation_counts(c.files)


@audit_query("cleaned_code")
def cleaned_code(c: Corpus):
    """Cleaned code per script: digest and line count."""
    return c.texts.select("ext_id", "path", F.md5(F.col("code").cast("binary")).alias("code_md5"),
                          F.size(F.split("code", "\n")).alias("n_lines"))


@audit_query("code_line_counts")
def code_line_counts(c: Corpus):
    """Numbered lines: count, last number and characters per script."""
    return c.lines.groupBy("ext_id", "path").agg(
        F.count("*").alias("n_lines"), F.max("line").alias("last_line"), F.sum(F.length("text")).alias("n_chars"))


@audit_query("code_urls")
def code_urls(c: Corpus):
    return c.urls.select("ext_id", "path", "line", "url", "context", "url_class", "host")


@audit_query("code_domains")
def code_domains(c: Corpus):
    return c.domains_in_code.select("ext_id", "path", "line", "domain")


@audit_query("api_references")
def api_references(c: Corpus):
    return c.api_refs


@audit_query("text_signals")
def text_signals(c: Corpus):
    """Raw-text signals of every script."""
    return signals.grep_signals(c.scripts)


@audit_query("large_file_signals")
def large_file_signals(c: Corpus):
    """Raw-text signals of every script but libraries, whatever its size, with its role."""
    return c.text_signals


@audit_query("decoded_literals")
def decoded_literals(c: Corpus):
    return signals.decoded_literals(c.scripts)


@audit_query("decoded_layers")
def decoded_layers(c: Corpus):
    """What encoded literals hide, at every depth."""
    return c.layers.drop("text")


@audit_query("call_sites")
def call_sites(c: Corpus):
    return c.calls.drop("snippet")


@audit_query("member_sites")
def member_sites(c: Corpus):
    return c.members.groupBy("ext_id", "path", "line", "object", "property", "is_write").agg(F.count("*").alias("n"))


@audit_query("assignments")
def assignments(c: Corpus):
    return c.assigned.select("ext_id", "path", "line", "stmt_no", "target", "value")


@audit_query("bound_names")
def bound_names(c: Corpus):
    """Every name that a declaration, an assignment, a binding pattern or a promise callback binds."""
    return bindings.named_values(c.bound).groupBy("ext_id", "path", "line", "kind", "name", "value").agg(F.count("*").alias("n"))


@audit_query("code_literals")
def code_literals(c: Corpus):
    return c.literals.groupBy("ext_id", "path", "line", "is_template", "value").agg(F.count("*").alias("n"))


@audit_query("dom_selectors")
def dom_selectors(c: Corpus):
    return lexical.selectors(c.calls).select("ext_id", "path", "line", "method", "selector")


# --- graph --------------------------------------------------------------------------------


@audit_query("dependency_edges")
def dependency_edges(c: Corpus):
    return c.edges


@audit_query("unresolved_dependencies")
def unresolved_dependencies(c: Corpus):
    return graph.unresolved(c.edges, c.listing)


@audit_query("reachable_files")
def reachable_files(c: Corpus):
    return c.reached


@audit_query("orphan_scripts")
def orphan_scripts(c: Corpus):
    return c.orphans


@audit_query("remote_scripts")
def remote_scripts(c: Corpus):
    return c.remote_scripts


# --- permissions ----------------------------------------------------------------------------


@audit_query("permission_risk")
def permission_risk(c: Corpus):
    """Risk of every declared permission, with its manifest line."""
    return c.permission_risk.select("ext_id", "permission", "source", "category", "weight", "host_sensitive", "line")


@audit_query("permission_sets")
def permission_sets(c: Corpus):
    """Sizes of the union, intersection and difference of declared and used permissions."""
    wanted = c.manifests.select("ext_id", F.explode(F.concat("api_perms", "host_perms", "optional_perms")).alias("permission")).distinct()
    api = c.manifests.select("ext_id", F.explode("api_perms").alias("permission")).distinct()
    used = c.used_permissions
    tag = lambda df, name: df.groupBy("ext_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
    return (
        tag(wanted, "declared").unionByName(tag(api.intersect(used), "used")).unionByName(tag(api.subtract(used), "unused"))
        .unionByName(tag(api.union(used).distinct(), "either"))
    )


@audit_query("unused_permissions")
def unused_permissions(c: Corpus):
    return permissions.describe_unused(c.unused_permissions, c.permission_risk)


@audit_query("broad_hosts")
def broad_hosts(c: Corpus):
    return permissions.broad_hosts(c.manifests)


@audit_query("external_connections")
def external_connections(c: Corpus):
    return permissions.external_connections(c.manifests, c.lines)


@audit_query("exposed_executables")
def exposed_executables(c: Corpus):
    return permissions.exposed_executables(c.manifests)


@audit_query("network_rules")
def network_rules(c: Corpus):
    """Rules of the network-rule files."""
    return manifests.network_rules(c.manifests, c.extra_files)[0].drop("text", "name", "author")


@audit_query("network_rule_findings")
def network_rule_findings(c: Corpus):
    return c.rule_findings


# --- code findings ------------------------------------------------------------------------------


@audit_query("pattern_findings")
def pattern_findings(c: Corpus):
    """Pattern findings of all matchers with their kinds."""
    return c.pattern_findings.groupBy("ext_id", "path", "line", "pattern", "kind", "category", "severity").agg(
        F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@audit_query("sink_calls")
def sink_calls(c: Corpus):
    return patterns.sink_findings(c.calls).drop("snippet")


@audit_query("native_api_hooks")
def native_api_hooks(c: Corpus):
    return patterns.assignment_findings(c.assigned).select("ext_id", "path", "line", "pattern", "severity", "confidence")


@audit_query("credential_words")
def credential_words(c: Corpus):
    """Credential words in literals and selectors."""
    words = c.pattern_findings.filter(F.col("pattern").startswith("credential "))
    return words.groupBy("ext_id", "path", "line", "pattern", "severity").agg(F.count("*").alias("n"))


@audit_query("string_constants")
def string_constants(c: Corpus):
    return c.constants


@audit_query("contacted_domains")
def contacted_domains(c: Corpus):
    return c.contacts


@audit_query("fallback_domains")
def fallback_domains(c: Corpus):
    return c.fallback


@audit_query("remote_elements")
def remote_elements(c: Corpus):
    return dataflow.remote_resources(c.assigned, c.constants)


@audit_query("tainted_variables")
def tainted_variables(c: Corpus):
    return c.tainted


@audit_query("data_flows")
def data_flows(c: Corpus):
    return c.flows.select("ext_id", "path", "line", "sink", "source", "detail", "confidence")


@audit_query("external_navigations")
def external_navigations(c: Corpus):
    return c.navigations.drop("snippet", "role")


# --- findings -----------------------------------------------------------------------------------


@audit_query("findings_by_stream")
def findings_by_stream(c: Corpus):
    """Enriched findings per stream, kind and severity."""
    return c.base_findings.groupBy("stage", "kind", "severity", "category").agg(
        F.count("*").alias("n"), F.round(F.sum("impact"), 6).alias("impact"), F.round(F.sum("confidence"), 6).alias("confidence"))


@audit_query("correlations")
def correlations(c: Corpus):
    return c.correlations


@audit_query("correlation_flags")
def correlation_flags(c: Corpus):
    f = c.correlation_flags
    return f.select("ext_id", *[x.name for x in f.schema if x.dataType.typeName() in ("boolean", "long", "integer")])


@audit_query("platform_traces")
def platform_traces(c: Corpus):
    return correlate.platform_counts(c.base_findings, c.files)


@audit_query("sink_files")
def sink_files(c: Corpus):
    return c.sink_files


@audit_query("final_findings")
def final_findings(c: Corpus):
    """Findings after context filter, context confidence and first-wins dedupe."""
    return c.findings.select("ext_id", "path", "line", "kind", "detail", "role", "severity", "category", "confidence", "impact")


@audit_query("finding_verdicts")
def finding_verdicts(c: Corpus):
    return c.verdicted.groupBy("ext_id", "kind", "verdict", "reason").agg(F.count("*").alias("n"))


@audit_query("domain_findings")
def domain_findings(c: Corpus):
    """Deduplicated domain findings with verdict, reason and report list."""
    return findings.domain_verdicts(c.domain_findings).withColumn(
        "list", F.when(F.col("category") == "unknown", "unknown").otherwise("sensitive")).drop("ord", "path", "role", "line").join(
        c.domain_findings.select("ext_id", "domain", "kind", "category", "path", "line"), ["ext_id", "domain", "kind", "category"])


@audit_query("entity_summary")
def entity_summary(c: Corpus):
    nav = c.findings.filter(F.col("kind") == "sensitive_navigation")
    return domains.entity_summary(c.domain_findings, nav, c.manifests)


@audit_query("audit_score")
def audit_score(c: Corpus):
    return c.audit_score.select("ext_id", F.round("weighted", 4).alias("weighted"), "url_points", "domain_points", "score", "level")


@audit_query("score_reasons")
def score_reasons(c: Corpus):
    return scoring.top_reasons(c.findings).drop("ord")


@audit_query("report_score")
def report_score(c: Corpus):
    """Report score with the level of a reviewer for every third package."""
    reviews = c.packages.filter(F.col("ext_no") % 3 == 0).select("ext_id", F.lit("medium").alias("review_level"))
    return scoring.report_score(c.ext_ids, c.verdicted, reviews)


# --- categories -------------------------------------------------------------------------------------


@audit_query("kept_api_calls")
def kept_api_calls(c: Corpus):
    return c.api_calls


@audit_query("category_rules")
def category_rules(c: Corpus):
    """Hits per package, category and rule."""
    return c.rule_hits.groupBy("ext_id", "risk", "rule_id").agg(F.count("*").alias("hits"))


@audit_query("category_states")
def category_states(c: Corpus):
    return c.states.select("ext_id", "risk", "state", "rules")


@audit_query("category_order")
def category_order(c: Corpus):
    """Categories of each package in report order."""
    window = Window.partitionBy("ext_id").orderBy(F.desc("weight"), F.desc("priority"))
    return c.states.withColumn("position", F.row_number().over(window)).select("ext_id", "position", "risk", "state")


@audit_query("category_evidence")
def category_evidence(c: Corpus):
    return categories.category_evidence(c.category_flags, c.rule_hits, c.domain_findings).drop("ord")


@audit_query("category_places")
def category_places(c: Corpus):
    return categories.code_places(c.rule_hits).drop("ord", "snippet")


@audit_query("final_verdict")
def final_verdict(c: Corpus):
    return c.verdict


@audit_query("verdict_reasons")
def verdict_reasons(c: Corpus):
    evidence = categories.category_evidence(c.category_flags, c.rule_hits, c.domain_findings)
    return categories.verdict_reasons(c.states, evidence, c.verdict)


@audit_query("risk_answers")
def risk_answers(c: Corpus):
    return categories.answers(c.states)


@audit_query("verdict_sentence")
def verdict_sentence(c: Corpus):
    return categories.verdict_sentence(c.states)


# --- report ---------------------------------------------------------------------------------------------


@audit_query("narratives")
def narratives(c: Corpus):
    return narrate.narratives(c.verdicted).select("ext_id", "rank", "group_key", "occurrences", "priority", "narrative")


@audit_query("narratives_omitted")
def narratives_omitted(c: Corpus):
    return narrate.omitted(c.verdicted, narrate.narratives(c.verdicted))


@audit_query("domain_narratives")
def domain_narratives(c: Corpus):
    return narrate.domain_narratives(c.domain_findings).select("ext_id", "rank", "domain", "narrative")


@audit_query("review_findings")
def review_findings(c: Corpus):
    return narrate.review_findings(c.findings).select("ext_id", "rank", "kind", "role", "path", "line", "detail", "occurrences", "confidence")


@audit_query("source_budget")
def source_budget(c: Corpus):
    """Characters of each file shown within the budget."""
    return narrate.source_budget(c.files, c.findings)


@audit_query("evidence_lines")
def evidence_lines(c: Corpus):
    """Reviewer evidence as JSON lines, checked by their key facts."""
    entities = domains.entity_summary(c.domain_findings, c.findings.filter(F.col("kind") == "sensitive_navigation"), c.manifests)
    lines = narrate.evidence_lines(c.manifests, narrate.review_findings(c.findings), entities, c.domain_findings)
    fact = lambda path: F.get_json_object("line", path)
    return lines.select("ext_id", "section", "seq", F.coalesce(fact("$.name"), fact("$.detail"), fact("$.category")).alias("fact"))


@audit_query("report_documents")
def report_documents(c: Corpus):
    """Report rows as stored: verdict, score and summary, without NUL characters."""
    rows = c.ext_ids.join(c.verdict, "ext_id").join(scoring.report_score(c.ext_ids, c.verdicted), "ext_id").join(
        categories.verdict_sentence(c.states), "ext_id")
    return rows.select("ext_id", "verdict", "level", "report_score", "report_level",
                       stored.without_nul(F.concat(F.col("summary"), F.lit("\\u0000"))).alias("summary"))


@audit_query("report_sections")
def report_sections(c: Corpus):
    """All sections of all reports, written to a report store and read back from its commit."""
    idle = permissions.describe_unused(c.unused_permissions, c.permission_risk)
    rows = reports.sections(c.verdict, scoring.report_score(c.ext_ids, c.verdicted), c.states, c.verdicted, c.domain_findings, idle, c.manifests)
    store = reportstore.ReportStore(c.spark, staged_path(c.spark))
    store.write(rows)
    return store.read()


@audit_query("reason_translation")
def reason_translation(c: Corpus):
    """Reader wording and normalised detail of every finding text."""
    return c.verdicted.select("kind", "detail", findings.translate_reason(F.col("reason")).alias("reader_reason"),
                              findings.normalise_detail(F.col("detail")).alias("plain_detail")).distinct()


@query("review_parsing")
def review_parsing(spark, folder):
    """Parsed review answers over conversation turns wrapped as reviews."""
    t = read(spark, folder, "conversations").select("conv_id", "turn", "text")
    k = F.col("conv_id") % 5
    verdict = F.when(k == 0, "maliciosa").when(k == 1, "Benigna").when(k == 2, "rara").otherwise("sospechosa")
    level = F.when(k < 2, "alto").when(k == 3, "CRITICO").otherwise("nada")
    answers = F.when(k == 4, '{"a": broken}').otherwise(F.concat(
        F.lit('{"can_log_keys": {"valor": "si", "razon": "x"}, "hidden_code": "posible", "other": "'), F.col("turn").cast("string"), F.lit('"}')))
    text = F.concat(
        F.lit("PROPOSITO: Turn "), F.col("turn").cast("string"), F.lit("\n# Title\n**bold** and `code`\n- item\n"), F.col("text"),
        F.lit("\n\n\n\nVEREDICTO: "), verdict, F.lit("\nRIESGO: "), level, F.lit("\nRESPUESTAS: "), answers)
    parsed = review.parse_reviews(t.select("conv_id", "turn", text.alias("text")))
    return parsed.select(
        "conv_id", "turn", "purpose", "review_verdict", "review_level", 
        F.try_element_at("answers", F.lit("can_log_keys")).alias("log_keys"),
        F.try_element_at("answers", F.lit("hidden_code")).alias("hidden_code"), F.try_element_at("answers", F.lit("other")).alias("other"),
        F.md5(F.col("narrative").cast("binary")).alias("narrative_md5"), F.length("narrative").alias("narrative_length"))


@query("json_recovery")
def json_recovery(spark, folder):
    """JSON recovered from fenced, chatty and thinking answers around event properties."""
    e = read(spark, folder, "events").select("event_id", "props")
    k = F.col("event_id") % 5
    fence = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    text = F.when(k == 0, F.col("props")).when(k == 1, fence).when(
        k == 2, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done"))).when(
        k == 3, F.concat(F.lit("<think>{no}</think>?. "), F.col("props"))).otherwise(F.lit("no json at all"))
    return e.select("event_id", F.get_json_object(review.recover_json(review.without_thoughts(text)), "$.k").cast("bigint").alias("k"))


# --- evaluation ---------------------------------------------------------------------------------------------


def _metrics(c: Corpus) -> DataFrame:
    idle = permissions.describe_unused(c.unused_permissions, c.permission_risk)
    score = scoring.report_score(c.ext_ids, c.verdicted)
    rows = evaluate.metric_rows(c.ext_ids, c.verdicted, c.states, c.verdict, categories.answers(c.states), c.domain_findings, idle, score)
    n = F.regexp_extract("ext_id", r"(\d+)$", 1).cast("bigint")
    # the job of a package: the events of the user of its number; a last error stands for a failure
    jobs_ = c.table("events").groupBy(F.col("user_id").alias("n")).agg(
        F.max(F.struct("ts", "event_id", "event_type")).alias("last"),
        F.round(F.sum("value"), 3).alias("duration_s")).select("n", F.col("last.event_type").alias("event"), "duration_s")
    named = rows.withColumn("n", n).join(growing(jobs_), "n", "left")
    return named.withColumns({
        "status": F.when(F.col("event") == "error", "failed").otherwise("completed"), "duration_s": F.coalesce("duration_s", F.lit(0.0)),
        "batch": F.floor(F.col("n") / 10) + 1}).drop("n", "event")


@audit_query("batch_metrics")
def batch_metrics(c: Corpus):
    return _metrics(c)


@audit_query("batch_summary")
def batch_summary(c: Corpus):
    return evaluate.batch_summary(_metrics(c).select("batch", "status", "duration_s"))


@audit_query("verdict_distribution")
def verdict_distribution(c: Corpus):
    n = F.regexp_extract("ext_id", r"(\d+)$", 1).cast("bigint")
    return evaluate.distribution(c.verdict.withColumn("batch", F.floor(n / 10) + 1), "batch", "verdict", "level")


@audit_query("category_cross_table")
def category_cross_table(c: Corpus):
    return evaluate.cross_table(c.states, "risk", "state", ["critical", "suspicious", "capability", "none"])


@audit_query("answer_cross_table")
def answer_cross_table(c: Corpus):
    names = [a[0] for a in C.ANSWERS] + ["can_spy_unnoticed"]
    long_rows = categories.answers(c.states).unpivot(["ext_id"], names, "answer", "value")
    return evaluate.cross_table(long_rows, "answer", "value", ["yes", "possible", "no"])


@audit_query("finding_totals")
def finding_totals(c: Corpus):
    """Totals over all metric rows."""
    m = _metrics(c)
    return m.agg(
        F.count("*").alias("packages"), F.sum("n_critical_findings").alias("critical"), F.sum("n_high_findings").alias("high"),
        F.sum("n_medium_findings").alias("medium"), F.sum("n_low_findings").alias("low"), F.sum("n_unused").alias("unused"),
        F.sum("n_unused_high").alias("unused_high"), F.count_if(F.col("n_unused") > 0).alias("with_unused"),
        F.sum("n_sensitive_domains").alias("sensitive_domains"), F.sum("n_unknown_domains").alias("unknown_domains"))


@query("detection_rate")
def detection_rate(spark, folder):
    """Detection and false-negative rate of the package verdict against labelled documents."""
    c = corpus(spark, folder)
    n = F.col("doc_id")
    files = read(spark, folder, "labels").select(
        "doc_id", "toxic", F.concat(F.lit("ext-"), F.expr("doc_id div 20").cast("string")).alias("ext_id"))
    joined = files.join(c.verdict.select("ext_id", "verdict"), "ext_id")
    return evaluate.detection_rates(joined, F.col("verdict") == "malicious", F.col("toxic") == 1)


@query("batch_numbers")
def batch_numbers(spark, folder):
    """Batch and position of every document file in name order."""
    files = read(spark, folder, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file"))
    return evaluate.batch_numbers(files, "file", 10)


@query("sorted_page")
def sorted_page(spark, folder):
    """One page of the sorted file list: ten names after the first twenty."""
    files = read(spark, folder, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file"))
    return files.orderBy("file").offset(20).limit(10)


@query("scored_order_lines")
def scored_order_lines(spark, folder):
    """Weighted impact, level, share and top parts per supplier over order lines."""
    lines = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("key"), (F.col("l_quantity") / 10).alias("impact"), (F.col("l_discount") * 10).alias("confidence"))
    return scoring.weighted_impact(lines, "key").withColumn("score", scoring.one_decimal(F.col("weighted"))).withColumn(
        "level", scoring.level(F.col("score"), K.AUDIT_LEVELS)).withColumn("weighted", F.round("weighted", 4))


@query("top_order_lines")
def top_order_lines(spark, folder):
    """Five costliest lines per supplier and what the rest adds up to."""
    lines = read(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    top = scoring.top_rows(lines, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    rest = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"))
    shown = top.groupBy("l_suppkey").agg(F.count("*").alias("shown"), F.sum("l_extendedprice").alias("shown_total"))
    return top.join(rest.join(shown, "l_suppkey"), "l_suppkey").select(
        "l_suppkey", "rank", "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("n") - F.col("shown")).alias("omitted"),
        F.round(F.col("total") - F.col("shown_total"), 2).alias("omitted_total"))


# --- reputation, jobs, limits -----------------------------------------------------------------------------------


def _reputation(spark, folder) -> DataFrame:
    """Provider answers derived from events: the user is the domain, the type the provider."""
    n = F.col("event_id")
    return read(spark, folder, "events").select(
        F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit(".example.net")).alias("domain"),
        F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("queried_at"),
        (n % 3).alias("malicious"), (n % 5).alias("suspicious"), (n % 70).alias("harmless"), (n % 11).alias("undetected"), "value", n.alias("event_id"))


def _now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


@query("reputation_scores")
def reputation_scores(spark, folder):
    """Best score per domain over three scoring schemes."""
    r = _reputation(spark, folder)
    engines = reputation.engine_score(r).select("domain", F.lit("engines").alias("provider"), "score", "is_malicious")
    scans = reputation.scan_score(r.select("domain", (F.col("malicious") > 1).alias("scan_malicious"))).select(
        "domain", F.lit("scans").alias("provider"), "score", "is_malicious")
    share = reputation.abuse_score(F.least("value", F.lit(100.0)))
    abuse = r.select("domain", F.lit("abuse").alias("provider"), share.alias("score"), (share > 0.5).alias("is_malicious"))
    best = reputation.best_per_domain(engines.unionByName(scans).unionByName(abuse))
    return best.withColumn("score", F.round("score", 6))


@query("reputation_cache")
def reputation_cache(spark, folder):
    """Unexpired answers per wanted domain and provider, and the domains to query."""
    cache = _reputation(spark, folder).groupBy("domain", "provider").agg(F.max("queried_at").alias("queried_at")).withColumn(
        "expires_at", reputation.expiry(F.col("queried_at"), 86400))
    wanted = read(spark, folder, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.lit(".example.net")).alias("domain"))
    hits, misses = reputation.lookup(wanted, cache, _now())
    return hits.groupBy("domain").agg(F.count("*").alias("n")).withColumn("cached", F.lit(True)).unionByName(
        misses.select("domain", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("cached")))


@query("lookup_caps")
def lookup_caps(spark, folder):
    """Domains to query per job within the global and provider caps."""
    rows = read(spark, folder, "events").select(F.col("event_type").alias("job"), F.col("user_id").alias("domain")).distinct()
    return reputation.capped(rows, "job", [F.col("domain")])


@query("report_retention")
def report_retention(spark, folder):
    """Orders as jobs: reports older than the retention period emptied, hashes kept."""
    rows = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("sha256"), F.col("o_orderpriority").alias("report"))
    kept = reputation.retire_reports(rows, F.lit("1998-08-02 00:00:00").cast("timestamp"))
    return kept.groupBy(F.col("report").isNull().alias("purged")).agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("hashes"))


@query("cache_purge")
def cache_purge(spark, folder):
    cache = _reputation(spark, folder).withColumn("expires_at", reputation.expiry(F.col("queried_at")))
    return reputation.purge_cache(cache, _now()).groupBy("provider").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))


@query("latest_job_status")
def latest_job_status(spark, folder):
    """Current status and progress per job, events taken as status changes."""
    states = [s for s, _ in K.PROGRESS_ROWS]
    rows = read(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("updated_at"),
        F.get(F.array(*[F.lit(s) for s in states]), (F.col("event_id") % len(states)).cast("int")).alias("status"))
    return stored.latest_status(rows).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("stored_job_status")
def stored_job_status(spark, folder):
    """The same after two upserts into a bucketed store: the earlier half of the events, then the later one."""
    states = [s for s, _ in K.PROGRESS_ROWS]
    rows = read(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("updated_at"),
        F.get(F.array(*[F.lit(s) for s in states]), (F.col("event_id") % len(states)).cast("int")).alias("status"))
    store = jobstore.JobStore(spark, staged_path(spark))
    for half in (0, 1):
        store.upsert(rows.filter(F.col("event_id") % 2 == half))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return store.jobs().select("job_id", "status", stamp("created_at"), stamp("updated_at"), "n_events", stored.progress(F.col("status")).alias("progress"))


@query("reputation_timeline")
def reputation_timeline(spark, folder):
    """Answers stored, renewed and expired, as a stream with keyed state and timers says it."""
    from .streams import run_reputation_timeline
    return run_reputation_timeline(spark, _reputation(spark, folder), 86400, "1 hour")


@query("id_checks")
def id_checks(spark, folder):
    """Accepted and rejected identifiers built from customers and orders."""
    digest = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    letters = F.translate(digest, "0123456789", "ghijklmnop")
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    k = F.col("o_orderkey") % 4
    rows = read(spark, folder, "orders").select(
        "o_orderkey", F.when(k == 0, F.upper(letters)).otherwise(letters).alias("ext_id"),
        F.when(k == 1, F.concat(uuid, F.lit("0"))).otherwise(uuid).alias("job_id"),
        F.concat(F.lit("pack"), F.col("o_orderkey").cast("string"), F.when(k == 2, ".tar").when(k == 3, ".ZIP").otherwise(".crx")).alias("file"))
    return rows.groupBy(
        F.col("ext_id").rlike("^[a-z]{32}$").alias("valid_ext"),
        F.col("job_id").rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").alias("valid_job"),
        F.col("file").rlike(r"(?i)\.(crx|zip)$").alias("valid_file")).agg(F.count("*").alias("n"))


@query("request_limits")
def request_limits(spark, folder):
    """Windows in which a client exceeds a request limit, on a compressed event clock."""
    clock = (F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000)  # ten minutes of events per second
    requests = read(spark, folder, "events").select(
        F.timestamp_seconds(F.floor(clock)).alias("ts"), F.col("event_type").alias("client"))
    parts = [jobs.over_limit(requests, duration, limit).withColumn("duration", F.lit(duration)) for duration, limit in K.RATE_LIMITS]
    return parts[0].unionByName(parts[1]).withColumn("window_start", F.unix_seconds("window_start"))


@query("streamed_request_limits")
def streamed_request_limits(spark, folder):
    """The 60-second limit run as a stream over the event file, read back as a table."""
    from .streams import run_request_limits
    return run_request_limits(spark, folder)


@query("visit_priorities")
def visit_priorities(spark, folder):
    """Visit order of domain findings: sensitive categories first."""
    c = corpus(spark, folder)
    return c.domain_findings.groupBy("category").agg(
        F.min(domains.visit_priority(F.col("category"))).alias("priority"),
        F.bool_or(domains.is_sensitive(F.col("category"))).alias("sensitive"), F.countDistinct("domain").alias("n_domains"))

