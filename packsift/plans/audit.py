"""The audit of a package corpus as a set of tables, each built once on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import domains as D
from ..catalog import signals as S
from ..functions.urls import host_from_pattern, with_url_class
from ..operators import bindings, categories, correlate, dataflow, domains, findings, graph, layers, lexical, patterns, permissions, scoring, signals
from ..session import cut_growing, growing
from ..sources import inventory, manifests, packages


class Audit:
    """Tables of an audit. Subclasses give the four sources: ``packages`` (ext_id),
    ``scripts`` (ext_id, path, raw), ``manifest_texts`` (ext_id, text) and ``extra_files``
    (ext_id, path, text) for everything else.

    Tables that several branches read (described files, statements, findings) are written
    to the shared folder once and read back from there.
    """

    packages: DataFrame
    scripts: DataFrame
    manifest_texts: DataFrame
    extra_files: DataFrame

    @cached_property
    def all_files(self) -> DataFrame:
        texts = (
            self.scripts.select("ext_id", "path", F.col("raw").alias("text"))
            .unionByName(self.extra_files)
            .unionByName(self.manifest_texts.select("ext_id", F.lit("manifest.json").alias("path"), "text"))
        )
        return texts.withColumn("size_bytes", F.octet_length("text").cast("bigint"))

    @cached_property
    def inventory(self) -> DataFrame:
        return inventory.inventory(self.all_files)

    @cached_property
    def listing(self) -> DataFrame:
        """(ext_id, path) of every file; no text is read for it."""
        return growing(self.all_files.select("ext_id", "path").filter(~F.col("path").rlike(inventory.S.SKIPPED_DIRS)))

    @cached_property
    def manifests(self) -> DataFrame:
        parsed, _ = manifests.parse_manifests(self.manifest_texts)
        return cut_growing(manifests.resolve_names(parsed, manifests.locale_messages(self.extra_files)))

    # --- scripts --------------------------------------------------------------------
    @cached_property
    def base_roles(self) -> DataFrame:
        """(ext_id, path, role) before run-time promotion."""
        return cut_growing(graph.file_roles(self.scripts.select("ext_id", "path"), self.manifests, self.extra_files))

    @cached_property
    def described(self) -> DataFrame:
        """Cleaned code and flags of every script but libraries. This is the only pass over
        raw text; nothing shuffles it, and roles are joined to narrow results later."""
        return cut_growing(signals.describe_files(graph.without_libraries(self.scripts, self.base_roles)))

    @cached_property
    def edges(self) -> DataFrame:
        return cut_growing(graph.dependency_edges(self.manifests, self.extra_files, self.lines, self.texts))

    @cached_property
    def reached(self) -> DataFrame:
        return graph.reachable(self.edges, self.listing)

    @cached_property
    def orphans(self) -> DataFrame:
        return graph.orphans(self.files.select("ext_id", "path", "role"), self.reached)

    @cached_property
    def files(self) -> DataFrame:
        """Narrow facts of every script with final roles; no text. Libraries have no flags."""
        facts = self.described.drop("code")
        rows = self.base_roles.join(facts, ["ext_id", "path"], "left")
        flags = [f.name for f in facts.schema if f.dataType.typeName() == "boolean"]
        rows = rows.join(layers.layer_flags(self.layers), ["ext_id", "path"], "left")
        inside = [c for c in rows.columns if c.startswith("layer_")]
        rows = rows.withColumns({c.removeprefix("layer_"): F.col(c.removeprefix("layer_")) | F.coalesce(c, F.lit(False)) for c in inside}).drop(*inside)
        filled = rows.fillna(False, flags).fillna(0, ["line_count", "platform_bits", "shown_chars"])
        return cut_growing(graph.promote(filled, graph.promoted_files(self.base_roles, self.edges)))

    def with_role(self, rows: DataFrame) -> DataFrame:
        """Narrow rows (ext_id, path, ...) with the role of their file."""
        return rows.join(self.files.select("ext_id", "path", "role"), ["ext_id", "path"])

    @cached_property
    def texts(self) -> DataFrame:
        """(ext_id, path, code) of every script but libraries."""
        return self.described.select("ext_id", "path", "code")

    @cached_property
    def lines(self) -> DataFrame:
        """Cleaned lines of every script but libraries."""
        return lexical.code_lines(self.texts)

    @cached_property
    def layers(self) -> DataFrame:
        """Texts that encoded literals of every script but libraries hide, of every depth."""
        return layers.layers(graph.without_libraries(self.scripts, self.base_roles))

    @cached_property
    def all_lines(self) -> DataFrame:
        """Cleaned lines and the lines of decoded literals."""
        return self.lines.unionByName(layers.layer_lines(self.layers))

    @cached_property
    def statements(self) -> DataFrame:
        """Statements of the scripts and of the code that they hide."""
        return cut_growing(lexical.statements(self.texts).unionByName(layers.layer_statements(self.layers)))

    @cached_property
    def calls(self) -> DataFrame:
        return cut_growing(lexical.call_sites(self.statements))

    @cached_property
    def bound(self) -> DataFrame:
        """Every binding of a name by a statement."""
        return cut_growing(bindings.bindings(self.statements))

    @cached_property
    def members(self) -> DataFrame:
        return lexical.members(self.statements)

    @cached_property
    def assigned(self) -> DataFrame:
        return bindings.assignments(self.bound)

    @cached_property
    def literals(self) -> DataFrame:
        return lexical.literals(self.all_lines)

    @cached_property
    def api_refs(self) -> DataFrame:
        return cut_growing(self.with_role(lexical.api_references(self.all_lines)))

    @cached_property
    def urls(self) -> DataFrame:
        found = lexical.code_urls(self.all_lines)
        return cut_growing(with_url_class(found, "url").drop("protocol", "reasons"))

    @cached_property
    def domains_in_code(self) -> DataFrame:
        return lexical.code_domains(self.all_lines)

    @cached_property
    def text_signals(self) -> DataFrame:
        """Raw-text signals of every script but libraries, with its role."""
        return self.with_role(signals.grep_signals(graph.without_libraries(self.scripts, self.base_roles)))

    @cached_property
    def constants(self) -> DataFrame:
        return dataflow.string_constants(self.bound)

    @cached_property
    def contacts(self) -> DataFrame:
        return cut_growing(dataflow.contacted_domains(self.calls, self.assigned, self.constants))

    @cached_property
    def fallback(self) -> DataFrame:
        return dataflow.fallback_domains(self.files, self.domains_in_code, self.contacts)

    @cached_property
    def navigations(self) -> DataFrame:
        return cut_growing(self.with_role(dataflow.navigations(self.calls, self.assigned, self.constants)))

    @cached_property
    def tainted(self) -> DataFrame:
        return dataflow.tainted(self.bound)

    @cached_property
    def flows(self) -> DataFrame:
        return cut_growing(self.with_role(dataflow.flows(self.calls, self.assigned, self.tainted)))

    @cached_property
    def pattern_findings(self) -> DataFrame:
        return cut_growing(self.with_role(patterns.all_pattern_findings(
            self.calls, self.members, self.assigned, self.literals, self.constants)))

    # --- permissions and manifest structures ---------------------------------------------
    @cached_property
    def permission_risk(self) -> DataFrame:
        return permissions.permission_risk(permissions.declared(self.manifests))

    @cached_property
    def used_permissions(self) -> DataFrame:
        return permissions.used_permissions(self.api_refs)

    @cached_property
    def unused_permissions(self) -> DataFrame:
        return permissions.permission_use(self.manifests, self.used_permissions)[1]

    @cached_property
    def remote_scripts(self) -> DataFrame:
        return graph.remote_scripts(self.manifests, self.extra_files)

    @cached_property
    def rule_findings(self) -> DataFrame:
        return permissions.network_rule_findings(*manifests.network_rules(self.manifests, self.extra_files))

    # --- domain findings --------------------------------------------------------------------
    @cached_property
    def domain_findings(self) -> DataFrame:
        """Sensitive and unknown domains, first finding per (package, domain, kind, category)."""
        roles = self.files.select("ext_id", "path", "role")
        in_code = (
            self.contacts.select("ext_id", "path", "line", "domain", F.lit(1).alias("stage"))
            .unionByName(self.fallback.select("ext_id", "path", "line", "domain", F.lit(2).alias("stage")))
            .join(roles, ["ext_id", "path"]).withColumn("kind", F.lit("code_contact"))
        )
        placed = F.transform("host_perms", lambda p: F.struct(p.alias("pattern"), manifests.line_of(F.col("raw"), p).alias("line")))
        declared = self.manifests.select("ext_id", F.explode(placed).alias("p")).select(
            "ext_id", F.lit("manifest.json").alias("path"), F.col("p.line").alias("line"),
            host_from_pattern(F.col("p.pattern")).alias("domain"), F.lit(3).alias("stage"),
            F.lit("manifest").alias("role"), F.lit("host_permission").alias("kind")).filter(F.col("domain").isNotNull())
        named = in_code.unionByName(declared).join(self.manifests.select("ext_id", "name", "author"), "ext_id")
        classified = domains.classify_distinct(named).filter(F.col("category").isin("unknown", *D.SENSITIVE))
        ordered = classified.withColumn("ord", F.concat_ws(
            "|", F.col("stage").cast("string"), "path", F.lpad(F.col("line").cast("string"), 8, "0")))
        return cut_growing(domains.dedupe_domains(ordered.select(
            "ext_id", "domain", "kind", "category", "ord", "path", "role", "line", "priority")))

    # --- findings -----------------------------------------------------------------------------
    def finding_streams(self) -> list[DataFrame]:
        """Every stream before correlation, in reference order."""
        s, col = findings.stream, F.col
        files, perms = self.files, self.permission_risk
        roles = files.select("ext_id", "path", "role")
        risky = perms.filter(col("category") != "low")
        risky_detail = F.concat(
            col("permission"), F.lit(" ("), col("category"), F.lit(", weight="), col("weight").cast("string"),
            F.lit(", hostSensitive="), col("host_sensitive").cast("string"), F.lit(", "), col("source"), F.lit(")"))
        missing = graph.unresolved(self.edges, self.listing).withColumnRenamed("src", "path").join(
            roles, ["ext_id", "path"], "left")
        at_manifest = {"path": "manifest.json", "role": "manifest"}
        archives = inventory.nested_archives(self.inventory)
        return [
            s(archives, 1, "nested_archive", F.concat(F.lit("nested archive ("), col("size_bytes").cast("string"), F.lit(" bytes)")),
              role="unknown", line=1),
            s(risky.select("ext_id", "permission", "weight", "host_sensitive", "source", "line", col("category")), 2,
              "permission_risky", risky_detail, line=col("line"),
              category=F.lit(None), **at_manifest),
            s(self.orphans, 3, "orphan_file", F.lit("script is not reachable from the dependency graph"), line=1),
            s(missing.withColumn("role", F.coalesce("role", F.lit("unknown"))), 4, "unresolved_dependency",
              F.concat(col("type"), F.lit(" -> "), col("dst"))),
            s(self.remote_scripts, 5, "remote_script", col("src"), path=col("page"), role="popup", line=1),
            s(files.filter("is_obfuscated"), 6, "obfuscated", F.lit("obfuscated or aggressively minified file"), line=1),
            s(files.filter("is_minified"), 7, "minified", F.lit("minified file; findings may be dense"), line=1),
            s(self.pattern_findings, 8, col("kind"), col("pattern")),
            s(self.flows.filter(col("role") != "popup"), 9, "data_flow", col("detail"), severity="critical", category="exfiltration"),
            s(self.navigations, 10, "sensitive_navigation",
              F.concat(F.lit("navigation to https://"), col("domain"), F.lit(" ("), col("reason"), F.lit(")")), confidence=0.84,
              category="privacy_risk"),
            s(self.rule_findings, 11, col("kind"), col("detail"), role="manifest"),
            s(permissions.external_connections(self.manifests, self.lines), 12, "correlation", col("detail"), role="manifest"),
            s(permissions.exposed_executables(self.manifests), 13, "correlation", col("detail"), role="manifest"),
            s(self.unused_permissions, 14, "permission_unused", col("permission"), line=col("line"), **at_manifest),
        ]

    @cached_property
    def base_findings(self) -> DataFrame:
        """Enriched findings of every stream but the correlations, which are stage 15."""
        return cut_growing(findings.enrich(findings.union(self.finding_streams())))

    @cached_property
    def correlation_flags(self) -> DataFrame:
        before = self.base_findings.filter(F.col("stage") < 15)
        return cut_growing(correlate.package_flags(
            self.manifests, before, self.files, self.urls, self.remote_scripts))

    @cached_property
    def correlations(self) -> DataFrame:
        roles = self.files.select("ext_id", "path", "role")
        return correlate.correlations(self.correlation_flags).join(roles, ["ext_id", "path"], "left").withColumn(
            "role", F.coalesce("role", F.lit("manifest")))

    @cached_property
    def sink_files(self) -> DataFrame:
        return growing(findings.sink_files(self.all_findings, self.files))

    @cached_property
    def all_findings(self) -> DataFrame:
        correlated = findings.enrich(findings.stream(self.correlations, 15, "correlation", F.col("detail")))
        return self.base_findings.unionByName(correlated)

    @cached_property
    def findings(self) -> DataFrame:
        """Filtered, re-weighted and deduplicated findings."""
        marked = self.all_findings.join(
            self.sink_files.withColumn("has_sink", F.lit(True)), ["ext_id", "path"], "left").withColumn(
            "has_sink", F.coalesce("has_sink", F.lit(False)))
        weighted = findings.context_confidence(findings.contextual_filter(marked)).drop("has_sink")
        return cut_growing(findings.dedupe(weighted))

    @cached_property
    def verdicted(self) -> DataFrame:
        return findings.verdicts(self.findings)

    @cached_property
    def confirmed(self) -> DataFrame:
        return self.verdicted.filter(F.col("verdict") == "confirmed")

    @cached_property
    def ext_ids(self) -> DataFrame:
        return self.packages.select("ext_id")

    @cached_property
    def audit_score(self) -> DataFrame:
        return scoring.audit_score(self.ext_ids, self.findings, self.urls, self.domain_findings)

    @cached_property
    def api_calls(self) -> DataFrame:
        return categories.kept_api_calls(self.api_refs, self.verdicted)

    @cached_property
    def rule_hits(self) -> DataFrame:
        return cut_growing(categories.rule_hits(self.confirmed))

    @cached_property
    def category_flags(self) -> DataFrame:
        return cut_growing(categories.package_flags(self.manifests, self.confirmed, self.api_calls, self.domain_findings))

    @cached_property
    def states(self) -> DataFrame:
        return growing(categories.category_states(self.category_flags, categories.triggered_rules(self.rule_hits)))

    @cached_property
    def verdict(self) -> DataFrame:
        return categories.final_verdict(self.states)


class PackageAudit(Audit):
    """Audit of real packages: blobs as ``sources.packages`` reads them, each content once."""

    def __init__(self, blobs: DataFrame):
        self.blobs = packages.distinct_packages(blobs)

    @cached_property
    def unpacked(self) -> DataFrame:
        """Entries of every package, with text decoded where the type is text."""
        rows = cut_growing(self.blobs.mapInPandas(packages.entries, packages.ENTRY_SCHEMA))
        kind = packages.resource_type(F.col("path"))
        return rows.withColumn("type", kind).withColumn(
            "text", F.when(kind.isin("javascript", "html", "json", "css"), F.make_valid_utf8(F.col("content").cast("string"))))

    @cached_property
    def rejects(self) -> DataFrame:
        """Packages that were refused, with the reason."""
        refused = self.unpacked.filter(F.col("reject").isNotNull()).select("ext_id", "reject")
        held = self.files_in.select("ext_id").distinct()
        without = held.join(self.manifest_texts, "ext_id", "left_anti").select("ext_id", F.lit("no manifest").alias("reject"))
        return refused.unionByName(without).unionByName(manifests.parse_manifests(self.manifest_texts)[1])

    @cached_property
    def files_in(self) -> DataFrame:
        return self.unpacked.filter(F.col("reject").isNull())

    @cached_property
    def manifest_texts(self) -> DataFrame:
        return self.files_in.filter(F.col("path") == "manifest.json").select("ext_id", "text")

    @cached_property
    def packages(self) -> DataFrame:
        return self.manifests.select("ext_id")

    @cached_property
    def scripts(self) -> DataFrame:
        skipped = F.col("path").rlike(S.SKIPPED_DIRS)
        return self.files_in.filter((F.col("type") == "javascript") & ~skipped).select(
            "ext_id", "path", F.col("text").alias("raw")).join(self.packages, "ext_id", "left_semi")

    @cached_property
    def extra_files(self) -> DataFrame:
        return self.files_in.filter((F.col("type") != "javascript") & (F.col("path") != "manifest.json")).select("ext_id", "path", "text")

    @cached_property
    def all_files(self) -> DataFrame:
        return self.files_in.select("ext_id", "path", "text", F.octet_length("content").cast("bigint").alias("size_bytes"))


def audit_packages(blobs: DataFrame) -> DataFrame:
    """One report row per package content: status, error, verdict, scores and states.

    A refused package has status ``failed``, its reason and no verdict; an entry that could
    not be read is named while the rest of its package is audited.
    """
    audit = PackageAudit(blobs)
    states = audit.states.groupBy("ext_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk", "state")))).alias("states"))
    report = scoring.report_score(audit.ext_ids, audit.verdicted)
    names = blobs.groupBy("ext_id", "package_sha256").agg(F.min("name").alias("name"))
    errors = audit.rejects.groupBy("ext_id").agg(F.min("reject").alias("error"))
    done = (
        audit.verdict.select("ext_id", "verdict", "level")
        .join(audit.audit_score.select("ext_id", F.col("score").alias("audit_score"), F.col("level").alias("audit_level")), "ext_id")
        .join(growing(report), "ext_id").join(growing(states), "ext_id")
    )
    rows = names.join(growing(done), "ext_id", "left").join(growing(errors), "ext_id", "left")
    return rows.withColumn("status", F.when(F.col("verdict").isNull(), "failed").otherwise("completed"))


def audit_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Audit every package file of a folder."""
    return audit_packages(packages.read_packages(spark, folder))
