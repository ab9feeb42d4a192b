"""Behaviour categories, verdict and answers.

Plain flags used by the catalogue's conditions, besides the prefixed ones: broad_host,
broad_pattern, has_content_script, auto_run, has_background, invisible_execution,
sensitive_reach, matches_read_host, first_execute_background, n_contacts, n_techniques.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import categories as C
from ..catalog import findings as K
from ..catalog import permissions as M
from ..functions.text import any_of, first_of, may_hold, test
from ..session import growing
from .scoring import top_rows

# Signals some state, evidence sentence or flag refers to.
_USED = sorted({w[2:] for text in [*(c for s in C.STATES.values() for c in s), *(e[1] for e in C.EVIDENCE), *C.FP_TECHNIQUES]
                for w in text.replace("(", " ").replace(")", " ").split() if w.startswith("s_")})
_KINDS = [row[0] for row in K.KIND_ROWS]


def signal(name: str) -> Column:
    """Whether the detail shows a signal: matched only where plain search, in its lower case, finds what every match needs."""
    detail, lowered = F.col("detail"), F.col("lowered")
    return may_hold(detail, lowered, C.SIGNALS[name]) & test(detail, C.SIGNALS[name])


def kept_api_calls(api_refs: DataFrame, verdicted: DataFrame) -> DataFrame:
    """API references outside the places of dismissed findings."""
    dismissed = verdicted.filter(F.col("verdict") == "dismissed").select("ext_id", "path", "line").distinct()
    return api_refs.join(dismissed, ["ext_id", "path", "line"], "left_anti")


def rule_hits(confirmed: DataFrame) -> DataFrame:
    """One row per confirmed finding and rule it satisfies.

    The rules are literal patterns in a few arrays: one pass over short detail texts, no
    pattern recompiled per row and no shuffle, so a detail text shared by a third of all
    findings costs nothing extra.
    """
    def rule(category: str, rule_id: str, kind: str | None, names: list[str] | None) -> Column:
        condition = F.col("kind") == kind if kind else F.lit(True)
        if names:
            condition = condition & any_of(signal(n) for n in names)
        return F.when(condition, F.struct(F.lit(category).alias("risk"), F.lit(rule_id).alias("rule_id")))

    size = 28  # keeps each generated method small enough to be compiled
    chunks = [C.RULES[i:i + size] for i in range(0, len(C.RULES), size)]
    arrays = [F.filter(F.array(*[rule(*r) for r in chunk]), lambda r: r.isNotNull()) for chunk in chunks]
    return confirmed.withColumn("lowered", F.lower("detail")).withColumn("r", F.explode(F.concat(*arrays))).select(*confirmed.columns, "r.risk", "r.rule_id")


def triggered_rules(hits: DataFrame) -> DataFrame:
    return hits.groupBy("ext_id", "risk").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def finding_flags(confirmed: DataFrame) -> DataFrame:
    """Kind, detail-signal and flow flags per package.

    Signals are tested once per distinct (package, kind, detail).
    """
    texts = confirmed.select("ext_id", "kind", "detail").distinct().withColumn("lowered", F.lower("detail"))
    flow = F.col("kind") == "data_flow"
    return texts.groupBy("ext_id").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"k_{k}") for k in _KINDS],
        *[F.bool_or(signal(s)).alias(f"s_{s}") for s in _USED],
        *[F.bool_or(flow & signal(s)).alias(name) for name, s in C.FLOW_SIGNALS.items()],
        F.bool_or((F.col("kind") == "permission_risky") & F.col("detail").rlike(C.BROAD_DETAIL)).alias("broad_permission"))


def api_flags(api_calls: DataFrame) -> DataFrame:
    api = F.col("api")
    executes = test(api, C.API_USE["a_script_execute"])
    first = F.min(F.when(executes, F.struct("path", "line", "role")))
    return api_calls.groupBy("ext_id").agg(
        *[F.bool_or(test(api, p)).alias(name) for name, p in C.API_USE.items()],
        F.coalesce(first["role"] == "background", F.lit(False)).alias("first_execute_background"))


def surface_flags(manifests: DataFrame) -> DataFrame:
    perms = F.concat("api_perms", "optional_perms")
    patterns = F.concat("host_perms", "matches")
    has_scripts = F.col("n_content_scripts") > 0
    has_background = F.col("service_worker").isNotNull() | (F.size("background") > 0)
    no_ui = F.col("popup").isNull() & F.col("options").isNull() & F.col("side_panel").isNull()
    return manifests.select(
        "ext_id", *[F.array_contains(perms, p).alias(f"p_{p}") for p in C.FLAG_PERMISSIONS],
        F.exists("matches", lambda m: m.isin(M.BROAD_HOSTS)).alias("broad_match"),
        F.exists(patterns, lambda m: m.isin(M.BROAD_HOSTS)).alias("broad_pattern"),
        has_scripts.alias("has_content_script"), "auto_run", has_background.alias("has_background"),
        ((has_background | has_scripts) & no_ui).alias("invisible_execution"),
        (F.exists("matches", lambda m: m.isin(M.EVERY_SITE) | m.rlike(C.SENSITIVE_ACCESS_HOST))
         | F.exists("host_perms", lambda m: m.rlike(C.SENSITIVE_ACCESS_HOST))).alias("sensitive_reach"),
        F.exists("matches", lambda m: m.rlike(C.SENSITIVE_READ_HOST)).alias("matches_read_host"))


def package_flags(manifests: DataFrame, confirmed: DataFrame, api_calls: DataFrame, domains: DataFrame) -> DataFrame:
    """One wide flag row per package; absent parts are false or zero."""
    contacts = domains.filter(F.col("kind") == "code_contact").groupBy("ext_id").agg(F.count("*").alias("n_contacts"))
    flags = surface_flags(manifests)
    for part in (finding_flags(confirmed), api_flags(api_calls), contacts):
        flags = flags.join(growing(part), "ext_id", "left")
    fill = {f.name: False for f in flags.schema if f.dataType.typeName() == "boolean"}
    flags = flags.fillna(fill | {"n_contacts": 0})
    techniques = F.lit(0)
    for name in C.FP_TECHNIQUES:
        techniques = techniques + F.col(name).cast("int")
    return flags.withColumn("n_techniques", techniques).withColumn(
        "broad_host", F.col("broad_permission") | F.col("broad_match"))


def category_states(flags: DataFrame, triggered: DataFrame) -> DataFrame:
    """13 rows per package: state, rules and order rank.

    A category without a state but with a triggered rule counts as a capability.
    """
    def state(name: str) -> Column:
        critical, suspicious, capability = C.STATES[name]
        return F.when(F.expr(critical), "critical").when(F.expr(suspicious), "suspicious").when(
            F.expr(capability), "capability").otherwise("none")

    items = F.array(*[
        F.struct(F.lit(name).alias("risk"), F.lit(title).alias("title"), F.lit(priority).alias("priority"),
                 state(name).alias("state")) for name, title, priority in C.CATEGORIES])
    rows = flags.select("ext_id", F.explode(items).alias("i")).select("ext_id", "i.*")
    joined = rows.join(triggered, ["ext_id", "risk"], "left").withColumn(
        "rules", F.coalesce("rules", F.expr("cast(array() as array<string>)")))
    raised = F.when((F.col("state") == "none") & (F.size("rules") > 0), "capability").otherwise(F.col("state"))
    return joined.withColumn("state", raised).withColumn("weight", state_weight(F.col("state")))


def state_weight(state: Column) -> Column:
    return F.coalesce(*[F.when(state == s, F.lit(w)) for s, w in C.STATE_WEIGHT.items()])


def evaluator_evidence(flags: DataFrame) -> DataFrame:
    """Evidence sentences the evaluators add themselves, in catalogue order."""
    items = F.array(*[
        F.when(F.expr(condition), F.struct(F.lit(risk).alias("risk"), F.lit(i).alias("seq"), F.lit(text).alias("text")))
        for i, (risk, condition, text) in enumerate(C.EVIDENCE)])
    return flags.select("ext_id", F.explode(F.array_compact(items)).alias("i")).select(
        "ext_id", "i.risk", F.format_string("1|%04d", "i.seq").alias("ord"), "i.text")


def manifest_evidence(flags: DataFrame) -> DataFrame:
    items = F.array(*[
        F.when(F.expr(condition), F.struct(F.lit(risk).alias("risk"), F.lit(i).alias("seq"), F.lit(text).alias("text")))
        for i, (risk, condition, text) in enumerate(C.MANIFEST_EVIDENCE)])
    return flags.select("ext_id", F.explode(F.array_compact(items)).alias("i")).select(
        "ext_id", "i.risk", F.format_string("2|%04d", "i.seq").alias("ord"), "i.text")


def rule_evidence(hits: DataFrame) -> DataFrame:
    """Evidence of rule hits: rule and place."""
    return hits.select(
        "ext_id", "risk", F.concat(F.lit("3|"), F.col("ord")).alias("ord"),
        F.concat(F.col("rule_id"), F.lit(" at "), F.col("path"), F.lit(":"), F.col("line").cast("string")).alias("text"))


def domain_evidence(domains: DataFrame) -> DataFrame:
    """Evidence of contacted and declared domains; one domain can serve several risks."""
    sensitive = F.col("category").isin(C.SENSITIVE_DOMAIN_CATEGORIES)
    contact = F.col("kind") == "code_contact"
    item = lambda condition, risk, text: F.when(condition, F.struct(F.lit(risk).alias("risk"), text.alias("text")))
    place = F.concat(F.col("domain"), F.lit(" ("), F.col("category"), F.lit(")"))
    items = F.array(
        item(contact, "tracking", F.concat(F.lit("Contacts "), place)),
        item(contact & sensitive, "browser_access", F.concat(F.lit("Code refers to "), place)),
        item(~contact, "browser_access", F.concat(F.lit("Declares host permission for "), F.col("domain"))),
        item(~contact & sensitive, "credential_capture", F.concat(F.lit("Declares host permission for sensitive site "), place)),
        item(~contact & sensitive, "history_access", F.concat(F.lit("Host permission may reveal addresses at "), F.col("domain"))))
    return domains.select("ext_id", F.col("ord").alias("o"), F.explode(F.array_compact(items)).alias("i")).select(
        "ext_id", "i.risk", F.concat(F.lit("4|"), F.col("o")).alias("ord"), "i.text")


def category_evidence(flags: DataFrame, hits: DataFrame, domains: DataFrame, limit: int = K.EVIDENCE_LIMIT) -> DataFrame:
    """First distinct sentences per package and category: evaluator, manifest, rules, domains."""
    every = (
        evaluator_evidence(flags).unionByName(manifest_evidence(flags))
        .unionByName(rule_evidence(hits)).unionByName(domain_evidence(domains))
    )
    distinct = every.groupBy("ext_id", "risk", "text").agg(F.min("ord").alias("ord"))
    return top_rows(distinct, ["ext_id", "risk"], [F.col("ord"), F.col("text")], limit)


def code_places(hits: DataFrame, limit: int = K.HIT_LIMIT) -> DataFrame:
    """First distinct code places per package and category."""
    distinct = hits.groupBy("ext_id", "risk", "path", "line", "rule_id").agg(
        F.min("ord").alias("ord"), F.min(F.substring("snippet", 1, 120)).alias("snippet"))
    return top_rows(distinct, ["ext_id", "risk"], [F.col("ord"), F.col("rule_id")], limit)


def final_verdict(states: DataFrame) -> DataFrame:
    """Verdict and level per package from state counts and the critical categories."""
    counted = states.groupBy("ext_id").agg(
        F.count_if(F.col("state") == "critical").alias("n_critical"),
        F.count_if(F.col("state") == "suspicious").alias("n_suspicious"),
        F.count_if(F.col("state") == "capability").alias("n_capability"),
        F.bool_or((F.col("state") == "critical") & F.col("risk").isin(C.DIRECT_ABUSE)).alias("direct_abuse"))
    n_crit, n_susp, n_cap = F.col("n_critical"), F.col("n_suspicious"), F.col("n_capability")
    steps = [
        (F.col("direct_abuse"), "malicious", "critical"),
        ((n_crit > 0) | (n_susp >= 3), "suspicious", "high"),
        ((n_susp > 0) | (n_cap >= 3), "suspicious", "medium"),
        (n_cap > 0, "benign", "medium"), (F.lit(True), "benign", "low"),
    ]
    return counted.withColumn("verdict", first_of((c, v) for c, v, _ in steps)).withColumn(
        "level", first_of((c, lv) for c, _, lv in steps))


def verdict_reasons(states: DataFrame, evidence: DataFrame, verdict: DataFrame) -> DataFrame:
    """Ranked reasons behind a verdict: its states by weight, with the first evidence."""
    first = growing(evidence.filter(F.col("rank") == 1).select("ext_id", "risk", F.col("text").alias("evidence")))
    limits = verdict.select(
        "ext_id", F.col("verdict").alias("v"),
        F.when((F.col("verdict") == "malicious") | (F.col("level") == "high"), 5)
        .when(F.col("verdict") == "suspicious", 4).otherwise(3).alias("limit"))
    counted = (
        states.join(limits, "ext_id")
        .filter(F.when(F.col("limit") == 5, F.col("state").isin("critical", "suspicious"))
                .otherwise(F.col("state").isin("suspicious", "capability")))
        .join(first, ["ext_id", "risk"], "left")
    )
    ranked = top_rows(counted, ["ext_id"], [F.col("weight").desc(), F.col("priority").desc()], 5)
    return ranked.filter(F.col("rank") <= F.col("limit")).select(
        "ext_id", "rank", F.concat(F.col("title"), F.lit(": "), F.col("state"),
                                   F.coalesce(F.concat(F.lit(". Evidence: "), "evidence"), F.lit(""))).alias("reason"))


def answers(states: DataFrame) -> DataFrame:
    """Ten yes / possible / no answers per package."""
    wide = states.groupBy("ext_id").pivot("risk", [c[0] for c in C.CATEGORIES]).agg(F.first("state"))
    reply = lambda s: F.when(s == "critical", "yes").when(s.isin("suspicious", "capability"), "possible").otherwise("no")
    spy = [F.col(c) for c in C.SPYING]
    return wide.select(
        "ext_id", *[reply(F.col(risk)).alias(name) for name, risk in C.ANSWERS],
        F.when(any_of(s == "critical" for s in spy), "yes").when(any_of(s == "suspicious" for s in spy), "possible")
        .otherwise("no").alias("can_spy_unnoticed"))


def verdict_sentence(states: DataFrame) -> DataFrame:
    """Summary sentence with counts and titles per state, in category order."""
    def part(state: str, words: str) -> Column:
        titles = F.transform(
            F.reverse(F.array_sort(F.collect_list(F.when(
                F.col("state") == state, F.struct(F.col("priority").alias("p"), F.col("title").alias("t")))))),
            lambda s: s["t"])
        count = F.count_if(F.col("state") == state)
        return F.when(count > 0, F.concat(count.cast("string"), F.lit(f" {words}: "), F.array_join(titles, ", "))).alias(state)

    parts = states.groupBy("ext_id").agg(
        part("critical", "critical"), part("suspicious", "suspicious"), part("capability", "capabilities"))
    joined = F.concat_ws("; ", "critical", "suspicious", "capability")
    return parts.select("ext_id", F.when(joined == "", "No significant signals.").otherwise(
        F.concat(F.lit("Detected "), joined, F.lit("."))).alias("summary"))
