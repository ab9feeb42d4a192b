"""Pattern findings over the lexical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import patterns as P
from ..catalog import signals as S
from ..functions.text import any_of, first_of, first_word
from .dataflow import is_sink, remote_resources
from .lexical import first_literal

OUT = ["ext_id", "path", "line", "snippet", "pattern", "category", "severity", "confidence"]


def pattern_rules(spark, matcher: str) -> DataFrame:
    """The rules of one matcher: fixed rows, 59 in all."""
    rows = [(category, severity, obj, name, words) for kind, category, severity, obj, name, words in P.PATTERN_ROWS
            if kind == matcher]
    return spark.createDataFrame(
        rows, "category string, severity string, rule_object string, name string, words array<string>")


def _out(rows: DataFrame, pattern: Column, confidence: Column) -> DataFrame:
    return rows.withColumn("pattern", pattern).withColumn("confidence", confidence).select(*OUT)


# --- fixed values: constructor, pattern text, category, severity, confidence ---------------
_CONSTRUCTORS = [
    ("Function", "new Function", "injection", "critical", 0.95),
    ("WebSocket", "WebSocket", "exfiltration", "high", 0.82),
    ("EventSource", "EventSource", "exfiltration", "high", 0.82),
    ("RTCPeerConnection", "new RTCPeerConnection", "privacy_risk", "high", 0.78),
    ("Worker", "new Worker", "evasion", "medium", 0.65),
    ("SharedWorker", "new SharedWorker", "evasion", "medium", 0.65),
]
_LISTENER = "addEventListener"


def _last(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def call_findings(calls: DataFrame) -> DataFrame:
    """Everything a call site alone can show, in one pass over the calls: pattern rules by
    callee suffix, listeners, sinks, constructors, string timers and credential selectors.

    Most calls end in a name no rule knows; one membership test drops them before the
    rules run.
    """
    callee, last, made = F.col("callee"), F.substring_index("callee", ".", -1), F.col("is_new")
    rules = [row for row in P.PATTERN_ROWS if row[0] == "call"]
    known = sorted({_last(name) for *_, name, _ in rules} | {_last(s) for s in P.NETWORK_SINKS + P.MESSAGE_SINKS}
                   | {row[0] for row in _CONSTRUCTORS} | {_LISTENER, "setTimeout"})
    rows = calls.filter(last.isin(known) | callee.rlike(P.CREDENTIAL_SELECTOR_CALLS)).withColumn(
        "literal", first_literal(F.col("args")))
    literal = F.col("literal")

    def found(condition: Column, pattern: Column, category: str, severity: Column | str, confidence: float | Column) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(condition, F.struct(
            pattern.alias("pattern"), F.lit(category).alias("category"), as_column(severity).alias("severity"),
            as_column(confidence).alias("confidence")))

    def ends(name: str) -> Column:
        return (callee == name) | callee.endswith("." + name)

    hits = []
    for _, category, severity, _, name, words in rules:
        said = any_of(F.coalesce(F.contains(literal, F.lit(w)), F.lit(False)) for w in words) if words else F.lit(True)
        weak = F.when(callee == "console.clear", 0.45).otherwise(0.8) if name == "console.clear" else 0.8
        hits.append(found(~made & ends(name) & said, callee, category, severity, weak))
    for _, category, severity, _, name, _ in (row for row in P.PATTERN_ROWS if row[0] == "listener"):
        hits.append(found((last == _LISTENER) & (literal == name), F.lit(name), category, severity, 0.8))
    for name, pattern, category, severity, confidence in _CONSTRUCTORS:
        hits.append(found(made & (callee == name), F.lit(pattern), category, severity, confidence))
    hits.append(found(callee.isin("setTimeout", "setInterval") & literal.isNotNull(),
                      F.concat(callee, F.lit("(string)")), "injection", "high", 0.9))
    word = first_word(literal, S.SELECTOR_WORDS)
    hits.append(found(callee.rlike(P.CREDENTIAL_SELECTOR_CALLS) & word.isNotNull(), F.concat(F.lit("credential selector:"), word),
                      "data_theft", F.when(word.isin(S.CRITICAL_SELECTOR_WORDS), "critical").otherwise("high"), 0.9))
    hits += _sink_hits(callee, made, found)
    return rows.select("ext_id", "path", "line", "snippet", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(
        "ext_id", "path", "line", "snippet", "h.*").select(*OUT)


def _sink_hits(callee: Column, made: Column, found) -> list[Column]:
    return [
        found(~made & is_sink(callee, P.NETWORK_SINKS), callee, "exfiltration",
              F.when(callee == "fetch", "medium").otherwise("high"), 0.75),
        found(~made & is_sink(callee, P.MESSAGE_SINKS), callee, "exfiltration", "medium", 0.62),
    ]


def member_findings(members: DataFrame) -> DataFrame:
    """Member reads by property, or by object and property."""
    rules = F.broadcast(pattern_rules(members.sparkSession, "member"))
    hits = members.withColumnRenamed("property", "name").join(rules, "name").filter(
        (F.col("rule_object").isNull() | (F.col("rule_object") == F.col("object")))
        & ~(F.col("is_write") & F.col("name").isin("textContent", "innerText")))
    return _out(hits, F.concat_ws(".", "object", "name"),
                F.when(F.col("name").isin("toDataURL", "getImageData"), 0.5).otherwise(0.8))


def assignment_findings(assigned: DataFrame) -> DataFrame:
    """Rule properties that are written, dynamic script sources, replaced native APIs."""
    rules = F.broadcast(pattern_rules(assigned.sparkSession, "assignment"))
    dotted = assigned.filter(F.col("target").contains("."))
    written = _out(dotted.withColumn("name", F.substring_index("target", ".", -1)).join(rules, "name"),
                   F.col("name"), F.lit(0.8))
    script = dotted.filter(F.col("target").endswith(".src") & F.col("value").rlike(P.SCRIPT_VALUE))
    script = _out(script.withColumn("category", F.lit("injection")).withColumn("severity", F.lit("high")),
                  F.lit("script.src assignment"), F.lit(0.82))
    is_function = F.col("value").rlike(r"^(async\s+)?function\b|=>")
    tests = [
        (F.col("target").rlike(pattern) & (is_function if needs_function else F.lit(True)), name, severity, confidence)
        for name, severity, confidence, pattern, needs_function in P.HOOK_ROWS
    ]
    hooked = (
        dotted.withColumn("hook", first_of((t, name) for t, name, _, _ in tests)).filter(F.col("hook").isNotNull())
        .withColumn("category", F.lit("interception"))
        .withColumn("severity", first_of((F.col("hook") == name, severity) for _, name, severity, _ in tests))
    )
    hooked = _out(hooked, F.col("hook"),
                  F.coalesce(*[F.when(F.col("hook") == name, F.lit(c)) for _, name, _, c in tests]))
    return written.unionByName(script).unionByName(hooked)


def sink_findings(calls: DataFrame) -> DataFrame:
    """Network and messaging sinks only."""
    callee = F.col("callee")
    network, message = is_sink(callee, P.NETWORK_SINKS), is_sink(callee, P.MESSAGE_SINKS)
    rows = calls.filter(~F.col("is_new") & (network | message)).withColumn("category", F.lit("exfiltration"))
    as_network = _out(rows.filter(network).withColumn(
        "severity", F.when(callee == "fetch", "medium").otherwise("high")), callee, F.lit(0.75))
    as_message = _out(rows.filter(message).withColumn("severity", F.lit("medium")), callee, F.lit(0.62))
    return as_network.unionByName(as_message)


def credential_literals(literals: DataFrame) -> DataFrame:
    """Literals that name a credential; the first word of the list decides."""
    rows = literals.withColumn("word", first_word(F.col("value"), S.LITERAL_WORDS)).filter(F.col("word").isNotNull())
    shape = F.when(F.col("is_template"), "credential template:").otherwise("credential string:")
    return _out(rows.withColumn("category", F.lit("data_theft")).withColumn("severity", F.lit("medium")),
                F.concat(shape, F.col("word")), F.lit(0.65))


def remote_element_findings(assigned: DataFrame, constants: DataFrame) -> DataFrame:
    rows = remote_resources(assigned, constants)
    is_script = F.col("tag") == "script"
    return _out(
        rows.withColumn("snippet", F.lit(None).cast("string")).withColumn("category", F.lit("injection"))
        .withColumn("severity", F.when(is_script, "critical").otherwise("high")),
        F.concat(F.col("tag"), F.lit(".src remote")), F.when(is_script, 0.92).otherwise(0.84))


def kind_of(pattern: Column, category: Column) -> Column:
    """Finding kind of a pattern text, in fixed precedence.

    Hooks are tested before the network words their names contain, and extension storage
    counts as storage whatever its case.
    """
    has = pattern.contains
    return first_of([
        (pattern.isin("xhr_prototype_hook", "fetch_hook", "history_api_hook"), "api_hook"),
        (pattern == "geolocation_api_spoof", "api_spoof"),
        ((pattern == "document.cookie") | pattern.startswith("chrome.cookies"), "cookie_read"),
        (has("Storage") | pattern.startswith("chrome.storage."), "storage_read"),
        (pattern.isin("keydown", "keyup", "keypress", "submit", "input", "change"), "input_listener"),
        (pattern.isin("innerHTML", "outerHTML") | has("document.write") | has("createElement") | has("script.src")
         | has("iframe.src") | has(".src remote") | has("executeScript"), "dom_injection"),
        (F.lit(True), "risky_call"),
    ])


def all_pattern_findings(calls: DataFrame, members: DataFrame, assigned: DataFrame, literals: DataFrame,
                         constants: DataFrame) -> DataFrame:
    """Findings of every matcher with their kinds; roles are joined by the caller."""
    parts = [
        call_findings(calls), member_findings(members), assignment_findings(assigned), credential_literals(literals),
        remote_element_findings(assigned, constants),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("kind", kind_of(F.col("pattern"), F.col("category")))
