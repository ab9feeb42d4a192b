"""String constants, contacted hosts, navigations and taint flows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import patterns as P
from ..catalog import signals as S
from ..functions.text import decode_base64, first_of, test, trim_all
from ..functions.urls import host_from_literal
from ..session import cut_growing, growing
from .bindings import bindings, declarations, named_values

FILE = ["ext_id", "path"]
_PIECE = r"\"(?:[^\"\\]++|\\[\s\S])*+(?:\"|$)|'(?:[^'\\]++|\\[\s\S])*+(?:'|$)|[A-Za-z_$][A-Za-z0-9_$.]*"
_ATOB = r"^atob\(\s*[\"']([A-Za-z0-9+/]+={0,2})[\"']"


def _as_concatenation(expr: Column) -> Column:
    """Template literals written as a concatenation of quoted parts and names."""
    opened = F.regexp_replace(expr, r"\$\{\s*([^}]*)\}", "\"+$1+\"")
    return F.regexp_replace(opened, "`", "\"")


def expression_pieces(exprs: DataFrame, key: list[str]) -> DataFrame:
    """Quoted parts and names of string expressions, in order.

    Only expressions made of literals, names, ``+`` and templates have pieces.
    """
    encoded = F.regexp_extract("expr", _ATOB, 1)
    plain = F.when(encoded != "", F.concat(F.lit("\""), decode_base64(encoded), F.lit("\""))).otherwise(
        _as_concatenation(F.col("expr")))
    pure = exprs.withColumn("plain", plain).filter(
        F.regexp_replace("plain", _PIECE + r"|[\s+]", "") == "")
    rows = pure.select(*key, *FILE, F.posexplode(F.regexp_extract_all("plain", F.lit(_PIECE), F.lit(0))).alias("pos", "piece"))
    quoted = F.col("piece").rlike("^[\"']")
    return rows.select(
        *key, *FILE, "pos",
        F.when(quoted, F.regexp_replace("piece", r"^[\"']|[\"']$", "")).alias("literal"),
        F.when(~quoted, F.col("piece")).alias("name"))


def constant_declarations(bound: DataFrame) -> DataFrame:
    """(file, name, expr) of declared names and object properties; the first declaration of a name counts."""
    rows = declarations(bound).groupBy(*FILE, "name").agg(F.min(F.struct("line", "stmt_no", "bind_no", "expr")).alias("first"))
    return rows.select(*FILE, "name", F.col("first.expr").alias("expr"))


def string_constants(bound: DataFrame) -> DataFrame:
    """(file, name, value) by a fixed point of joins on (file, name).

    A declaration resolves once every name in it that is itself declared has a value;
    other names count as empty text. Each round works on what is still open, and the loop
    ends when a round resolves nothing, so cycles stay open and chains of any length close.
    """
    declared = constant_declarations(bound)
    pieces = expression_pieces(declared.withColumnRenamed("name", "const"), ["const"])
    names = pieces.select(*FILE, F.col("const").alias("name")).distinct().withColumn("is_const", F.lit(True))
    pieces = cut_growing(pieces.join(names, [*FILE, "name"], "left"))
    known = None
    while True:
        if known is None:
            todo = pieces.withColumn("value", F.lit(None).cast("string"))
        else:
            done = known.select(*FILE, F.col("name").alias("const"))
            todo = pieces.join(done, [*FILE, "const"], "left_anti").join(known, [*FILE, "name"], "left")
        fresh = (
            todo.groupBy(*FILE, "const")
            .agg(
                F.bool_or(F.col("name").isNotNull() & F.coalesce("is_const", F.lit(False))
                          & F.col("value").isNull()).alias("waiting"),
                F.bool_or(F.coalesce("literal", "value").isNotNull()).alias("has_text"),
                F.array_sort(F.collect_list(F.struct(
                    "pos", F.coalesce("literal", "value", F.lit("")).alias("text")))).alias("parts"))
            .filter(~F.col("waiting") & F.col("has_text"))
            .select(*FILE, F.col("const").alias("name"), _joined_parts().alias("value"))
        )
        fresh = cut_growing(fresh)
        rounds = 1 if known is None else rounds + 1
        known = fresh if known is None else growing(known.unionByName(fresh))
        if fresh.isEmpty():
            return known
        if rounds % 8 == 0:
            known = cut_growing(known)


def _joined_parts() -> Column:
    return F.array_join(F.transform("parts", lambda p: p["text"]), "")


def resolve_expressions(exprs: DataFrame, key: list[str], constants: DataFrame) -> DataFrame:
    """Add ``resolved`` to rows (file, key, expr); rows without any known text drop out."""
    return (
        expression_pieces(exprs, key).join(constants, [*FILE, "name"], "left")
        .groupBy(*FILE, *key)
        .agg(F.bool_or(F.coalesce("literal", "value").isNotNull()).alias("has_text"),
             F.array_sort(F.collect_list(F.struct(
                 "pos", F.coalesce("literal", "value", F.lit("")).alias("text")))).alias("parts"))
        .filter("has_text").select(*FILE, *key, _joined_parts().alias("resolved"))
    )


def is_sink(callee: Column, sinks: list[str]) -> Column:
    match = callee.isin(sinks)
    for sink in sinks:
        match = match | callee.endswith("." + sink)
    return match


def argument(part: Column) -> Column:
    """What an argument (text between commas) says: text up to a nested call, or the whole of an encoded literal."""
    part = F.trim(part)
    return F.when(part.rlike(_ATOB), F.regexp_extract(part, r"^atob\([^)]*", 0)).otherwise(
        trim_all(F.regexp_extract(part, r"^[^()]*", 0)))


def xhr_variables(assigned: DataFrame) -> DataFrame:
    return (
        assigned.filter(F.col("value").rlike(r"^new\s+XMLHttpRequest\s*\("))
        .select(*FILE, F.col("target").alias("receiver")).distinct()
    )


def xhr_opens(calls: DataFrame, assigned: DataFrame) -> DataFrame:
    """``x.open(...)`` calls on variables that hold an XMLHttpRequest."""
    return (
        calls.filter(F.col("callee").rlike(r"^[^.]+\.open$"))
        .withColumn("receiver", F.substring_index("callee", ".", 1))
        .join(xhr_variables(assigned), [*FILE, "receiver"], "left_semi").drop("receiver")
    )


def element_sources(assigned: DataFrame) -> DataFrame:
    """Assignments to ``.src`` of variables that hold a created script or iframe."""
    tag = F.lower(F.regexp_extract("value", r"^document\.createElement\(\s*[\"'](\w+)[\"']", 1))
    holders = assigned.select(*FILE, F.col("target").alias("holder"), tag.alias("tag")).filter(
        F.col("tag").isin("script", "iframe")).groupBy(*FILE, "holder").agg(F.max("tag").alias("tag"))
    return (
        assigned.filter(F.col("target").rlike(r"^[^.]+\.src$"))
        .withColumn("holder", F.substring_index("target", ".", 1))
        .join(holders, [*FILE, "holder"])
        .select(*FILE, "line", "stmt_no", "bind_no", "snippet", "tag", F.col("value").alias("expr"))
    )


def remote_resources(assigned: DataFrame, constants: DataFrame) -> DataFrame:
    """(file, line, tag, domain) of remote script and iframe sources."""
    sources = element_sources(assigned)
    key = ["line", "stmt_no", "bind_no", "tag"]
    return (
        resolve_expressions(sources, key, constants)
        .withColumn("domain", host_from_literal(F.col("resolved")))
        .filter(F.col("domain").isNotNull())
        .select(*FILE, "line", "tag", "domain").distinct()
    )


def contacted_domains(calls: DataFrame, assigned: DataFrame, constants: DataFrame) -> DataFrame:
    """Distinct (file, line, domain) reached by sinks, XHR, sockets and remote elements.
    Navigation is not a contact."""
    channels = calls.filter(
        is_sink(F.col("callee"), P.NETWORK_SINKS)
        | (F.col("is_new") & F.col("callee").isin(P.CHANNEL_CONSTRUCTORS)))
    parts = lambda rows: rows.select(*FILE, "line", "stmt_no", "call_no", F.posexplode(F.split("args", ",")).alias("arg_no", "part"))
    by_open = xhr_opens(calls, assigned).select(*FILE, "line", "stmt_no", "call_no", F.lit(0).alias("arg_no"),
                                                F.coalesce(F.get(F.split("args", ",", 3), F.lit(1)), "args").alias("part"))
    by_arg = parts(channels).unionByName(by_open).withColumn("expr", argument(F.col("part"))).drop("part")
    key = ["line", "stmt_no", "call_no", "arg_no"]
    in_calls = (
        resolve_expressions(by_arg, key, constants)
        .select(*FILE, "line", host_from_literal(F.col("resolved")).alias("domain"))
        .filter(F.col("domain").isNotNull())
    )
    elements = remote_resources(assigned, constants).select(*FILE, "line", "domain")
    return in_calls.unionByName(elements).distinct()


def fallback_domains(files: DataFrame, domains: DataFrame, contacts: DataFrame) -> DataFrame:
    """All domains of minified files that send but show no contact.

    A plain join on distinct files: the planner would move a semi join below the split into lines and shuffle whole texts.
    """
    quiet = growing(
        files.filter(F.col("is_minified") & (F.col("uses_fetch") | F.col("uses_xhr")))
        .select(*FILE).join(contacts.select(*FILE).distinct(), FILE, "left_anti").distinct()
    )
    return domains.join(quiet, FILE).select(*FILE, "line", "domain").distinct()


def navigations(calls: DataFrame, assigned: DataFrame, constants: DataFrame) -> DataFrame:
    """Outbound navigations that carry page, product or affiliate context."""
    opened = calls.filter(F.col("callee").rlike(r"^(window\.)?open$")).select(
        *FILE, "line", "stmt_no", "snippet", argument(F.substring_index("args", ",", 1)).alias("expr"))
    created = calls.filter(F.col("callee").rlike(r"^chrome\.(tabs|windows)\.create$")).select(
        *FILE, "line", "stmt_no", "snippet",
        F.when(F.trim("args").startswith("{"),
               trim_all(F.regexp_extract("args", r"\burl[\"']?\s*:\s*([^,{}()]*)", 1)))
        .otherwise(argument(F.substring_index("args", ",", 1))).alias("expr"))
    moved = assigned.filter(
        F.col("target").contains(".") & F.col("target").rlike(r"\.(href|location)$")
    ).select(*FILE, "line", "stmt_no", "snippet", F.col("value").alias("expr"))
    rows = opened.unionByName(created).unionByName(moved).filter(F.col("expr") != "")
    key = ["line", "stmt_no", "snippet"]
    found = (
        resolve_expressions(rows.distinct().withColumn("n", F.xxhash64("expr")), [*key, "n"], constants)
        .withColumn("domain", host_from_literal(F.col("resolved")))
        .filter(F.col("domain").isNotNull())
    )
    hay = F.lower(F.concat_ws(" ", "domain", "resolved", "snippet"))
    reason = F.concat_ws(", ", *[F.when(test(hay, pattern), F.lit(name)) for name, pattern in S.NAVIGATION_REASONS])
    return (
        found.withColumn("reason", reason).filter(F.col("reason") != "")
        .groupBy(*FILE, "line", "domain", "reason").agg(F.min("snippet").alias("snippet"))
        .withColumn("severity", F.when(F.col("reason").rlike("affiliate|domain|product|page"), "high").otherwise("medium"))
    )


# --- taint ---------------------------------------------------------------------------------


def source_label(token: Column) -> Column:
    """Kind of sensitive source a dotted name stands for, null when none."""
    return first_of([
        ((token == "document.cookie") | token.startswith("document.cookie."), "document.cookie"),
        (token.rlike(P.DOM_SELECTION), F.concat(F.lit("DOM selection via "), token)),
        (token.rlike(P.SENSITIVE_API), F.concat(F.lit("sensitive API source "), token)),
        (token.rlike(P.SENSITIVE_MEMBER), token),
        (token.rlike(P.DOM_READ), F.concat(F.lit("DOM read "), token)),
    ])


def _tokens(expr: Column) -> Column:
    return F.regexp_extract_all(expr, F.lit(r"[A-Za-z_$][A-Za-z0-9_$.]*"), F.lit(0))


def direct_source(expr: Column) -> Column:
    """First sensitive source named in an expression, null when none."""
    return F.get(F.filter(F.transform(_tokens(expr), source_label), lambda s: s.isNotNull()), F.lit(0))


def _roots(expr: Column) -> Column:
    return F.array_distinct(F.transform(_tokens(expr), lambda t: F.substring_index(t, ".", 1)))


def value_bindings(bound: DataFrame) -> DataFrame:
    """(file, var, expr): every way a statement gives a name the value of an expression. A promise gives only what its
    source is known for; a dotted name stands for the variable it begins with."""
    rows = named_values(bound).filter((F.col("kind") != "promise") | F.col("value").rlike(P.PROMISE_SOURCE))
    return rows.select(*FILE, F.substring_index("name", ".", 1).alias("var"), F.col("value").alias("expr"))


def smallest_labels(seeds: list[tuple[str, str]], links: list[tuple[str, str]]) -> dict[str, str]:
    """The smallest label that reaches each variable along the links, in one pass per link."""
    onward: dict[str, list[str]] = {}
    for a, b in links:
        onward.setdefault(a, []).append(b)
    labels: dict[str, str] = {}
    for variable, label in sorted(seeds, key=lambda s: s[1]):
        todo = [variable]
        while todo:
            v = todo.pop()
            if v not in labels:
                labels[v] = label
                todo += onward.get(v, ())
    return labels


def tainted_variables(stmts: DataFrame) -> DataFrame:
    """(file, var, source) of statements: see ``tainted``."""
    return tainted(bindings(stmts))


def tainted(bound: DataFrame) -> DataFrame:
    """(file, var, source): variables that carry sensitive data, by label propagation.

    Seeds are bindings that name a source; labels move along (variable -> variable) bindings
    of the same file, and a variable keeps its smallest label. Bindings never leave their
    file, so the bindings of each file that has a seed are followed together, to the end of
    chains of any length; they are fewer than the characters of the file.
    """
    valued = value_bindings(bound).withColumn("source", direct_source(F.col("expr")))
    seeds = cut_growing(
        valued.filter(F.col("source").isNotNull()).groupBy(*FILE, "var").agg(F.min("source").alias("source")))
    links = (
        valued.filter(F.col("source").isNull())
        .select(*FILE, F.explode(_roots(F.col("expr"))).alias("var"), F.col("var").alias("to"))
        .filter(F.col("var") != F.col("to")).distinct().join(seeds.select(*FILE).distinct(), FILE, "left_semi")
    )
    none = F.lit(None).cast("string")
    rows = seeds.withColumn("to", none).unionByName(links.withColumn("source", none))

    def follow(key, table):
        variables, sources, targets = (table[c].to_pylist() for c in ("var", "source", "to"))
        labels = smallest_labels([(v, s) for v, s in zip(variables, sources) if s is not None],
                                 [(v, t) for v, t in zip(variables, targets) if t is not None])
        names = sorted(labels)
        return pa.table({"ext_id": pa.array([key[0].as_py()] * len(names), pa.string()), "path": pa.array([key[1].as_py()] * len(names), pa.string()),
                         "var": pa.array(names, pa.string()), "source": pa.array([labels[v] for v in names], pa.string())})

    return cut_growing(rows.groupBy(*FILE).applyInArrow(follow, "ext_id string, path string, var string, source string"))


def flows(calls: DataFrame, assigned: DataFrame, tainted: DataFrame) -> DataFrame:
    """Sink calls whose arguments carry a sensitive source, directly or by a variable."""
    callee = F.col("callee")
    message, network = is_sink(callee, P.MESSAGE_SINKS), is_sink(callee, P.NETWORK_SINKS)
    channel = F.col("is_new") & callee.isin(P.CHANNEL_CONSTRUCTORS)
    sinks = calls.filter(message | network | channel).select(
        *FILE, "line", "stmt_no", "call_no", "snippet", "args",
        F.when(message, F.concat(F.lit("extension message sink "), callee))
        .when(channel, F.concat(callee, F.lit(" constructor")))
        .otherwise(F.concat(F.lit("network sink "), callee)).alias("sink"),
        F.when(message, 0.78).when(channel, 0.88).otherwise(0.9).alias("confidence"))
    opens = xhr_opens(calls, assigned).select(
        *FILE, "line", "stmt_no", "call_no", "snippet", "args",
        F.lit("XMLHttpRequest URL").alias("sink"), F.lit(0.84).alias("confidence"))
    every = sinks.unionByName(opens).withColumn("direct", direct_source(F.col("args")))
    key = [*FILE, "line", "stmt_no", "call_no", "snippet", "sink", "confidence"]
    by_source = every.filter(F.col("direct").isNotNull()).select(*key, F.col("direct").alias("source"))
    by_variable = (
        every.filter(F.col("direct").isNull())
        .select(*key, F.explode(_roots(F.col("args"))).alias("var"))
        .join(tainted, [*FILE, "var"]).groupBy(*key).agg(F.min("source").alias("source"))
    )
    return (
        by_source.unionByName(by_variable)
        .groupBy(*FILE, "line", "sink", "source")
        .agg(F.min("snippet").alias("snippet"), F.max("confidence").alias("confidence"))
        .withColumn("detail", F.concat_ws(" -> ", "source", "sink"))
    )
