"""Lexical tables: lines, statements, call sites, members, assignments, literals.

No parser: lines that plainly go on are joined, cut into statements at every ``;`` outside
literals, and each table is a Spark expression over them. Lines, literals and brackets are
read in Python, in one linear pass per file and one per statement.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..catalog import patterns as P
from ..catalog import signals as S
from ..functions.text import all_hits, around, snippet, test, trim_all

KEY = ["ext_id", "path"]
NAME = r"[A-Za-z_$][A-Za-z0-9_$.]*"


def code_lines(files: DataFrame, code: str = "code") -> DataFrame:
    """One row per line, numbered from 1."""
    keep = [c for c in files.columns if c != code]
    return files.select(*keep, F.posexplode(F.split(code, "\n")).alias("pos", "text")).select(
        *keep, (F.col("pos") + 1).alias("line"), "text")


# Quoted literals; a backslash takes the next character with it. Possessive, so that they need no regex stack.
QUOTED = r"\"(?:[^\"\\]++|\\[\s\S])*+\"|'(?:[^'\\]++|\\[\s\S])*+'"
LITERAL = QUOTED + r"|`(?:[^`\\]++|\\[\s\S])*+`"
_EXPRESSION = r"(?<=[=(,:\[!&|?{};+\n])[ \t]*+/(?![*/])(?:[^/\n\\]++|\\.)++/"
_LEXEME = re.compile(r"(?:" + QUOTED.replace(r'[^\"\\]', r'[^\"\\\n]').replace(r"[^'\\]", r"[^'\\\n]") + r"|`(?:[^`\\]++|\\[\s\S])*+`|" + _EXPRESSION + r"|\\.)|[\n;()\[\]{}]")
# A line goes on if it ends with one of these, or the next begins with one of those.
_GOES_ON, _CONTINUES = "([,+=&|?", re.compile(r"[ \t]*+[.)]")
_CODELIKE = re.compile(r"[(=\"'`\[]|[A-Za-z0-9_$)]\.[A-Za-z_$]")
_CLOSES = {")": "(", "]": "["}
_BLANK = " \t\r\n\f\v"


def _goes_on(code: str, start: int, end: int) -> bool:
    while end > start and code[end - 1] in " \t\r":
        end -= 1
    return end > start and code[end - 1] in _GOES_ON


def _opens_object(code: str, at: int) -> bool:
    """Whether the brace at a position begins an object and not a block."""
    while at and code[at - 1] in _BLANK:
        at -= 1
    return at > 0 and (code[at - 1] in "(,[:=?&|+" or code[max(at - 6, 0):at] == "return")


def _layout(code: str) -> tuple[list[int], set[int], list[tuple[int, int]], list[int]]:
    """Positions of line ends, of those where lines are joined, bodies inside brackets, and positions of ``;`` that end statements.

    Lines are joined inside literals and where a bracket ``(`` or ``[`` with a partner is open, also in the objects
    inside it. The blocks inside it (function bodies) of several lines are bodies: lines and statements of their own.
    """
    ends, joined, bodies, stops = [], set(), [], []
    open_: list[list] = []  # bracket, position, line ends and bodies that wait for the partner
    braces = 0

    def hand_on(entry: list) -> None:
        if open_ and open_[-1][0] != "block":
            for k in (2, 3):
                a, b = open_[-1][k], entry[k]
                if len(a) < len(b):
                    a, b = b, a
                a.extend(b)
                open_[-1][k] = a

    for token in _LEXEME.finditer(code):
        at, c = token.start(), code[token.start()]
        if token.end() - at > 1:
            if "\n" in token[0]:
                inside = [at + m.start() for m in re.finditer("\n", token[0])]
                ends += inside
                joined.update(inside)
        elif c == "\n":
            ends.append(at)
            if open_ and open_[-1][0] != "block":
                open_[-1][2].append(at)
        elif c == ";":
            stops.append(at)
        elif c == "{":
            open_.append(["object" if _opens_object(code, at) else "block", at, [], []])
            braces += 1
        elif c in "([":
            open_.append([c, at, [], []])
        elif c == "}":
            if braces:
                braces -= 1
                while open_[-1][0] in "([":
                    open_.pop()
                entry = open_.pop()
                if entry[0] == "object":
                    hand_on(entry)
                elif open_ and open_[-1][0] != "block" and bisect_left(ends, entry[1]) < len(ends):
                    open_[-1][3].append((entry[1] + 1, at))
        elif open_ and open_[-1][0] == _CLOSES[c]:
            entry = open_.pop()
            joined.update(entry[2])
            bodies += entry[3]
    return ends, joined, sorted(bodies), stops


def statements_of(code: str) -> list[tuple[int, int, str]]:
    """(line, number, statement) of the lines that can hold code at all, those that go on joined.

    ``line`` is the one where the statement begins; the number counts the statements of its joined lines.
    """
    code = code.translate({2: " ", 11: " "})
    ends, joined, bodies, stops = _layout(code)
    start = 0
    for i, end in enumerate(ends):
        after = end + 1
        if end not in joined and (_goes_on(code, start, end) or _CONTINUES.match(code, after)):
            joined.add(end)
        start = after
    events = sorted([(e, 1, "") for e in ends] + [(a, 0, "{") for a, _ in bodies] + [(b, 2, "}") for _, b in bodies] + [(s, 1, ";") for s in stops])
    out, taken, outer = [], set(), []
    parts = [[]]

    def flush() -> None:
        """Write the statements of one joined line: parts are lists of (start, end) pieces."""
        number = 0
        if any(_CODELIKE.search(code, a, b) for part in parts for a, b in part):
            for part in parts:
                if not any(a < b for a, b in part):
                    continue
                text = " ".join(code[a:b].replace("\n", " ") for a, b in part)
                bare = text.strip(_BLANK)
                if bare:
                    first = next(a + len(code[a:b]) - len(code[a:b].lstrip(_BLANK)) for a, b in part if code[a:b].strip(_BLANK))
                    line, n = bisect_left(ends, first) + 1, number
                    while (line, n) in taken:
                        n += 1
                    taken.add((line, n))
                    out.append((line, n, bare))
                number += 1

    at = 0
    for place, _, kind in events:
        if kind == "{":
            parts[-1].append((at, place))
            outer.append(parts)
            parts, at = [[]], place
        elif kind == "}":
            parts[-1].append((at, place))
            flush()
            parts, at = outer.pop(), place
        elif kind == ";":
            parts[-1].append((at, place))
            parts.append([])
            at = place + 1
        elif place in joined:
            continue
        else:
            parts[-1].append((at, place))
            flush()
            parts, at = [[]], place + 1
    parts[-1].append((at, len(code)))
    flush()
    return sorted(out)


def statements(files: DataFrame, code: str = "code") -> DataFrame:
    """Statements of the files' lines that can hold code at all; those that go on are joined. Prose, data and blank
    lines stop here, before the wider extraction. ``line`` is the one where the statement begins."""
    keep = [c for c in files.columns if c != code]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, text in enumerate(batch[code]):
                found += [(i, *s) for s in statements_of(text.as_py() or "")]
                if len(found) > 20_000 or i + 1 == batch.num_rows:
                    at = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*[batch[c].take(at) for c in keep], *[pa.array([f[k] for f in found], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()))]],
                        [*keep, "line", "stmt_no", "stmt"])
                    found = []

    added = [StructField("line", IntegerType()), StructField("stmt_no", IntegerType()), StructField("stmt", StringType())]
    rows = files.select(*keep, code).mapInArrow(scan, StructType([*[files.schema[c] for c in keep], *added]))
    return rows.select(*keep, "line", snippet(F.col("stmt")).alias("snippet"), "stmt_no", "stmt")


_TOKEN = re.compile(LITERAL + r"|" + _EXPRESSION + r"|\\.|[()]")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.")
_WORD_CHARS = _NAME_CHARS - {"$", "."}


def calls_of(stmt: str) -> list[tuple[int, str, bool, str]]:
    """(number, callee, is_new, arguments) of every ``name(`` outside literals.

    Arguments end at the matching bracket, or with the statement. One pass with a stack; a
    name is read backwards from its bracket.
    """
    calls, open_, before, number = [], [], 0, 0
    for token in _TOKEN.finditer(stmt):
        at = token.start()
        if stmt[at] == "(":
            end = at
            while end > before and stmt[end - 1] in _BLANK:
                end -= 1
            start = end
            while start > before and stmt[start - 1] in _NAME_CHARS:
                start -= 1
            while start < end and (stmt[start].isdigit() or stmt[start] == "."):
                start += 1
            open_.append(None)
            if start < end and stmt[start:end] not in P.KEYWORDS:
                left = start
                while left > before and stmt[left - 1] in _BLANK:
                    left -= 1
                new = left < start and left - before >= 3 and stmt[left - 3:left] == "new" and (left - before == 3 or stmt[left - 4] not in _WORD_CHARS)
                open_[-1] = len(calls)
                calls.append([number, stmt[start:end], new, at + 1, len(stmt)])
            before, number = at + 1, number + 1
        elif stmt[at] == ")" and open_:
            call = open_.pop()
            if call is not None:
                calls[call][4] = at
    return [(number, name, new, stmt[start:end]) for number, name, new, start, end in calls]


def call_sites(stmts: DataFrame) -> DataFrame:
    """One row per ``name(``: callee, is_new and the text of its arguments."""
    keep = [c for c in stmts.columns if c != "stmt"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *call) for i, stmt in enumerate(batch["stmt"].to_pylist()) for call in calls_of(stmt)]
            at = pa.array([f[0] for f in found], pa.int64())
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in keep], *[pa.array([f[i + 1] for f in found], k) for i, k in enumerate(kinds)]],
                                             [*keep, "call_no", "callee", "is_new", "args"])

    added = [StructField("call_no", IntegerType()), StructField("callee", StringType()), StructField("is_new", BooleanType()), StructField("args", StringType())]
    return stmts.filter(F.col("stmt").contains("(")).mapInArrow(scan, StructType([*[stmts.schema[c] for c in keep], *added]))


def first_literal(args: Column) -> Column:
    """First argument when it is a quoted literal, else null."""
    quoted = F.regexp_extract(args, rf"^\s*({QUOTED})", 1)
    return F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def without_literals(stmt: Column) -> Column:
    return F.regexp_replace(stmt, QUOTED, "\"\"")


# Names that a statement without its literals assigns.
TARGETS = r"(?:^|[\s{}(,])([A-Za-z_$][A-Za-z0-9_$.]*)\s*=(?=[^=>])"


def members(stmts: DataFrame) -> DataFrame:
    """One row per member access: object (``?`` when not a plain name), property and
    whether the access is the target of an assignment."""
    keep = [c for c in stmts.columns if c != "stmt"]
    bare = without_literals(F.col("stmt"))
    tokens = (
        stmts.filter(F.col("stmt").contains("."))
        .withColumn("bare", bare)
        .withColumn("targets", F.regexp_extract_all("bare", F.lit(TARGETS), F.lit(1)))
        .select(*keep, "targets", F.explode(F.regexp_extract_all("bare", F.lit(r"[A-Za-z0-9_$.]+"), F.lit(0))).alias("token"))
        .filter(F.col("token").contains("."))
        .withColumn("seg", F.split("token", r"\.", -1))
    )
    pairs = tokens.select(*keep, "token", "targets", "seg", F.explode(F.sequence(F.lit(1), F.size("seg") - 1)).alias("k"))
    first = F.element_at("seg", 1)
    return pairs.select(
        *keep,
        F.when(first == "", "?").otherwise(
            F.call_function("substring_index", F.col("token"), F.lit("."), F.col("k"))).alias("object"),
        F.element_at("seg", F.col("k") + 1).alias("property"),
        (F.array_contains("targets", F.col("token")) & (F.col("k") == F.size("seg") - 1)).alias("is_write"),
    ).filter(F.col("property").rlike(r"^[A-Za-z_$]"))


def assignments(stmts: DataFrame) -> DataFrame:
    """One row per assignment of a plain or dotted name."""
    from . import bindings

    return bindings.assignments(bindings.bindings(stmts))


def literals(lines: DataFrame) -> DataFrame:
    """One row per quoted literal of a line."""
    keep = [c for c in lines.columns if c != "text"]
    return (
        lines.filter(F.col("text").rlike("[\"'`]"))
        .select(*keep, "text", F.explode(F.regexp_extract_all("text", F.lit(LITERAL), F.lit(0))).alias("quoted"))
        .select(*keep, around(F.col("text"), F.col("quoted")).alias("snippet"), (F.substring("quoted", 1, 1) == "`").alias("is_template"),
                F.substring(F.col("quoted"), F.lit(2), F.length("quoted") - 2).alias("value"))
    )


def api_references(lines: DataFrame) -> DataFrame:
    """Distinct privileged API references per line with their permission root."""
    keep = [c for c in lines.columns if c != "text"]
    return (
        lines.filter(F.col("text").contains("chrome."))
        .select(*keep, F.explode(F.array_distinct(all_hits(F.col("text"), S.API_REFERENCE, 1))).alias("name"))
        .select(*keep, F.concat(F.lit("chrome."), F.col("name")).alias("api"),
                F.substring_index("name", ".", 1).alias("root"))
    )


def code_urls(lines: DataFrame) -> DataFrame:
    """Distinct URLs per line plus one ``<dynamic>`` row where a sink builds its URL."""
    keep = [c for c in lines.columns if c != "text"]
    text = F.col("text")
    found = F.array_distinct(all_hits(text, S.URL_IN_CODE))
    built = F.when(test(text, S.DYNAMIC_URL), F.array(F.lit("<dynamic>"))).otherwise(
        F.expr("cast(array() as array<string>)"))
    return (
        lines.filter(text.contains("http") | text.contains("("))
        .select(*keep, "text", F.explode(F.concat(found, built)).alias("url"))
        .select(*keep, around(text, F.col("url")).alias("context"), "url")
    )


def code_domains(lines: DataFrame) -> DataFrame:
    """Distinct lower-cased hosts per line: from URLs and from quoted bare domains."""
    keep = [c for c in lines.columns if c != "text"]
    text = F.col("text")
    hosts = F.concat(all_hits(text, S.URL_HOST, 1), all_hits(text, S.BARE_HOST, 1))
    return (
        lines.filter(text.contains("."))
        .select(*keep, F.explode(F.array_distinct(F.transform(hosts, F.lower))).alias("domain"))
    )


def selectors(calls: DataFrame) -> DataFrame:
    """DOM selector calls with a literal selector."""
    wanted = [m.split(".")[1] for m in P.SELECTOR_METHODS]
    method = F.concat(F.lit("document."), F.substring_index("callee", ".", -1))
    return (
        calls.filter(F.substring_index("callee", ".", -1).isin(wanted))
        .withColumn("method", method)
        .filter((F.col("callee") == F.col("method")) | F.expr("endswith(callee, concat('.', method))"))
        .withColumn("selector", first_literal(F.col("args")))
        .filter(F.col("selector").isNotNull())
    )
