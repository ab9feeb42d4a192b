"""What statements give names: assignments, declaration lists, binding patterns, promise callbacks.

One pass with a stack of brackets per statement. Every ``=`` is one binding; its value ends at the next comma or closing bracket of
its own depth, so that each declarator of a list and each assignment of a comma expression is a row. A target is a dotted
name or a pattern; patterns give all names they bind, with the path of each inside the value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .lexical import _BLANK, _EXPRESSION, LITERAL, QUOTED

_TOKEN = re.compile(LITERAL + r"|" + _EXPRESSION + r"|\\.|[()\[\]{},]|[-=!<>+*/%&|^?]*=[=>]*")
_NAME = r"[A-Za-z_$][A-Za-z0-9_$.]*"
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.")
_BEFORE_NAME = frozenset(" \t\r\n\f\v{}(,")
_CALLBACK = re.compile(rf"\s*(?:async\s*)?(?:function\s*[A-Za-z0-9_$]*\s*)?\(?\s*(?:({_NAME})|([{{\[]))")
_ENTRY = re.compile(rf"\s*(?:({_NAME})|({QUOTED}))\s*:\s*([\s\S]*?)\s*$")
_PART = re.compile(QUOTED + rf"|{_NAME}|\.\.\.|[\[\]{{}}(),:=]")
_CLOSED = {"(": ")", "[": "]", "{": "}"}


def bound_names(pattern: str) -> list[tuple[str, str]]:
    """(name, path in the value) of all names that a binding pattern binds; defaults and keys are no names."""
    out, frames = [], []
    for token in _PART.finditer(pattern):
        text = token[0]
        top = frames[-1] if frames else None
        if text in "([{":
            inside = top is not None
            computed = inside and top["kind"] == "{" and top["key"] is None and text == "["
            muted = text == "(" or inside and (top["skip"] or top["muted"] or computed)
            step = "" if not inside else f"[{top['index']}]" if top["kind"] == "[" else f".{top['key']}"
            if computed:
                top["name"] = "?"
            frames.append({"kind": text, "path": (top["path"] if inside else "") + step, "muted": muted, "skip": False, "key": None, "name": None, "index": 0, "rest": False})
            continue
        if top is None:
            continue
        if text in ")]},=" and not (top["muted"] or top["skip"]) and top["name"] not in (None, "?"):
            step = "..." if top["rest"] else f"[{top['index']}]" if top["kind"] == "[" else f".{top['key'] or top['name']}"
            out.append((top["name"], (top["path"] + step).lstrip(".") if not top["rest"] else top["path"].lstrip(".") + step))
        if text in ")]}":
            frames.pop()
        elif text == ",":
            top.update(skip=False, key=None, name=None, rest=False, index=top["index"] + 1)
        elif text == "=":
            top.update(skip=True, name=None)
        elif text == ":" and top["kind"] == "{" and not top["skip"]:
            top.update(key=top["name"], name=None)
        elif text == "...":
            top["rest"] = True
        elif not top["skip"] and text != ":":
            top["name"] = text[1:-1] if text[0] in "\"'" else text
    return out


def object_entries(value: str) -> list[tuple[str, str]]:
    """(key, expression) of the entries of an object literal that is closed; none of others."""
    depth, at, parts = 0, 1, []
    for token in _TOKEN.finditer(value):
        c = value[token.start()]
        if token.end() - token.start() > 1:
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                parts.append(value[at:token.start()])
                found = [_ENTRY.match(p) for p in parts]
                return [(m[1] or m[2][1:-1], m[3]) for m in found if m and m[3]]
        elif c == "," and depth == 1:
            parts.append(value[at:token.start()])
            at = token.end()
    return []


def _back(text: str, low: int, at: int) -> int:
    """The end of what stands before the blanks that end at a position."""
    while at > low and text[at - 1] in _BLANK:
        at -= 1
    return at


def _name_before(text: str, low: int, at: int) -> tuple[int, int]:
    """Where a dotted name that ends at a position begins and ends; equal if there is none."""
    end = start = _back(text, low, at)
    while start > low and text[start - 1] in _NAME_CHARS:
        start -= 1
    whole = start < end and (start == low or text[start - 1] in _BEFORE_NAME) and not (text[start].isdigit() or text[start] == ".")
    return (start, end) if whole else (end, end)


def _declares(text: str, low: int, at: int) -> bool:
    """Whether const, let or var stands before a position."""
    end = _back(text, low, at)
    for word in ("const", "let", "var"):
        start = end - len(word)
        if start >= low and text.startswith(word, start) and (start == low or text[start - 1] in _BLANK + "{}("):
            return True
    return False


def bindings_of(stmt: str) -> list[tuple[str, str, str, list[tuple[str, str]]]]:
    """(kind, target, value, names) of a statement, in order.

    Kinds: ``declared`` (const, let, var), ``assigned``, ``entry`` (of a declared object, ``owner.key``), and ``promise``: what a
    callback given to ``.then`` calls the result, whose value is the expression before ``.then``.
    """
    # per open bracket: its position, start of the part after the last comma, whether it holds a declaration list, bindings without an end
    groups: list[list] = [[-1, 0, False, []]]
    closes: dict[int, int] = {}
    opens: dict[int, int] = {}
    out: list[list] = []
    promised: list[tuple[int, str, int]] = []

    def end(group: list, at: int) -> None:
        for number in group[3]:
            out[number][3] = at
        group[3] = []

    for token in _TOKEN.finditer(stmt):
        at, text = token.start(), token[0]
        group = groups[-1]
        if text in "([{" and len(text) == 1:
            if text == "(" and stmt[max(at - 5, 0):at] == ".then":
                promised.append((at + 1, stmt[group[1]:at - 5].strip(), len(out)))
            groups.append([at, at + 1, False, []])
        elif text in ")]}" and len(text) == 1:
            end(group, at)
            if len(groups) > 1:
                closes[group[0]], opens[at] = at, group[0]
                groups.pop()
            else:
                groups[0] = [-1, at + 1, False, []]
        elif text == ",":
            if not group[3] and not group[2]:
                start, stop = _name_before(stmt, group[1], at)
                group[2] = start < stop and _declares(stmt, group[1], start)
            end(group, at)
            group[1] = at + 1
        elif text == "=":
            start, stop = _name_before(stmt, group[1], at)
            if start == stop:
                start = opens.get(stop - 1, -1)
                if start < group[1] or stmt[start] == "(" or not (_back(stmt, group[1], start) == group[1] or _declares(stmt, group[1], start)):
                    continue
            declared = not group[3] and (_declares(stmt, group[1], start) or group[2] and _back(stmt, group[1], start) == group[1])
            group[2] = group[2] or declared
            group[3].append(len(out))
            out.append(["declared" if declared else "assigned", stmt[start:stop], token.end(), len(stmt)])
    rows = []
    for number in range(len(out) + 1):
        for place, receiver, before in promised:
            if before == number:
                found = _CALLBACK.match(stmt, place)
                if found and found[1]:
                    rows.append(("promise", found[1], receiver, [(found[1], "")]))
                elif found:
                    pattern = stmt[found.start(2):closes.get(found.start(2), len(stmt)) + 1]
                    rows.append(("promise", pattern, receiver, bound_names(pattern)))
        if number < len(out):
            kind, target, start, stop = out[number]
            value = stmt[start:stop].strip()
            if value:
                plain = target[0] not in "{["
                rows.append((kind, target, value, [(target, "")] if plain else bound_names(target)))
                if kind == "declared" and plain and value[0] == "{":
                    rows += [("entry", f"{target}.{key}", expr, []) for key, expr in object_entries(value)]
    return rows


def bindings(stmts: DataFrame) -> DataFrame:
    """One row per binding of a statement: bind_no, kind, target, value and names (name, path)."""
    keep = [c for c in stmts.columns if c != "stmt"]
    named = pa.list_(pa.struct([("name", pa.string()), ("path", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, number, kind, target, value, [{"name": n, "path": p} for n, p in names])
                    for i, stmt in enumerate(batch["stmt"].to_pylist()) for number, (kind, target, value, names) in enumerate(bindings_of(stmt))]
            at = pa.array([r[0] for r in rows], pa.int64())
            added = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string(), named), 1)]
            yield pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in keep], *added], [*keep, "bind_no", "kind", "target", "value", "names"])

    names = ArrayType(StructType([StructField("name", StringType()), StructField("path", StringType())]))
    added = [StructField("bind_no", IntegerType()), *[StructField(c, StringType()) for c in ("kind", "target", "value")], StructField("names", names)]
    rows = stmts.filter(F.col("stmt").contains("=") | F.col("stmt").contains(".then("))
    return rows.mapInArrow(scan, StructType([*[stmts.schema[c] for c in keep], *added]))


def _plain(target: Column) -> Column:
    return ~target.rlike(r"^[{\[]")


def assignments(bound: DataFrame) -> DataFrame:
    """The bindings that assign a plain or dotted name."""
    return bound.filter(F.col("kind").isin("declared", "assigned") & _plain(F.col("target"))).drop("kind", "names")


def declarations(bound: DataFrame) -> DataFrame:
    """(file, line, stmt_no, bind_no, name, expr) of declared names without a dot, and of the entries of declared objects."""
    simple = (F.col("kind") == "declared") & _plain(F.col("target")) & ~F.col("target").contains(".") & ~F.col("value").startswith("{")
    return bound.filter(simple | (F.col("kind") == "entry")).select(
        "ext_id", "path", "line", "stmt_no", "bind_no", F.col("target").alias("name"), F.col("value").alias("expr"))


def named_values(bound: DataFrame) -> DataFrame:
    """(file, line, stmt_no, bind_no, kind, name, member, value): every name that a statement binds."""
    rows = bound.filter(F.col("kind") != "entry")
    return rows.select("ext_id", "path", "line", "stmt_no", "bind_no", "kind", F.explode("names").alias("n"), "value").select(
        "ext_id", "path", "line", "stmt_no", "bind_no", "kind", F.col("n.name").alias("name"), F.col("n.path").alias("member"), "value")
