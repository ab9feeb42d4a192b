"""Text expressions. All stay inside Catalyst except the comment stripper and the entropy."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..catalog import signals as S

# Java's \b follows Unicode letters, scripts' \b follows ASCII word characters. Catalogue
# patterns put \b only before or after a word character, where one look-around is enough.
_BEFORE_WORD = re.compile(r"\\b(?=[A-Za-z_]|\(\?:[A-Za-z_]|\[[a-z])")


def js(pattern: str) -> str:
    """Java form of a catalogue pattern."""
    return _BEFORE_WORD.sub(lambda _: r"(?<!\w)", pattern).replace(r"\b", r"(?!\w)")


def needles(pattern: str) -> list[str] | None:
    """Texts of which every match of a catalogue pattern holds one, in lower case if case does not matter; None if unknown.

    Of each alternative the longest run of plain characters counts; what stands in groups and classes, or may be missing, does
    not. Alternatives inside one group that is the whole pattern count as well.
    """
    folded = pattern.startswith("(?i)")
    body = re.sub(r"^(?:\\b)+|(?:\\b)+$", "", pattern.removeprefix("(?i)"))
    parts, depth, start, at, in_class = [], 0, 0, 0, False
    while at < len(body):
        c = body[at]
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(body[start:at])
            start = at + 1
        at += 1
    parts.append(body[start:])
    if len(parts) == 1 and re.fullmatch(r"\((?:\?:)?[^()]*\)", body):
        return needles(("(?i)" if folded else "") + re.sub(r"^\((?:\?:)?|\)$", "", body))
    found = []
    for part in parts:
        bare = re.sub(r"\[(?:\\.|[^\]\\])*\](?:[?*+]|\{[^}]*\})?", "\n", part)  # classes
        while re.search(r"\([^()]*\)", bare):
            bare = re.sub(r"(?<!\\)\([^()]*(?<!\\)\)(?:[?*+]|\{[^}]*\})?|\\[()]", "\n", bare)
        bare = re.sub(r"\\[a-zA-Z](?:[?*+]|\{[^}]*\})?", "\n", bare)  # kinds of characters and edges
        bare = re.sub(r"(?:\\.|[^\n\\])(?:[?*]|\{[^}]*\})", "\n", bare)  # what may be missing
        runs = re.sub(r"\\(.)", r"\1", re.sub(r"(?<!\\)[.^$+]", "\n", bare)).split("\n")
        found.append(max(runs, key=len))
    if any(len(f) < 2 for f in found):
        return None
    return [f.lower() for f in found] if folded else found


def may_hold(text: Column, lowered: Column, pattern: str) -> Column:
    """Whether a text can hold a match at all, by plain search."""
    wanted = needles(pattern)
    if wanted is None:
        return F.lit(True)
    return any_of((lowered if pattern.startswith("(?i)") else text).contains(w) for w in wanted)


def test(text: Column, pattern: str) -> Column:
    return text.rlike(js(pattern))


def count_hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(js(pattern)))


def all_hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(js(pattern)), F.lit(group))


def first_hit(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, js(pattern), group)


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def first_of(choices: Iterable[tuple[Column, str | Column]]) -> Column:
    """Value of the first true condition, null when none holds."""
    return F.coalesce(*[F.when(test_, F.lit(value) if isinstance(value, str) else value)
                        for test_, value in choices])


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_word(text: Column, words: list[str]) -> Column:
    """First word of the list contained in the text (list order decides)."""
    lowered = F.lower(text)
    return first_of((lowered.contains(word), word) for word in words)


def snippet(line: Column, size: int = S.CONTEXT_CHARS) -> Column:
    return F.substring(F.trim(line), 1, size)


def around(line: Column, needle: Column, size: int = S.CONTEXT_CHARS) -> Column:
    """The text around the first place of a needle: a third before it, the rest from it on."""
    return F.substring(line, F.greatest(F.instr(line, needle) - size // 3, F.lit(1)), F.lit(size))


def line_at(text: Column, position: Column) -> Column:
    """Line number of a 1-based position, by counting the line feeds before it."""
    before = F.substring(text, F.lit(1), position - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def trim_all(text: Column) -> Column:
    """Trim of every kind of white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# --- fixed value: literals are kept, comments removed ---------------------------------
# Every alternative begins with a plain character, so that the matcher skips to the next of them, and repeats are possessive.
_COMMENTS = re.compile(
    r""""(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`"""
    r"""|/(?![*/])(?:[^/\n\\]++|\\.)++/[gimyus]*|/\*.*?\*/|//[^\n]*""",
    re.S,
)


def _without_comment(match: re.Match) -> str:
    text = match[0]
    if text.startswith("/*"):
        return "\n" * text.count("\n")
    return "" if text.startswith("//") else text


@F.pandas_udf(StringType())
def strip_comments(code: pd.Series) -> pd.Series:
    """Code without comments, line numbers kept. Python's matcher does not recurse, so a
    literal of any length is safe; files without comment marks pass through."""
    return code.map(
        lambda text: _COMMENTS.sub(_without_comment, text)
        if text is not None and ("//" in text or "/*" in text) else text
    )


def _bits_per_character(text: str) -> float:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return 0.0
    counts = np.bincount(codes) if codes.max() < 1 << 16 else np.unique(codes, return_counts=True)[1]
    counts = counts[counts > 0].astype(float)
    return float(np.log2(len(codes)) - (counts * np.log2(counts)).sum() / len(codes))


@F.pandas_udf(DoubleType())
def entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy in bits per character of whole texts, linear in their length whatever the alphabet."""
    return texts.map(_bits_per_character, na_action="ignore").astype(float)


def decode_base64(value: Column) -> Column:
    """Decoded text of base64 with or without padding, null when it does not decode."""
    bare = F.regexp_replace(value, "=", "")
    fitting = F.when(F.length(bare) % 4 == 1, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    padded = F.rpad(fitting, (F.ceil(F.length(fitting) / 4) * 4).cast("int"), F.lit("="))
    return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def is_obfuscated(code: Column) -> Column:
    """More indicators than usual; each is counted only in texts that can hold it."""
    total = F.lit(0)
    for pattern in S.OBFUSCATION_INDICATORS:
        held = code.contains("\\") if "\\\\" in pattern else may_hold(code, F.lower(code), pattern)
        total = total + F.when(held, count_hits(code, pattern)).otherwise(0)
    return F.when(code.isNotNull(), total > S.OBFUSCATION_LIMIT)


_FIRST_CHARS = 1000


def is_minified(code: Column) -> Column:
    """Long lines, escapes, short names or, in texts that are long enough to judge, entropy.

    Words are counted in the first characters before they are counted in the whole: a part never has more of them, so
    enough of them there settle the share of short names.
    """
    long_line = F.exists(F.split(code, "\n"), lambda line: F.length(line) > S.MAX_LINE)
    escapes = code.contains("\\x") & (count_hits(code, S.HEX_ESCAPE) > S.MAX_HEX_ESCAPES)
    short, long_ = count_hits(code, S.SHORT_ASSIGN), count_hits(code, S.LONG_WORD)
    at_least = count_hits(F.substring(code, 1, _FIRST_CHARS), S.LONG_WORD)
    # nested, so that the whole is not counted before the first test
    ratio = F.when(short >= at_least * S.SHORT_LONG_RATIO, F.when(long_ > 0, short / long_ > S.SHORT_LONG_RATIO))
    dense = entropy(F.when(F.length(code) > S.ENTROPY_MIN_SAMPLE, code)) > S.ENTROPY_LIMIT
    return F.when(code.isNotNull(), long_line | escapes | F.coalesce(ratio, F.lit(False)) | F.coalesce(dense, F.lit(False)))
