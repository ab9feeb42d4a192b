"""File-level signals: flags, raw-text signals, encoded literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import domains as D
from ..catalog import signals as S
from ..functions.text import (
    any_of, count_hits, decode_base64, entropy, is_minified, is_obfuscated, js, line_at, may_hold, strip_comments, test, trim_all,
)


def usage_flags(code: Column) -> list[Column]:
    uses = {"uses_fetch": S.USES_FETCH, "uses_xhr": S.USES_XHR, "uses_eval": S.USES_EVAL, "uses_dom_write": S.USES_DOM_WRITE}
    return [(may_hold(code, F.lower(code), pattern) & test(code, pattern)).alias(name) for name, pattern in uses.items()]


def describe_files(files: DataFrame) -> DataFrame:
    """Per-file record in one pass over the text: cleaned code, flags, line count, traces of
    social platforms and the characters a reader would be shown.

    ``is_obfuscated`` follows the decoder: suspicion alone is not enough, one literal must
    decode. Files of every size are treated alike.
    """
    raw, code = F.col("raw"), F.col("code")
    tested = files.select("ext_id", "path", "raw", is_minified(raw).alias("is_minified"), is_obfuscated(raw).alias("indicated"))
    cleaned = tested.select(
        "ext_id", "path", ((F.col("indicated") | F.col("is_minified")) & has_decodable(raw)).alias("is_obfuscated"), "is_minified",
        F.size(F.split(raw, "\n")).alias("line_count"), strip_comments(raw).alias("code"))
    return cleaned.select("*", *usage_flags(code), platform_bits(code).alias("platform_bits"),
                          F.length(trim_all(code)).cast("bigint").alias("shown_chars"))


def platform_bits(code: Column) -> Column:
    """One bit per social platform traced in the code."""
    bits = F.lit(0)
    for i, traces in enumerate(D.PLATFORM_TRACES.values()):
        bits = bits + F.when(any_of(code.contains(t) for t in traces), 1 << i).otherwise(0)
    return bits


def grep_signals(files: DataFrame) -> DataFrame:
    """Raw-text signals per file: label with count, line of the first hit and a snippet.

    All patterns are literals inside one array, so the file text is read once and no regex is recompiled per row. A pattern
    is matched only in texts that hold the characters which every match needs; most texts hold few of them.
    """
    raw, lowered = F.col("raw"), F.col("lowered")

    def one(label: str, severity: str, pattern: str, root: str | None) -> Column:
        hits = count_hits(raw, pattern)
        first = F.regexp_extract(raw, js(pattern), 0)
        title = F.concat(F.lit(f"[{severity.upper()}] {label}"),
                         F.when(hits > 1, F.concat(F.lit(" ("), hits.cast("string"), F.lit("x)"))).otherwise(F.lit("")))
        at = F.regexp_instr(raw, F.lit(js(pattern)))
        start = F.greatest(at - 20, F.lit(1))
        around = F.substring(raw, start, at + F.length(first) + 60 - start)
        # nested, so that nothing of it is computed before the first test
        return F.when(may_hold(raw, lowered, pattern), F.when(
            hits > 0,
            F.struct(
                title.alias("label"), F.lit(label).alias("signal"), F.lit(severity).alias("severity"),
                F.lit(root).cast("string").alias("root"), hits.cast("bigint").alias("hits"),
                line_at(raw, at).alias("line"),
                F.substring(F.trim(F.regexp_replace(around, "\n", " ")), 1, 120).alias("snippet"),
            ),
        ))

    found = F.array(*[one(*row) for row in S.GREP_SIGNALS])
    return files.withColumn("lowered", F.lower("raw")).select(
        "ext_id", "path",
        F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s"),
    ).select("ext_id", "path", "s.*")


# --- encoded literals -----------------------------------------------------------------

def _printable(text: Column) -> Column:
    return F.when(text.rlike(S.PRINTABLE), text)


def _inner(body: Column) -> Column:
    return F.substring(body, F.lit(2), F.length(body) - 2)


def _from_char_codes(body: Column) -> Column:
    codes = F.transform(F.split(body, ","), lambda c: F.trim(F.regexp_replace(c, r"\s", "")).try_cast("int"))
    usable = F.filter(codes, lambda c: c.isNotNull() & (c >= 0) & (c < 65536))
    return _printable(F.array_join(F.transform(usable, F.char), ""))


def _from_eval(body: Column) -> Column:
    inner = _inner(body)
    return F.when(~inner.contains("eval"), inner)


# --- fixed values: method, pattern, group; with the decoder of each -----------------------
_ENCODED: list[tuple[str, str, int, Callable[[Column], Column]]] = [
    ("base64", S.BASE64_CALL, 1, lambda body: _printable(decode_base64(body))),
    ("hex", r"\"(?:\\x[0-9a-fA-F]{2}){3,}\"|'(?:\\x[0-9a-fA-F]{2}){3,}'", 0,
     lambda body: F.decode(F.unhex(F.regexp_replace(body, r"\\x|[\"']", "")), "ISO-8859-1")),
    ("unicode", r"\"(?:\\u[0-9a-fA-F]{4}){3,}\"|'(?:\\u[0-9a-fA-F]{4}){3,}'", 0,
     lambda body: F.decode(F.unhex(F.regexp_replace(body, r"\\u|[\"']", "")), "UTF-16BE")),
    ("char_codes", S.CHAR_CODES, 1, _from_char_codes),
    ("eval_body", r"eval\s*\(\s*(\"[^\"\n]*\"|'[^'\n]*')\s*\)", 1, _from_eval),
]
CAN_DECODE = r"atob|\\x|\\u|fromCharCode|eval"


def decoded_literals(files: DataFrame) -> DataFrame:
    """One row per encoded literal that decodes: method, source text, decoded text."""
    raw = F.col("raw")
    def tagged(method: str, pattern: str, group: int, decoder: Callable[[Column], Column]) -> Column:
        return F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(group)), lambda body: F.struct(
            F.lit(method).alias("method"), body.alias("body"), decoder(body).alias("decoded")))

    found = F.concat(*[tagged(*row) for row in _ENCODED])
    return (
        files.filter(raw.rlike(CAN_DECODE))
        .select("ext_id", "path", F.explode(F.filter(found, lambda e: e["decoded"].isNotNull())).alias("e"))
        .select("ext_id", "path", "e.*")
    )


def has_decodable(raw: Column) -> Column:
    """Whether any encoded literal of the text decodes."""
    def decodes(_: str, pattern: str, group: int, decoder: Callable[[Column], Column]) -> Column:
        return F.exists(F.regexp_extract_all(raw, F.lit(pattern), F.lit(group)), lambda body: decoder(body).isNotNull())

    return raw.rlike(CAN_DECODE) & F.coalesce(any_of(decodes(*row) for row in _ENCODED), F.lit(False))


def obfuscation_counts(files: DataFrame) -> DataFrame:
    """Obfuscated-file count and flag per package."""
    return files.groupBy("ext_id").agg(
        F.count_if("is_obfuscated").alias("obfuscated_files"),
        F.bool_or("is_obfuscated").alias("has_obfuscation"))


def character_entropy(texts: DataFrame, text: str) -> DataFrame:
    return texts.withColumn("entropy", entropy(F.col(text)))

