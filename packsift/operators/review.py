"""Reading reviewers' answers: labelled text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: labels and accepted values -----------------------------------------------
VERDICTS = {"maliciosa": "malicious", "sospechosa": "suspicious", "benigna": "benign"}
LEVELS = {"bajo": "low", "medio": "medium", "alto": "high", "critico": "critical"}
VALUES = {"si": "yes", "posible": "possible", "no_detectado": "no"}
_ANSWERS = r"(?is)RESPUESTAS\s*:\s*(\{.*?\})\s*$"


def _one_of(word: Column, names: dict[str, str], default: str) -> Column:
    low = F.lower(word)
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in names.items()], F.lit(default))


def strip_markup(text: Column) -> Column:
    """Text without emphasis, headings, bullets, quotes, code, rules and emoji."""
    steps = [
        (r"\*{1,3}([^*]+)\*{1,3}", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[-*]\s+", ""),
        (r"(?m)^>\s+", ""), (r"`{1,3}[^`]*`{1,3}", ""), (r"(?m)^-{3,}$", ""),
        (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", ""), (r"\n{3,}", "\n\n"),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_reviews(reviews: DataFrame, text: str = "text") -> DataFrame:
    """Purpose, verdict, level, answers and the plain narrative of each review text.

    Unknown or missing values get the defaults suspicious and medium; unreadable answers
    are null.
    """
    raw = F.col(text)
    purpose = F.trim(F.regexp_extract(raw, r"(?im)^PROPOSITO\s*:[ \t]*(.+)$", 1))
    body = raw
    for label in ("PROPOSITO", "VEREDICTO", "RIESGO"):
        body = F.regexp_replace(body, rf"(?im)^{label}\s*:.*$", "")
    body = F.regexp_replace(body, _ANSWERS, "")
    json = F.regexp_extract(raw, _ANSWERS, 1)
    answers = F.from_json(F.when(json != "", json), "map<string, string>")
    value = lambda v: F.coalesce(F.get_json_object(v, "$.valor"), v)
    return reviews.select(
        *[c for c in reviews.columns if c != text],
        F.when(purpose == "", "audit completed").otherwise(purpose).alias("purpose"),
        _one_of(F.regexp_extract(raw, r"(?im)^VEREDICTO\s*:\s*(\w+)\s*$", 1), VERDICTS, "suspicious").alias("review_verdict"),
        _one_of(F.regexp_extract(raw, r"(?im)^RIESGO\s*:\s*(\w+)\s*$", 1), LEVELS, "medium").alias("review_level"),
        F.transform_values(answers, lambda k, v: _one_of(value(v), VALUES, "no")).alias("answers"),
        strip_markup(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("narrative"))


def without_thoughts(text: Column) -> Column:
    """Text without closed or unclosed think blocks and leading question marks."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    opened = F.regexp_replace(closed, r"(?s)<think>.*", "")
    return F.regexp_replace(F.regexp_replace(opened, r"^\?+\.?\s*", ""), r"^\s+|\s+$", "")


def recover_json(text: Column) -> Column:
    """JSON text out of a fenced or chatty answer, null when there is none."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    for pattern in (r"(?i)^```json\s*", r"(?i)^```\s*", r"\s*```$"):
        clean = F.regexp_replace(clean, pattern, "")
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    inner = F.regexp_extract(clean, r"(?s)\{.*\}|\[.*\]", 0)
    return F.coalesce(F.to_json(F.try_parse_json(clean)), F.to_json(F.try_parse_json(F.nullif(inner, F.lit("")))))
