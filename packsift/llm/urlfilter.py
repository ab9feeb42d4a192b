"""URL filters: domain and path rules, and a weighted vocabulary searched by an Aho-Corasick automaton.

Rules (host, path, verdict) fit a host and all its subdomains where the path of the URL starts with the rule's; the
longest rule wins. URLs without a rule are judged by vocabulary: terms are counted in the lower-cased URL where no letter
or digit stands before or after. One strict term, or distinct soft terms with a weight of ``SOFT_LIMIT`` together, reject.

Nulls and URLs without ``://`` have an empty host and path; a null URL holds no terms and is allowed. Rows keep all
columns (those named like an added one are replaced), so repeated rows and extra columns pass through. An empty table gives an empty result.
URLs of any length are read whole. Two rules that fit one URL with equal length would be the same rule, so there are no ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import packed, unpacked

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
STRICT = ["casino", "porn", "xxx", "viagra", "pills", "escort", "malware", "phishing", "spam"]
SOFT = {"cheap": 1, "win": 1, "free": 1, "bet": 1, "bets": 1, "bonus": 1, "ads": 1, "track": 1, "click": 1, "deal": 1, "sale": 1, "farm": 1, "loan": 1,
        "prize": 1, "adult": 1, "dating": 1, "crack": 1, "torrent": 1}
SOFT_LIMIT = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name = verdict = None
    for site, start, said in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        name = F.when(fits, F.lit(site + start)) if name is None else name.when(fits, F.lit(site + start))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return name, verdict


class Vocabulary:
    """Strict terms and soft terms with weights, in one automaton."""

    def __init__(self, strict: list[str], soft: dict[str, int]):
        self.automaton = ahocorasick.Automaton()
        for term in strict:
            self.automaton.add_word(term, (term, True, 0))
        for term, weight in soft.items():
            self.automaton.add_word(term, (term, False, weight))
        self.automaton.make_automaton()

    def count(self, url: str | None) -> tuple[int, int, int]:
        """Strict hits, distinct soft terms and their weight."""
        url = (url or "").lower()
        strict, soft = 0, {}
        for end, (term, is_strict, weight) in self.automaton.iter(url):
            before, after = end - len(term), end + 1
            if before >= 0 and url[before].isalnum() or after < len(url) and url[after].isalnum():
                continue
            if is_strict:
                strict += 1
            else:
                soft[term] = weight
        return strict, len(soft), sum(soft.values())


def judged(pages: DataFrame, strict=tuple(STRICT), soft=None, limit: int = SOFT_LIMIT) -> DataFrame:
    """All columns, host, path, rule, strict_hits, soft_terms and verdict."""
    soft = SOFT if soft is None else soft
    rows = packed(pages, "url")

    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary = Vocabulary(list(strict), soft)
        for batch in batches:
            found = [vocabulary.count(u) for u in batch["url"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[i] for f in found], pa.int32()) for i in range(3)]],
                                             ["url", "rest", "strict_hits", "soft_terms", "weight"])

    kinds = [StructField(c, IntegerType()) for c in ("strict_hits", "soft_terms", "weight")]
    rows = rows.mapInArrow(run, StructType([*rows.schema, *kinds])).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, said = rule(F.col("host"), F.col("path"))
    method = F.when((F.col("strict_hits") > 0) | (F.col("weight") >= limit), "block").otherwise("allow")
    rows = rows.withColumns({"rule": name, "verdict": F.coalesce(said, method)})
    return unpacked(rows, pages.columns, "host", "path", "rule", "strict_hits", "soft_terms", "verdict")
