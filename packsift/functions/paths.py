"""Package path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import signals as S


def parent_of(path: Column) -> Column:
    """Folder of a path, empty at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..``; a ``..`` above the root is kept in front."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.lit("..")

    def step(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.element_at(done, -1) != up)
        return F.when(
            (part == up) & F.coalesce(can_pop, F.lit(False)),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(part)))

    joined = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    return F.array_join(joined, "/")


def resolve(folder: Column, target: Column) -> Column:
    """Path of a reference made from a file in ``folder``; query strings are dropped."""
    clean = F.regexp_replace(F.regexp_replace(target, r"\?.*$", ""), r"\\", "/")
    joined = F.when(folder == "", clean).otherwise(F.concat(folder, F.lit("/"), clean))
    return F.when(clean.startswith("/"), F.substr(clean, F.lit(2))).otherwise(normalise(joined))


def is_local(target: Column) -> Column:
    return target.startswith(".") | target.startswith("/") | target.rlike(S.LOCAL_FILE)


def manifest_path(value: Column) -> Column:
    """Manifest reference as a package path; null for remote or empty values."""
    return F.when(
        (value != "") & ~value.rlike(r"(?i)^https?://"),
        F.regexp_replace(F.regexp_replace(value, r"^/", ""), r"\\", "/"),
    )


def suffixes(path: Column, separator: str) -> Column:
    """All suffixes at a separator, the whole value first: a/b/c -> [a/b/c, b/c, c]."""
    n = F.size(F.split(path, separator, -1)) if separator != "." else F.size(F.split(path, r"\."))
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.call_function("substring_index", path, F.lit(separator), i - n))


def resource_type(path: Column) -> Column:
    return F.coalesce(*[F.when(path.rlike(p), F.lit(t)) for t, p in S.RESOURCE_TYPES], F.lit("other"))


def safe_name(name: Column) -> Column:
    """File name reduced to safe characters."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"[^a-zA-Z0-9._-]", "_")
