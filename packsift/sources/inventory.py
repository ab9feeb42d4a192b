"""File inventory of unpacked packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..functions.paths import resource_type
from ..functions.text import is_minified


def inventory(files: DataFrame) -> DataFrame:
    """Type, size, line count and minified flag per file.

    Expects ext_id, path, size_bytes and text (null for binary files).
    """
    kind = resource_type(F.col("path"))
    text = F.when(kind.isin("javascript", "html", "json", "css"), F.col("text"))
    return (
        files.filter(~F.col("path").rlike(S.SKIPPED_DIRS))
        .select(
            "ext_id", "path", kind.alias("type"), "size_bytes",
            (kind.isin("javascript", "css") & F.coalesce(F.length(text) > 0, F.lit(False))
             & F.coalesce(is_minified(text), F.lit(False))).alias("is_minified"),
            F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(F.lit(0)).alias("line_count"),
        )
    )


def nested_archives(files: DataFrame) -> DataFrame:
    return files.filter(F.col("type") == "archive")
