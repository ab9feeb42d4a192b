r"""Decoded code: layers of text that encoded literals hide.

A literal that decodes (base64, escapes, character codes, a text given to ``eval``) is a layer below the text that holds it. Layers
are decoded again until a round finds nothing; a decoded text is shorter than its literal, so the rounds end. Each layer knows
its parent, its depth, its place in the parent and the line of the file it comes from, which is the line of all that is found
in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..functions.text import decode_base64, strip_comments
from ..session import cut_growing, growing
from . import lexical, signals

FILE = ["ext_id", "path"]
#: Statements of layers are numbered from here on within their file.
FIRST_NUMBER = 1 << 32

# --- fixed values: method, pattern, group of the body --------------------------------------
METHODS = [
    ("base64", S.BASE64_CALL, 1),
    ("hex", r"\"(?:\\x[0-9a-fA-F]{2}){3,}\"|'(?:\\x[0-9a-fA-F]{2}){3,}'", 0),
    ("unicode", r"\"(?:\\u[0-9a-fA-F]{4}){3,}\"|'(?:\\u[0-9a-fA-F]{4}){3,}'", 0),
    ("char_codes", S.CHAR_CODES, 1),
    ("eval_body", r"eval\s*\(\s*(\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+')\s*\)", 1),
]
#: What makes a decoded text code; other texts are the contents of a string.
CODE = r"[(=;{]"


def _unescaped(quoted: Column) -> Column:
    """The text of a quoted literal."""
    text = F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("\\\\"), F.lit("\x01"))
    for escape, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'")):
        text = F.replace(text, F.lit(escape), F.lit(plain))
    return F.replace(text, F.lit("\x01"), F.lit("\\"))


def _decoded(method: Column, body: Column) -> Column:
    plain = decode_base64(body)
    escapes = F.regexp_replace(body, r"\\[xu]|[\"']", "")
    codes = F.transform(F.split(body, ","), lambda c: F.trim(F.regexp_replace(c, r"\s", "")).try_cast("int"))
    usable = F.filter(codes, lambda c: c.isNotNull() & (c >= 0) & (c < 65536))
    chars = F.array_join(F.transform(usable, F.char), "")
    return (F.when((method == "base64") & plain.rlike(S.PRINTABLE), plain)
            .when(method == "hex", F.decode(F.unhex(escapes), "ISO-8859-1"))
            .when(method == "unicode", F.decode(F.unhex(escapes), "UTF-16BE"))
            .when((method == "char_codes") & chars.rlike(S.PRINTABLE), chars)
            .when(method == "eval_body", _unescaped(body)))


def _feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _round(texts: DataFrame) -> DataFrame:
    """The layers right below some texts (file, layer, depth, line, text; line is null for a file itself)."""
    size = lambda t: F.struct(F.length(t).alias("n"), _feeds(t).alias("feeds"))
    hits = []
    for method, pattern, group in METHODS:
        found = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
        # each array is built once; positions come from the lengths of what lies between the matches
        rows = F.arrays_zip(F.transform(found(0), size).alias("match"), found(group).alias("body"), F.transform(F.split("text", pattern, -1), size).alias("gap"))
        hits.append(F.transform(F.filter(rows, lambda r: r["body"].isNotNull()), lambda r: F.struct(F.lit(method).alias("method"), r["match"].alias("match"), r["body"].alias("body"), r["gap"].alias("gap"))))
    rows = texts.filter(F.col("text").rlike(signals.CAN_DECODE)).select(*FILE, "layer", "depth", "line", F.posexplode(F.concat(*hits)).alias("pos", "h"))
    rows = rows.select(*FILE, "layer", "depth", "line", "pos", "h.*")
    so_far = Window.partitionBy(*FILE, "layer", "method").orderBy("pos")
    before = lambda field: F.sum(f"gap.{field}").over(so_far) + F.sum(f"match.{field}").over(so_far) - F.col(f"match.{field}")
    rows = rows.withColumns({"number": F.row_number().over(so_far) - 1, "offset": before("n") + 1, "at": before("feeds") + 1})
    rows = rows.withColumn("decoded", _decoded(F.col("method"), F.col("body"))).filter(F.col("decoded").isNotNull())
    text = F.when((F.col("method") == "eval_body") | F.col("decoded").rlike(CODE), F.col("decoded")).otherwise(F.concat(F.lit('"'), "decoded", F.lit('"')))
    name = F.concat_ws("/", F.when(F.col("layer") != "", F.col("layer")), F.concat("method", F.lit("."), F.col("number").cast("string")))
    return rows.select(*FILE, name.alias("layer"), F.col("layer").alias("parent"), (F.col("depth") + 1).alias("depth"), "method", "offset",
                       F.coalesce("line", "at").cast("int").alias("line"), "decoded", text.alias("text"))


def layers(files: DataFrame) -> DataFrame:
    """All layers of files (ext_id, path, raw): layer (the way to it), parent, depth, method, offset, line, decoded and text."""
    texts = files.select(*FILE, F.lit("").alias("layer"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("line"), F.col("raw").alias("text"))
    found = cut_growing(_round(texts))
    every = found
    while not found.isEmpty():
        found = cut_growing(_round(found.select(*FILE, "layer", "depth", "line", "text")))
        every = growing(every.unionByName(found))
    return every


def layer_lines(found: DataFrame) -> DataFrame:
    """Lines of decoded literals, each with the number of the file's line. What is given to eval stands in its parent as it is."""
    texts = found.filter("method <> 'eval_body'").select(*FILE, F.col("line").alias("origin"), strip_comments("text").alias("code"))
    return lexical.code_lines(texts).select(*FILE, F.col("origin").alias("line"), "text")


def layer_statements(found: DataFrame) -> DataFrame:
    """Statements of all layers, with the line of the file and numbers of their own."""
    inside = lexical.statements(found.select(*FILE, "layer", F.col("line").alias("origin"), strip_comments("text").alias("code")))
    order = Window.partitionBy(*FILE).orderBy("layer", "line", "stmt_no")
    return inside.withColumn("stmt_no", F.row_number().over(order) + F.lit(FIRST_NUMBER)).drop("line", "layer").withColumnRenamed("origin", "line")


def layer_flags(found: DataFrame) -> DataFrame:
    """Per file with layers: the usage flags of the code in them."""
    flags = signals.usage_flags(strip_comments("text"))
    rows = found.select(*FILE, *flags)
    names = [c for c in rows.columns if c not in FILE]
    return rows.groupBy(*FILE).agg(*[F.bool_or(c).alias(f"layer_{c}") for c in names])
