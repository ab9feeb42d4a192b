"""Line deduplication by a suffix array over line ids.

A document is a sequence of its lines that hold a word. A run of consecutive lines with ``min_words`` words or more that
also occurs earlier (in a smaller doc_id, or before in the same document) is a later copy, and its lines go.

1. Lines get ranks in the order of their 128-bit ids. Lines that occur once end a sequence: no repeated run crosses
   them, so only stretches of repeated lines with enough words go on.
2. Prefix doubling: a suffix is ranked by its first line, then by its first 2, 4, 8 ... lines. Each round groups the
   pairs (rank, rank that many lines on), ranks the distinct pairs over sorted ranges with running totals, and joins the
   ranks back. A run needs at most ``min_words`` lines, so the rounds are few whatever the data.
3. Suffixes of equal rank are one class. Classes whose first lines reach ``min_words`` alike are neighbours in the array;
   the longest common prefixes of neighbours split them into intervals, each a repeated run of a given length.
4. In each interval all but the earliest suffix are later copies: their lines are deleted.

Step 3 looks, for every suffix, at the shortest prefix with enough words, and at all prefixes that have enough words only
with their first line. Their union covers exactly the lines of all maximal repeated runs: a line of such a run lies in the
shortest prefix that starts at it or, near the end of the run, in one of the others.

Frequent lines and passages are rows in hash groups that are summed before they move; classes keep one row each.

Nulls: a null text stays null (0 lines). Blank lines stay and count for nothing. Rows that agree in id and text count as
one document and get the same result; equal ids with different texts are told apart by the text's hash; null ids come first. An empty table gives
an empty result.
Columns ``n_lines`` and ``n_deleted`` of the input are replaced; other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import offsets, ordered, packed, small, unpacked

HAS_WORD = r"[^\x09-\x0D\x20]"
_KEY = ["doc", "h"]


def _document(prefix: str = "") -> dict[str, Column]:
    """What names a document: its id (null: the smallest number) and the hash of its text."""
    return {f"{prefix}doc": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), f"{prefix}h": F.xxhash64("text")}


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, h, s (place among lines with words), id1, id2, w (words) and uid (the row) of every line that holds a word."""
    kept = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(HAS_WORD))
    rows = docs.filter("text IS NOT NULL").withColumns({**_document(), "uid": F.monotonically_increasing_id()}).select(*_KEY, "uid", F.posexplode(kept).alias("s", "line"))
    return rows.select(*_KEY, "s", F.xxhash64("line").alias("id1"), F.xxhash64(F.lit(1), "line").alias("id2"),
                       F.size(F.regexp_extract_all("line", F.lit(f"({HAS_WORD}+)"), 0)).alias("w"), "uid")


def _once(lines: DataFrame) -> DataFrame:
    """The lines of one row of each document, of those that agree in id and text."""
    again = lines.filter("s = 0").groupBy(*_KEY).agg(F.min("uid").alias("kept"), F.count("*").alias("n")).filter("n > 1").select(*_KEY, "kept")
    return lines.join(small(again), _KEY, "left").filter("kept IS NULL OR uid = kept").drop("uid", "kept")


def _named(rows: DataFrame, *key: str) -> DataFrame:
    """key and rank: how many rows have a smaller key. One row per distinct key with more rows than none."""
    counts = ordered(rows, *key)
    before = F.sum("n").over(Window.partitionBy("_pid").orderBy("_idx")) - F.col("n")
    return cut_lineage(counts.withColumn("before", before).join(offsets(counts, F.col("n")), "_pid").select(
        *key, (F.col("before") + F.col("_offset")).alias("rank")))


def suffix_ranks(rows: DataFrame, depth: int) -> DataFrame:
    """Ranks of suffixes by their first ``depth`` lines or more, from ranks of lines (doc, h, seg, s, rank, ...)."""
    step, classes = 1, -1
    while step < depth:
        order = Window.partitionBy(*_KEY, "seg").orderBy("s")
        paired = cut_lineage(rows.withColumn("later", F.coalesce(F.lead("rank", step).over(order), F.lit(-1))))
        names = _named(paired.groupBy("rank", "later").agg(F.count("*").alias("n")).withColumnRenamed("rank", "r"), "r", "later")
        rows = cut_lineage(paired.withColumnRenamed("rank", "r").join(names, ["r", "later"]).drop("r", "later"))
        step *= 2
        found = names.count()
        if found == classes:  # no class has split: all are as deep as they will ever be
            break
        classes = found
    return rows


def _depths(w: list[int], least: int) -> list[int]:
    """Prefix lengths to look at: the shortest with ``least`` words, and those that have them only with their first line."""
    out, total = [], 0
    for d, n in enumerate(w, 1):
        total += n
        if total >= least and (not out or total - w[0] < least):
            out.append(d)
    return out


def _intervals(ids: list[list[int]], depths: list[list[int]], first: list[tuple]) -> list[int]:
    """Per class of a cluster in the order of the array: the longest run that also occurs before its earliest suffix, or 0."""
    common = []
    for a, b in zip(ids, ids[1:]):
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        common.append(n)
    best = [0] * len(ids)
    for d in sorted({d for x in depths for d in x}):
        left = 0
        for right in range(1, len(ids) + 1):
            if right == len(ids) or common[right - 1] < d:
                least = min(first[left:right])
                for c in range(left, right):
                    if first[c] > least and d in depths[c]:
                        best[c] = d
                left = right
    return best


def later_runs(classes: DataFrame, least: int) -> DataFrame:
    """rank, all_depth (lines to delete at every suffix of the class but its earliest) and first_depth (at that one)."""
    def split(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            depths = [_depths(w, least) for w in batch["ws"].to_pylist()]
            cluster = [hash(tuple(x[:d[0]])) if d else None for x, d in zip(batch["ids"].to_pylist(), depths)]
            yield pa.RecordBatch.from_arrays([*batch.select(["rank", "doc", "h", "s", "ids"]).columns, pa.array(depths, pa.list_(pa.int32())), pa.array(cluster, pa.int64())],
                                             ["rank", "doc", "h", "s", "ids", "depths", "cluster"])

    def emit(held):
        best = _intervals([x["ids"] for x in held], [x["depths"] for x in held], [(x["doc"], x["h"], x["s"]) for x in held])
        return pa.RecordBatch.from_arrays([
            pa.array([x["rank"] for x in held], pa.int64()), pa.array([x["depths"][-1] for x in held], pa.int32()), pa.array(best, pa.int32())],
            ["rank", "all_depth", "first_depth"])

    def scan(batches: Iterator[pa.RecordBatch]):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                # a cluster shares its first lines, so it is contiguous in the order of ranks
                if held and row["ids"][:held[0]["depths"][0]] != held[0]["ids"][:held[0]["depths"][0]]:
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    schema = "rank long, doc long, h long, s int, ids array<long>, depths array<int>, cluster long"
    rows = classes.mapInArrow(split, schema).filter("size(depths) > 0")
    return rows.repartition("cluster").sortWithinPartitions("rank").mapInArrow(scan, "rank long, all_depth int, first_depth int")


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc, h and s of every line that belongs to a later copy of a run."""
    lines = _once(cut_lineage(lines_of(docs)))
    counts = lines.groupBy("id1", "id2").agg(F.count("*").alias("n")).filter("n > 1")
    ranks = _named(counts, "id1", "id2")
    active = lines.join(ranks, ["id1", "id2"]).select(*_KEY, "s", "w", "rank")
    order = Window.partitionBy(*_KEY).orderBy("s")
    stretch = Window.partitionBy(*_KEY, "seg")
    rows = active.withColumn("seg", F.col("s") - F.row_number().over(order))
    rows = cut_lineage(rows.withColumn("words", F.sum("w").over(stretch)).filter(F.col("words") >= min_words).drop("words").withColumn("line", F.col("rank")))
    ahead = stretch.orderBy("s").rowsBetween(0, min_words - 1)
    sorted_rows = suffix_ranks(rows, min_words)
    classes = sorted_rows.groupBy("rank").agg(F.min(F.struct("doc", "h", "s")).alias("first"))
    classes = cut_lineage(classes.select("rank", "first.doc", "first.h", "first.s"))
    content = sorted_rows.withColumns({"ids": F.collect_list("line").over(ahead), "ws": F.collect_list("w").over(ahead)})
    content = content.join(classes.select(*_KEY, "s"), [*_KEY, "s"], "left_semi").select("rank", *_KEY, "s", "ids", "ws")
    runs = cut_lineage(later_runs(content, min_words))
    first = cut_lineage(classes.join(runs, "rank").select("rank", F.col("doc").alias("d0"), F.col("h").alias("h0"), F.col("s").alias("s0"), "all_depth", "first_depth"))
    copies = sorted_rows.join(first, "rank").withColumn(
        "depth", F.when((F.col("doc") == F.col("d0")) & (F.col("h") == F.col("h0")) & (F.col("s") == F.col("s0")), F.col("first_depth")).otherwise(F.col("all_depth")))
    return copies.filter("depth > 0").select(*_KEY, F.explode(F.expr("sequence(s, s + depth - 1)")).alias("s")).distinct()


def deduplicated(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All columns of the documents with ``text`` cut, and ``n_lines`` and ``n_deleted`` (lines)."""
    found = repeated_lines(docs, min_words).groupBy(*_KEY).agg(F.sort_array(F.collect_list("s")).alias("_gone"))
    found = cut_lineage(found.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), "_gone"))
    own = [c for c in ("doc_id", "text") if c in docs.columns]
    rows = packed(docs, *own).withColumns(_document("_")).join(found.hint("shuffle_hash"), ["_doc", "_h"], "left")
    spoken = F.expr(f"filter(sequence(0, size(_lines) - 1), k -> _lines[k] rlike '{HAS_WORD}')".replace("\\", "\\\\"))
    kept = F.array_except(F.expr("sequence(0, size(_lines) - 1)"), F.expr("transform(_gone, k -> _spoken[k])"))
    cut = F.array_join(F.transform(kept, lambda k: F.col("_lines")[k]), "\n")
    rows = rows.withColumn("_lines", F.split(F.col("text"), "\n", -1)).withColumn("_spoken", F.when(F.col("_gone").isNotNull(), spoken))
    rows = rows.withColumns({"text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut),
                             "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines")), F.lit(0)).cast("long"),
                             "n_deleted": F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long")})
    return unpacked(rows, docs.columns, "n_lines", "n_deleted")
