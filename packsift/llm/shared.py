"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows up to which a table is broadcast by hand; beyond it Spark plans the join itself.
BROADCAST_ROWS = 500_000


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The own columns, and all others in one struct ``rest``, so that their names cannot clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*others) if others else F.lit(None).cast("int")).alias("rest"))


def unpacked(rows: DataFrame, columns: list[str], *added: str, **changed: Column) -> DataFrame:
    """The columns as they were before ``packed`` (some changed), then the added ones, which replace columns of their name."""
    rest = getattr(rows.schema["rest"].dataType, "names", [])
    keep = [changed.get(c, F.col(f"rest.`{c}`") if c in rest else F.col(f"`{c}`")).alias(c) for c in columns if c not in added]
    return rows.select(*keep, *added)


def small(df: DataFrame) -> DataFrame:
    """A table marked for broadcast if it has at most ``BROADCAST_ROWS`` (narrow) rows; staged, so counted once."""
    table = cut_lineage(df)
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """The staged table in the order of columns, with its place: ``_pid`` and ``_idx`` (place within the range).

    Ranges are split by the data, so a key that all columns of ``order`` tell apart never piles up in one task.
    """
    place = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    return cut_lineage(rows).withColumns({
        "_pid": F.shiftright("_place", 33).cast("int"), "_idx": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_place")


def offsets(df: DataFrame, weight: Column, *kinds: str) -> DataFrame:
    """Per ``_pid`` (and kind): the weight of all earlier ranges. One row per range, so it is broadcast."""
    sums = df.groupBy("_pid", *kinds).agg(F.sum(weight).alias("_w"))
    window = Window.partitionBy(*kinds).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_pid", *kinds, F.coalesce(F.sum("_w").over(window), F.lit(0)).alias("_offset")))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """The staged table with ``_rank``, from 0 in the order of columns."""
    rows = ordered(df, *order)
    return rows.join(offsets(rows, F.lit(1)), "_pid").withColumn("_rank", F.col("_idx") + F.col("_offset")).drop("_pid", "_idx", "_offset")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by links (a, b). Nodes without links are left out.

    Labels move along links and then jump to their label's label, so rounds grow with the logarithm of a chain.
    The loop ends when no label falls; every round is staged.
    """
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = cut_lineage(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        onward = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut_lineage(hooked.join(onward, "label", "left").select("node", "old", F.least("label", "next").alias("label")))
        if labels.filter("label < old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("old")


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)  # a random value per byte
_STEP = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)  # and an odd factor per place in a word


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow text column (null: empty), without Python strings."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and at[-1] else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds a MB of text, or one long text."""
    for batch in batches:
        _, at = buffer(batch[column])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows, for rows that hold whole sets: Spark fills a batch up to many MB, and Python copies it."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and row bounds of all words of a text buffer.

    ``inside`` tells by byte what belongs to a word, ``fold`` maps bytes (lower case). Words end at row ends.
    The row bounds say which words belong to a row: ``bounds[i]`` to ``bounds[i + 1]``.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    use = inside[data]
    first = use.copy()
    first[1:] &= ~use[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] |= use[edge]
    last = use.copy()
    last[:-1] &= ~use[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] |= use[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    total = np.zeros(len(start), np.uint64)
    for a in range(0, len(start), 1 << 15):  # some words at a time: a byte of them takes fifty here
        some, n = start[a:a + (1 << 15)], size[a:a + (1 << 15)]
        where = np.flatnonzero(use[some[0]:some[-1] + n[-1]]) + some[0]
        value = _BYTE[fold[data[where]]] * _STEP[(where - np.repeat(some, n)) & 4095]
        total[a:a + (1 << 15)] = np.add.reduceat(value, np.cumsum(n) - n)
    return start, end, mix(total + size.astype(np.uint64)), np.searchsorted(start, at)
