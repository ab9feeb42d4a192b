"""Ranked lexical search by hashed max-sketches.

The impact of a term on a document is what it adds to the score of a query that holds it. In a document's sketch every term falls
into one coordinate by its hash, and a coordinate keeps the greatest impact that falls into it, rounded up to 16 bits. Sketches
have ``SPARE`` coordinates or more a distinct term, so texts of every length are as empty, and only coordinates that hold something
are stored. A query looks its terms up; the sum is never below the score, whatever else fell into these coordinates.

1. One pass counts terms, documents and, by term, the documents that hold it. The most frequent terms, ``WEIGHTS`` at most, go
   to all tasks with their weights; other terms take the greatest weight there is, which only loosens bounds.
2. A second pass folds every document into its sketch. The sketches are staged, and queries read them instead of the texts.
3. Queries come in batches (``BATCH`` items). All terms of a batch are looked up in all sketches at once, as a product of
   the looked-up impacts and the matrix of terms and items. The bounds are first counted by size, so that one knows the bound above
   which a number of documents lies.
4. Documents are scored exactly in the order of their bounds: for each item some hundred first, then eight times as many each
   round. The k-th best score so far is the threshold. An item is done when no document with a bound at or above its threshold
   is left; equal scores count, as the smaller id wins. Nothing is left out, so the result is that of scoring everything.

Scores are 64-bit integers as given by the formula in ``part`` and ``weight``. Terms are known by 64-bit hashes.

A null text has no terms; texts and items without terms find nothing. Every row is a document of its own, also one that repeats
another; rows with a null id count in the statistics and are not ranked. Items that agree in id and text are one; an id with
several texts is several items; a null item id stays. Ties go to the smaller doc_id. Further columns are not read. Empty tables give an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import BROADCAST_ROWS, buffer, chunks, words

WEIGHTS = 1 << 20
BATCH = 512  # items
SPARE, LEAST_WIDTH = 32, 1024
TOP = (1 << 16) - 1  # the greatest impact of a sketch
ROOM = 1 << 22  # coordinates laid out at a time
FLUSH = 2_000_000  # words that a task gathers before it passes counts on
BINS = 1024
STEP = 2048  # terms looked up at a time
SCALE = 1_000_000_000

_INSIDE = np.ones(256, bool)
_INSIDE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct term of each text, sorted by row and hash; and the terms of each text."""
    data, at = buffer(texts)
    _, _, h, bounds = words(data, at, _INSIDE, _FOLD)
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.append(first, len(h))), size


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds, besides its weight, to the score of a document of relative length m."""
    return SCALE * tf // (1000 * tf + 20 * m)


class Statistics:
    """N, L and the weights of the most frequent terms."""

    def __init__(self, documents: int, total: int, terms: np.ndarray, holding: np.ndarray):
        self.documents, self.total = documents, total
        known = {int(n): weight(documents, int(n)) for n in np.unique(holding)}
        order = np.argsort(terms)
        self.terms = terms[order]
        self.weights = np.array([known[int(n)] for n in holding[order]], np.int64)
        self.most = max(weight(documents, 1), 1) if documents else 1  # of any term that a document holds
        self.unit = -(-self.most * (SCALE // 1000) // TOP)  # impacts stay below weight * 10 ** 6

    def lengths(self, size: np.ndarray) -> np.ndarray:
        return np.array([50 + 50 * n * self.documents // max(self.total, 1) for n in size.tolist()], np.int64)

    def bounded(self, h: np.ndarray) -> np.ndarray:
        """Weights, or what they are at most."""
        if not len(self.terms):
            return np.full(len(h), self.most)
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[place] == h, self.weights[place], self.most)


def term_counts(docs: DataFrame) -> DataFrame:
    """kind 0: a term and the documents that hold it; kind 1: documents with terms; kind 2: all terms with repeats."""
    def send(held, full, total):
        term, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([
            pa.array(np.append(np.zeros(len(n)), [1, 2]).astype(np.int32)), pa.array(np.append(term.view(np.int64), [0, 0])), pa.array(np.append(n, [full, total]))],
            ["kind", "term", "n"])

    def run(batches):
        held, full, total = [], 0, 0
        for batch in chunks(batches, "text"):
            _, h, _, size = terms_of(batch["text"])
            held.append(h)
            full, total = full + int((size > 0).sum()), total + int(size.sum())
            if sum(map(len, held)) >= FLUSH:
                yield send(held, full, total)
                held, full, total = [], 0, 0
        if held:
            yield send(held, full, total)

    return cut_lineage(docs.select("text").mapInArrow(run, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")))


def statistics(counts: DataFrame) -> Statistics:
    whole = {r.kind: r.n for r in counts.filter("kind > 0").collect()}
    top = counts.filter("kind = 0").orderBy(F.desc("n"), "term").limit(WEIGHTS).select("term", "n").toArrow()
    return Statistics(whole.get(1, 0), whole.get(2, 0), top["term"].to_numpy().view(np.uint64), top["n"].to_numpy())


def sketches(docs: DataFrame, stats: Statistics) -> DataFrame:
    """doc_id, h (hash of the text), width, places and impacts of each document with terms; staged."""
    shared = docs.sparkSession.sparkContext.broadcast(stats)

    def run(batches):
        stats = shared.value
        for batch in chunks(batches, "text"):
            row, h, tf, size = terms_of(batch["text"])
            distinct = np.bincount(row, minlength=batch.num_rows)
            width = np.maximum(LEAST_WIDTH, 1 << np.ceil(np.log2(np.maximum(SPARE * distinct, 1))).astype(np.int64))
            place = (h & (width[row] - 1).astype(np.uint64)).astype(np.int64)
            impact = -(-(stats.bounded(h) * part(tf, stats.lengths(size)[row])) // stats.unit)
            order = np.lexsort((-impact, place, row))
            row, place, impact = row[order], place[order], impact[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])) if len(row) else row
            row, place, impact = row[first], place[first], impact[first].astype(np.uint16)
            some = np.flatnonzero(distinct)
            low, high = np.searchsorted(row, some), np.searchsorted(row, some, "right")
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(pa.array(some)), batch["h"].take(pa.array(some)), pa.array(width[some]),
                pa.array([place[a:b].astype(np.uint16 if w <= 1 << 16 else np.uint32).tobytes() for a, b, w in zip(low, high, width[some])], pa.binary()),
                pa.array([impact[a:b].tobytes() for a, b in zip(low, high)], pa.binary())], ["doc_id", "h", "width", "places", "impacts"])

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return cut_lineage(rows.mapInArrow(run, "doc_id long, h long, width long, places binary, impacts binary"))


class Batch:
    """The terms of some items: ``start`` bounds the terms of each in ``place``, which points into the vocabulary."""

    def __init__(self, texts: list[str]):
        row, h, _, _ = terms_of(pa.array(texts, pa.string()))
        self.items = len(texts)
        self.terms, self.place = np.unique(h, return_inverse=True)
        self.start = np.searchsorted(row, np.arange(self.items + 1))
        self.weights = np.zeros(len(self.terms), np.int64)  # of a term that no document holds: 0

    def weigh(self, counts: DataFrame, documents: int) -> None:
        wanted = counts.sparkSession.createDataFrame(pa.table({"term": pa.array(self.terms.view(np.int64))}))
        for r in counts.filter("kind = 0").join(F.broadcast(wanted), "term").select("term", "n").collect():
            self.weights[np.searchsorted(self.terms, np.uint64(r.term % 2**64))] = weight(documents, r.n)

    def bounds(self, table: pa.RecordBatch, unit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, bounds): sums of looked-up impacts, row x item. An impact counts for what the term itself can reach at most,
        if something else has made it greater."""
        item = np.repeat(np.arange(self.items), np.diff(self.start))
        most = (-(-self.weights * (SCALE // 1000) // unit)).astype(np.uint16)
        # sums are whole numbers; single precision holds them up to 2 ** 24
        kind = np.float32 if self.items and int(np.diff(self.start).max()) * TOP < 1 << 24 else np.float64
        order = np.argsort(self.place, kind="stable")
        cuts = np.searchsorted(self.place[order], np.arange(0, len(self.terms) + STEP, STEP))
        matrices = []
        for i in range(len(cuts) - 1):
            mine = order[cuts[i]:cuts[i + 1]]
            matrices.append(np.zeros((len(self.terms[i * STEP:(i + 1) * STEP]), self.items), kind))
            matrices[i][self.place[mine] - i * STEP, item[mine]] = 1
        width, places, impacts = table["width"].to_numpy(), table["places"], table["impacts"]
        for w in np.unique(width).tolist():
            column = (self.terms & np.uint64(w - 1)).astype(np.int64)
            rows = np.flatnonzero(width == w)
            step = max(1, min(1024, ROOM // w))
            for a in range(0, len(rows), step):
                some = rows[a:a + step]
                held = [impacts[int(r)].as_py() for r in some]
                place = np.frombuffer(b"".join(places[int(r)].as_py() for r in some), np.uint16 if w <= 1 << 16 else np.uint32)
                sketch = np.zeros((len(some), w), np.uint16)
                sketch[np.repeat(np.arange(len(some)), [len(x) // 2 for x in held]), place] = np.frombuffer(b"".join(held), np.uint16)
                total = np.zeros((len(some), self.items), kind)
                for i, matrix in enumerate(matrices):
                    part_ = slice(i * STEP, (i + 1) * STEP)
                    total += np.minimum(sketch[:, column[part_]], most[None, part_]).astype(kind) @ matrix
                yield some, total.astype(np.int64)

    def scores(self, h: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
        """Exact scores of one document for all items."""
        value = np.zeros(len(self.terms) + 1, np.int64)
        at = np.searchsorted(self.terms, h)
        held = np.append(self.terms, np.uint64(0))[at] == h
        held &= at < len(self.terms)
        value[at[held]] = self.weights[at[held]] * part(tf[held], m)
        sums = np.concatenate([[0], np.cumsum(value[self.place])])
        return sums[self.start[1:]] - sums[self.start[:-1]]


def bound_counts(table: DataFrame, batch: Batch, unit: int) -> np.ndarray:
    """Documents by item and size of their bound, in ``BINS`` bins of equal width per item."""
    shared = table.sparkSession.sparkContext.broadcast(batch)

    def run(batches):
        batch, total = shared.value, 0
        width = bin_width(batch)
        for rows in batches:
            for _, bound in batch.bounds(rows, unit):
                cell = bound // width[None] + np.arange(batch.items)[None] * BINS
                total = total + np.bincount(cell.ravel(), minlength=batch.items * BINS)
        if np.ndim(total):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    out = np.zeros(batch.items * BINS, np.int64)
    for r in table.select("width", "places", "impacts").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(batch.items, BINS)


def bin_width(batch: Batch) -> np.ndarray:
    return TOP * np.diff(batch.start) // BINS + 1


def within(table: DataFrame, batch: Batch, unit: int, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(doc_id, h, items): the items for which a document's bound is from low up to high (excluded)."""
    shared = table.sparkSession.sparkContext.broadcast(batch)

    def run(batches):
        batch = shared.value
        for rows in batches:
            for some, bound in batch.bounds(rows, unit):
                fits = (bound >= low[None]) & (bound < high[None])
                held = np.flatnonzero(fits.any(1))
                if len(held):
                    items = [np.flatnonzero(fits[i]).tolist() for i in held]
                    at = pa.array(some[held])
                    yield pa.RecordBatch.from_arrays([rows["doc_id"].take(at), rows["h"].take(at), pa.array(items, pa.list_(pa.int32()))], ["doc_id", "h", "items"])

    return table.mapInArrow(run, "doc_id long, h long, items array<int>")


def rescored(docs: DataFrame, candidates: DataFrame, batch: Batch, stats: Statistics) -> DataFrame:
    """(item, doc_id, score) of the candidates with a score above 0, exactly."""
    shared = docs.sparkSession.sparkContext.broadcast(batch)
    documents, total = stats.documents, stats.total

    def run(batches):
        batch = shared.value
        for rows in chunks(batches, "text"):
            row, h, tf, size = terms_of(rows["text"])
            cuts = np.searchsorted(row, np.arange(rows.num_rows + 1))
            out = []
            for i, (doc, items) in enumerate(zip(rows["doc_id"].to_pylist(), rows["items"].to_pylist())):
                span = slice(cuts[i], cuts[i + 1])
                m = 50 + 50 * int(size[i]) * documents // total
                score = batch.scores(h[span], tf[span], m)[items]
                out += [(k, doc, s) for k, s in zip(items, score.tolist()) if s > 0]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    # rows that agree in id and text have one sketch each, so candidates are made distinct before they meet the texts
    wanted = cut_lineage(candidates.dropDuplicates(["doc_id", "h"]))
    if (wanted.agg(F.sum(F.size("items") + 4)).collect()[0][0] or 0) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return texts.join(wanted, ["doc_id", "h"]).select("doc_id", "text", "items").mapInArrow(run, "item int, doc_id long, score long")


def best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def next_bound(above: np.ndarray, width: int, high: int, wanted: int) -> int:
    """The bound down to which no more than the wanted number of further documents lie, or those of one more bin."""
    top = min(high // width, BINS)
    new = above[:top] - (above[top] if top < BINS else 0)
    some = new[new > 0]
    return int(np.argmax(new <= max(wanted, some[-1]))) * width if len(some) else 0


def ranked_batch(docs: DataFrame, table: DataFrame, batch: Batch, stats: Statistics, k: int) -> DataFrame:
    """item, rank, doc_id and score of the k best documents of each item."""
    held = bound_counts(table, batch, stats.unit)
    above = np.cumsum(held[:, ::-1], axis=1)[:, ::-1]  # documents in a bin or in one above it
    width = bin_width(batch)
    high = np.full(batch.items, np.iinfo(np.int64).max)
    threshold = np.ones(batch.items, np.int64)  # no document with a smaller bound is among the best
    top, wanted = None, 4 * k
    while (high > threshold).any():
        low = np.array([next_bound(a, int(w), int(h), wanted) for a, w, h in zip(above, width, high)])
        low = np.where(high > threshold, np.maximum(low, threshold), high)
        scores = rescored(docs, within(table, batch, stats.unit, low, high), batch, stats).select("item", "doc_id", "score")
        top = cut_lineage(best(scores if top is None else top.select("item", "doc_id", "score").unionByName(scores), k))
        high, wanted = np.minimum(high, low), wanted * 8
        for r in top.filter(F.col("rank") == k).collect():
            threshold[r["item"]] = max(1, -(-r["score"] // stats.unit))
    return top


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score: for each item the k documents with the highest scores above 0."""
    spark = docs.sparkSession
    counts = term_counts(docs)
    stats = statistics(counts)
    table = sketches(docs, stats)
    queries = cut_lineage(items.select("item_id", "text").distinct().repartitionByRange("item_id", "text").sortWithinPartitions("item_id", "text").withColumn("at", F.monotonically_increasing_id()))
    kind = items.schema["item_id"].dataType.simpleString()
    out, last = [], -1
    while True:
        rows = queries.filter(F.col("at") > last).orderBy("at").limit(BATCH).collect()
        if not rows:
            break
        last = rows[-1]["at"]
        batch = Batch([r["text"] or "" for r in rows])
        batch.weigh(counts, stats.documents)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        top = ranked_batch(docs, table, batch, stats, k)
        if top is not None:
            out.append(cut_lineage(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
