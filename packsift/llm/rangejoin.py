"""Near duplicates of embeddings by an exact metric range join.

Two vectors link when their cosine is at least ``least``. On the unit sphere that is a distance of at most
``r = sqrt(2 - 2 * least)``, so the join is a range join in a metric space:

1. Pivots are chosen from a bounded sample (``SAMPLE`` vectors at most), far from each other, and moved to the middle of what
   is nearest to them. Every vector belongs to the cell of its nearest pivot.
2. A vector y of another cell can have a partner x in the cell of pivot p only if (a) the triangle inequality allows it, so its
   distance to p is within r of those that occur in the cell, and (b) it is at most r beyond the plane halfway between p and
   its own pivot, as x is not beyond it. Only then is y copied to that cell; of two cells one gets the copies.
3. Cells join independently. A cell with more vectors than ``HOME`` bytes hold is dealt into blocks by hash, which are cells of
   their own then. A task keeps one block and streams what comes to it, in the order of the distance to the pivot: the triangle
   inequality leaves a window of the block to compare, and all with ``d(x, p) + d(y, p) <= r`` link without being compared, so a
   dense group around its pivot costs no more than its size. Sums and links are returned, no pairs: at most one link a vector
   and block, chosen so that they connect what the pairs would.

Equal vectors are joined once, as one vector with a number of copies. The number of pivots grows with the square root of the
table, up to ``PIVOTS``; it changes the work, never the links. Where all distances are alike (random directions in many
dimensions) no bound excludes much, and nearly every vector reaches every cell.

Null, zero and empty vectors and those with null or non-finite components link with nothing (n_links 0, component = own id), nor
do vectors of different lengths. Rows that agree in id and vector count once and get the same result; an id with several
vectors is several vectors. Rows with a null id link nothing and keep a null component (``kept`` false). An empty table gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..session import cut_lineage
from .shared import components

SAMPLE = 16_384
PIVOTS = 1024
HOME = 48 << 20  # bytes of a block as doubles
CELLS = 1 << 21  # comparisons made at a time
SLACK = 1e-6  # of distances, for their rounding


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows of length 1, in doubles. Scaling by powers of two first keeps squares in range and digits as they are."""
    rows = flat.astype(np.float64).reshape(-1, dim)
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other, then the means of what is nearest to them."""
    chosen = [0]
    nearest = _distances(rows, rows[:1])[:, 0]
    while len(chosen) < count and nearest.max() > SLACK:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(rows, rows[chosen[-1:]])[:, 0])
    own = _distances(rows, rows[chosen]).argmin(1)
    sums = np.zeros((len(chosen), rows.shape[1]))
    np.add.at(sums, own, rows)
    return sums / np.maximum(np.bincount(own, minlength=len(chosen)), 1)[:, None]


class Layout:
    """Pivots per vector length, and the blocks of their cells."""

    def __init__(self, radius: float, pivots: dict[int, np.ndarray]):
        self.radius, self.pivots = radius, pivots

    def split(self, sizes: list) -> None:
        """sizes: rows of dim, cell, n, near and far (distances that occur in the cell)."""
        self.blocks, self.first, self.near, self.far = {}, {}, {}, {}
        unit = 0
        for r in sorted(sizes, key=lambda r: (r.dim, r.cell)):
            self.first[r.dim, r.cell], self.blocks[r.dim, r.cell] = unit, -(-r.n * r.dim * 8 // HOME)
            self.near[r.dim, r.cell], self.far[r.dim, r.cell] = r.near, r.far
            unit += self.blocks[r.dim, r.cell]
        self.units = unit

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and the distance to its pivot."""
        pivots = self.pivots.get(rows.shape[1])
        if pivots is None:  # a length that is not in the sample has one cell around nothing
            return np.zeros(len(rows), np.int64), np.ones(len(rows))
        distance = _distances(rows, pivots)
        own = distance.argmin(1)
        return own, distance[np.arange(len(rows)), own]

    def targets(self, rows: np.ndarray, cell: np.ndarray, salt: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """(unit, whether it is theirs, rows that go there, their distances to its pivot)."""
        dim, r = rows.shape[1], self.radius + SLACK
        pivots = self.pivots.get(dim)
        distance = np.ones((len(rows), 1)) if pivots is None else _distances(rows, pivots)
        at = np.arange(len(rows))
        blocks = np.array([self.blocks.get((dim, c), 1) for c in range(distance.shape[1])])
        first = np.array([self.first.get((dim, c), -1) for c in range(distance.shape[1])])
        home = first[cell] + salt % blocks[cell]
        own = distance[at, cell]
        for c in range(distance.shape[1]):
            if first[c] < 0:
                continue
            d = distance[:, c]
            reach = (d <= self.far[dim, c] + r) & (d >= self.near[dim, c] - r)
            if pivots is not None:
                gap = _distances(pivots, pivots[c:c + 1])[:, 0][cell]
                reach &= (cell == c) | (d * d - own * own <= 2 * gap * r + SLACK)
            for unit in range(first[c], first[c] + blocks[c]):
                # of two units the smaller gets the copies if their sum is even, else the larger: shares stay even
                gets = np.where((home + unit) % 2 == 0, unit < home, unit > home)
                for theirs, mask in ((True, home == unit), (False, reach & gets)):
                    if mask.any():
                        yield unit, theirs, np.flatnonzero(mask), d[mask]


class Home:
    """A block of vectors, in the order of their distance to the pivot, and what has been found about them."""

    def __init__(self, uid: np.ndarray, copies: np.ndarray, distance: np.ndarray, rows: np.ndarray, least: float, radius: float):
        self.uid, self.copies, self.distance, self.rows, self.least, self.radius = uid, copies.astype(np.float64), distance, rows, least, radius
        self.before = np.concatenate([[0], np.cumsum(self.copies)])
        self.found, self.label, self.joined = np.zeros(len(uid)), np.arange(len(uid)), 1

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.label[a], self.label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def compare(self, distance: np.ndarray, rows: np.ndarray, copies: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Links of each row and one partner (-1: none). ``own``: places in the block of rows that are of the block itself.

        Rows of the block count only what they find themselves; others are counted on both sides.
        """
        sure = int(np.searchsorted(self.distance, self.radius - SLACK - distance[-1], "right"))
        low = max(sure, int(np.searchsorted(self.distance, distance[0] - self.radius - SLACK)))
        high = max(low, int(np.searchsorted(self.distance, distance[-1] + self.radius + SLACK, "right")))
        linked = rows @ self.rows[low:high].T >= self.least
        counts = np.full(len(rows), self.before[sure])
        partner = np.full(len(rows), 0 if sure else -1)
        if own is None:
            self.found[:sure] += copies.sum()
        else:
            inside = (own >= low) & (own < high)
            linked[np.flatnonzero(inside), own[inside] - low] = False
            counts[own < sure] -= self.copies[own[own < sure]]
        if sure > self.joined:
            self.unite(np.arange(self.joined, sure), np.zeros(sure - self.joined, np.int64))
            self.joined = sure
        counts += linked @ self.copies[low:high]
        if own is None:
            self.found[low:high] += copies @ linked
        some = linked.any(1)
        first = (linked.argmax(1) if high > low else np.zeros(len(rows), np.int64)) + low
        y, x = np.nonzero(linked)
        x = x + low
        pairs = np.unique(x * len(self.uid) + np.where(partner[y] >= 0, 0, first[y]))
        self.unite(pairs // len(self.uid), pairs % len(self.uid))
        partner = np.where((partner < 0) & some, first, partner)
        if own is not None:
            mine = partner >= 0
            self.unite(own[mine], partner[mine])
        return counts, partner

    def scan(self, distance: np.ndarray, rows: np.ndarray, copies: np.ndarray, own: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        step = max(1, CELLS // max(len(self.uid), 1))
        for a in range(0, len(rows), step):
            part = slice(a, min(a + step, len(rows)))
            yield part, *self.compare(distance[part], rows[part], copies[part].astype(np.float64), np.arange(part.start, part.stop) if own else None)


def _result(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])


def joined(copied: DataFrame, layout: Layout, least: float, single: bool) -> DataFrame:
    """kind 0: a vector and a number of links; kind 1: two linked vectors."""
    dtype = np.float32 if single else np.float64

    def run(batches):
        unit, held, home = None, [], None

        def settle():
            rows = np.concatenate([x[3] for x in held])
            block = Home(*[np.concatenate([x[i] for x in held]) for i in range(3)], rows, least, layout.radius)
            for part, counts, _ in block.scan(block.distance, rows, block.copies, True):
                block.found[part] += counts
            return block

        def close(block):
            some = block.found > 0
            yield _result(0, block.uid[some], block.found[some].astype(np.int64))
            away = block.label != np.arange(len(block.uid))
            yield _result(1, block.uid[away], block.uid[block.label[away]])

        for batch in batches:
            units, theirs = batch["unit"].to_numpy(), batch["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(theirs) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if units[a] != unit:
                    if held:
                        yield from close(home or settle())
                    unit, held, home = units[a], [], None
                uid, copies, distance = (part[c].to_numpy() for c in ("uid", "copies", "distance"))
                flat = np.frombuffer(b"".join(part["vector"].to_pylist()), dtype)
                rows = unit_rows(flat, len(flat) // len(uid))
                if theirs[a] == 0:
                    held.append((uid, copies, distance, rows))
                elif held:
                    home = home or settle()
                    for span, counts, partner in home.scan(distance, rows, copies, False):
                        some = partner >= 0
                        yield _result(0, uid[span][some], counts[some].astype(np.int64))
                        yield _result(1, uid[span][some], home.uid[partner[some]])
        if held:
            yield from close(home or settle())

    dealt = copied.repartition(max(1, min(2 * layout.units, 4096)), "unit").sortWithinPartitions("unit", "kind", "distance")
    return cut_lineage(dealt.mapInArrow(run, "kind int, a long, b long"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one length, and their unit vectors."""
    sizes = np.diff(batch["embedding"].offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
        flat = rows["embedding"].flatten().to_numpy(zero_copy_only=False)
        for a in range(0, rows.num_rows, 2048):
            yield dim, rows.slice(a, 2048), flat[a * dim:(a + 2048) * dim]


def fitted(vectors: DataFrame, radius: float) -> Layout:
    """Pivots and blocks for a staged table (uid, embedding)."""
    lengths = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(PIVOTS).collect()
    total = max(sum(r["count"] for r in lengths), 1)
    sample: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("uid", "embedding"), "uid").limit(SAMPLE).select("embedding").collect():
        sample.setdefault(len(r.embedding), []).append(r.embedding)
    pivots = {}
    for r in lengths:
        count = min(max(1, round((r["count"] / 64) ** 0.5)), max(1, PIVOTS * r["count"] // total))
        if r.dim in sample:
            pivots[r.dim] = choose_pivots(unit_rows(np.array(sample[r.dim]).ravel(), r.dim), count)
    layout = Layout(radius, pivots)

    def place(batches):
        for batch in batches:
            for dim, rows, flat in _by_length(batch):
                cell, distance = layout.assign(unit_rows(flat, dim))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(distance)], ["dim", "cell", "distance"])

    cells = vectors.select("embedding").mapInArrow(place, "dim int, cell int, distance double").groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far"))
    layout.split(cells.collect())
    return layout


def range_links(vectors: DataFrame, least: float, single: bool) -> DataFrame:
    """The results of all cells over a staged table (uid, copies, embedding)."""
    layout = fitted(vectors, float(np.sqrt(2 - 2 * least)))

    def copy(batches):
        for batch in batches:
            for dim, rows, flat in _by_length(batch):
                units = unit_rows(flat, dim)
                cell, _ = layout.assign(units)
                uid, copies = rows["uid"].to_numpy(), rows["copies"].to_numpy()
                size = dim * flat.itemsize
                data = np.ascontiguousarray(flat).tobytes()
                vector = np.array([data[i:i + size] for i in range(0, len(data), size)], object)
                for unit, theirs, some, distance in layout.targets(units, cell, uid % 1_000_003):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(some), unit), pa.int32()), pa.array(np.full(len(some), 0 if theirs else 1), pa.int32()), pa.array(distance),
                        pa.array(uid[some]), pa.array(copies[some]), pa.array(vector[some], pa.binary())], ["unit", "kind", "distance", "uid", "copies", "vector"])

    schema = "unit int, kind int, distance double, uid long, copies long, vector binary"
    return joined(vectors.select("uid", "copies", "embedding").mapInArrow(copy, schema), layout, least, single)


def near_vectors(embeddings: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    single = isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType)
    rows = embeddings.select("vec_id", "embedding").withColumns({
        "ok": usable(F.col("embedding")) & F.col("vec_id").isNotNull(), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    good = rows.filter("ok")
    ids = good.select("h1", "h2", "vec_id").distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    texts = good.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    vectors = cut_lineage(texts.join(ids, ["h1", "h2"]).withColumn("uid", F.monotonically_increasing_id()))
    found = range_links(vectors, least, single)
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("uid")).agg(F.sum("b").alias("n"))
    labels = cut_lineage(components(found.filter("kind = 1").select("a", "b")))
    names = vectors.select("uid", "h1", "h2", "rep", "copies")
    smallest = labels.join(names.select(F.col("uid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = labels.join(smallest, "component").select(F.col("node").alias("uid"), "least")
    known = names.join(counts, "uid", "left").join(named, "uid", "left").filter("n IS NOT NULL OR copies > 1")
    known = cut_lineage(known.select("h1", "h2", F.lit(True).alias("ok"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "rep").alias("c")))
    out = rows.drop("embedding").join(known, ["h1", "h2", "ok"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
