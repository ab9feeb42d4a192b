"""Centroid clustering over a vector-approximation file.

Vectors become integers, ``floor(scale * x)``, and every dimension is cut into at most ``2 ** bits`` cells. The VA file holds
the cell numbers of each vector, packed to ``bits`` a dimension. To assign vectors to centroids only that file is read:

1. lookup tables per dimension, cell and centroid give the smallest and the largest squared distance, their sums an interval
   for every centroid; centroids whose interval begins above the end of another's are out,
2. where intervals still overlap, the tables of the difference to the likeliest centroid are looked up the same way,
3. full vectors are fetched only for vectors with more than one centroid left, and for those that have moved: the centroid
   sums change by what moved, so they stay exact without a further pass over the vectors.

The first round fetches every vector, as all of them have moved; the last assignment reads them for the distances. Cells are
narrow where a bounded sample (``SAMPLE`` vectors) has many values and reach to the smallest and largest value of the whole
table, so the intervals always hold; the sample only changes how many vectors are fetched.

Rounds need one row a centroid on the driver. Nothing else is collected and no group meets in one task: sums are formed per
batch, then summed by cluster. Ties of distance go to the smaller number.

Null embeddings, other lengths, and null or non-finite components leave no row; nor do components beyond ``LIMIT`` after
scaling, whose squared distances do not fit a long. Repeated rows are vectors of their own, equal ids among the first centroids
are told apart by their vectors, a null id is hashed as ``1:null``. With fewer vectors than ``k`` there are fewer centroids;
an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SAMPLE = 10_000
LIMIT = 1 << 26
BLOCK = 4096  # vectors looked up at a time


def whole(embedding: Column, dims: int, scale: int) -> Column:
    """The integer vector, or null for an embedding that is not kept."""
    scaled = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < LIMIT)
    return F.when((F.size(embedding) == dims) & F.forall(embedding, good), scaled)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


class Cells:
    """The cells of each dimension: their first and last value."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int):
        self.bits, self.edges, self.first, self.last = bits, [], [], []
        for d in range(len(low)):
            value, count = np.unique(sample[:, d], return_counts=True)
            share = np.cumsum(np.cbrt(count))  # widths after the cube root of the density keep the mean error least
            cell = np.minimum((share / share[-1] * (1 << bits) - 1e-9).astype(int), (1 << bits) - 1)
            edge = value[1:][np.diff(cell) > 0]
            edge = edge[(edge > low[d]) & (edge <= high[d])]
            self.edges.append(edge)
            self.first.append(np.append(low[d], edge))
            self.last.append(np.append(edge - 1, high[d]))

    def pack(self, vectors: np.ndarray) -> list[bytes]:
        codes = np.stack([np.searchsorted(e, vectors[:, d], "right") for d, e in enumerate(self.edges)], 1).astype(np.uint8)
        bits = np.unpackbits(codes[:, :, None], axis=2)[:, :, 8 - self.bits:]
        return [row.tobytes() for row in np.packbits(bits.reshape(len(vectors), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        dims = len(self.edges)
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(rows, axis=1)[:, :dims * self.bits].reshape(len(packed), dims, self.bits)
        return np.packbits(np.pad(bits, ((0, 0), (0, 0), (8 - self.bits, 0))), axis=2)[:, :, 0]

    def tables(self, centroids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per dimension the least and the greatest squared distance of a cell's values to each centroid (cell x centroid)."""
        out = []
        for d, (a, b) in enumerate(zip(self.first, self.last)):
            c, a, b = centroids[:, d][None], a[:, None], b[:, None]
            out.append((np.maximum(0, np.maximum(a - c, c - b)) ** 2, np.maximum(np.abs(a - c), np.abs(b - c)) ** 2))
        return out

    def differences(self, centroids: np.ndarray) -> list[np.ndarray]:
        """Per dimension how much nearer the first of two centroids may at most be, less the second's (cell x second x first).

        ``(x - b) ** 2 - (x - a) ** 2`` is linear in x, so its least value is at one end of the cell.
        """
        out = []
        for d, ends in enumerate(zip(self.first, self.last)):
            squares = [(e[:, None] - centroids[:, d][None]) ** 2 for e in ends]
            out.append(np.minimum(*[s[:, None, :] - s[:, :, None] for s in squares]))
        return out


def candidates(codes: np.ndarray, tables, differences) -> np.ndarray:
    """Which centroids may be nearest (vector x centroid), by the cells alone."""
    low = np.zeros((len(codes), tables[0][0].shape[1]), np.int64)
    high = low.copy()
    for d, (least, most) in enumerate(tables):
        low += least[codes[:, d]]
        high += most[codes[:, d]]
    left = low <= high.min(1)[:, None]
    rows = np.flatnonzero(left.sum(1) > 1)
    best = (low[rows] + high[rows]).argmin(1)
    margin = np.zeros((len(rows), left.shape[1]), np.int64)
    for d, table in enumerate(differences):
        margin += table[codes[rows, d], best]
    # farther than the likeliest for certain, or as far with a larger number
    left[rows] &= ~((margin > 0) | ((margin == 0) & (np.arange(left.shape[1])[None] > best[:, None])))
    return left


def nearest(vectors: np.ndarray, centroids: np.ndarray, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance; ties go to the smaller number. Only centroids that are left are measured."""
    if left is not None and len(vectors) and (left.sum(1) == 1).all():
        own = left.argmax(1)
        return own, ((vectors - centroids[own]) ** 2).sum(1)
    distance = np.full((len(vectors), len(centroids)), np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        rows = slice(None) if left is None else np.flatnonzero(left[:, c])
        distance[rows, c] = ((vectors[rows] - centroid) ** 2).sum(1)
    own = distance.argmin(1)
    return own, distance[np.arange(len(vectors)), own]


def va_file(embeddings: DataFrame, dims: int, scale: int, bits: int) -> tuple[DataFrame, Cells | None]:
    """The staged table (uid, vec_id, v, approx) and its cells (none for an empty table)."""
    rows = embeddings.select("vec_id", whole(F.col("embedding"), dims, scale).alias("v")).filter("v IS NOT NULL")
    rows = cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()))

    def ends(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch["v"], dims)
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(v.min(0)), pa.array(v.max(0))], ["d", "low", "high"])

    span = rows.select("v").mapInArrow(ends, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    if not span:
        return rows.withColumn("approx", F.lit(None).cast("binary")), None
    sample = rows.orderBy(F.xxhash64("uid", "v"), "uid").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    cells = Cells(matrix(sample, dims), np.array([r["low"] for r in span]), np.array([r["high"] for r in span]), bits)

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.pack(matrix(batch["v"], dims)), pa.binary())], ["uid", "vec_id", "v", "approx"])

    return cut_lineage(rows.select("uid", "vec_id", "v").mapInArrow(pack, "uid long, vec_id long, v array<long>, approx binary")), cells


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    return np.array([r.v for r in rows.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()], np.int64)


def _blocks(batch: pa.RecordBatch):
    return (batch.slice(a, BLOCK) for a in range(0, batch.num_rows, BLOCK))


def by_cells(rows: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """The columns of the VA file (uid, approx, own) with ``left``, the centroids that may be nearest, as one bit each."""
    def run(batches):
        tables, differences = cells.tables(centroids), cells.differences(centroids)
        for batch in batches:
            for part in _blocks(batch):
                left = candidates(cells.unpack(part["approx"].to_pylist()), tables, differences)
                bits = [row.tobytes() for row in np.packbits(left, axis=1)]
                own = np.where(left.sum(1) == 1, left.argmax(1), -1)
                yield pa.RecordBatch.from_arrays([part["uid"], part["approx"], part["own"], pa.array(own, pa.int32()), pa.array(bits, pa.binary())],
                                                 ["uid", "approx", "own", "now", "left"])

    return cut_lineage(rows.select("uid", "approx", "own").mapInArrow(run, "uid long, approx binary, own int, now int, left binary"))


def measured(rows: DataFrame, centroids: np.ndarray, cells: Cells | None = None) -> DataFrame:
    """Vectors (uid, own, v, and left or approx) with ``now``, the nearest of the centroids left, and its distance."""
    count, given = len(centroids), cells is None

    def run(batches):
        tables, differences = (None, None) if given else (cells.tables(centroids), cells.differences(centroids))
        for batch in batches:
            for part in _blocks(batch):
                vectors = matrix(part["v"], centroids.shape[1])
                if given:
                    left = np.unpackbits(np.frombuffer(b"".join(part["left"].to_pylist()), np.uint8).reshape(len(vectors), -1), axis=1)[:, :count].astype(bool)
                else:
                    left = candidates(cells.unpack(part["approx"].to_pylist()), tables, differences)
                now, distance = nearest(vectors, centroids, left)
                yield pa.RecordBatch.from_arrays([part["uid"], part["vec_id"], part["own"], part["v"], part["approx"], pa.array(now, pa.int32()), pa.array(distance, pa.int64())],
                                                 ["uid", "vec_id", "own", "v", "approx", "now", "distance"])

    return rows.mapInArrow(run, "uid long, vec_id long, own int, v array<long>, approx binary, now int, distance long")


def moved_sums(moved: DataFrame, dims: int) -> list:
    """What the moved vectors (own, now, v) add to each cluster: rows of cluster, n and sums."""
    def run(batches):
        for batch in batches:
            v, own, now = matrix(batch["v"], dims), batch["own"].to_numpy(), batch["now"].to_numpy()
            for c in np.union1d(own, now):
                if c >= 0:
                    sign = (now == c).astype(np.int64) - (own == c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(dims + 1, c), pa.int32()), pa.array(range(-1, dims), pa.int32()),
                                                      pa.array(np.append(sign.sum(), sign @ v))], ["cluster", "d", "n"])

    sums = moved.select("own", "now", "v").mapInArrow(run, "cluster int, d int, n long").groupBy("cluster", "d").agg(F.sum("n").alias("n"))
    return sums.collect()  # one row per centroid and dimension


def clustered(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, bits: int = 6) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    table, cells = va_file(embeddings, dims, scale, bits)
    if cells is None:
        return table.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in [
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]])
    centroids = first_centroids(table, k)
    count, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
    state = None
    for _ in range(rounds):
        if state is None:  # all vectors move
            fetched = cut_lineage(measured(table.withColumn("own", F.lit(-1)), centroids, cells))
            state = fetched
        else:
            seen = by_cells(state.select("uid", "approx", F.col("now").alias("own")), cells, centroids)
            open_rows = seen.filter("now < 0 OR now <> own").join(table.select("uid", "vec_id", "v"), "uid")
            fetched = cut_lineage(measured(open_rows, centroids))
            state = seen.filter("now >= 0 AND now = own").select("uid", "approx", "now").unionByName(fetched.select("uid", "approx", "now"))
        for r in moved_sums(fetched.filter("own <> now"), dims):
            if r.d < 0:
                count[r.cluster] += r.n
            else:
                sums[r.cluster, r.d] += r.n
        full = count > 0
        centroids = centroids.copy()
        centroids[full] = sums[full] // count[full][:, None]
    final = cut_lineage(measured(table.withColumn("own", F.lit(-1)), centroids, cells).select("vec_id", F.col("now").alias("cluster"), "distance"))
    inertia = {r.cluster: r.s for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    value = lambda values, kind: F.array(*[F.lit(x).cast(kind) for x in values])[F.col("cluster")]
    return final.select("vec_id", "cluster", "distance", value([inertia.get(c, 0) for c in range(len(names))], "long").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"), value(names, "string").alias("centroid_sha256"))
