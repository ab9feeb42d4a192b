"""N-gram Jaccard join with prefix filters under several global token orders.

A document is its set of distinct word shingles (64-bit hashes). Two sets link when ``100 * |A & B| >= percent * |A | B|``.
Under any total order of tokens, linked sets share a token among their first ``n - ceil(t n) + 1`` tokens, and miss at
most ``n - overlap`` of the tokens below any bound. So a candidate must pass

1. order 1 (rare tokens first, then by hash): an index over the prefix tokens finds the pairs,
2. orders 2 and 3 (two other hashes): both prefixes must agree up to the smaller of their last tokens, but for the
   tokens that linked sets may miss,
3. the exact intersection of whole sets.

No group is expanded into all its pairs. Equal sets become one representative. In each bucket of the index one pivot is
compared with all members first; its links give components, and only members of different components of one bucket are
compared after that: in buckets of up to ``LARGE`` members directly, in larger ones by their differences to the pivot. The
tokens in which V and U differ are those in one only of their differences to the pivot. So if V links with U, then either
both link with the pivot, or their differences share tokens, at least half of what their sizes exceed the limit by. A second
prefix index, over the differences with places, finds those pairs. Its order has the tokens that the pivot lacks first, else
what only the pivot has would be at the front of all differences to it. No link between different components is missed.
The pivot is the member that shares most of its prefix.

Order 1 counts the documents of every shingle of the corpus. Shingles in ``HOT`` or more documents come last; the most
frequent ``HOT_ROWS`` at most are marked (a bound for the broadcast). Which shingles are marked changes the work, never the links.

An empty table gives an empty result; further columns are not read. Nulls and texts without words: no shingles, linked with nothing, component = own id. Fewer than ``k`` words: the whole
sequence is one shingle. Rows with a null id link nothing and keep a null component. Equal rows fall into one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import buffer, chunks, components, mix, slices, small, words

HOT, HOT_ROWS = 64, 1 << 20
LARGE = 64  # rows of a bucket, from which on its members are compared by their differences to the pivot
FLUSH = 2_000_000  # tokens that a task gathers before it passes them on
GROUP = 4_000_000  # tokens counted together

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, at = buffer(texts)
    _, _, h, bounds = words(data, at, _INSIDE, _FOLD)
    rolled = h.copy()
    for j in range(1, k if len(h) >= k else 0):
        rolled[: len(h) - j] = mix(rolled[: len(h) - j] * np.uint64(2 * j + 1) + h[j:])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield np.unique(rolled[a:b - k + 1])
        elif b > a:  # the whole sequence, told apart from shingles by its length
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = mix(whole * np.uint64(11) + x)
            yield whole
        else:
            yield h[:0]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size) and two 64-bit sums that name the set."""
    def run(batches):
        for batch in chunks(batches, "text"):
            n, a, b = [], [], []
            for s in shingles(batch["text"], k):
                n.append(len(s))
                a.append(int(mix(s).sum(dtype=np.uint64)) - (1 << 63))
                b.append(int(mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "n", "s1", "s2"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def frequent(docs: DataFrame, k: int, total: int) -> np.ndarray:
    """The most frequent shingles (their upper 48 bits), sorted: those in ``HOT`` documents or more, ``HOT_ROWS`` at most.

    Tasks pass on sorted tokens as differences, dealt by the lower bits, so that a count needs about four bytes a token.
    """
    parts = max(24, -(-total // GROUP))

    def send(tokens):
        tokens = np.concatenate(tokens)
        part = (tokens & np.uint64(0xFFFF)).astype(np.int64) * parts >> 16
        order = np.lexsort((tokens, part))
        tokens, part = tokens[order] >> np.uint64(16), part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, np.diff(tokens[a:b], prepend=np.uint64(0))) for p, a, b in zip(range(parts), cuts[:-1], cuts[1:]) if b > a]
        return pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in rows], pa.int32()), pa.array([d.astype(np.uint32).tobytes() for _, d in rows], pa.binary()),
            pa.array([(d >> np.uint64(32)).astype(np.uint16).tobytes() for _, d in rows], pa.binary())], ["part", "low", "high"])

    def gather(batches):
        held, n = [], 0
        for batch in chunks(batches, "text"):
            for s in shingles(batch["text"], k):
                held.append(s)
                n += len(s)
                if n >= FLUSH:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def count(part: pa.Table) -> pa.Table:
        tokens = np.concatenate([
            np.cumsum(np.frombuffer(a.as_buffer(), np.uint32) + (np.frombuffer(b.as_buffer(), np.uint16).astype(np.uint64) << np.uint64(32)), dtype=np.uint64)
            for a, b in zip(part["low"], part["high"])])
        tokens.sort()
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        n = np.diff(np.append(first, len(tokens)))
        return pa.table({"token": tokens[first][n >= HOT].astype(np.int64), "n": n[n >= HOT].astype(np.int64)})

    counts = docs.select("text").mapInArrow(gather, "part int, low binary, high binary").groupBy("part").applyInArrow(count, "token long, n long")
    top = counts.orderBy(F.desc("n"), "token").limit(HOT_ROWS).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.uint64))


def _rare_first(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Sorted tokens in order 1: those that are not marked as frequent first."""
    if not len(hot) or not len(tokens):
        return tokens
    top = tokens >> np.uint64(16)
    marked = hot[np.minimum(np.searchsorted(hot, top), len(hot) - 1)] == top
    return np.concatenate([tokens[~marked], tokens[marked]])


def prefixes(docs: DataFrame, k: int, percent: int, hot: np.ndarray) -> DataFrame:
    """doc_id, n, prefix under order 1, and the ends of the prefixes under orders 2 and 3 (32 bits a token)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot = shared.value
        for batch in chunks(batches, "text"):
            n, first, second, third = [], [], [], []
            for s in shingles(batch["text"], k):
                p = prefix_length(len(s), percent) if len(s) else 0
                head = _rare_first(s, hot)[:p]
                n.append(len(s))
                first.append(head.astype(np.int64))
                second.append(np.sort(np.partition(mix(s + np.uint64(17)), p - 1)[:p]) if p else s)
                third.append(np.sort(np.partition(mix(s + np.uint64(91)), p - 1)[:p]) if p else s)
            values = np.concatenate(first) if first else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            sketch = lambda rows: pa.array([(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), sketch(second), sketch(third)],
                ["doc_id", "n", "prefix", "second", "third"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, prefix array<long>, second binary, third binary")


def overlap_needed(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def _agree(x: bytes, y: bytes, a: int, b: int, need: int) -> bool:
    """Whether two prefixes under one order may belong to sets that share ``need`` tokens."""
    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    # a set whose prefix is the whole set has no further tokens
    bound = min(x[-1] if len(x) < a else 2**32, y[-1] if len(y) < b else 2**32)
    x, y = np.unique(x[x < bound]), np.unique(y[y < bound])
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= len(x) - (a - need) and same >= len(y) - (b - need)


def agreeing(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes under orders 2 and 3 agree."""
    def run(batches):
        for batch in slices(batches):
            c = {x: batch[x].to_pylist() for x in batch.schema.names}
            keep = []
            for m, n, x2, y2, x3, y3 in zip(c["na"], c["nb"], c["a2"], c["b2"], c["a3"], c["b3"]):
                need = overlap_needed(m, n, percent)
                keep.append(_agree(x2, y2, m, n, need) and _agree(x3, y3, m, n, need))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    side = lambda x: table.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("second").alias(f"{x}2"), F.col("third").alias(f"{x}3"))
    return cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long"))


def compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int, hot: np.ndarray) -> DataFrame:
    """Pairs (a, b) with their whole sets: n (size of b), linked, d (tokens in one of both only) and ``diff``.

    ``diff`` holds those of the d tokens, a's own last and else in order 1, among which b and a set linked to it must share one.
    """
    ids = small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def sets(batches):
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s.tobytes() for s in shingles(batch["text"], k)], pa.binary())], ["doc_id", "tokens"])

    def run(batches):
        for batch in slices(batches):
            n, linked, d, diffs = [], [], [], []
            for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = x[place] == y
                missing = np.ones(len(x), bool)
                missing[place[both]] = False
                own, missing, same = y[~both], x[missing], int(both.sum())
                n.append(len(y))
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
                d.append(len(own) + len(missing))
                most = 100 * len(y) // percent
                diff = np.concatenate([_rare_first(own, shared.value), _rare_first(missing, shared.value)])
                diffs.append(diff[:len(y) + most - 2 * overlap_needed(len(y), most, percent) + 2].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(d, pa.int64()), pa.array(diffs, pa.list_(pa.int64()))],
                                             ["a", "b", "n", "linked", "d", "diff"])

    whole = cut_lineage(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, tokens binary"))
    side = lambda x: whole.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"t{x}"))
    return cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, n long, linked boolean, d long, diff array<long>"))


def _apart(percent: int) -> tuple[str, str]:
    """SQL: the tokens that only one of two linked sets of sizes m and n may have; the tokens two differences must share."""
    most = f"(m + n - 2 * ceil({percent} * (m + n) / {100 + percent}))"
    return most, f"(d + e - {most}) / 2"


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of each document."""
    docs = docs.select("doc_id", "text")
    facts = cut_lineage(signatures(docs, k))
    sets = cut_lineage(facts.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    total = facts.agg(F.sum("n")).collect()[0][0] or 0
    hot = frequent(docs, k, total)
    copies = facts.join(sets, ["s1", "s2", "n"]).filter("doc_id <> rep").select("doc_id").distinct()
    copies = copies.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")  # an id with several texts may be both
    table = cut_lineage(prefixes(docs, k, percent, hot).filter("n > 0 AND doc_id IS NOT NULL").join(small(copies), "doc_id", "left_anti"))
    index = table.select("doc_id", "n", F.explode("prefix").alias("token"))
    shared = cut_lineage(index.groupBy("token").agg(F.count("*").alias("docs")).filter("docs > 1").select("token", (F.col("docs") > LARGE).alias("large")))
    members = cut_lineage(index.join(shared, "token"))
    # the pivot shares most of its prefix with others: of near copies that is the text they were copied from, if it is there
    odd = members.groupBy("doc_id").agg(F.count("*").alias("held")).join(table.select("doc_id", F.size("prefix").alias("p")), "doc_id")
    odd = cut_lineage(odd.select("doc_id", (F.col("p") - F.col("held")).alias("odd")))
    pivots = members.join(odd, "doc_id").groupBy("token").agg(
        F.min(F.struct("odd", F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("pivot"), F.col("n").alias("m"))).alias("p"))
    pivots = cut_lineage(pivots.select("token", "p.pivot", "p.m"))
    near_size = f"100 * least(m, n) >= {percent} * greatest(m, n)"
    named = lambda rows, node, labels: rows.join(labels.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))

    def checked(pairs):
        return compared(agreeing(cut_lineage(pairs.distinct()), table, percent), docs, k, percent, hot)

    # one pivot per bucket against all its members
    stars = members.join(pivots, "token").filter("doc_id <> pivot")
    pair = [F.col("pivot").alias("a"), F.col("doc_id").alias("b")]
    near = compared(cut_lineage(stars.filter("large").select(*pair).distinct()), docs, k, percent, hot)
    links = near.unionByName(checked(stars.filter(f"NOT large AND {near_size}").select(*pair))).filter("linked").select("a", "b").distinct()
    links = cut_lineage(links)
    labels = cut_lineage(components(links))
    # large buckets: sets that link without a link to their pivot share tokens of their differences to it
    open_pivots = cut_lineage(near.groupBy("a").agg(F.bool_and("linked").alias("all"), F.count("*").alias("c")).filter("c > 1 AND NOT all").select("a"))
    spread = cut_lineage(named(near.join(open_pivots, "a"), "b", labels).select("a", "b", "n", "d", "linked", "component", F.posexplode("diff").alias("i", "x")))
    other = spread.select("a", "x", F.col("b").alias("u"), F.col("n").alias("m"), F.col("d").alias("e"), F.col("i").alias("j"), F.col("component").alias("theirs"))
    _, needed = _apart(percent)
    around = spread.filter("NOT linked").join(other, ["a", "x"]).filter(f"component <> theirs AND {near_size} AND least(d - i, e - j) >= {needed}")
    around = around.select(F.least("b", "u").alias("a"), F.greatest("b", "u").alias("b"))
    # small buckets: what different components still have to be compared
    labelled = cut_lineage(named(members.filter("NOT large").select("token", "doc_id", "n"), "doc_id", labels))
    sizes = labelled.groupBy("token", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
    open_rows = cut_lineage(labelled.join(main.select("token", F.col("top.component").alias("main")), "token"))
    rest = open_rows.filter("component <> main").select("token", F.col("doc_id").alias("u"), F.col("n").alias("m"), F.col("component").alias("theirs"))
    across = open_rows.join(rest, "token").filter(f"component <> theirs AND (component = main OR doc_id < u) AND {near_size}")
    across = across.select(F.least("doc_id", "u").alias("a"), F.greatest("doc_id", "u").alias("b"))
    links = cut_lineage(links.unionByName(checked(around.unionByName(across)).filter("linked").select("a", "b")))
    labels = components(links).withColumnRenamed("node", "rep")
    named = cut_lineage(sets.join(labels, "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component")))
    out = facts.join(named, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
