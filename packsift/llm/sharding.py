"""Balanced label propagation: shards of equal size that keep linked documents together.

Documents are linked when their key (by default the text) is equal. Labels are shards. All documents of one key
in one shard form a block; a block sees how many neighbours every shard holds, proposes to move to the shard that
holds most of them, and moves as far as the quotas of the round allow:

* a swap quota per pair of shards, the smaller of both demands, which keeps all sizes as they are,
* the room that is left in a shard below its target size.

Documents without links have nothing to lose anywhere, so they are placed last and fill every shard to its target:
counts differ by at most one. Blocks, votes and moves are at most ``shards`` rows per key, whatever the size of a key.
All steps are DataFrame operations.

Nulls: a null text is a key of its own with no bytes (crc32 0). An empty table gives an empty result. Equal rows are
documents of their own. Only the id and the text are read, so further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import offsets, ordered

BINS = 64  # bins per pair of shards in which a quota is dealt out


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, key, size and crc32 of each document."""
    text = F.col("text")
    return docs.select(
        "doc_id", F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))


def place(numbers: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most the value: the range that a rank falls into."""
    bounds = F.array(*[F.lit(n).cast("long") for n in numbers])
    return F.size(F.filter(bounds, lambda b: b <= value))


def starts(sizes: list[int]) -> list[int]:
    return [sum(sizes[:i]) for i in range(len(sizes))]


def propagate(groups: DataFrame, target: list[int], max_rounds: int) -> tuple[DataFrame, list[int]]:
    """(key, shard, n) blocks after label propagation, and documents per shard.

    ``groups`` has key, start (rank of its first document among the linked) and total. Documents are dealt
    round robin at first, the worst start for links and an exactly even one for sizes.
    """
    shards = len(target)
    turn = F.expr(f"transform(sequence(0, {shards - 1}), s -> named_struct('shard', s, 'n', "
                  f"floor((total + {shards - 1} - pmod(s - start, {shards})) / {shards})))")
    state = cut_lineage(groups.select("key", F.explode(turn).alias("b")).select("key", "b.shard", "b.n").filter("n > 0"))
    load = [0] * shards
    for row in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[row.shard] = row.n
    idle = 0
    for number in range(max_rounds):
        room = [t - n for t, n in zip(target, load)]
        open_shards = [s for s in range(shards) if room[s] > 0] if number % 2 else list(range(shards))
        if not open_shards:
            idle += 1
            continue
        # neighbours per shard, as votes; ties are broken by a hash of key and shard
        votes = state.filter(F.col("shard").isin(open_shards)).groupBy("key").agg(
            F.max(F.struct("n", F.xxhash64("key", "shard").alias("tie"), "shard")).alias("best"))
        moves = state.join(votes, "key").filter("shard <> best.shard AND n <= best.n").select(
            "key", "shard", F.col("best.shard").alias("to"), "n",
            F.pmod(F.xxhash64("key", F.lit(number)), F.lit(BINS)).alias("bin"))
        moves = cut_lineage(moves)
        demand = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        quota = {}
        for (a, b), n in sorted(demand.items()):
            swap = min(n, demand.get((b, a), 0))
            more = min(n - swap, max(room[b], 0))
            room[b] -= more
            if swap + more:
                quota[a, b] = swap + more
        if not quota:
            idle += 1
            if idle == 2:
                break
            continue
        allowed = F.create_map(*[F.lit(x) for (a, b), q in quota.items() for x in (a * shards + b, q)])
        window = Window.partitionBy("shard", "to").orderBy("bin")
        bins = moves.groupBy("shard", "to", "bin").agg(F.sum("n").alias("sum")).withColumns({
            "before": F.sum("sum").over(window) - F.col("sum"),
            "quota": F.coalesce(F.try_element_at(allowed, F.col("shard") * shards + F.col("to")), F.lit(0))})
        bins = bins.select("shard", "to", "bin", "sum", F.greatest(F.lit(0), F.least("sum", F.col("quota") - F.col("before"))).alias("take"))
        part = F.when(F.col("take") == F.col("sum"), F.col("n")).otherwise(F.floor(F.col("n") * F.col("take") / F.col("sum")))
        taken = cut_lineage(moves.join(F.broadcast(bins), ["shard", "to", "bin"]).select("key", "shard", "to", part.cast("long").alias("n")).filter("n > 0"))
        flows = taken.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()
        if not flows:
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        for r in flows:
            load[r["shard"]] -= r["n"]
            load[r["to"]] += r["n"]
        state = cut_lineage(
            state.unionByName(taken.select("key", "shard", (-F.col("n")).alias("n")))
            .unionByName(taken.select("key", F.col("to").alias("shard"), "n"))
            .groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
    return state, load


def balanced_shards(docs: DataFrame, shards: int = 24, max_rounds: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, copies, shard and slot of each document.

    ``slot`` counts from 0 within a shard, in the order of doc_id. Shard sizes differ by at most one row.
    """
    rows = ordered(facts(docs), "key", "doc_id")
    window = Window.partitionBy("key")
    blocks = rows.groupBy("key", "_pid").agg(F.count("*").alias("n"), F.min("_idx").alias("first"))
    blocks = blocks.withColumns({
        "total": F.sum("n").over(window), "base": F.sum("n").over(window.orderBy("_pid")) - F.col("n")})
    blocks = cut_lineage(blocks.withColumn("linked", F.col("total") > 1))
    before = F.sum("n").over(Window.partitionBy("_pid", "linked").orderBy("first")) - F.col("n")
    blocks = cut_lineage(blocks.withColumn("before", before).join(offsets(blocks, F.col("n"), "linked"), ["_pid", "linked"])
                         .withColumn("start", F.col("before") + F.col("_offset")).drop("before", "_offset"))
    total = blocks.agg(F.sum("n")).collect()[0][0] or 0
    target = [total // shards + (s < total % shards) for s in range(shards)]
    groups = blocks.filter("linked").groupBy("key").agg(F.min("start").alias("start"), F.max("total").alias("total"))
    state, load = propagate(groups, target, max_rounds)
    # ranges of ranks within a key, then the shard of each document by its rank
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("shard"))
    ranges = cut_lineage(state.withColumn("upto", upto).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("ranges")))
    blocks = cut_lineage(blocks.join(ranges, "key", "left"))
    gaps = starts([t - n for t, n in zip(target, load)])
    free = place(gaps, F.col("start")) - 1
    rank = F.col("base") + F.col("_idx") - F.col("first")
    mine = F.expr("filter(ranges, r -> r.upto > rank)[0].shard")
    labelled = rows.join(blocks.select("key", "_pid", "first", "base", "start", "linked", F.col("total").alias("copies"), "ranges"), ["key", "_pid"])
    labelled = labelled.withColumn("rank", rank).withColumn("shard", F.when(F.col("linked"), mine).otherwise(free).cast("int"))
    labelled = labelled.select("doc_id", "size", "text_crc32", "copies", "shard")
    out = ordered(labelled, "shard", "doc_id")
    out = out.join(offsets(out, F.lit(1)), "_pid")
    begin = F.array(*[F.lit(n).cast("long") for n in starts(target)])
    slot = F.col("_idx") + F.col("_offset") - begin[F.col("shard")]
    return out.select("doc_id", "size", "text_crc32", "copies", "shard", slot.cast("long").alias("slot"))
