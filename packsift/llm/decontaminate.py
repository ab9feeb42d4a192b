"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings of training tokens: document, position, and the token together with the one after it (a
nextword index). Only pairs of neighbours that some test item has are stored, so frequent words alone cost nothing.
A phrase is found by intersecting offset-adjusted lists (position minus offset in the item): the rarest pair of each
window, by its count over all documents, gives the diagonals (item, document, position of the item's first word);
the other pairs of the window are then looked up at the positions that a diagonal expects. Unbroken runs of matched
pairs give exact occurrences. Proximity matches need half as many pairs as a window has around one place, a few words off their
distances in the item; documents without the rarer pairs of any such place are left out before lists are joined.

All steps are DataFrame operations. No list is gathered: a passage that a third of all documents holds is spread by
document. The pairs of the test items are broadcast only up to a checked size.

Nulls: a null text has no words and a null item no windows; rows with a null id are documents like others. Items of one
word match that word. Equal ids in the benchmark count as one item; items with a null id are matched, and so hit, but not
counted or listed. Texts of any length are rows of words. Empty tables: no documents give no rows, no items no hits.
Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A to Z only) words of a text. ``lower`` does the same, and faster, where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), F.lit(f"({WORD})"), 0)


def _neighbours(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, n_words, pos, a, b): every word with the next one (null at the end); one row with a null pos without words."""
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    follow = F.expr("slice(w, 2, size(w))").alias("next")
    return rows.select(*keep, "n_words", F.posexplode_outer(F.arrays_zip(F.col("w"), follow)).alias("pos", "x")).select(
        *keep, "n_words", F.col("pos").cast("long").alias("pos"), F.col("x.w").alias("a"), F.col("x.next").alias("b"))


def test_items(benchmark: DataFrame, window: int) -> DataFrame:
    """Pairs of each item: iid, item_id, len (words), win (words of a window), j (offset), a, b, pair."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0").withColumn("iid", F.monotonically_increasing_id())
    rows = cut_lineage(_neighbours(items, "iid", "item_id").filter("b IS NOT NULL OR n_words = 1").withColumnRenamed("pos", "j"))
    pairs = cut_lineage(rows.select("a", "b").distinct().withColumn("pair", F.monotonically_increasing_id()))
    rows = rows.withColumn("win", F.least("n_words", F.lit(window))).withColumnRenamed("n_words", "len")
    return cut_lineage(rows.join(pairs, (rows.a == pairs.a) & rows.b.eqNullSafe(pairs.b)).drop(pairs.a).drop(pairs.b))


def positional_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """uid, doc_id, n_words, pos, pair and single: the postings, and one row per document in any case (pos 0 or null).

    ``pair`` is a pair of neighbours of some item, ``single`` the word of a one-word item.
    """
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("uid", F.monotonically_increasing_id())
    rows = _neighbours(rows, "uid", "doc_id")
    pairs = small(items.filter("len > 1").select("a", "b", "pair").distinct())
    singles = small(items.filter("len = 1").select("a", F.col("pair").alias("single")).distinct())
    rows = rows.join(pairs, ["a", "b"], "left").join(singles, "a", "left")
    return cut_lineage(rows.filter("pair IS NOT NULL OR single IS NOT NULL OR pos = 0 OR pos IS NULL").select("uid", "doc_id", "n_words", "pos", "pair", "single"))


def phrase_matches(index: DataFrame, items: DataFrame) -> DataFrame:
    """uid, iid, first and last: the maximal word ranges of a document that hold whole windows of an item."""
    hits = index.filter("pair IS NOT NULL").select("uid", "pos", "pair")
    counts = hits.groupBy("pair").agg(F.count("*").alias("n"))
    known = cut_lineage(items.filter("len > 1").join(counts, "pair", "left").select("iid", "len", "win", "j", "pair", F.coalesce("n", F.lit(0)).alias("n")))
    window = F.explode(F.expr("sequence(greatest(0, j - win + 2), least(j, len - win))")).alias("o")
    rarest = known.filter("greatest(0, j - win + 2) <= least(j, len - win)").select("*", window).groupBy("iid", "o").agg(
        F.min(F.struct("n", "j", "pair", "win")).alias("r"))
    seeds = rarest.filter("r.n > 0").select("iid", "r.j", "r.pair", "r.win").distinct()
    diagonals = hits.join(small(seeds), "pair").select("uid", "iid", (F.col("pos") - F.col("j")).alias("diagonal"), F.col("j").alias("seed"), "win")
    around = F.explode(F.expr("sequence(seed - win + 2, seed + win - 2)")).alias("j")
    expected = diagonals.select("uid", "iid", "diagonal", around).distinct().join(small(known.select("iid", "j", "win", "pair")), ["iid", "j"])
    expected = expected.withColumn("pos", F.col("diagonal") + F.col("j"))
    found = expected.join(hits, ["uid", "pos", "pair"])
    order = Window.partitionBy("uid", "iid", "diagonal").orderBy("j")
    runs = found.withColumn("run", F.col("j") - F.row_number().over(order)).groupBy("uid", "iid", "diagonal", "run").agg(
        F.min("pos").alias("first"), (F.max("pos") + 1).alias("last"), F.max("win").alias("win"))
    exact = runs.filter("last - first + 1 >= win").select("uid", "iid", "first", "last")
    single = items.filter("len = 1").select("iid", F.col("pair").alias("single"))
    return exact.unionByName(index.filter("single IS NOT NULL").join(small(single), "single").select("uid", "iid", F.col("pos").alias("first"), F.col("pos").alias("last")))


def proximity_matches(index: DataFrame, items: DataFrame, slop: int = 5) -> DataFrame:
    """(uid, iid): around one of the document's postings of the item lie at least half as many of its pairs as a window has.

    A pair lies around another if it is less than a window away in the item, and in the document at most ``slop`` words off
    that distance. Of the pairs around any place some must be among the rarest ones there, as there are fewer others than
    a match needs; only documents with such a pair of an item are looked at for it.
    """
    hits = index.filter("pair IS NOT NULL").select("uid", "pos", "pair")
    counts = hits.groupBy("pair").agg(F.count("*").alias("n"))
    need = F.ceil((F.col("win") - 1) / 2).cast("int")
    places = cut_lineage(items.filter("len > 1").select("iid", "len", "win", "j", "pair", need.alias("need")).join(counts, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    # what lies around a pair are at most 2 * win - 1 pairs; stretches of as many begin at each pair that has them, or at the first
    last = F.least(F.col("j"), F.greatest(F.lit(0), F.col("len") - 2 * F.col("win")))
    starts = F.sequence(F.least(last, F.greatest(F.lit(0), F.col("j") - 2 * F.col("win") + 2)), last)
    order = Window.partitionBy("iid", "o").orderBy("n", "j")
    ranked = places.withColumn("o", F.explode(starts)).withColumns({"rank": F.row_number().over(order), "size": F.count("*").over(Window.partitionBy("iid", "o"))})
    seeds = ranked.filter("rank <= size - need + 1 AND n > 0").select("iid", "pair").distinct()
    found = cut_lineage(hits.join(small(seeds), "pair").select("uid", "iid").distinct())
    known = small(places.select("iid", "pair", "j", "win", "need"))
    wanted = hits.join(found.select("uid").distinct(), "uid", "left_semi").join(known, "pair").join(found, ["uid", "iid"], "left_semi")
    spots = cut_lineage(wanted.select("uid", "iid", "j", "win", "need", (F.col("pos") - F.col("j")).alias("diagonal")))
    cell = F.floor(F.col("diagonal") / (slop + 1))
    around = spots.select("uid", "iid", F.col("j").alias("k"), F.col("diagonal").alias("e"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    pairs = spots.withColumn("cell", cell).join(around, ["uid", "iid", "cell"]).filter(f"abs(diagonal - e) <= {slop} AND abs(j - k) < win")
    held = pairs.groupBy("uid", "iid", "j", "diagonal").agg(F.count_distinct("k").alias("held"), F.max("need").alias("need"))
    return held.filter("held >= need").select("uid", "iid").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items near by) of each document.

    Without a ``slop`` there are no proximity matches and no n_near.
    """
    items = test_items(benchmark, window)
    index = positional_index(docs, items)
    base = index.filter("pos = 0 OR pos IS NULL").select("uid", "doc_id", "n_words")
    matches = cut_lineage(phrase_matches(index, items).distinct())
    order = Window.partitionBy("uid").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce(reach + 1, F.col("first"))) + 1)
    hit = matches.select("uid", "first", "last").distinct().withColumn("new", new).groupBy("uid").agg(F.sum("new").alias("n_hit"))
    names = small(items.select("iid", F.col("item_id").cast("string").alias("item")).distinct())
    listed = matches.select("uid", "iid").distinct().join(names, "iid").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    exact = hit.join(listed, "uid", "left")
    if slop is not None:
        near = proximity_matches(index, items, slop).join(names, "iid").groupBy("uid").agg(F.count_distinct(F.struct("item")).alias("n_near"))
        exact = exact.join(near, "uid", "full")
    out = base.join(cut_lineage(exact), "uid", "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
                      F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                      *([] if slop is None else [F.coalesce("n_near", F.lit(0)).alias("n_near")]))
