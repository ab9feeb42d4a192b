"""Sharding, near duplicates, line dedup and decontamination against plain Python."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from packsift.llm import decontaminate, jaccard, linededup, sharding

rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# --- sharding -----------------------------------------------------------------------------

def test_shards_are_even_and_keep_copies_together(spark, documents):
    rows = [(i, prose(4)) for i in range(150)] + [(200 + i, "hot text") for i in range(100)] + [(400 + i, f"pair {i // 2}") for i in range(50)]
    got = sharding.balanced_shards(documents(rows), 6).collect()
    assert len(got) == 300
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(6))
    assert all(sorted(s) == list(range(50)) for s in sizes.values())
    texts = dict(rows)
    shards = {}
    for r in got:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert len(shards["hot text"]) <= 3  # two shards are its least; the others' room is shared
    assert sum(len(s) > 1 for t, s in shards.items() if t.startswith("pair")) <= 1


def test_propagation_when_no_shard_has_room(spark):
    groups = spark.createDataFrame([(f"k{i}", 3 * i, 3) for i in range(40)], "key string, start long, total long")
    state, load = sharding.propagate(groups, [30] * 4, 40)
    assert load == [30] * 4
    blocks = state.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    assert all(b.n == 3 for b in blocks) and sum(b.c for b in blocks) < 90  # from 120 blocks


def test_shards_of_odd_rows(spark, documents, odd):
    got = sharding.balanced_shards(documents(odd), 4).collect()
    assert len(got) == len(odd)
    assert sorted(r["size"] for r in got if r.doc_id in (1, 2)) == [8, 8]
    assert sharding.balanced_shards(documents([]), 4).count() == 0


# --- n-gram Jaccard join ------------------------------------------------------------------

def brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else []))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {rows[i][0]: (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])) for i in range(len(rows))}


def near(text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, documents, k, percent):
    base, passage = prose(90), prose(40)
    rows = [(i, near(base, rng.choice([0, 1, 1, 2, 3]))) for i in range(60)]  # near copies around one text
    rows += [(100 + i, f"{passage} {prose(30)}") for i in range(30)]  # a shared passage, but not similar
    chain = prose(80).split()
    rows += [(200 + i, " ".join(chain[i:i + 70])) for i in range(8)]  # a chain of similar texts
    rows += [(300 + i, prose(rng.randrange(1, 12))) for i in range(40)] + [(400, "One two"), (401, "one TWO"), (402, "one"), (403, ""), (404, None)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_components_with_frequent_shingles_marked(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "LARGE", 8)  # so that differences to the pivot decide
    base = prose(70)
    rows = [(i, near(base, rng.choice([0, 1, 2, 3, 4]))) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize("large", [2, 5])
def test_components_of_families_of_copies(spark, documents, monkeypatch, large):
    """Families of near copies that differ from the common text, and from each other, in the same places."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    base = prose(60).split()
    rows = []
    for family in range(4):
        root = list(base)
        for place in range(6 + 9 * family, 12 + 9 * family):
            root[place] = f"family{family}"
        for member in range(12):
            text = list(root)
            for place in (3 * (member % 4), 45 + member % 5):
                text[place] = f"own{member % 6}"
            rows.append((100 * family + member, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_components_of_odd_rows(spark, documents, odd):
    got = [(r.doc_id, r.component_id) for r in jaccard.similar_groups(documents(odd), 4, 85).collect()]
    assert len(got) == len(odd) and (None, None) in got and (1, 1) in got and (2, 2) in got and got.count((6, 5)) == 2
    assert jaccard.similar_groups(documents([]), 4, 85).count() == 0


# --- line dedup ---------------------------------------------------------------------------

def brute_lines(rows, least):
    """Lines (id, place among lines with words) in a run of ``least`` words or more that occurs earlier."""
    lines = {i: [x for x in (t or "").split("\n") if x.strip()] for i, t in rows}
    gone, seen = set(), {}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                run = tuple(lines[i][a:b])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen and seen[run] < (i, a):
                        gone |= {(i, s) for s in range(a, b)}
                    seen.setdefault(run, (i, a))
    return gone


@pytest.mark.parametrize("least", [6, 10])
def test_repeated_runs_match_brute_force(spark, documents, least):
    pool = [prose(rng.randrange(1, 6)) for _ in range(14)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(len(pool))
            parts += pool[a:a + rng.randrange(1, 7)] if rng.random() < 0.7 else [prose(3), ""]
        rows.append((i, "\n".join(parts)))
    got = linededup.repeated_lines(documents(rows), least).join(documents(rows).select("doc_id", F.xxhash64("text").alias("h")), "h")
    assert {(r.doc, r.s) for r in got.collect()} == brute_lines(rows, least)
    out = {r.doc_id: (r.text, r.n_deleted) for r in linededup.deduplicated(documents(rows), least).collect()}
    gone = brute_lines(rows, least)
    for i, text in rows:
        kept, s = [], 0
        for line in text.split("\n"):
            if not line.strip():
                kept.append(line)
            else:
                if (i, s) not in gone:
                    kept.append(line)
                s += 1
        assert out[i] == ("\n".join(kept), sum(1 for d, _ in gone if d == i))


def test_line_dedup_of_odd_rows(spark, documents, odd):
    long = "\n".join(prose(12) for _ in range(10))
    rows = [*odd, (20, long), (21, f"begin\n{long}\n\nend"), (22, long)]
    got = linededup.deduplicated(documents(rows), 50).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "score", "n_lines", "rest", "n_chars", "ids", "key", "n_deleted"}
    texts = {r.doc_id: r.text for r in got}
    assert texts[21] == "begin\n\nend" and texts[22] == "" and texts[20] == long and texts[1] is None and texts[2] == "" and texts[3] == " \n\t "
    assert {r.doc_id: r.n_lines for r in got}[1] == 0
    assert linededup.deduplicated(documents([])).count() == 0


def test_line_dedup_of_repeated_rows(spark, documents):
    text = "\n".join(prose(12) for _ in range(10))
    own = "\n".join(prose(12) for _ in range(10))
    rows = [(30, text), (31, text), (40, own), (41, "\n".join([own, own]))]
    twice = [*rows, (31, text), (40, own), (40, own), (41, rows[3][1])]
    got = linededup.repeated_lines(documents(twice), 50).join(documents(rows).select("doc_id", F.xxhash64("text").alias("h")), "h")
    assert {(r.doc, r.s) for r in got.filter("doc = doc_id").collect()} == brute_lines(rows, 50)
    out = [(r.doc_id, r.n_deleted) for r in linededup.deduplicated(documents(twice), 50).collect()]
    assert sorted(out) == [(30, 0), (31, 10), (31, 10), (40, 0), (40, 0), (40, 0), (41, 20), (41, 20)]


# --- decontamination ----------------------------------------------------------------------

def brute_hits(docs, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(window, len(x))
            for o in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == x[o:o + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found))
    return out


def test_hits_match_brute_force(spark, documents):
    items = [(i, prose(rng.randrange(1, 30))) for i in range(25)] + [(90, "w1"), (91, "W1 w2"), (92, ""), (93, None), (94, "w5 w5 w5 w5 w5 w5 w5 w5 w5 w5 w5 w5 w5")]
    docs = []
    for i in range(60):
        parts = [prose(10)]
        for _ in range(rng.randrange(3)):
            x = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(x) + 1)
            parts += [" ".join(x[a:a + rng.randrange(5, 25)]).upper(), prose(3)]
        docs.append((i, ", ".join(parts)))
    docs += [(80, None), (81, ""), (82, "w5 " * 40), (83, "—")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(docs), bench, 10).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == brute_hits(docs, items, 10)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_proximity_finds_phrases_with_insertions(spark, documents):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my"
    bench = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    docs = documents([(1, phrase), (2, phrase.replace("delta", "delta so")), (3, "alpha beta then lamda my"), (4, phrase.replace("epsilon", "x").replace("theta", "y"))])
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.contamination(docs, bench, 10).collect()}
    assert got == {1: (12, 1), 2: (0, 1), 3: (0, 0), 4: (0, 1)}


def brute_near(docs, items, slop=5, window=10):
    out = {}
    for i, t in docs:
        w, out[i] = t.split(), 0
        for text in {x for _, x in items}:
            x = text.split()
            win = min(window, len(x))
            spots = [(p, j) for p in range(len(w) - 1) for j in range(len(x) - 1) if w[p:p + 2] == x[j:j + 2]]
            out[i] += any(len({k for q, k in spots if abs((p - j) - (q - k)) <= slop and abs(j - k) < win}) >= -(-(win - 1) // 2) for p, j in spots)
    return out


def test_proximity_matches_brute_force(spark, documents):
    long = [f"l{i}" for i in range(59)]
    piece = " ".join([*long[30:38], "so", *long[38:45]])  # no unbroken ten words
    docs = [(1, piece), *[(10 + i, " ".join(long[28:47])) for i in range(5)], (2, "a a a b a"), (3, "x b y"), (4, "a a"), (5, "l3 l4"), (6, "b y b y")]
    items = [(1, " ".join(long)), (2, "a a a a"), (3, "b y b y b"), *[(10 + i, prose(rng.randrange(2, 40))) for i in range(8)]]
    for i in range(80):
        x = (rng.choice(items)[1]).split()
        a = rng.randrange(len(x))
        words = x[a:a + rng.randrange(2, 14)]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(VOCABULARY))
        docs.append((100 + i, " ".join([*words, *prose(rng.randrange(1, 6)).split(), *x[:4]])))
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(documents(docs), bench, 10).collect()}
    assert (got[1].n_hit, got[1].n_near) == (0, 1)
    assert {i: r.n_near for i, r in got.items()} == brute_near(docs, items)


def test_decontamination_of_odd_rows(spark, documents, odd):
    bench = spark.createDataFrame([(1, "same text of some words here"), (None, "without an id"), (1, "same text of some words here")], "item_id long, text string")
    got = decontaminate.contamination(documents(odd), bench).collect()
    assert len(got) == len(odd) and sum(r.contaminated for r in got) == 4
    assert [r.n_items for r in got if r.doc_id == 5] == [1]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents(odd), empty).filter("contaminated").count() == 0
    assert decontaminate.contamination(documents([]), bench).count() == 0
