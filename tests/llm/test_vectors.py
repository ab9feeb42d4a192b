"""The metric range join, the max-sketch search and the VA file against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from packsift.llm import rangejoin, sketchsearch, vafile

rng = np.random.default_rng(3)
FLOATS = "vec_id long, embedding array<float>, label int, distance double, cluster int"


def table(spark, rows, schema=FLOATS):
    """Vectors, with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1.5, 7) for i, v in rows], schema)


def direction(dim=8):
    v = rng.normal(size=dim)
    return v / np.linalg.norm(v)


def around(v, size):
    return v + size * direction(len(v))


# --- metric range join --------------------------------------------------------------------

def brute_links(rows, least):
    """vec_id to (links, component): equal (id, vector) rows count once."""
    good = sorted({(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    m = [np.array(v, float) for _, v in good]
    linked = lambda a, b: len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least
    label, links = list(range(len(good))), [0] * len(good)
    for x in range(len(good)):
        for y in range(x):
            if linked(m[x], m[y]):
                links[x] += 1
                links[y] += 1
                old, new = label[x], label[y]
                label = [new if c == old else c for c in label]
    return {good[k]: (links[k], min(good[j][0] for j in range(len(good)) if label[j] == label[k])) for k in range(len(good))}


def check_links(spark, rows, least):
    got = rangejoin.near_vectors(table(spark, rows), least).collect()
    want, left = brute_links(rows, least), sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None)
    expected = []
    for i, v in rows:
        key = (i, tuple(np.float32(x) for x in v)) if v and None not in v else None
        n, c = want.get(key, (0, i))
        if i is not None:
            expected.append((i, n, c, c == i))
    assert left == sorted(expected) and len(got) == len(rows)


@pytest.mark.parametrize("least,home,cells", [(0.95, 48 << 20, 1 << 21), (0.95, 8 * 8 * 20, 300), (0.6, 8 * 8 * 30, 1000), (0.995, 8 * 8 * 10, 64)])
def test_links_match_brute_force(spark, monkeypatch, least, home, cells):
    monkeypatch.setattr(rangejoin, "HOME", home)
    monkeypatch.setattr(rangejoin, "CELLS", cells)
    hot, loose = direction(), direction()
    rows = [(i, direction().tolist()) for i in range(120)]
    rows += [(200 + i, around(hot, 0.1 * rng.random()).tolist()) for i in range(80)]  # a dense group
    rows += [(300 + i, around(loose, 0.4).tolist()) for i in range(60)]
    rows += [(400 + i, (rows[i][1] if i < 10 else hot.tolist())) for i in range(40)]  # exact copies
    rows += [(500 + i, (np.array(rows[i][1]) * 7).tolist()) for i in range(10)]  # the same directions
    chain = [np.cos(t) * np.eye(8)[0] + np.sin(t) * np.eye(8)[1] for t in np.linspace(0, 1.5, 12)]
    rows += [(600 + i, v.tolist()) for i, v in enumerate(chain)]
    check_links(spark, rows, least)


def test_links_of_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (1, [3.0, -2.0, 0.0]), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 2.0]), (8, [float("inf"), 1.0, 2.0]),
            (None, v), (9, [1.0, 2.0]), (10, [2.0, 4.0]), (11, [1e-38, 2e-38, 3e-38]), (12, [1e38, 2e38, 3e38]), (13, [float(i) for i in range(1, 5000)])]
    check_links(spark, [(i, x) for i, x in rows if x is None or all(y is None or math.isfinite(y) for y in x)], 0.95)
    odd = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rangejoin.near_vectors(table(spark, rows)).collect() if r.vec_id != 1}
    assert all(odd[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 13)) and odd[None] == (0, None, False)
    assert odd[2][1] == odd[11][1] == odd[12][1] == 1 and odd[10] == (1, 9, False)
    assert rangejoin.near_vectors(table(spark, [])).count() == 0


def test_doubles_link_as_floats_do(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e-300, 2e-300]), (3, [2.0, 1.0])]
    got = rangejoin.near_vectors(table(spark, rows, FLOATS.replace("array<float>", "array<double>")), 0.95).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_copies_go_where_partners_may_be():
    """Every linked pair of different blocks meets in one of them, and only there."""
    rows = np.array([direction(6) for _ in range(150)] + [around(np.eye(6)[0], 0.2) for _ in range(50)])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    layout = rangejoin.Layout(0.5, {6: rangejoin.choose_pivots(rows, 9)})
    cell, distance = layout.assign(rows)

    class Size:
        def __init__(self, c):
            self.dim, self.cell, self.n, self.near, self.far = 6, c, int((cell == c).sum()), distance[cell == c].min(), distance[cell == c].max()

    layout.split([Size(c) for c in np.unique(cell).tolist()])
    home, there = {}, {}
    for unit, theirs, some, _ in layout.targets(rows, cell, np.arange(len(rows))):
        for i in some.tolist():
            if theirs:
                home[i] = unit
            else:
                there.setdefault(i, set()).add(unit)
    assert len(home) == len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if home[i] != home[j] and np.linalg.norm(rows[i] - rows[j]) <= 0.5:
                assert (home[j] in there.get(i, ())) + (home[i] in there.get(j, ())) == 1


# --- ranked search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = set()
    for item, text in set(items):
        scores = []
        for i, w in held:
            if w and i is not None:
                m = 50 + 50 * len(w) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in set(terms(text)) if t in df)
                if s > 0:
                    scores.append((-s, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def found(spark, docs, items, k):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in sketchsearch.ranked_search(docs, bench, k).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("changes", [{}, {"WEIGHTS": 20, "SPARE": 1, "LEAST_WIDTH": 4, "BINS": 8}, {"BATCH": 3, "STEP": 7, "FLUSH": 50, "ROOM": 2048}])
def test_ranks_match_brute_force(spark, documents, monkeypatch, changes):
    for name, value in changes.items():
        monkeypatch.setattr(sketchsearch, name, value)
    draw = random.Random(9)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(4000)] + ["Äther", "ÄTHER", "7", "x_y"]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 40, 300])))) for i in range(150)]
    docs += [(200 + i, docs[i % 5][1].upper()) for i in range(40)] + [(300, None), (301, ""), (302, "?!")]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 4, 30])))) for i in range(12)] + [(50, docs[0][1]), (51, ""), (52, None), (53, "unseen"), (50, docs[0][1])]
    assert found(spark, documents(docs), items, 10) == brute_ranks(docs, items, 10)


def test_ranks_of_odd_rows(spark, documents, odd):
    items = [(1, "same text of some words here"), (None, "without an id"), (1, "word5x5 ünïcode"), (2, " ".join(f"word{i % 977}x{i}" for i in range(3000)))]
    docs = [d for d in odd if d[0] != 6]
    assert found(spark, documents(docs), items, 3) == brute_ranks(docs, items, 3)
    twice = sketchsearch.ranked_search(documents(odd), spark.createDataFrame(items[:1], "item_id long, text string"), 5).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(twice, key=lambda r: r["rank"])] == [(1, 5), (2, 6), (3, 6), (4, 8)]
    assert found(spark, documents([]), items, 3) == set() and found(spark, documents(odd), [], 3) == set()


def test_bounds_are_never_below_scores():
    draw = random.Random(4)
    texts = [" ".join(f"t{draw.randrange(60)}" for _ in range(30)) for _ in range(20)]
    row, h, tf, size = sketchsearch.terms_of(pa.array(texts))
    terms_, holding = np.unique(h, return_counts=True)
    stats = sketchsearch.Statistics(len(texts), int(size.sum()), terms_[holding > 12], holding[holding > 12])
    batch = sketchsearch.Batch([f"t{i} t{i + 1} t{i + 2}" for i in range(50)])
    at = {int(t): int(n) for t, n in zip(terms_, holding)}
    batch.weights = np.array([sketchsearch.weight(len(texts), at[int(t)]) if int(t) in at else 0 for t in batch.terms])
    impact = -(-(stats.bounded(h) * sketchsearch.part(tf, stats.lengths(size)[row])) // stats.unit)
    for width in (8, 64, 1024):
        places, impacts = [], []
        for i in range(len(texts)):
            best = {}
            for p, v in zip((h[row == i] & np.uint64(width - 1)).tolist(), impact[row == i].tolist()):
                best[p] = max(best.get(p, 0), v)
            places.append(np.array(sorted(best), np.uint16).tobytes())
            impacts.append(np.array([best[p] for p in sorted(best)], np.uint16).tobytes())
        sketches = pa.RecordBatch.from_arrays([pa.array([width] * len(texts)), pa.array(places, pa.binary()), pa.array(impacts, pa.binary())], ["width", "places", "impacts"])
        for rows, bounds in batch.bounds(sketches, stats.unit):
            for r, bound in zip(rows, bounds):
                exact = batch.scores(h[row == r], tf[row == r], 50 + 50 * int(size[r]) * stats.documents // stats.total)
                assert (bound * stats.unit >= exact).all() and (exact > 0).any()


# --- VA file ------------------------------------------------------------------------------

def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, np.array([math.floor(scale * float(np.float32(x))) for x in v], object)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), list(r[1])))[:k]]
    near = lambda v: min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centroids = [sum(v for (_, v), o in zip(kept, own) if o == n) // own.count(n) if own.count(n) else c for n, c in enumerate(centroids)]
    out = [(i, *near(v)) for i, v in kept]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sum(x for _, x, y in out if y == c), sum(x for _, x, _ in out), names[c]) for i, d, c in out), key=str)


def clusters(spark, rows, **options):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
                   for r in vafile.clustered(table(spark, rows), **options).collect()), key=str)


@pytest.mark.parametrize("bits,sample", [(6, 10_000), (2, 30), (1, 1)])
def test_clusters_match_brute_force(spark, monkeypatch, bits, sample):
    monkeypatch.setattr(vafile, "SAMPLE", sample)
    monkeypatch.setattr(vafile, "BLOCK", 64)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(250)] + [(300 + i, (np.eye(12)[i % 3] + 0.01 * rng.normal(size=12)).tolist()) for i in range(150)]
    rows += [(500 + i, [1.0] * 12) for i in range(40)]
    assert clusters(spark, rows, k=7, rounds=4, dims=12, scale=20, bits=bits) == brute_clusters(rows, 7, 4, 12, 20)


def test_clusters_of_odd_vectors(spark):
    same = [(i, [0.5, -0.5]) for i in range(5)]  # centroids that are equal: the smaller number wins, the others stay empty
    odd = [(10, None), (11, []), (12, [1.0]), (13, [1.0, None]), (14, [float("nan"), 1.0]), (15, [float("-inf"), 1.0]), (None, [1.0, 1.0]), (1, [0.5, -0.5]), (1, [2.0, 2.0])]
    assert clusters(spark, same + odd, k=4, rounds=2, dims=2, scale=64) == brute_clusters(same + odd, 4, 2, 2, 64)
    assert clusters(spark, same[:2], k=16, rounds=1, dims=2, scale=64) == brute_clusters(same[:2], 16, 1, 2, 64)
    assert clusters(spark, []) == [] and clusters(spark, [(1, [3.0e38, 1.0])], dims=2) == []


def test_cells_keep_their_vectors():
    vectors = rng.integers(-500, 500, (300, 5))
    cells = vafile.Cells(vectors[:20], vectors.min(0), vectors.max(0), 3)
    codes = cells.unpack(cells.pack(vectors))
    for d in range(5):
        assert (cells.first[d][codes[:, d]] <= vectors[:, d]).all() and (vectors[:, d] <= cells.last[d][codes[:, d]]).all()
    centroids = rng.integers(-500, 500, (6, 5))
    left = vafile.candidates(codes, cells.tables(centroids), cells.differences(centroids))
    own, _ = vafile.nearest(vectors, centroids)
    assert left[np.arange(300), own].all() and (left.sum(1) == 1).any()
