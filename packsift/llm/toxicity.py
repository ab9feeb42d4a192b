"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is its words (letters, digits and all non-ASCII, A to Z lower-cased). A word enters as its embedding, with the
log odds of toxic documents in front, and as the mean of the embeddings of its characters in their context. Two
gated recurrent networks read each window of ``WINDOW`` words in both directions, attention pools their states, and the
pool gives a logit. Windows start every ``STRIDE`` words, so they overlap, and the last one ends with the text: all of a
whole text is scored. The largest logit of a document, calibrated on labelled documents that the network has not seen, is
its score.

Training (``fit``) takes a bounded sample: at most ``PER_CLASS`` labelled rows of either class, those with the smallest
hash of the id, and never rows of the held-out quarter. Labels belong to documents, so of a toxic document only the
windows that look most toxic are learned, at first by the log odds of their words.

Scoring is one pass over the text in Arrow batches, without Python strings; the model (a few MB at most) goes with the task.

Nulls and empty texts are scored as one window without words. Without labels of both classes every score is the share
of toxic labels (0 without labels). Equal texts get equal scores; rows with a null id are scored but never learned from. A column
``score`` of the input is replaced; other names cannot clash. An empty table gives an empty result. Of an id with several texts one
text, whichever, is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import buffer, chunks, mix, packed, unpacked, words

PER_CLASS = 1500  # labelled rows of a class to learn from
WINDOW, STRIDE = 48, 32
VOCABULARY, CHARACTERS = 30_000, 4096
WIDTH, HIDDEN, FOCUS = 8, 8, 8
EPOCHS, BATCH, RATE = 10, 128, 0.02
THRESHOLD = 0.3

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Text:
    """The words of a batch of texts: distinct words with their characters, and the windows of each text."""

    def __init__(self, texts: pa.Array):
        data, at = buffer(texts)
        start, end, h, bounds = words(data, at, _INSIDE, _FOLD)
        self.hashes, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        self.words, self.bounds = inverse.astype(np.int32), bounds
        # each byte of a distinct word with the bytes beside it
        start, size = start[first], (end - start)[first]
        cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        where = np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])
        byte = _FOLD[data[where]] if len(data) else np.zeros(0, np.int64)
        left, right = np.roll(byte, 1), np.roll(byte, -1)
        left[cuts[:-1]], right[cuts[1:] - 1] = 0, 0
        self.grams = (mix((left << 16 | byte << 8 | right).astype(np.uint64)) % np.uint64(CHARACTERS)).astype(np.int32)
        self.cuts, self.size = cuts, size
        # windows: first word, length, and the text they belong to
        n = np.diff(bounds)
        many = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
        self.text = np.repeat(np.arange(len(n)), many)
        turn = np.arange(len(self.text)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.minimum(turn * STRIDE, np.maximum(n - WINDOW, 0)[self.text])
        self.begin, self.length = begin + bounds[:-1][self.text], np.minimum(n, WINDOW)[self.text]
        self.first = np.cumsum(many) - many

    def window(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words (0 beyond the end) and the mask of some windows, by place."""
        place = np.arange(WINDOW)
        mask = place < self.length[some][:, None]
        at = np.where(mask, self.begin[some][:, None] + place, 0)
        return (self.words[at] if len(self.words) else np.zeros_like(at)).T, mask.T.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": draw(len(vocabulary) + 1, WIDTH), "char": draw(CHARACTERS, WIDTH), "focus": draw(2 * HIDDEN, FOCUS),
                  "look": draw(FOCUS), "out": draw(2 * HIDDEN), "bias": np.full(1, -1, np.float32)}
        self.p["word"] *= 0.3
        self.p["word"][0] = 0
        self.p["word"][1:, 0] = odds
        for side in "fb":
            self.p |= {f"w{side}": draw(2 * WIDTH, 3 * HIDDEN), f"u{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the word table, and the input vector of each distinct word."""
        at = np.searchsorted(self.vocabulary, text.hashes)
        at = np.minimum(at, max(len(self.vocabulary) - 1, 0))
        rows = np.where(self.vocabulary[at] == text.hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(len(text.hashes), int)
        chars = np.add.reduceat(self.p["char"][text.grams], text.cuts[:-1], axis=0) / text.size[:, None] if len(rows) else np.zeros((0, WIDTH))
        return rows, np.concatenate([self.p["word"][rows], chars], 1).astype(np.float32)

    def run(self, projected: dict, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what the gradients need."""
        steps, n = ids.shape
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        cache = {}
        for side, order, part in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, None))):
            h, u, table, kept = np.zeros((n, HIDDEN), np.float32), self.p[f"u{side}"], projected[side], []
            for t in order:
                x, hu = table[ids[t]], h @ u
                gates = 1 / (1 + np.exp(-(x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])))
                z, r, hn = gates[:, :HIDDEN], gates[:, HIDDEN:], hu[:, 2 * HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN:] + r * hn)
                if keep:
                    kept.append((t, h, z, r, hn, new))
                h = h + mask[t][:, None] * (1 - z) * (new - h)
                states[t, :, part] = h
            cache[side] = kept
        glance = np.tanh(states @ self.p["focus"])
        weight = np.exp(np.clip(glance @ self.p["look"], -20, 20)) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pool = np.einsum("tn,tnd->nd", weight, states)
        logit = pool @ self.p["out"] + self.p["bias"]
        return (logit, states, glance, weight, pool, cache) if keep else logit

    def project(self, x: np.ndarray) -> dict:
        """Per direction, what a word adds to the gates (one row at least, for windows without words)."""
        x = x if len(x) else np.zeros((1, 2 * WIDTH), np.float32)
        return {side: x @ self.p[f"w{side}"] + self.p[f"c{side}"] for side in "fb"}

    def gradients(self, text: Text, some: np.ndarray, label: np.ndarray, weigh: np.ndarray) -> dict:
        ids, mask = text.window(some)
        used, ids = np.unique(ids, return_inverse=True)
        ids = ids.reshape(mask.shape)
        rows, x = self.inputs_of(text, used)
        logit, states, glance, weight, pool, cache = self.run(self.project(x), ids, mask, True)
        d = ((_sigmoid(logit) - label) * weigh / weigh.sum()).astype(np.float32)
        g = {"out": pool.T @ d, "bias": d.sum(keepdims=True)}
        dpool = d[:, None] * self.p["out"]
        dstates = weight[:, :, None] * dpool
        along = np.einsum("tnd,nd->tn", states, dpool)
        dscore = weight * (along - (weight * along).sum(0))
        g["look"] = np.einsum("tn,tnk->k", dscore, glance)
        dglance = dscore[:, :, None] * self.p["look"] * (1 - glance ** 2)
        g["focus"] = np.einsum("tnd,tnk->dk", states, dglance)
        dstates += dglance @ self.p["focus"].T
        dx = np.zeros_like(x)
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u, dh = self.p[f"u{side}"], np.zeros((ids.shape[1], HIDDEN), np.float32)
            du, dc, dp = np.zeros_like(u), 0, np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, z, r, hn, new in reversed(cache[side]):
                dh = dh + dstates[t, :, part]
                m = mask[t][:, None]
                dz = dh * m * (h - new) * z * (1 - z)
                dn = dh * m * (1 - z) * (1 - new ** 2)
                dr = dn * hn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                du += h.T @ dg
                dh = dh * (1 - m * (1 - z)) + dg @ u.T
                dgate = np.concatenate([dz, dr, dn], 1)
                np.add.at(dp, ids[t], dgate)
            dc = dp.sum(0)
            g[f"u{side}"], g[f"c{side}"], g[f"w{side}"] = du, dc, x.T @ dp
            dx += dp @ self.p[f"w{side}"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], rows, dx[:, :WIDTH])
        g["word"][0] = 0
        size = text.size[used] if len(text.size) else np.zeros(0, int)
        if len(size):
            flat = np.concatenate([np.arange(text.cuts[k], text.cuts[k + 1]) for k in used])
            np.add.at(g["char"], text.grams[flat], np.repeat(dx[:, WIDTH:] / size[:, None], size, axis=0))
        return g

    def inputs_of(self, text: Text, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = object.__new__(Text)
        if not len(text.size):
            part.hashes = text.hashes
            return np.zeros(len(used), int), np.zeros((len(used), 2 * WIDTH), np.float32)
        part.hashes, part.size = text.hashes[used], text.size[used]
        part.grams = text.grams[np.concatenate([np.arange(text.cuts[k], text.cuts[k + 1]) for k in used])]
        part.cuts = np.concatenate([[0], np.cumsum(part.size)])
        return self.inputs(part)

    def logits(self, text: Text, some: np.ndarray | None = None) -> np.ndarray:
        """Logits of all windows (or some), in blocks."""
        projected = self.project(self.inputs(text)[1])
        some = np.arange(len(text.text)) if some is None else some
        return np.concatenate([self.run(projected, *text.window(some[i:i + 2048])) for i in range(0, len(some), 2048)] or [np.zeros(0)])


class Model:
    """A network with its calibration, or a constant score."""

    def __init__(self, texts: list[str], labels: np.ndarray, share: float, seed: int = 7):
        self.constant = None
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(share)
            return
        rng = np.random.default_rng(seed)
        text = Text(pa.array(texts, pa.large_string()))
        test = rng.random(len(labels)) < 0.2  # not learned from, to calibrate
        for value in (0, 1):
            if (test & (labels == value)).sum() < 1 or (~test & (labels == value)).sum() < 1:
                test[:] = False
        odds, vocabulary = self._odds(text, labels, ~test)
        self.network = Network(text.hashes[vocabulary], odds[vocabulary], seed)
        self._train(text, labels, ~test, odds, rng)
        most = np.maximum.reduceat(self.network.logits(text), text.first)
        use = test if test.any() else ~test
        self.slope, self.shift = self._calibrate(most[use], labels[use], np.where(labels[use] == 1, share / max(labels[use].mean(), 1e-9), (1 - share) / max(1 - labels[use].mean(), 1e-9)))

    @staticmethod
    def _odds(text: Text, labels: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shrunk log odds per distinct word, and the words (sorted) to embed: those in two documents or more."""
        doc = np.repeat(np.arange(len(labels)), np.diff(text.bounds))
        seen = np.unique(doc.astype(np.int64) * len(text.hashes) + text.words)
        seen_doc, seen_word = seen // len(text.hashes), seen % len(text.hashes)
        keep = use[seen_doc]
        toxic = np.bincount(seen_word[keep & (labels[seen_doc] == 1)], minlength=len(text.hashes))
        clean = np.bincount(seen_word[keep & (labels[seen_doc] == 0)], minlength=len(text.hashes))
        n1, n0 = (use & (labels == 1)).sum(), (use & (labels == 0)).sum()
        odds = np.log((toxic + 0.3) / (n1 + 0.6)) - np.log((clean + 0.3) / (n0 + 0.6))
        odds = (odds * (toxic + clean) / (toxic + clean + 3)).astype(np.float32)
        frequent = np.argsort(-(toxic + clean), kind="stable")[:VOCABULARY]
        return odds, np.sort(frequent[(toxic + clean)[frequent] > 1])

    def _train(self, text: Text, labels: np.ndarray, use: np.ndarray, odds: np.ndarray, rng) -> None:
        net, of = self.network, text.text
        reach = np.concatenate([[0], np.cumsum(np.maximum(odds[text.words], 0))])
        belief = reach[text.begin + text.length] - reach[text.begin]
        positive, negative = np.flatnonzero(use[of] & (labels[of] == 1)), np.flatnonzero(use[of] & (labels[of] == 0))
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            if epoch > 2:
                belief = np.zeros(len(of))
                belief[positive] = net.logits(text, positive)
            # the most toxic window of each toxic document; of the others random windows and the most suspicious ones
            order = positive[np.lexsort((-belief[positive], of[positive]))]
            best = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
            some = rng.choice(negative, min(len(negative), 2 * len(best) + 500), replace=False)
            if epoch > 2 and len(negative):
                pool = rng.choice(negative, min(len(negative), 8 * len(best) + 1000), replace=False)
                doubt = net.logits(text, pool)
                some = np.concatenate([some, pool[np.argsort(-doubt)[:len(best)]]])
            sample = rng.permutation(np.concatenate([best, some]))
            truth = labels[of[sample]].astype(np.float32)
            balance = np.where(truth == 1, (truth == 0).sum() / max((truth == 1).sum(), 1) / 2, 1.0)
            for i in range(0, len(sample), BATCH):
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for k, g in net.gradients(text, sample[i:i + BATCH], truth[i:i + BATCH], balance[i:i + BATCH]).items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    @staticmethod
    def _calibrate(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
        """Weighted logistic regression on one number, by Newton's steps with a little shrinkage."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = _sigmoid(a * x + b)
            s = weigh * p * (1 - p) + 1e-6
            ga, gb = (weigh * (p - y) * x).sum() + 0.5 * (a - 1), (weigh * (p - y)).sum() + 0.05 * b
            haa, hab, hbb = (s * x * x).sum() + 0.5, (s * x).sum(), s.sum() + 0.05
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        return float(max(a, 0.05)), float(b)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant if self.constant is not None else 0.0)
        text = Text(texts)
        most = np.maximum.reduceat(self.network.logits(text), text.first).astype(float)
        return np.round(_sigmoid(self.slope * most + self.shift), 6)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled documents outside the held-out quarter."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.filter(~held_out(F.col("doc_id")))
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = [labels.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(PER_CLASS) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    return Model(sample["text"].tolist(), sample["toxic"].to_numpy(int), share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents and ``score``, from whole texts."""
    rows = packed(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch["text"]), pa.float64())], ["text", "rest", "score"])

    return unpacked(rows.mapInArrow(run, StructType([*rows.schema, StructField("score", DoubleType())])), docs.columns, "score")
