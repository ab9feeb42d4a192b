"""Secret scans: patterns for known forms, and grammar inference for the formats of labelled credentials.

``base_spans`` finds assignments, access keys and long hexadecimal strings, leftmost and without overlap per kind.

``infer`` learns a probabilistic automaton per format from labelled strings (ALERGIA): the strings form a prefix tree with
counts; states are merged, in the order of their strings, when their ends and their symbols' shares differ by no more than
Hoeffding's bound allows, all along their subtrees, and what makes the automaton ambiguous is folded. Symbols are classes
of characters, but the first ``PREFIX`` characters stand for themselves, so that fixed beginnings are learned.

``scan`` adds spans: every candidate (a run of ``LEAST`` token characters or more, the least that an assignment is learned
from, with dots inside) is scored by all automata; its score is the likelihood per character, over all its characters, against
the likelier of two other explanations: the ordinary words of all documents, and ``identifier``, a model of names, numbers, dates and
paths that knows runs of letters and digits but no format. Characters of a class share its likelihood, so that classes of any
size compare. Candidates that reach the grammar's margin become spans of kind ``format``, unless a base span covers them. A
quarter of the labelled strings is held back from the automata; the margin is half of what all but a twentieth of
them reach, and ``FLOOR`` at least. Of equal scores none is preferred, as one format is enough.

The labelled credentials are the base spans of documents, a sample of at most ``SAMPLE`` strings a kind, those with the
smallest hashes. The background are the symbols that follow each other in the runs of all documents outside base spans,
counted in Spark. All texts are scanned whole, each in one Arrow batch row.

Nulls are empty texts: no spans. Offsets are code points, ends exclusive. Equal rows give equal results. An empty table gives an
empty result, a table without credentials base spans alone. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import chunks

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SAMPLE, PREFIX, LEAST, ALPHA = 400, 4, 6, 0.05
MARGIN, FLOOR, ENOUGH = 0.6, 0.3, 20  # of scores: without held-back strings, at least, and how many of them are enough
CANDIDATE = re.compile(rf"(?=[A-Za-z0-9+/_=.-]{{{LEAST}}})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
HELD = 200_000  # answers for short values that are kept for the next time
_PLACES = [str(i) for i in range(PREFIX + 2)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a shorter run of these characters holds no match, so the length is part of the pattern
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_FIRST = {chr(c): "^" + chr(c) for c in range(128)}
_KIND = {chr(c): "9" if chr(c).isdigit() else "f" if chr(c) in "abcdef" else "F" if chr(c) in "ABCDEF" else "z" if chr(c).islower() else "Z" if chr(c).isupper() else chr(c)
         for c in range(128)}


def _symbols(value: str) -> list[str]:
    """Values are ASCII."""
    return [_FIRST[c] for c in value[:PREFIX]] + [_KIND[c] for c in value[PREFIX:]]


#: Number of symbols of candidates: 67 characters at the first places, ten classes, the end.
SYMBOLS = 67 + 10 + 1


#: Bits that tell the characters of a class apart.
_WITHIN = {"9": math.log2(10), "f": math.log2(6), "F": math.log2(6), "z": math.log2(20), "Z": math.log2(20)}
_TOKEN_CHARACTERS = math.log2(68)


def _model_of_names() -> tuple[list[float], list[list[float]]]:
    """Bits of each class of characters at the start, and behind each class (rows); a character's own bits included.

    Classes: lower case, upper case, digits, others. A run goes on with four fifths; the end, a tenth, is not part of the table.
    """
    own = [math.log2(26), math.log2(26), math.log2(10), math.log2(6)]
    follow = [[0.8, 0.2 / 3, 0.2 / 3, 0.2 / 3], [0.2 / 3, 0.8, 0.2 / 3, 0.2 / 3], [0.2 / 3, 0.2 / 3, 0.8, 0.2 / 3], [0.3, 0.3, 0.3, 0.1]]
    return [math.log2(0.25) - x for x in own], [[math.log2(0.9 * p) - x for p, x in zip(row, own)] for row in follow]


_FIRST_BITS, _NEXT_BITS = _model_of_names()
_CLASS = {chr(c): 0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 3 for c in range(128)}


def identifier(value: str) -> float:
    """Log2 of the likelihood of a value as a name, number, date or path."""
    classes = [_CLASS[c] for c in value]
    bits = _FIRST_BITS[classes[0]] + math.log2(0.1)
    for a, b in zip(classes, classes[1:]):
        bits += _NEXT_BITS[a][b]
    return bits


class Automaton:
    """Counts of symbols and ends per state, and where the symbols lead."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.ends, self.counts, self.next = [0], [{}], [{}]
        for s in strings:
            state = 0
            for symbol in _symbols(s):
                self.counts[state][symbol] = self.counts[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.ends)
                    self.ends.append(0)
                    self.counts.append({})
                    self.next.append({})
                state = self.next[state][symbol]
            self.ends[state] += 1
        self.alphabet = len({x for c in self.counts for x in c}) + 1
        self._merge(alpha)
        self._take_logs()

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.counts[state].values())

    def _differ(self, a: int, n: int, b: int, m: int, alpha: float) -> bool:
        return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states may be one; ``b`` is the root of a tree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m, alpha):
                return False
            for symbol in self.counts[a].keys() | self.counts[b].keys():
                if self._differ(self.counts[a].get(symbol, 0), n, self.counts[b].get(symbol, 0), m, alpha):
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree at ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for symbol, n in self.counts[b].items():
                self.counts[a][symbol] = self.counts[a].get(symbol, 0) + n
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
                else:
                    self.next[a][symbol] = self.next[b][symbol]

    def _merge(self, alpha: float) -> None:
        red = [0]
        blue = [(0, x) for x in sorted(self.next[0])]
        while blue:
            parent, symbol = blue.pop(0)
            state = self.next[parent][symbol]
            for r in red:
                if self._compatible(r, state, alpha):
                    self.next[parent][symbol] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            seen = set(red)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in seen]
        place = {r: i for i, r in enumerate(red)}
        self.ends, self.counts, self.next = [self.ends[r] for r in red], [self.counts[r] for r in red], [{x: place[s] for x, s in self.next[r].items()} for r in red]

    def _take_logs(self) -> None:
        """Log2 of the share of a character of each symbol, of one that was never seen and of the end, by state.

        All unseen characters of a state share what one string in ten would have had.
        """
        whole = [math.log2(self.total(i) + 0.2) for i in range(len(self.ends))]
        self.logs = [{x: math.log2(n) - w - _WITHIN.get(x, 0.0) for x, n in c.items() if n} for c, w in zip(self.counts, whole)]
        self.unseen, self.stop = [math.log2(0.1) - w - _TOKEN_CHARACTERS for w in whole], [math.log2(n + 0.1) - w for n, w in zip(self.ends, whole)]

    def bits(self, symbols: list[str], least: float = -math.inf) -> float:
        """Log2 of the likelihood of the symbols, or -inf as soon as it is under the least."""
        state, bits = 0, 0.0
        for symbol in symbols:
            bits += self.logs[state].get(symbol, self.unseen[state])
            if bits < least:
                return -math.inf
            state = self.next[state].get(symbol, state)
        return bits + self.stop[state]


class Background:
    """Shares of the symbols (``$``: the end) that follow a symbol, at each of the first places or later."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.counts, self.totals, self.symbols = counts, Counter(), Counter()
        for (context, symbol), n in counts.items():
            self.totals[context] += n
            self.symbols[symbol] += n
        self.total = self.symbols.total()
        self.logs: dict[tuple[str, str], float] = {}

    @staticmethod
    def steps(symbols: list[str]) -> Iterator[tuple[str, str]]:
        return zip(map(str.__add__, chain(_PLACES, repeat(_PLACES[-1])), chain(("",), symbols)), chain(symbols, ("$",)))

    @classmethod
    def count(cls, words: Counter, into: Counter) -> Counter:
        for value, n in words.items():
            for step in cls.steps(_symbols(value)):
                into[step] += n
        return into

    def bits(self, symbols: list[str]) -> float:
        """Log2 of the likelihood of symbols. What is rare behind a symbol falls back on its share of all symbols, smoothed like an automaton's."""
        bits = 0.0
        for step in self.steps(symbols):
            if step not in self.logs:
                share = (self.symbols[step[1]] + 0.1) / (self.total + 0.1 * SYMBOLS)
                self.logs[step] = math.log2((self.counts.get(step, 0) + share) / (self.totals[step[0]] + 1)) - _WITHIN.get(step[1], 0.0)
            bits += self.logs[step]
        return bits


class Grammar:
    """An automaton per format and the background of ordinary words."""

    def __init__(self, formats: dict[str, list[str]], words: Background | list[str], alpha: float = ALPHA, margin: float = MARGIN):
        self.formats = {k: Automaton(v, alpha) for k, v in sorted(formats.items()) if v}
        self.background = words if isinstance(words, Background) else Background(Background.count(Counter(words), Counter()))
        self.margin, self.held = margin, {}

    @classmethod
    def learned(cls, formats: dict[str, list[str]], words: Background | list[str], alpha: float = ALPHA) -> Grammar:
        """A grammar of three quarters of the strings, with the margin that the others set."""
        back = {k: [v for v in values if zlib.crc32(v.encode()) % 4 == 0] for k, values in formats.items()}
        grammar = cls({k: [v for v in values if zlib.crc32(v.encode()) % 4] for k, values in formats.items()}, words, alpha)
        scores = sorted(grammar.score(v) for values in back.values() for v in values)
        if len(scores) >= ENOUGH:
            grammar.margin = max(FLOOR, scores[len(scores) // 20] / 2)
        return grammar

    def score(self, value: str) -> float:
        """Bits per character by which the likeliest format beats ordinary words and names."""
        if not self.formats:
            return -math.inf
        symbols = _symbols(value)
        return (max(a.bits(symbols) for a in self.formats.values()) - max(self.background.bits(symbols), identifier(value))) / len(value)

    def fits(self, value: str) -> bool:
        """Whether the score reaches the margin; formats are left as soon as they cannot."""
        if value in self.held:
            return self.held[value]
        symbols = _symbols(value)
        least = identifier(value) + self.margin * len(value)
        best = max((a.bits(symbols, least) for a in self.formats.values()), default=-math.inf)
        found = best >= least and best >= self.background.bits(symbols) + self.margin * len(value)
        if len(value) <= 64:
            if len(self.held) >= HELD:
                self.held.clear()
            self.held[value] = found
        return found


def _runs(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[re.Match, bool, bool]]:
    """The candidates of a text, whether a base span covers each, and whether one overlaps it."""
    covered = touched = -1
    i = j = 0
    for m in CANDIDATE.finditer(text):
        first, last = m.span()
        while i < len(base) and base[i][0] <= first:
            covered = max(covered, base[i][2])
            i += 1
        while j < len(base) and base[j][0] < last:
            touched = max(touched, base[j][2])
            j += 1
        yield m, covered >= last, touched > first


def infer(docs: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The grammar of the credentials that the base patterns label in the documents, and of all their ordinary words."""
    def label(batches: Iterator[pa.RecordBatch]):
        counts = Counter()
        for batch in chunks(batches, "text"):
            rows, plain = {}, Counter()
            for text in batch["text"].to_pylist():
                text = text or ""
                spans = base_spans(text)
                for start, kind, end in spans:
                    value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
                    rows[KINDS[kind], value] = 1
                plain.update(m[0] for m, _, touched in _runs(text, spans) if not touched)
            Background.count(plain, counts)
            yield table([(*r, 1) for r in rows])
        yield table([("word", f"{context} {symbol}", n) for (context, symbol), n in counts.items()])

    def table(rows):
        kinds = [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "value", "n"])

    found = cut_lineage(docs.select("text").mapInArrow(label, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")))
    order = F.xxhash64("value")
    parts = [found.filter(F.col("kind") == k).orderBy(order, "value").limit(sample) for k in KINDS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).collect()
    values = {k: sorted(r["value"] for r in rows if r["kind"] == k) for k in KINDS}
    # pairs of symbols, so their number does not grow with the documents
    words = {tuple(r["value"].split(" ")): r["n"] for r in found.filter("kind = 'word'").collect()}
    return Grammar.learned(values, Background(words))


def spans_of(text: str, grammar: Grammar) -> tuple[list, list]:
    """Base spans and added spans (start, kind number, end); the added kind is number 3."""
    base = base_spans(text)
    return base, [(m.start(), 3, m.end()) for m, covered, _ in _runs(text, base) if not covered and grammar.fits(m[0])]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'format')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_format of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches, "text"):
            rows = []
            for text in batch["text"].to_pylist():
                base, added = spans_of(text or "", grammar)
                rows.append((*[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added), len(added)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
