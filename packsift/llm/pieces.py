"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and exact decoding.

The automaton holds all pieces of a vocabulary file. Reading a text once, it reports at each position the pieces that end
there, longest first along the output links; each relaxes the best score of its end: ``best[end] = max(best[start] + score)``.
Characters that no piece covers cost ``UNKNOWN`` below the lowest score and become byte pieces.

As usual a space becomes U+2581 and one is put in front of the text. A literal U+2581 of the text is written in byte
pieces, so decoding gives every text back exactly.

Positions that no piece can cross cut a text without changing its best path: before a run of spaces, and around
characters that are in no longer piece. Which these are is read off the vocabulary. Each task keeps the encodings of the
chunks that it met last, ``CACHE`` at most, so that repeated words are encoded once. They are kept in two halves: when the
newer one is full, the older one goes, so that words that come again and again stay.

Ties: the earliest start (longest last piece) wins. Nulls: null ids and no tokens. An empty text has no tokens. Repeated rows
are encoded each, an empty table gives an empty result.
Columns named like an added one are replaced. The vocabulary file is a parameter; its bytes are broadcast, so that executors need not have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .shared import chunks, packed, unpacked

SPACE, UNKNOWN, CACHE = "▁", 10.0, 150_000


class Pieces:
    """Encoder and decoder over a serialized model."""

    def __init__(self, model: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(model.get_piece_size())
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        # control, unknown and byte pieces stand for no text of their own
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.value = {i: bytes([b]) for b, i in self.byte.items()}
        if len(self.byte) < 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        self.automaton = ahocorasick.Automaton()
        for i in sorted(plain, reverse=True):
            self.automaton.add_word(self.text[i], (len(self.text[i]), model.get_score(i), i))
        self.automaton.make_automaton()
        self.lowest = min(model.get_score(i) for i in plain) - UNKNOWN
        inner = {c for t in self.text.values() if len(t) > 1 for c in t}
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.text.values())
        alone = "".join(re.escape(chr(c)) for c in range(33) if chr(c) not in inner)
        space = "" if crossing else SPACE
        self.cut = re.compile(f"[{alone}]|{SPACE if not crossing else '(?!)'}+[^{space}{alone}]*|[^{space}{alone}]+")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.back: dict[int, bytes] = {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()} | self.value

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best path over one chunk."""
        lowest, best, last = self.lowest, [0.0], [None]  # by position: the best score, and the last piece of its path
        n = 0
        for end, found in self.automaton.iter(chunk):
            while n < end:  # no piece ends here
                best.append(best[n] + lowest)
                last.append(None)
                n += 1
            size, score, _ = found
            value = best[end + 1 - size] + score
            # an unknown character is only a way out where no piece is that character
            if n == end:
                top = best[end] + lowest
                n += 1
                if value > top or size == 1:
                    best.append(value)
                    last.append(found)
                else:
                    best.append(top)
                    last.append(None)
            elif value > best[n] or size == 1 and last[n] is None:
                best[n], last[n] = value, found
        out, end = [], len(chunk)
        while end:
            if end > n or last[end] is None:
                out.extend(self.byte[b] for b in reversed(chunk[end - 1].encode()))
                end -= 1
            else:
                size, _, i = last[end]
                out.append(i)
                end -= size
        return out[::-1]

    def part(self, chunk: str) -> tuple[int, ...]:
        found = self.cache.get(chunk)
        if found is None:
            found = self.older.get(chunk)
            if len(self.cache) >= CACHE // 2:
                self.cache, self.older = {}, self.cache
            found = self.cache[chunk] = tuple(self.viterbi(chunk)) if found is None else found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for k, plain in enumerate(text.split(SPACE)):
            if k:  # a literal U+2581
                out += [self.byte[b] for b in SPACE.encode()]
            escaped = plain.replace(" ", SPACE)
            for chunk in self.cut.findall(escaped if k else SPACE + escaped):
                out += self.cache.get(chunk) or self.part(chunk)
        return out

    def decode(self, ids) -> str:
        """The text of ids; the space in front is dropped."""
        back = self.back
        return b"".join([back.get(i, b"") for i in ids]).decode("utf-8", "replace")[1:]


def encoded(docs: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """All columns of the documents, ``ids``, ``n_tokens`` and ``exact`` (the ids decode to the text).

    Without ``keep_text`` the texts, which callers that need only the encodings would carry back from Python, are left out.
    """
    with open(path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = packed(docs, "text")
    kept = [c for c in rows.columns if c != "text" or keep_text]

    def run(batches: Iterator[pa.RecordBatch]):
        pieces = Pieces(model.value)
        for batch in chunks(batches, "text"):
            ids, exact = [], []
            for text in batch["text"].to_pylist():
                got = None if text is None else pieces.encode(text)
                ids.append(None if got is None else np.array(got, np.int32))
                exact.append(text is None or pieces.decode(got) == text)
            sizes = [0 if x is None else len(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.int64()), pa.array(exact, pa.bool_())], [*kept, "ids", "n_tokens", "exact"])

    added = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("exact", BooleanType())]
    found = rows.mapInArrow(run, StructType([*(rows.schema[c] for c in kept), *added]))
    return unpacked(found, [c for c in docs.columns if c != "text" or keep_text], "ids", "n_tokens", "exact")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """All columns and ``decoded``, the text of column ``ids`` (null: null)."""
    with open(path, "rb") as file:
        model = encodings.sparkSession.sparkContext.broadcast(file.read())
    rows = packed(encodings, "ids")

    def run(batches: Iterator[pa.RecordBatch]):
        pieces = Pieces(model.value)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["ids", "rest", "decoded"])

    return unpacked(rows.mapInArrow(run, StructType([*rows.schema, StructField("decoded", StringType())])), encodings.columns, "decoded")
