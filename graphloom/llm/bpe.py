"""Byte-level BPE encoding and decoding with a pair occurrence index.

A worker cuts texts into units (white space, or a run of other characters with the space before it; no rule of the
pre-tokenizer looks further), and encodes each distinct unit once. The new units of a slice of the partition are encoded
together: an index maps each adjacent pair that has a rank to all its positions, ranks are taken in ascending
order, all positions of a rank merge from left to right, and the lists of the pairs that a merge makes are updated.
A pair is in front of another only by its rank, and a merge makes only pairs of higher rank, so the result is
that of merging word by word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import held
from .scratch import bounded_batches

# The white space and the pre-tokenizer pattern of byte-level BPE, and its letters for bytes.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Of each generation of a worker's units, to bound its memory.
MAX_UNITS = 400_000
_UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _letters() -> dict[str, int]:
    """Letter of the vocabulary -> byte: plain bytes stand for themselves, the others follow from code point 256."""
    rest = [b for b in range(256) if b not in PLAIN_BYTES]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model, vocab = _letters(), spec["model"], spec["model"]["vocab"]
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: to_bytes(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.merged = [vocab[a + b] for a, b in pairs]
        self.left, self.right = (keys >> 20).tolist(), (keys & 0xFFFFF).tolist()
        self.rank = dict(zip(keys.tolist(), range(len(pairs))))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.pieces = regex.compile(PIECES)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text_of = {i: str(i) for i in self.bytes_of}
        # Two generations: when the newer is full it becomes the older, and what is used again moves back.
        self.newer: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        before[ends - lengths] = -1
        pairs = symbols[:-1] << 20 | symbols[1:]
        found = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        at = np.flatnonzero((self.keys[found] == pairs) & (following[:-1] >= 0))
        ranks = self.order[found[at]]
        by = np.argsort(ranks, kind="stable")
        ranks, at = ranks[by], at[by]
        heads = np.flatnonzero(np.diff(ranks, prepend=-1))
        index = dict(zip(ranks[heads].tolist(), map(np.ndarray.tolist, np.split(at, heads[1:])))) if len(at) else {}
        heap = list(index)  # ascending, so a heap
        sym, nxt, prv = symbols.tolist(), following.tolist(), before.tolist()
        rank_of, push = self.rank.get, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.left[r], self.right[r], self.merged[r]
            places = index.pop(r)
            places.sort()
            for p in places:
                if sym[p] != a:
                    continue
                q = nxt[p]
                if q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -1
                n = nxt[p] = nxt[q]
                if n >= 0:
                    prv[n] = p
                    k = rank_of(new << 20 | sym[n])
                    if k is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            push(heap, k)
                o = prv[p]
                if o >= 0:
                    k = rank_of(sym[o] << 20 | new)
                    if k is not None:
                        if k in index:
                            index[k].append(o)
                        else:
                            index[k] = [o]
                            push(heap, k)
        left = np.array(sym, np.int64)
        alive = left >= 0
        counts = np.add.reduceat(alive, ends - lengths).tolist()
        kept, out, i = left[alive].tolist(), [], 0
        for c in counts:
            out.append(kept[i : i + c])
            i += c
        return out

    def learn(self, units: set[str]) -> None:
        names, known, old = [], self.newer, self.older
        for u in units:
            if u in old:
                known[u] = old[u]
            elif u[0] == "\0" and u[1:] in self.special:
                known[u] = str(self.special[u[1:]]), u[1:].encode()
            else:
                names.append(u)
        # A piece is a unit too: what a unit with punctuation is made of is merged once.
        split = [[u] if u.isalpha() else self.pieces.findall(u) for u in names]
        new = []
        for w in {w for s in split for w in s}:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    new.append(w)
        text_of, bytes_of = self.text_of, self.bytes_of
        for w, got in zip(new, self.merge([w.encode() for w in new])):
            known[w] = ",".join([text_of[i] for i in got]), b"".join([bytes_of[i] for i in got])
        for name, s in zip(names, split):
            if len(s) > 1:
                got = [known[w] for w in s]
                known[name] = ",".join([x[0] for x in got]), b"".join([x[1] for x in got])

    def units(self, text: str) -> list[str]:
        """The units of a text, in order; a special token in it is one."""
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return [u for k, part in enumerate(parts) for u in (["\0" + part] if k % 2 else _UNITS.findall(part))]
        return _UNITS.findall(text)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its decimal ids, joined by commas, and the bytes that they stand for."""
        if len(self.newer) > MAX_UNITS:
            self.older, self.newer = self.newer, {}
        split = [self.units(t) for t in texts]
        unknown = set().union(*split).difference(self.newer)
        if unknown:
            self.learn(unknown)
        for s in split:
            got = list(map(self.newer.__getitem__, s))
            yield ",".join([x[0] for x in got]), b"".join([x[1] for x in got])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD. Ids that are not in the vocabulary are left out."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The worker's own: what it has learnt serves its next tasks."""
    return held(("bpe", path), lambda: Codec(path))


def _slices(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _mapped(docs: DataFrame, path: str, make, fields: list[tuple[str, str, pa.DataType]], text: str, doc_id: str) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = [make(ids, raw) for part in _slices(batch.column("t").to_pylist()) for ids, raw in own.encode(part)]
            columns = [pa.array([r[k] for r in rows], f[2]) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f[0] for f in fields)])

    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("t"))
    return own.mapInArrow(run, ", ".join(["doc_id long", *(f"{a} {b}" for a, b, _ in fields)]))


def encode(docs: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of each whole text; null text is empty and has no ids. Rows stay one for one:
    repeated rows and null ids included. An empty table gives no rows; further columns, one named ids too, are not read."""
    make = lambda ids, raw: ([int(i) for i in ids.split(",")] if ids else [],)
    return _mapped(docs, path, make, [("ids", "array<int>", pa.list_(pa.int32()))], text, doc_id)


def decode(ids: DataFrame, path: str, *, column: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text of each array of ids, row for row; null: empty text. An empty table gives no rows; further columns, one named
    text too, are not read."""
    bounded_batches(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select(ids[doc_id].cast("long").alias("doc_id"), ids[column].alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, **names: str) -> DataFrame:
    """Of each whole text, however long: number of ids, digest of the ids, digest of the text decoded from them. Null text is empty;
    repeated rows and null ids stay, an empty table gives no rows, further columns of any name are not read."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    make = lambda ids, raw: (ids.count(",") + 1 if ids else 0, sha(ids.encode()), sha(raw.decode("utf-8", "replace").encode()))
    return _mapped(docs, path, make, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], names.get("text", "text"), names.get("doc_id", "doc_id"))


def op6_bpe(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs, path)
