"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public byte-level vocabulary, whose path is a parameter; every single byte is one, so any text has a segmentation.
A language is a probability for each piece. The probability of a unit (a run of letters with a space before it, lower case, in
parts of at most ``PART`` bytes) is the sum over all its segmentations of the products of their pieces' probabilities, which a forward pass
over its bytes adds up. A text's is the product over its units, and the score its share among the languages, equally likely beforehand.

Training counts the units of each language over all documents with Spark, into a table that grows with the corpus, and runs
expectation maximisation over that table: each round, tasks add up the expected number of uses of each piece over all
segmentations (forward and backward), which an aggregate by language and piece brings together. What a round brings to the driver, and
what is sent to the tasks, has at most one number for each piece and language.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import held
from .scratch import Scratch, bounded_batches
from .textkit import Rolling, U

PART = 32
ROUNDS = 3
#: Weight of all languages' pieces in one's own, in uses; and what every piece has at least, as a share of an even one.
PRIOR, FLOOR = 50.0, 1e-3
#: Characters of a text that are taken at a time, units that a worker remembers, and numbers of a forward pass.
STRETCH, REMEMBERED, PASS = 1 << 20, 1 << 19, 1 << 21


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 2 for letters, 1 for marks, which go with letters, else 0."""
    import unicodedata

    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def vocabulary(path: str) -> list[bytes]:
    """The pieces that can be in a unit: all single bytes, and those of lower-case and other letters with or without a space before them."""
    pieces = [base64.b64decode(line.split()[0]) for line in open(path, "rb") if line.strip()]
    inner = frozenset([*range(ord("a"), ord("z") + 1), *range(128, 256)])
    return sorted({bytes([b]) for b in range(256)} | {p for p in pieces if len(p) <= PART and inner.issuperset(p[1:]) and (p[0] in inner or p[0] == 0x20)})


class Units:
    """Units of some texts: bytes ``starts`` to ``ends`` of ``data``, and the text each is of."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        joined = "\n" + "\n".join(lower) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8).copy()
        kinds = _classes()[points]
        inside = np.zeros(len(points) + 1, np.int8)
        inside[1:] = kinds > 0
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        letters = np.concatenate([[0], np.cumsum(kinds == 2)])
        own = letters[ends] > letters[starts]
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        at = np.concatenate([[0], np.cumsum(width)])
        starts, ends = at[starts[own]] - 1, at[ends[own]]
        data[starts] = 0x20
        base = at[np.cumsum([1, *(len(t) + 1 for t in lower[:-1])])]
        owner = np.searchsorted(base, starts + 1, "right") - 1
        parts = -(-(ends - starts) // PART)
        which = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.data, self.starts = data, starts[which] + nth * PART
        self.ends, self.owner = np.minimum(self.starts + PART, ends[which]), owner[which]
        self.roll = Rolling(data)
        self.hashes = self.roll.of(self.starts, self.ends)

    def texts(self, at: np.ndarray) -> pa.Array:
        length = self.ends[at] - self.starts[at]
        ends = np.cumsum(length)
        where = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - self.starts[at], length)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(self.data[where])])


@dataclass
class Model:
    """Keys of the pieces (sorted) and ``p``: a row for each piece, a column for each language; a last row of zeros is no piece."""

    keys: np.ndarray
    lengths: list[int]
    langs: list[str]
    p: np.ndarray
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece, or -1; a bitmap of the first 20 bits rules most out."""
        out = np.full(hashes.shape, -1, np.int64)
        if not hasattr(self, "_first"):
            self._first = np.zeros(1 << 20, bool)
            self._first[(self.keys >> U(44)).astype(np.int64)] = True
        may = np.nonzero(self._first[(hashes >> U(44)).astype(np.int64)])
        own = hashes[may]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == own, at, -1)
        return out

    def lattice(self, roll: Rolling, starts: np.ndarray, size: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end: (length, units, pieces) of the pieces that end there, in units of ``size`` bytes."""
        links: list[list] = [[] for _ in range(size + 1)]
        for k in self.lengths:
            if k > size:
                break
            begin = starts[None, :] + np.arange(size - k + 1)[:, None]
            piece = self.find(roll.of(begin, begin + k))
            place, unit = np.nonzero(piece >= 0)
            cuts = np.searchsorted(place, np.arange(size - k + 2)).tolist()
            found = piece[place, unit]
            for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    links[j + k].append((k, unit[a:b], found[a:b]))
        return links

    def forward(self, links: list, n: int, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of what is before each byte. PART pieces of FLOOR / pieces fit a double."""
        out = np.zeros((len(links), n, p.shape[1]))
        out[0] = 1.0
        for i, own in enumerate(links):
            for k, unit, piece in own:
                out[i, unit] += out[i - k, unit] * p[piece]
        return out

    def log_likelihood(self, roll: Rolling, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each unit, a column for each language."""
        out = np.zeros((len(starts), len(self.langs)))
        for at, links in self._by_length(roll, starts, ends, len(self.langs)):
            out[at] = np.log(self.forward(links, len(at), self.p)[-1])
        return out

    def _by_length(self, roll: Rolling, starts: np.ndarray, ends: np.ndarray, columns: int) -> Iterator[tuple[np.ndarray, list]]:
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], np.arange(PART + 2)).tolist()
        for size in range(1, PART + 1):
            most = max(PASS // (size * columns), 1)
            for a in range(cuts[size], cuts[size + 1], most):
                at = order[a : min(a + most, cuts[size + 1])]
                yield at, self.lattice(roll, starts[at], size)

    def uses(self, roll: Rolling, starts: np.ndarray, ends: np.ndarray, n: np.ndarray, lang: int) -> np.ndarray:
        """Expected number of uses of each piece in units that are there ``n`` times, under one language."""
        out, p = np.zeros(len(self.p)), self.p[:, lang : lang + 1]
        for at, links in self._by_length(roll, starts, ends, 2):
            before = self.forward(links, len(at), p)[:, :, 0]
            behind = np.zeros_like(before)
            behind[-1] = n[at] / before[-1]
            for i in range(len(links) - 1, 0, -1):
                for k, unit, piece in links[i]:
                    through = p[piece, 0] * behind[i, unit]
                    out += np.bincount(piece, before[i - k, unit] * through, len(out))
                    behind[i - k, unit] += through
        return out[:-1]


def stretches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about STRETCH characters with their numbers; a longer text is in several groups, cut before white space where it has any."""
    at, own, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        begin = 0
        while len(text) - begin > STRETCH:
            cut = next((j for j in range(begin + STRETCH, begin + STRETCH // 2, -1) if text[j].isspace()), begin + STRETCH)
            yield [i], [text[begin:cut]]
            begin = cut
        at.append(i)
        own.append(text[begin:])
        size += len(own[-1])
        if size > STRETCH:
            yield at, own
            at, own, size = [], [], 0
    if at:
        yield at, own


def _strings(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        own: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            own.setdefault(lang, []).append(i)
        texts = _strings(batch.column("t"))
        for lang, rows in own.items():
            for _, some in stretches([texts[i] for i in rows]):
                u = Units(some)
                _, at, n = np.unique(u.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), u.texts(at), pa.array(n)], ["lang", "unit", "n"])


def _laid_out(units: pa.Array) -> tuple[Rolling, np.ndarray, np.ndarray]:
    units = units.cast(pa.large_binary())
    offsets = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
    return Rolling(np.frombuffer(units.buffers()[2] or b"", np.uint8)), offsets[:-1], offsets[1:]


def _smoothed(uses: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces from their uses (a column for each language), and the row that is no piece."""
    if not uses.size:
        return np.zeros((len(uses) + 1, uses.shape[1]))
    total = np.maximum(uses.sum(axis=0), 1e-9)
    everywhere = (uses / total).mean(axis=1, keepdims=True)
    p = (uses + PRIOR * everywhere) / (total + PRIOR)
    p = (1 - FLOOR) * p / np.maximum(p.sum(axis=0), 1e-9) + FLOOR / len(uses)
    return np.vstack([p, np.zeros(uses.shape[1])])


def fit(docs: DataFrame, path: str, scratch: Scratch, *, rounds: int = ROUNDS) -> Model:
    """The model of ``docs`` (columns t and lang, neither null): one language for each value of lang, in code point order."""
    units = docs.mapInArrow(_counted, "lang string, unit binary, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    units = scratch.table(units, "units")
    langs = sorted(r["lang"] for r in units.select("lang").distinct().collect())  # languages
    pieces = vocabulary(path)
    buffer = b"".join(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    keys = Rolling(np.frombuffer(buffer, np.uint8)).of(ends - [len(p) for p in pieces], ends)
    model = Model(np.sort(keys), sorted({len(p) for p in pieces}), langs, _smoothed(np.ones((len(pieces), len(langs)))))
    for _ in range(rounds if langs else 0):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, sums = sent.value, {}
            for batch in batches:
                which = batch.column("lang").dictionary_encode()
                for code, lang in enumerate(which.dictionary.to_pylist()):
                    some = batch.filter(pa.array(which.indices.to_numpy() == code))
                    at = own.langs.index(lang)
                    sums[at] = sums.get(at, 0.0) + own.uses(*_laid_out(some.column("unit")), some.column("n").to_numpy().astype(float), at)
            for at, uses in sums.items():
                used = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), at, np.int32)), pa.array(used.astype(np.int32)), pa.array(uses[used])], ["lang", "piece", "uses"])

        found = units.mapInArrow(expected, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()  # pieces x languages at most
        uses = np.zeros((len(pieces), len(langs)))
        uses[found["piece"], found["lang"]] = found["uses"]
        model = Model(model.keys, model.lengths, langs, _smoothed(uses))
        sent.unpersist()
    scratch.drop("units")
    return model


class Remembered:
    """Log-likelihoods of the units that a worker has met lately."""

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.keys, self.values = np.zeros(0, U), np.zeros((0, len(self.model.langs)))

    def of(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """(values of the distinct units, which of them each unit is)."""
        keys, at, which = np.unique(u.hashes, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[where] == keys if len(self.keys) else np.zeros(len(keys), bool)
        values = np.zeros((len(keys), len(self.model.langs)))
        values[known] = self.values[where[known]]
        new = at[~known]
        values[~known] = self.model.log_likelihood(u.roll, u.starts[new], u.ends[new])
        if len(self.keys) + len(new) > REMEMBERED:
            self._empty()
        both = np.concatenate([self.keys, keys[~known]])
        order = np.argsort(both)
        self.keys, self.values = both[order], np.concatenate([self.values, values[~known]])[order]
        return values, which


def likelihoods(memory: Remembered, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text under each language, and its number of units."""
    logs, n = np.zeros((len(texts), len(memory.model.langs))), np.zeros(len(texts), np.int64)
    for at, some in stretches(texts):
        u = Units(some)
        np.add.at(n, at, np.bincount(u.owner, minlength=len(some)))
        if not logs.size:
            continue
        values, which = memory.of(u)
        for k in range(logs.shape[1]):
            np.add.at(logs[:, k], at, np.bincount(u.owner, values[which, k], len(some)))
    return logs, n


def predict(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, units of each row of ``docs``. Of equally likely languages the first in code point order is taken. A text
    that is null or has no letter, and every text under a model without languages, is ``und`` with score 0. A long text is taken in
    stretches of a million characters, cut before white space where it has any. No shuffle; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = held(("language", sent.value.token), lambda: Remembered(sent.value))
        names = np.array([*memory.model.langs, "und"], object)
        for batch in batches:
            logs, n = likelihoods(memory, _strings(batch.column("t")))
            best, score = np.full(len(n), len(names) - 1), np.zeros(len(n))
            if logs.shape[1]:
                top = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                best, score = np.where(n > 0, top, best), np.where(n > 0, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(n)], ["doc_id", "lang_pred", "score", "units"])

    own = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, units long")


def op12_language(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out (false for a null id), lang_pred, score of each row of ``docs``. Rows with a null text, lang or id teach
    nothing; a row that is there twice teaches twice. Empty tables give no rows."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "language")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    train = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").alias("t"), "lang")
    found = predict(docs, fit(train, path, scratch))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
