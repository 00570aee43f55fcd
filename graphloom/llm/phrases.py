"""Phrase collocation mining with count-min sketches.

1. Sketches. Tasks count words and word pairs of their texts, exactly within a batch, and add the counts to a count-min sketch of ``DEPTH``
   rows of ``WIDTH`` counters. A task sends only the counters that it has touched, in ranges; ranges of all tasks are added up
   as they stream by. What is kept of the merged sketch is a bit for each counter: whether it reaches the threshold. As a sketch
   never counts less than there is, a phrase whose bits are not all set is not frequent. A second sketch counts phrases of three words and more, of which
   every word pair has passed the first (a phrase is never more frequent than what it holds).
2. Exact counts. Phrases that pass both are aggregated by language and text, so nothing frequent is lost and nothing else is shuffled.
   Within a batch words get numbers through a dictionary, and phrases are numbered from those: no hash stands for a text.
3. Scores and subsumption are joins of the frequent phrases with their parts and with what they are part of.

Bounds: the bits are DEPTH * WIDTH / 8 bytes for a sketch (32 MB) at any size of the corpus, and so are the only thing that is
broadcast. A corpus that fills the counters makes the sketch let more pass: more is shuffled, and the result is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches
from .textkit import LOWER, WORD_FACTOR, Rolling, U, mix

MOST_WORDS = 5
DEPTH, WIDTH = 2, 1 << 27
RANGE = 1 << 18
#: Touched counters that a task holds before it sends them.
HELD = 1 << 21
#: Bytes of a text that are taken at a time.
STRETCH = 1 << 18
SPLIT = np.zeros(256, bool)
SPLIT[[*b".,;:!?\n\x0b\x0c\r"]] = True
GAP = SPLIT.copy()
GAP[[0x20, 0x09]] = True
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d\x20\x09]")
_END = re.compile(rb"[.,;:!?\x0a-\x0d]|(?:[\x20\x09]+[^.,;:!?\x0a-\x0d\x20\x09]+){%d}" % MOST_WORDS)


def packed(array: np.ndarray) -> bytes:
    return pa.compress(array.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


class Tokens:
    """Words of a buffer: their numbers in its dictionary, the piece each is in, and phrases as bytes. Phrases that begin at
    ``limit`` or later belong to the next stretch."""

    def __init__(self, buffer: bytes, cut: int | None = None):
        data = LOWER[np.frombuffer(buffer + b"\n", np.uint8)]
        gap = GAP[data]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = ~gap
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.piece = np.cumsum(SPLIT[data], dtype=np.int32)[starts]
        self.limit = len(starts) if cut is None else int(np.searchsorted(starts, cut))
        data[ends] = 0x20  # words are laid end to end with one space after each
        gap[ends] = False
        self.data = data[~gap]
        self.offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        large = self.offsets[-1] > np.iinfo(np.int32).max
        kind, offsets = (pa.large_binary(), self.offsets) if large else (pa.binary(), self.offsets.astype(np.int32))
        words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)]).dictionary_encode()
        self.ids, self.size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        self.first = np.zeros(self.size, np.int64)
        self.first[self.ids[::-1]] = np.arange(len(self.ids))[::-1]
        self.hashes = Rolling(self.data).of(self.offsets[self.first], self.offsets[self.first + 1])

    def hash(self, at: np.ndarray, words: int, seed: int) -> np.ndarray:
        out = np.zeros(len(at), U)
        for j in range(words):
            out += self.hashes[self.ids[at + j]] * WORD_FACTOR[j]
        return mix(out + U(seed), words)

    def texts(self, at: np.ndarray, words: int) -> pa.Array:
        begin, length = self.offsets[at], self.offsets[at + words] - 1 - self.offsets[at]
        ends = np.cumsum(length)
        where = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - begin, length)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(self.data[where])])


class Bits:
    """Which counters of a merged sketch reach the threshold."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def may_be(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in counters(hashes):
            out &= (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def counters(hashes: np.ndarray) -> list[np.ndarray]:
    """The counter of each hash in each row of the sketch; rows are laid end to end."""
    return [(mix(hashes, 100 + row) & U(WIDTH - 1)).astype(np.uint32) + np.uint32(row * WIDTH) for row in range(DEPTH)]


def counted(t: Tokens, seed: int, gates: dict[int, Bits], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to ``upto`` words: number of words, where each distinct phrase is first, its count here and its hash; only
    phrases that pass the gate for their number of words, and all of whose parts have passed theirs."""
    n = len(t.ids)
    alive, code = np.ones(n, bool), t.ids
    for words in range(1, upto + 1):
        if words == 1:
            at, first, which = np.arange(n), t.first, t.ids
        else:
            both = alive[:-1] & alive[1:]
            if words == 2:
                both &= t.piece[:-1] == t.piece[1:]
            at = np.flatnonzero(both)
            _, first, which = np.unique(code[at] * t.size + t.ids[at + words - 1], return_index=True, return_inverse=True)
        where = at[first]
        count = np.bincount(which[: np.searchsorted(at, t.limit)], minlength=len(where))
        hashes = t.hash(where, words, seed)
        passed = gates[words].may_be(hashes) if words in gates else np.ones(len(where), bool)
        own = passed & (count > 0)
        yield words, where[own], count[own], hashes[own]
        alive, code = np.zeros(n, bool), np.zeros(n, np.int64)
        alive[at], code[at] = passed[which], which


def buffers(texts: list[bytes]) -> Iterator[tuple[bytes, int | None]]:
    """Short texts together, a long one in stretches: (bytes, where the next stretch begins). A stretch ends at a gap and is
    followed by the words that phrases of it may reach."""
    held, size = [], 0
    for text in texts:
        if len(text) > STRETCH:
            begin = 0
            while begin < len(text):
                gap = _BREAK.search(text, begin + STRETCH)
                cut = gap.start() if gap else len(text)
                end = _END.search(text, cut)
                yield text[begin : end.end() if end else len(text)], cut - begin
                begin = cut
            continue
        if size + len(text) > STRETCH:
            yield b"\n".join(held), None
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield b"\n".join(held), None


@lru_cache(1 << 12)
def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Tokens]]:
    texts, langs = batch.column("t").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()
    own: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts):
        own.setdefault(lang, []).append(text)
    for lang, some in own.items():
        for buffer, cut in buffers(some):
            yield lang, Tokens(buffer, cut)


def _encoded(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Touched counters and what they hold, by range. ``held``: counter and count as one number each."""
    if not held:
        return
    both = np.concatenate(held)
    both.sort()
    at = (both >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    at, count = at[first], np.minimum(np.add.reduceat(both & U(0xFFFFFFFF), first), U(1 << 30)).astype(np.uint32)
    parts, begins = np.unique(at // RANGE, return_index=True)
    ends, data = np.append(begins[1:], len(at)), []
    for part, a, b in zip(parts.tolist(), begins.tolist(), ends.tolist()):
        gaps = np.diff(at[a:b] - part * RANGE, prepend=0).astype(np.uint32)
        data.append(packed(np.concatenate([gaps, count[a:b]])))
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array((ends - begins).astype(np.int32)), pa.array(data, pa.binary())], ["part", "touched", "data"])


def _sketch(rows: DataFrame, gates, orders: range, threshold: int, depth: int = DEPTH) -> DataFrame:
    """(part, bits): for each range of the merged sketch that has any, which counters reach the threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, own = [], 0, _gates(gates)
        for batch in batches:
            for lang, t in _by_language(batch):
                for words, _, n, hashes in counted(t, _seed(lang), own, orders[-1]):
                    if words in orders:
                        held += [(at.astype(U) << U(32)) | n.astype(U) for at in counters(hashes)]
                        size += depth * len(n)
                if size > HELD:
                    yield from _encoded(held)
                    held, size = [], 0
        yield from _encoded(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = -1, np.zeros(RANGE, np.uint32)  # rows come by range: one at a time is held

        def done() -> Iterator[pa.RecordBatch]:
            bits = own >= threshold
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([packed(np.packbits(bits, bitorder="little"))], pa.binary())], ["part", "bits"])

        for batch in batches:
            for part, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "touched", "data"))):
                if part != last:
                    yield from done()
                    last, own = part, np.zeros(RANGE, np.uint32)
                both = unpacked(data, np.uint32, 2 * n)
                at = np.cumsum(both[:n], dtype=np.int64)
                own[at] = np.minimum(own[at] + both[n:], np.uint32(1 << 30))
        yield from done()

    touched = rows.mapInArrow(count, "part int, touched int, data binary")
    return touched.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")


def _gates(gates) -> dict[int, Bits]:
    return {words: Bits(bits.value) for words, bits in gates.items()}


def _broadcast(sketch: DataFrame):
    bits = np.zeros(DEPTH * WIDTH // 8, np.uint8)
    for row in sketch.collect():  # DEPTH * WIDTH / RANGE rows at most
        at = row["part"] * (RANGE // 8)
        bits[at : at + RANGE // 8] = unpacked(bytes(row["bits"]), np.uint8, RANGE // 8)
    return sketch.sparkSession.sparkContext.broadcast(bits)


def frequent(docs: DataFrame, scratch: Scratch, *, threshold: int = 100) -> DataFrame:
    """lang, words, phrase, f: exact counts of all phrases of 1 to MOST_WORDS words with f >= threshold; and for each language a
    row of 0 words with the number of all its words."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    pairs = _broadcast(_sketch(rows, {}, range(1, 3), threshold))
    gates = {1: pairs, 2: pairs}
    longer = _broadcast(_sketch(rows, gates, range(3, MOST_WORDS + 1), threshold))
    gates |= {words: longer for words in range(3, MOST_WORDS + 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _gates(gates)
        for batch in batches:
            for lang, t in _by_language(batch):
                total = [pa.array([0], pa.int32()), pa.array([""], pa.large_string()), pa.array([t.limit], pa.int64())]
                found = [total, *([pa.array(np.full(len(n), words, np.int32)), t.texts(at, words), pa.array(n)] for words, at, n, _ in counted(t, _seed(lang), own, MOST_WORDS))]
                columns = [pa.concat_arrays(x) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), columns[0], columns[1].cast(pa.string()), columns[2]], ["lang", "words", "phrase", "n"])

    exact = rows.mapInArrow(count, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
    return scratch.table(exact.where((F.col("words") == 0) | (F.col("f") >= threshold)), "frequent")


def _score(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits, which the products of 64-bit counts fit."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * F.col(a).cast("decimal(15,0)")).cast("decimal(19,0)") * big(n)
    return F.call_function("div", top.cast("decimal(38,0)"), (big(l) * big(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, *, threshold: int = 100, most: int = 2000) -> DataFrame:
    """Each language's ``most`` best phrases of 2 to MOST_WORDS words: lang, rank, phrase, a, l, r, n, score.

    Words are split at blanks and tabs inside pieces, pieces at ``. , ; : ! ?`` and line ends; A-Z are folded. A phrase with
    a = f(phrase) >= threshold has the score of its lowest cut, floor(1000 * a * n / (f(first part) * f(rest))), of equal cuts that with
    the shortest first part. It is dropped if a longer frequent phrase that holds it occurs as often (100 * f(longer) >= 100 * a): it
    suffices to look one word further, since a phrase between the two occurs as often as both. Order: score, a (both falling), phrase in the order of UTF-8 bytes.

    Null text is empty, null lang is ``und``, together with rows that say so. Rows that repeat count again. A text of any
    length is counted whole, in stretches of 256 KB with the words that phrases reach beyond them. Languages without words or frequent
    phrases, and empty tables, give no rows. Ids and other columns are not read. ``a`` is exact up to 10**15, other counts to 2**63.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    found = frequent(docs, scratch, threshold=threshold)
    size = found.where("words = 0").select("lang", F.col("f").alias("n"))
    phrase = found.where("words between 2 and %d" % MOST_WORDS)
    part = found.where("words between 1 and %d" % (MOST_WORDS - 1))
    cuts = phrase.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("t", F.split("phrase", " "))
    cuts = cuts.withColumn("head", F.array_join(F.slice("t", F.lit(1), F.col("k")), " ")).withColumn("tail", F.array_join(F.slice("t", F.col("k") + 1, F.col("words") - F.col("k")), " ")).drop("t")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(size, "lang")
    best = cuts.withColumn("score", _score("a", "n", "l", "r")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = phrase.where("words > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array(F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', words - 1)"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    ranked = kept.select("lang", "phrase", "a", "n", "x.l", "x.r", "x.score")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(docs: DataFrame) -> DataFrame:
    return collocations(docs)


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
s AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
k AS (SELECT lang, phrase, m, f AS a, k, string_split(phrase, ' ') AS t FROM f, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
c AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.f AS l, y.f AS r, s.n, (1000 * k.a * s.n) // (x.f * y.f) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.t[1 : k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.t[k.k + 1 : k.m], ' ') JOIN s ON s.lang = k.lang),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, array_to_string(string_split(phrase, ' ')[2 : m], ' ') AS phrase, f FROM f WHERE m > 2 UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[1 : m - 1], ' '), f FROM f WHERE m > 2),
e AS (SELECT lang, phrase, max(f) AS longer FROM d GROUP BY lang, phrase),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN e ON b.lang = e.lang AND b.phrase = e.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""
