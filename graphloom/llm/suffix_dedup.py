"""Repeated substrings by a distributed, sparse suffix sort.

A text is a sequence of symbols: its bytes (``BYTES``: strings of 400) or its words (``WORDS``: passages of 51, whatever white
space is between them). A symbol goes if a string of the unit's length covers it that also starts elsewhere. Sorting every
suffix of the corpus would move each text hundreds of times, so suffixes are sorted only where the text itself picks them, and
as sequences of tokens: 64-bit fingerprints of stretches of the text. For bytes (for words: 25 of 51, and cells of 5):

1. Of the 201 200-byte strings in a 400-byte string, the one with the least hash is its anchor. Equal strings have their
   anchor in the same place, so a string can only occur again if its anchor does. About one position in a hundred is
   an anchor. The suffix at an anchor is written as two tokens: the anchor string, and the hull, the text that all
   400-byte strings with this anchor cover. Sampled splitters range-partition the suffixes (position last, so that a
   hot suffix is spread over partitions); a partition sorts by multikey quicksort, token after token; neighbours are
   compared, and the first and last suffix of a partition with those across the boundary.
   Both tokens occur again: all these strings are repeated. The first does not: none is. Otherwise, and for one of
   each kind of those repeated suffixes that share their first token with others:
2. The strings of an anchor are taken in cells of 14 starts, again as two tokens (what all of a cell's strings share, and
   what they cover), and sorted in the same way.
3. The strings of the cells that are still open are sorted themselves, as two tokens of 200 bytes.

Equality of tokens is equality of 128 bits of fingerprints. Positions go back to the documents as ranges of starts. Very long
texts are read in pieces that overlap.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .held import release
from .scratch import Scratch, bounded_batches
from .textkit import BYTE_VALUE, Rolling, U, mix, word_arrays

ROWS = "core long, hull long, rk long, rk2 long, pos long"
#: Buckets whose boundaries are compared in one task.
GROUP = 1024
_MASK = U((1 << 24) - 1)


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of, and the least length of a repeat (4 to 510, as a position holds the starts of an anchor in 8 bits)."""

    words: bool
    length: int
    #: Symbols of a piece.
    piece: int = 1 << 19

    def __post_init__(self):
        if not 4 <= self.length <= 510:
            raise ValueError("a repeat has 4 to 510 symbols")

    @property
    def core(self) -> int:
        return self.length // 2

    @property
    def cell(self) -> int:
        return math.isqrt(self.length - self.core)

    def symbols(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Bytes, or hashes of words, of each text."""
        if self.words:
            return (hashes for hashes, _, _ in word_arrays(texts))
        return (np.frombuffer(t, np.uint8) for t in texts)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.words else BYTE_VALUE[symbols]


BYTES = Unit(False, 400)
#: Passages of over 50 words.
WORDS = Unit(True, 51, 1 << 16)


class Slice:
    """Some texts, or pieces of a long one, laid end to end. A piece has the starts below ``limit`` to itself."""

    def __init__(self, parts: list[tuple[int, int, int, np.ndarray]]):
        self.doc, self.offset, self.limit = (np.array([p[k] for p in parts], np.int64) for k in range(3))
        lengths = np.array([len(p[3]) for p in parts], np.int64)
        self.base = np.cumsum(lengths) - lengths
        self.lengths, self.data = lengths, np.concatenate([p[3] for p in parts])


def slices(texts: list[bytes], unit: Unit, reach: int) -> Iterator[Slice]:
    """Slices of about a piece's size; ``reach``: symbols that may be looked at from a start on."""
    release()
    parts, size = [], 0
    for i, t in enumerate(unit.symbols(texts)):
        for off in range(0, max(len(t) - unit.length + 1, 0), unit.piece):
            part = t[off : off + unit.piece + reach] if len(t) > unit.piece + reach else t
            last = len(part) == len(t) - off
            parts.append((i, off, len(part) if last else unit.piece, part))
            size += len(part)
            if size >= unit.piece:
                yield Slice(parts)
                parts, size = [], 0
            if last:
                break
    if parts:
        yield Slice(parts)


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values: of the rest of one block and the begin of the next."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, ~U(0), U)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[w - 1 : w - 1 + n])


def pack(first: np.ndarray, count: np.ndarray, back: np.ndarray) -> np.ndarray:
    """First start, number of starts (1 to 201), and distance from the first start to the anchor, in one integer."""
    return first << 16 | (count - 1) << 8 | back


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 16, (pos >> 8 & 0xFF) + 1, pos & 0xFF


def anchors(s: Slice, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """core, hull, index of the part, packed position, of each anchor of a slice."""
    none, length = np.zeros(0, np.int64), unit.length
    if len(s.data) < length:
        return none.view(U), none.view(U), none, none
    roll = Rolling(unit.values(s.data))
    grams = roll.windows(unit.core)
    least = _window_least(grams & ~_MASK | np.arange(len(grams), dtype=U), length - unit.core + 1)
    valid = np.zeros(len(least), bool)
    for b, n, limit in zip(s.base.tolist(), s.lengths.tolist(), s.limit.tolist()):
        if n >= length:
            valid[b : b + min(n - length + 1, limit)] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return none.view(U), none.view(U), none, none
    anchor = (least[at] & _MASK).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    first, last, anchor = at[head], at[np.append(head[1:] - 1, len(at) - 1)], anchor[head]
    shape = (last - first) << 8 | (anchor - first)
    hull = mix(roll.of(first, last + length) + shape.astype(U), 1)
    part = np.searchsorted(s.base, first, "right") - 1
    return grams[anchor], hull, part, pack(first - s.base[part] + s.offset[part], last - first + 1, anchor - first)


def _located(s: Slice, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marks of the slice's parts: part, first start in the slice's data, number of starts, distance to the anchor."""
    part, at = [], []
    for k, (doc, off, limit) in enumerate(zip(s.doc.tolist(), s.offset.tolist(), s.limit.tolist())):
        first = marks[doc] >> 16
        own = marks[doc][(first >= off) & (first < off + limit)]
        part.append(np.full(len(own), k))
        at.append(own)
    part, (first, count, back) = np.concatenate(part), unpack(np.concatenate(at))
    return part, first - s.offset[part] + s.base[part], count, back


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run of each element, and its place in the run."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def cells(s: Slice, unit: Unit, marks: list[np.ndarray]):
    """The same as ``anchors``, for the cells of the marked anchors."""
    part, first, count, back = _located(s, marks)
    if not len(part):
        none = np.zeros(0, np.int64)
        return none.view(U), none.view(U), none, none
    roll, size, length = Rolling(unit.values(s.data)), unit.cell, unit.length
    low, high = back - count + 1, back  # an anchor lies so far behind its starts
    owner, k = _runs(high // size - low // size + 1)
    cell, anchor = (low // size)[owner] + k, (first + back)[owner]
    far, near = np.minimum(high[owner], size * cell + size - 1), np.maximum(low[owner], size * cell)
    begin, end = anchor - far, anchor - near
    core = mix(roll.of(anchor - size * cell, anchor - size * cell - size + 1 + length) + cell.astype(U), 2)
    hull = mix(roll.of(begin, end + length) + (far << 8 | near).astype(U), 3)
    part = part[owner]
    return core, hull, part, pack(begin - s.base[part] + s.offset[part], end - begin + 1, np.zeros_like(begin))


def strings(s: Slice, unit: Unit, marks: list[np.ndarray]):
    """The same, for each string of the marked cells."""
    part, first, count, _ = _located(s, marks)
    if not len(part):
        none = np.zeros(0, np.int64)
        return none.view(U), none.view(U), none, none
    roll, core, length = Rolling(unit.values(s.data)), unit.core, unit.length
    owner, k = _runs(count)
    at, part = first[owner] + k, part[owner]
    one = np.ones_like(at)
    return roll.of(at, at + core), roll.of(at + core, at + length), part, pack(at - s.base[part] + s.offset[part], one, 0 * one)


def _emit(make, unit: Unit, reach: int, marked: bool):
    """Rows (ROWS) of the texts of a partition. marked: the batches have a column of open positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").cast(pa.binary()).to_pylist()
            rk, rk2 = batch.column("rk").to_numpy(), batch.column("rk2").to_numpy()
            marks = [np.array(m, np.int64) for m in batch.column("marks").to_pylist()] if marked else None
            for s in slices(texts, unit, reach):
                core, hull, part, pos = make(s, unit, marks) if marked else make(s, unit)
                doc = s.doc[part]
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(rk[doc]), pa.array(rk2[doc]), pa.array(pos)], ["core", "hull", "rk", "rk2", "pos"])

    return run


def multikey(*tokens: np.ndarray) -> np.ndarray:
    """Order by the first token; what is equal in it, and only that, by the second, and so on."""
    order = np.argsort(tokens[0], kind="quicksort")
    new = np.ones(len(order), bool)
    new[1:] = tokens[0][order[1:]] != tokens[0][order[:-1]]
    for token in tokens[1:]:
        again = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(again):
            break
        run = np.cumsum(new)
        order[again] = order[again[np.lexsort((token[order[again]], run[again]))]]
        new[1:] |= token[order[1:]] != token[order[:-1]]
    return order


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket and compare neighbours. level 1: the first token occurs again; 2: both; 3: both, and this one stands
    for its kind in the next step, as others share the first token only. edge: for the boundaries."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    read = pa.Table.from_batches(held)
    core, hull, rk, rk2, pos = (read.column(k).to_numpy() for k in range(5))
    order = multikey(core, hull)
    core, hull, rk, rk2, pos = (x[order] for x in (core, hull, rk, rk2, pos))
    same = core[1:] == core[:-1]
    both = same & (hull[1:] == hull[:-1])
    level = np.zeros(len(core), np.int32)
    for hit, value in ((same, 1), (both, 2)):
        level[1:][hit] = value
        level[:-1][hit] = value
    run = np.cumsum(np.append(True, ~same)) - 1
    kinds = np.bincount(run[np.append(True, ~both)])
    kinds[[0, -1]] += 1  # these runs may go on in other buckets
    level[np.append(True, ~both) & (level == 2) & (kinds[run] > 1)] = 3
    edge = np.zeros(len(core), bool)
    edge[[0, -1]] = True
    keep = np.flatnonzero((level > 0) | edge)
    bucket = np.full(len(keep), TaskContext.get().partitionId(), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (core[keep], hull[keep], rk[keep], rk2[keep], pos[keep], level[keep], edge[keep], bucket, keep)], ["core", "hull", "rk", "rk2", "pos", "level", "edge", "bucket", "place"])


def _bucket_rows(spark: SparkSession) -> int:
    """Suffixes of a bucket: a fiftieth of the memory of an executor's core (a row has 40 bytes), 400,000 at least."""
    sc = spark.sparkContext
    name = "spark.driver.memory" if sc.master.startswith("local") else "spark.executor.memory"
    executors = max(sc._jsc.sc().getExecutorMemoryStatus().size() - 1, 1)
    cores = max(sc.defaultParallelism // executors, 1)
    memory = sc._jvm.org.apache.spark.util.Utils.memoryStringToMb(sc.getConf().get(name, "1g")) << 20
    return max(memory // cores // 50 // 40, 400_000)


def _across(edges: DataFrame) -> DataFrame:
    """Rows at the ends of buckets, with the level that they have by the nearest rows of the buckets before and behind.

    Empty buckets are passed over. Neighbours are found in groups of buckets, those of the groups in one window of a row for each GROUP buckets."""
    edges = edges.withColumn("grp", F.floor(F.col("bucket") / GROUP))
    tokens, at = F.struct("core", "hull"), F.struct("bucket", "place")
    ends = edges.groupBy("grp").agg(F.min_by(tokens, at).alias("first"), F.max_by(tokens, at).alias("last"))
    along, within = Window.orderBy("grp"), Window.partitionBy("grp").orderBy("bucket", "place")
    ends = ends.select(F.col("grp").alias("g"), F.lag("last").over(along).alias("behind"), F.lead("first").over(along).alias("ahead"))
    level = F.col("level")
    for other in (F.coalesce(F.lag(tokens).over(within), F.col("behind")), F.coalesce(F.lead(tokens).over(within), F.col("ahead"))):
        level = F.greatest(level, F.when(other["core"] == F.col("core"), F.when(other["hull"] == F.col("hull"), 2).otherwise(1)).otherwise(0))
    return edges.join(ends, F.col("grp") == F.col("g")).select("rk", "rk2", "pos", F.when(level > 1, 3).otherwise(level).alias("level"))


def repeated(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(rk, rk2, pos, level) of the suffixes of which a token at least occurs again."""
    spark, rows = rows.sparkSession, scratch.table(rows, f"{name}-rows")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _bucket_rows(spark)))
    found = rows.repartitionByRange(n, "core", "hull", "rk", "pos").mapInArrow(_sorted, ROWS + ", level int, edge boolean, bucket int, place long")
    found = scratch.table(found, name)
    scratch.drop(f"{name}-rows")
    return found.where("not edge").select("rk", "rk2", "pos", "level").unionByName(_across(found.where("edge"))).where("level > 0")


def _cut(unit: Unit):
    """Remove the marked ranges: each stands for the symbols from its first start to the unit's length behind its last. A word
    goes with the white space behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], batch.column("t").cast(pa.binary()).to_pylist()
            places = word_arrays(texts) if unit.words else ((t, None, None) for t in texts)
            for text, marks, (symbols, starts, ends) in zip(texts, batch.column("marks").to_pylist(), places):
                first, count, _ = unpack(np.array(marks, np.int64))
                step = np.zeros(len(symbols) + 1, np.int32)
                np.add.at(step, first, 1)
                np.add.at(step, first + count - 1 + unit.length, -1)
                gone = np.cumsum(step[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                lost = int(gone.sum())
                if unit.words:
                    upto = np.append(starts[1:], ends[-1:])
                    step = np.zeros(len(text) + 1, np.int32)
                    step[starts[gone]] += 1
                    np.add.at(step, upto[gone], -1)
                    gone = np.cumsum(step[:-1]) > 0
                data = np.frombuffer(text, np.uint8)
                kept = data[~gone].tobytes()
                char = np.cumsum((data & 0xC0) != 0x80)
                whole = ~(np.bincount(char, gone) > 0)[char]  # characters of which every byte stays
                out.append((lost, spans, hashlib.sha256(kept).hexdigest(), data[whole].tobytes().decode()))
            yield pa.RecordBatch.from_arrays([batch.column("rk"), batch.column("rk2"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))], ["rk", "rk2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _keys(doc_id: str) -> list:
    return [F.xxhash64(doc_id, "t").alias("rk"), F.xxhash64("t", doc_id).alias("rk2")]


def removals(docs: DataFrame, scratch: Scratch, unit: Unit, with_text: bool) -> DataFrame:
    """Of the documents (doc_id, t) that lose symbols: rk, rk2, n_removed, n_spans, kept_sha256, and with_text the whole characters that are left (kept)."""
    keyed = docs.select("t", *_keys("doc_id"))
    tables = {x: f"{x}-{'words' if unit.words else 'bytes'}" for x in ("anchors", "level1", "texts", "cells", "level2", "strings", "level3", "done")}
    level1 = scratch.table(repeated(keyed.mapInArrow(_emit(anchors, unit, unit.length, False), ROWS), scratch, tables["anchors"]), tables["level1"])
    scratch.drop(tables["anchors"])
    # A group is one document's positions.
    marks = lambda df: F.array_sort(F.collect_set(df)).alias("marks")
    held = level1.groupBy("rk", "rk2").agg(marks(F.when(F.col("level") != 2, F.col("pos"))))
    on = ["rk", "rk2"]
    texts = scratch.table(keyed.join(held, on), tables["texts"])
    some = texts.where("size(marks) > 0")
    level2 = scratch.table(repeated(some.mapInArrow(_emit(cells, unit, unit.length + 256, True), ROWS), scratch, tables["cells"]), tables["level2"])
    scratch.drop(tables["cells"])
    open_ = level2.where("level <> 2").groupBy("rk", "rk2").agg(marks("pos"))
    some = texts.drop("marks").join(open_, on)
    level3 = scratch.table(repeated(some.mapInArrow(_emit(strings, unit, unit.length + 256, True), ROWS), scratch, tables["strings"]), tables["level3"])
    scratch.drop(tables["strings"])
    ranges = level1.unionByName(level2).unionByName(level3).where("level > 1").groupBy("rk", "rk2").agg(marks("pos"))
    done = texts.drop("marks").join(ranges, on).mapInArrow(_cut(unit), "rk long, rk2 long, n_removed long, n_spans long, kept_sha256 string, kept string")
    done = done if with_text else done.drop("kept")
    done = scratch.table(done.dropDuplicates(["rk", "rk2"]), tables["done"])
    scratch.drop(*[tables[x] for x in ("texts", "level1", "level2", "level3")])
    return done


def _prepared(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("t"))


def substring_report(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``, by BYTES, and n_passage_words: the words that are
    in passages of over 50 words (WORDS) which also start anywhere else.

    Texts are UTF-8 bytes (null: empty); strings do not go across documents and are judged on the input. Repeated rows
    repeat each other's strings, so all their bytes in texts of 400 bytes or more go. Shorter texts lose nothing. Null
    ids are ids like others. An empty table gives no rows; other columns are not read.
    """
    own, scratch = _prepared(docs, text, doc_id), Scratch(docs.sparkSession, "suffix")
    done = removals(own, scratch, BYTES, False)
    passages = removals(own, scratch, WORDS, False).select("rk", "rk2", F.col("n_removed").alias("words"))
    slim = own.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("whole"), *_keys("doc_id"))
    out = slim.join(done, ["rk", "rk2"], "left").join(passages, ["rk", "rk2"], "left")
    count = lambda c, name: F.coalesce(c, F.lit(0).cast("long")).alias(name)
    return out.select("doc_id", "n_bytes", count("n_removed", "n_removed"), count("n_spans", "n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), count("words", "n_passage_words"))


def without_repeats(docs: DataFrame, unit: Unit = BYTES, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every occurrence of a repeated string cut out of the texts: same rows and columns. Where a cut divides a
    character, what is left of it goes too; a word goes with the white space behind it. Texts that lose nothing stay as they
    are, null included. Rows repeated in id and text repeat each other, null ids are ids, an empty table gives no rows."""
    own, scratch = _prepared(docs, text, doc_id), Scratch(docs.sparkSession, "suffix")
    done = removals(own, scratch, unit, True).select("rk", "rk2", F.lit(1).alias("hit"), "kept")
    row = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("r")
    t = F.coalesce(docs[text], F.lit(""))
    wide = docs.select(row, F.xxhash64(docs[doc_id].cast("long"), t).alias("rk"), F.xxhash64(t, docs[doc_id].cast("long")).alias("rk2")).join(done, ["rk", "rk2"], "left")
    return wide.select(*[F.when(F.col("hit").isNotNull(), F.col("kept")).otherwise(F.col("r")[c]).alias(c) if c == text else F.col("r")[c].alias(c) for c in docs.columns])


def op1_suffix(docs: DataFrame) -> DataFrame:
    return substring_report(docs)
