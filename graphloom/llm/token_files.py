"""Token ids in ORC files.

Documents go to files in ascending id order (range partitions, sorted within). A row is a document: its id, its part,
the number of ids before it in the part, its number of ids, and the ids as ``array<int>``, which ORC writes in
stripes with run-length encoding. Row indexes and a Bloom filter on ``doc_id`` let a reader skip stripes and
row groups; stripes are read in parallel. What precedes a part is the sum of the parts before it, so no pass
over all documents in order is needed.

A worker encodes each distinct run of non-space characters once and copies its ids from then on; Arrow splits texts and numbers their runs. The tokenizer drops
white space and no rule of it looks across, so the ids of a text are those of its runs one after another.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .held import held
from .scratch import Scratch, bounded_batches

#: Of each generation of a worker's runs, to bound its memory.
MAX_RUNS = 600_000
#: A run of which the part up to its last letter a to z, and a rest of these bytes, are encoded apart: no token goes across.
_TAIL = bytes(x for x in range(128) if not chr(x).isalnum())
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class _Runs:
    """Ids of runs of non-space bytes, as little-endian 32-bit integers.

    Two generations of runs are kept: when the newer is full it becomes the older, and what is used again moves back.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end_id], "<i4").tobytes()
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Lower case comes first where the tokenizer folds it and no special token may stand in the text.
        self.folds = self.tokenizer.encode("Q", add_special_tokens=False).ids == self.tokenizer.encode("q", add_special_tokens=False).ids
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _words(self, words: list[bytes]) -> None:
        """Words of letters go to the tokenizer many at once; each is one piece, which the count of pieces proves."""
        apart = []
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            got = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            piece, raw = np.array(got.word_ids, np.int64), np.array(got.ids, "<i4").tobytes()
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
            if len(cuts) - 1 != len(some):
                apart += some
            else:
                self.newer.update({w: raw[4 * a : 4 * b] for w, a, b in zip(some, cuts, cuts[1:])})
        self._runs(apart)

    def _runs(self, runs: list[bytes]) -> None:
        self.newer.update({r: np.array(x.ids, "<i4").tobytes() for r, x in zip(runs, self._ids([r.decode() for r in runs]))})

    def learn(self, runs: set[bytes], plain: bool) -> None:
        """plain: no run can hold a special token, and all are folded."""
        cut, whole, known, old = [], set(), self.newer, self.older
        for r in runs:
            if r in old:
                known[r] = old[r]
            elif (head := r.rstrip(_TAIL)) != r and head and head[-1] in _LETTERS and (plain or not any(x in r for x in self.special)):
                tail = r[len(head) :]
                cut.append((r, head, tail))
                whole.add(head)
                whole.add(tail)
            else:
                whole.add(r)
        words, other = [], []
        for r in whole:
            if r in old:
                known[r] = old[r]
            elif r not in known:
                (words if r.isalpha() or r.decode().isalpha() else other).append(r)
        self._words(words)
        self._runs(other)
        for r, head, tail in cut:
            known[r] = known[head] + known[tail]

    def encode(self, texts: pa.StringArray | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and the number of ids of each text. Runs are split and numbered by Arrow, so each
        distinct one of the texts is looked up once, and its ids are copied by number."""
        if len(self.newer) > MAX_RUNS:
            self.older, self.newer = self.newer, {}
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()).cast(pa.string())
        special = [pc.match_substring(texts, x[:2]) for x in self.special]
        plain = pc.invert(functools.reduce(pc.or_, special)) if special else pa.array([True] * len(texts))
        split = pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts) if self.folds else texts)
        numbered = split.flatten().dictionary_encode()  # white space at an end leaves an empty run, which has no ids
        runs = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.newer[b""] = b""
        unknown = set(runs).difference(self.newer)
        if unknown:
            self.learn(unknown, pc.all(plain).as_py() is not False)
        own = [*map(self.newer.__getitem__, runs), self.end]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(own), "<i4")))
        # The end id stands as one more run behind those of each text.
        ends = np.cumsum(np.asarray(split.value_lengths()) + 1)
        order = np.full(len(numbered) + len(texts), len(runs), np.int32)
        inside = np.ones(len(order), bool)
        inside[ends - 1] = False
        order[inside] = numbered.indices.to_numpy()
        upto = np.cumsum(sizes[order])[ends - 1]
        return ids.take(pa.array(order)).flatten().to_numpy(), np.diff(upto, prepend=0)


def _coder(path: str, end_id: int) -> _Runs:
    """The worker's own: what it has learnt serves its next tasks."""
    return held(("runs", path, end_id), lambda: _Runs(path, end_id))


def _slices(texts: pa.StringArray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    first = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, stripe_bytes: int = 64 << 20, row_index: int = 1000) -> None:
    """Encode every whole text (null: empty) and write the files; other columns of ``docs`` are not read.

    ``tokenizer``: file of a tokenizer of the tokenizers library, there on every worker, that drops white space.
    A null id comes first; rows of one id are in the order of a hash of their text, then the text. An empty table gives
    a folder without rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        coder = _coder(tokenizer, end_id)
        for batch in batches:
            texts = batch.column("t")
            for a, b in _slices(texts):
                ids, sizes = coder.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                starts = before + offsets[:-1]
                before += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(np.full(b - a, part, np.int32)), pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )

    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("t"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("t")]
    rows = own.repartitionByRange(*order).sortWithinPartitions(*order, "t")
    rows = rows.mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.create.index": "true", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": row_index}
    rows.write.mode("overwrite").options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Filters on doc_id reach the ORC reader."""
    rows = spark.read.schema("doc_id long, part int, part_start long, n_tokens long, ids array<int>").orc(path)
    ends = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("size"))
    # One row for each file: what lies before a part, summed over so many rows.
    base = ends.select(F.col("part").alias("p"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    base = Scratch(spark, "token-parts").table(base, "base")
    return rows.join(base, F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = Scratch(spark, "tokens").path("orc")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
