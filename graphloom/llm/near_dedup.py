"""Near-duplicates by HyperMinHash.

A document's set is its distinct five-word shingles. A shingle's hash picks one of ``REGISTERS`` registers; of the least
second hash in a register, the leading-zero count and ten mantissa bits are kept (two bytes). Empty registers borrow
from others in a fixed order for the bands only, so that short sets keep the property that registers agree as
often as sets overlap.

1. Documents with one set are one node (a fingerprint of the whole set), so copies never meet in a bucket.
2. Bands of registers are buckets. For the members of buckets the shingles that no other has are counted: they are in no
   intersection, so they bound each Jaccard index from above. The member with the smallest share of them is the hub of a
   bucket, as what is near to any other is mostly near to it. Members are compared with the hub: by that bound, by the
   Jaccard estimate, corrected for registers that agree by chance, then on the full sets.
3. Components of the links. Where the members of a bucket are still in several, those outside its largest component are
   compared, block by block, with the members of other components, as far as that bound and the estimate (within five
   standard errors) allow a link, each pair in the first bucket that it shares. Whatever shares a bucket is therefore in
   one component or has been compared.
4. Components again, with the further links.

A pair at 0.80 shares no bucket with probability (1 - 0.8**5)**48 = 5e-9, one at 0.85 with 6e-13. Nodes are 64-bit
fingerprints of sets. The full sets of the nodes in candidate pairs are made again from the texts, and only of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, bounded_batches
from .textkit import WORD_FACTOR, U, Words, mix, slices

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
EMPTY = 0xFFFF
MANTISSA = 10
#: Chance that two registers with different least hashes agree, for sets of like size (HyperMinHash, 10 mantissa bits).
CHANCE = 0.1699 / (1 << (MANTISSA - 1))
BLOCK = 512
_FILL = [np.random.Generator(np.random.PCG64(k)).permutation(REGISTERS) for k in range(24)]
_BAND = mix(np.arange(REGISTERS, dtype=U), 77) | U(1)


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of all its words where they are fewer than k."""
    for a, b in slices(texts):
        words = Words(texts[a:b], lower=True)
        grams, first = words.grams(k), words.first.tolist()
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= k:
                yield np.unique(grams[first[i] : first[i] + n - k + 1])
            elif n:
                yield mix(np.array([(words.hashes[first[i] : first[i] + n] * WORD_FACTOR[8 : 8 + n]).sum(dtype=U)]), n)
            else:
                yield np.zeros(0, U)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Two bytes a register: leading zeros and mantissa of the least hash, or EMPTY."""
    least = np.full(len(sets) * REGISTERS, ~U(0), U)
    if sets:
        all_, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        slot = ((mix(all_, 1) >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64) + owner * REGISTERS
        np.minimum.at(least, slot, mix(all_, 2) >> U(1))
    filled = least != ~U(0)
    value = np.where(filled, least, U(1)) | U(1)
    # Bits up to the leading one, from the exponent of the value without its lowest bits (no rounding upwards).
    zeros = 64 - np.frexp((value >> U(11) << U(11) | U(1)).astype(np.float64))[1]
    zeros = np.clip(zeros, 1, 63)
    mantissa = (value << (zeros + 1).astype(U)) >> U(64 - MANTISSA)
    code = (zeros - 1).astype(np.uint16) << np.uint16(MANTISSA) | mantissa.astype(np.uint16)
    return np.where(filled, code, np.uint16(EMPTY)).reshape(-1, REGISTERS)


def band_keys(codes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each document and band."""
    full = codes.copy()
    for order in _FILL:
        hole = full == EMPTY
        if not hole.any():
            break
        full = np.where(hole, codes[:, order], full)
    for step in range(1, REGISTERS):
        hole = full == EMPTY
        if not hole.any():
            break
        full = np.where(hole, np.roll(codes, step, axis=1), full)
    spread = mix(full.astype(U) + U(1), 5) * _BAND
    return mix(spread.reshape(len(codes), BANDS, ROWS).sum(axis=2, dtype=U) + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15), 6)


def may_link(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimated Jaccard index of two rows of registers is within five standard errors of the threshold."""
    some = (x != EMPTY) | (y != EMPTY)
    used = np.maximum(some.sum(axis=-1), 1)
    same = ((x == y) & some).sum(axis=-1)
    estimate = (same / used - CHANCE) / (1 - CHANCE)
    t = percent / 100
    return estimate + 5 * np.sqrt(t * (1 - t) / used) + 1 / used >= t


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("t").cast(pa.binary()).to_pylist()))
        sizes = np.array([len(s) for s in sets], np.int64)
        node = np.array([mix(np.array([s.sum(dtype=U) ^ mix(s, 9).sum(dtype=U) + U(len(s))]), 3)[0] for s in sets], U).view(np.int64)
        codes = [row.tobytes() for row in registers(sets)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(node), pa.array(sizes), pa.array(codes, pa.binary())], ["doc_id", "same", "node", "size", "codes"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(codes).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["band", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column("t").cast(pa.binary()).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("set")]
        for i in range(0, len(sets), 100):
            some = sets[i : i + 100]
            nodes = np.repeat(batch.column("node").to_numpy()[i : i + 100], [len(x) for x in some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some)), pa.array(nodes)], ["shingle", "node"])


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ca", "cb"))
            yield batch.select(["a", "b"]).filter(pa.array(may_link(x, y, percent)))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _blocks(percent: int):
    """Of one block of a bucket's members and one of those outside its largest component: the pairs that may link."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, comp, size, lone, outside = (rows.column(c).to_numpy() for c in ("node", "component", "size", "lone", "outside"))
        band = rows.column("band")[0].as_py()
        shared = size - lone  # of its shingles, as many may be in an intersection
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(codes).view(np.int64)
        inside, out_a, out_b = np.flatnonzero(~outside), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(outside):
            most = np.minimum(shared[inside], shared[i])
            at = inside[(comp[inside] != comp[i]) & (100 * most >= percent * (size[inside] + size[i] - most))]
            at = at[may_link(codes[at], codes[i][None, :], percent)]
            # A pair is taken in the first of the buckets that it shares.
            at = at[keys[i][(keys[at] == keys[i][None, :]).argmax(axis=1)] == band]
            out_a.append(np.minimum(nodes[at], nodes[i]))
            out_b.append(np.maximum(nodes[at], nodes[i]))
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _near(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


class _Corpus:
    """What the steps share: the documents, their nodes, and the scratch tables."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, percent: int):
        spark = docs.sparkSession
        bounded_batches(spark)
        self.percent, self.scratch = percent, Scratch(spark, "near")
        self.docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("t"))
        self.docs = self.docs.withColumn("same", F.xxhash64("doc_id", "t"))
        signed = self.docs.mapInArrow(_sign, "doc_id long, same long, node long, size long, codes binary")
        self.signed = self.scratch.table(signed, "signed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "same")).alias("x")
        nodes = self.signed.where("size > 0").groupBy("node").agg(first, F.max("size").alias("size"), F.first("codes").alias("codes"))
        self.nodes = self.scratch.table(nodes.select("node", "x.doc_id", "x.same", "size", "codes"), "nodes")

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """(node, set) of some nodes (column n): full sets, made again from the texts."""
        used = self.nodes.join(nodes, F.col("n") == F.col("node")).select("node", F.col("doc_id").alias("d"), F.col("same").alias("s"))
        texts = self.docs.join(used, (F.col("same") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "t")
        sets = self.scratch.table(texts.mapInArrow(_sets, "node long, set binary"), name)
        return sets.dropDuplicates(["node"]) if sets.count() > nodes.count() else sets  # only if a document is there twice

    def likely(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that sizes and estimates leave."""
        sized = lambda k: self.nodes.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("codes").alias(f"c{k}"))
        both = pairs.join(sized("b"), "b").join(sized("a"), "a").where(_near(F.col("na"), F.col("nb"), self.percent))
        return self.scratch.table(both.select("a", "b", "ca", "cb").mapInArrow(_likely(self.percent), "a long, b long"), name)

    def links(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of nodes whose full sets are near."""
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
        return self.scratch.table(both.mapInArrow(_confirm(self.percent), "a long, b long"), name)

    def open(self, members: DataFrame, comp: DataFrame, name: str) -> DataFrame:
        """Members (band, node) of the buckets that hold several components, with these and what blocks need."""
        grouped = members.join(comp.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        counts = grouped.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        several = counts.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("x")).where("parts > 1")
        blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
        several = several.select(F.col("band").alias("o"), F.col("x.component").alias("main"), blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("x.n")).alias("rests"))
        return self.scratch.table(grouped.join(several, F.col("band") == F.col("o")).drop("o"), name)

    def facts(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """(f, size, lone, codes) of some nodes (column n): lone is the number of their shingles that no other of them has."""
        alone = sets.mapInArrow(_exploded, "shingle long, node long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
        alone = alone.groupBy(F.col("node").alias("l")).agg(F.count(F.lit(1)).alias("lone"))
        own = self.nodes.select("node", "size", "codes").join(nodes, F.col("node") == F.col("n")).join(alone, F.col("node") == F.col("l"), "left")
        return self.scratch.table(own.select(F.col("node").alias("f"), "size", "codes", F.coalesce("lone", F.lit(0).cast("long")).alias("lone")), "facts")

    def blocks(self, open_: DataFrame, facts: DataFrame) -> DataFrame:
        """Pairs that may link between the components that share a bucket."""
        some = open_.join(facts, F.col("node") == F.col("f")).drop("f")
        # Every member is dealt to a block, and there to each block of those outside the largest component.
        own_block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        fields = ["band", "block", "part", "node", "component", "size", "lone", "codes", "outside"]
        dealt = some.withColumn("block", own_block("blocks")).withColumn("part", every("rests")).withColumn("outside", F.lit(False)).select(fields)
        rest = some.where("component <> main").withColumn("part", own_block("rests")).withColumn("block", every("blocks")).withColumn("outside", F.lit(True)).select(fields)
        return dealt.unionByName(rest).groupBy("band", "block", "part").applyInArrow(_blocks(self.percent), "a long, b long")


def _possible(percent: int) -> Column:
    """Whether sizes and lone shingles of (size, lone) and (hs, hl) allow a link."""
    most = F.least(F.col("size") - F.col("lone"), F.col("hs") - F.col("hl"))
    return most * 100 >= (F.col("size") + F.col("hs") - most) * percent


def near_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", percent: int = 85, row_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the component), kept, for each row of ``docs``.

    Sets whose Jaccard index is ``percent`` / 100 or more are linked. Whole texts count, very long ones too: a worker holds one text's set
    at a time, of a confirmed pair two. Texts without words have an empty set and are alone.
    Rows of equal sets are one node: repeated rows have the same component. Null ids count only where a component
    has no other; ``kept`` is then true. An empty table gives no rows. Other columns are not read. With ``row_key`` there is
    also ``same``, the hash xxhash64(id, text) of the row.
    """
    own = _Corpus(docs, text, doc_id, percent)
    scratch = own.scratch
    bands = own.nodes.select("node", "codes").mapInArrow(_bands, "band long, node long")
    bands = scratch.table(bands, "bands")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("h"))
    members = scratch.table(bands.join(shared, F.col("band") == F.col("h")).select("band", "node"), "members")
    scratch.drop("bands")
    nodes = scratch.table(members.select(F.col("node").alias("n")).distinct(), "used")
    sets = own.sets(nodes, "sets")
    facts = own.facts(nodes, sets)
    known = members.join(facts.drop("codes"), F.col("node") == F.col("f")).drop("f")
    hubs = known.groupBy("band").agg(F.min(F.struct((F.col("lone") / F.col("size")).alias("q"), "node", "size", "lone")).alias("x"))
    hubs = hubs.select(F.col("band").alias("o"), F.col("x.node").alias("hub"), F.col("x.size").alias("hs"), F.col("x.lone").alias("hl"))
    pairs = known.join(hubs, F.col("band") == F.col("o")).where("node <> hub").where(_possible(percent))
    first = own.likely(pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "first")
    links = own.links(first, sets, "first-links")
    comp = scratch.table(components(links, scratch), "comp")
    open_ = own.open(members, comp, "open")
    scratch.drop("members")
    second = scratch.table(own.blocks(open_, facts).distinct().join(first, ["a", "b"], "left_anti"), "second")
    if second.limit(1).count():
        links = links.unionByName(own.links(second, sets, "second-links"))
        comp = scratch.table(components(links, scratch), "comp2")

    label = own.nodes.select("node", "doc_id").join(comp.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
    label = label.select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "k")
    label = scratch.table(label.join(least, F.col("component") == F.col("k")).select(F.col("node").alias("n"), "component_id"), "label")
    key = ["same"] if row_key else []
    slim = own.signed.select("doc_id", "node", "size", *key)
    out = slim.where("size > 0").join(label, F.col("node") == F.col("n")).select("doc_id", F.col("size").alias("n_shingles"), "component_id", *key)
    alone = slim.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), *key)
    out = scratch.table(out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "out")
    scratch.drop("signed", "nodes", "label", "open", "used", "facts", "sets", "first", "second", "first-links", "second-links", "comp", "comp2")
    return out


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", percent: int = 85) -> DataFrame:
    """The row of ``docs`` with the least id of each component, with all columns; of rows equal in id and text one stays.
    Texts without words are alone and stay; where a component has only null ids, one row for each of its texts stays."""
    found = near_components(docs, text=text, doc_id=doc_id, percent=percent, row_key=True).where("kept")
    keys = found.groupBy(F.col("same").alias("near_same"), F.col("doc_id").alias("near_id")).agg(F.count(F.lit(1)).alias("n"))
    again = keys.where("n > 1").limit(1).count()
    row = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row")
    i, t = docs[doc_id].cast("long"), F.coalesce(docs[text], F.lit(""))
    wide = docs.select(row, i.alias("id"), F.xxhash64(i, t).alias("same"))
    kept = wide.join(keys, (F.col("same") == F.col("near_same")) & F.col("id").eqNullSafe(F.col("near_id")), "left_semi")
    return (kept.dropDuplicates(["id", "same"]) if again else kept).select("row.*")


def op4_near(docs: DataFrame) -> DataFrame:
    return near_components(docs)
