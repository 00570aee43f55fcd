"""Embedding whitening by hierarchical SVD merging.

A summary of some vectors is (n, sums, singular values, right singular vectors) of the vectors centred at their own mean, with
all of its up to d singular values. Two summaries merge by the SVD of their scaled singular vectors laid over each other, with a
row sqrt(n1 n2 / (n1 + n2)) * (mean1 - mean2) for the means, which gives that of all vectors together: nothing is cut off.

1. Components become whole numbers, and equal vectors one, by an aggregate that drops copies before the shuffle.
2. Each task folds its Arrow batches into one summary. Summaries merge in groups of ``FAN_IN`` until one is left; each level is written, so
   a lost executor costs a group, and no task holds more than FAN_IN summaries of d * d numbers.
3. Sums are exact, and so is what is subtracted for a mean: (n * x - S) is a whole number before it is divided. So vectors far from
   the origin lose no digits, and the covariance is never formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches
from .topk import _usable

FAN_IN = 8
#: Components beyond this are held there, so that 64 bits hold them.
FARTHEST = 1 << 60
SUMMARY = "part long, n long, sums array<string>, svd binary"
_SAFE = 1 << 62


@dataclass
class Summary:
    """n vectors: exact sums, and ``rows`` = singular values times right singular vectors of the centred vectors."""

    n: int
    sums: list[int]
    rows: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Summary":
        n = len(x)
        sums = _sums(x)
        return cls(n, sums, _compact(centred(x, n, sums)))

    def merged(self, other: "Summary") -> "Summary":
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        row = math.sqrt(self.n * other.n / n) * apart
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], _compact(np.vstack([self.rows, other.rows, row[None, :]])))


def _sums(x: np.ndarray) -> list[int]:
    if len(x) * int(np.abs(x).max(initial=0)) < _SAFE:
        return [int(s) for s in x.sum(axis=0)]
    return [sum(map(int, column)) for column in x.T]


def _compact(rows: np.ndarray) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def times_n(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit numbers where they hold it, else Python's."""
    if 2 * n * int(np.abs(x).max(initial=0)) < _SAFE and max(map(abs, sums), default=0) < _SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (times_n(x, n, sums) / n).astype(np.float64)


@dataclass
class Whitening:
    """n, exact sums, eigenvalues (falling) and unit eigenvectors (columns) of the covariance with divisor n; ``trace`` of it.
    Directions without variance, to the rounding of the largest singular value, are no components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, all_: Summary) -> "Whitening":
        d = len(all_.sums)
        if not all_.n or not d:
            return cls(all_.n, all_.sums, np.zeros(0), np.zeros((d, 0)), 0.0)
        _, s, v = np.linalg.svd(all_.rows, full_matrices=False)
        kept = s > s.max(initial=0.0) * max(d, 64) * 4 * np.finfo(float).eps
        values = s**2 / all_.n
        return cls(all_.n, all_.sums, values[kept], v[kept].T, float(values.sum()))

    def apply(self, x: np.ndarray, components: int) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors[:, :components] / np.sqrt(self.values[:components]))


def whole(vector: Column, width: int, scale: float, offset: int) -> Column:
    """floor(scale * component) + offset of each component; shorter vectors are filled with components 0."""
    number = lambda c: F.floor(F.least(F.greatest(c * F.lit(scale), F.lit(-float(FARTHEST))), F.lit(float(FARTHEST)))).cast("long") + F.lit(offset).cast("long")
    filled = F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vector)))
    return F.transform(filled, number)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _rows(batch: list[Summary]) -> Summary:
    out = Summary(0, [], np.zeros((0, 0)))
    for one in batch:
        out = out.merged(one)
    return out


def _packed(part: int, s: Summary) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([s.n], pa.int64()), "sums": pa.array([[str(x) for x in s.sums]], pa.list_(pa.string())), "svd": pa.array([s.rows.tobytes()], pa.binary())})


def _unpacked(n: int, sums: list[str], svd: bytes) -> Summary:
    return Summary(n, [int(x) for x in sums], np.frombuffer(svd).reshape(-1, len(sums)))


def fit(vectors: DataFrame, scratch: Scratch, width: int) -> Whitening:
    """The whitening of the distinct vectors in column ``x`` (whole numbers, ``width`` of them)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = _rows([Summary.of(_matrix(batch.column("x"), width)) for batch in batches if batch.num_rows])
        if own.n:
            yield from _packed(TaskContext.get().partitionId(), own).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "n", "sums", "svd"))))
        return _packed(rows[0][0] // FAN_IN, _rows([_unpacked(*row[1:]) for row in rows]))

    level, k = scratch.table(vectors.mapInArrow(summarise, SUMMARY), "level0"), 0
    last = level.agg(F.max("part")).first()[0]
    if last is None:
        return Whitening.of(Summary(0, [0] * width, np.zeros((0, width))))
    while last:
        k, last = k + 1, last // FAN_IN
        level = scratch.table(level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, SUMMARY), f"level{k}")
        scratch.drop(f"level{k - 1}")
    return Whitening.of(_unpacked(*level.select("n", "sums", "svd").first()))


def _identity_error(vectors: DataFrame, model, width: int, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity: a task sends n, mean and centred products."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, about = 0, np.zeros(components), np.zeros((components, components))
        for batch in batches:
            w = model.value.apply(_matrix(batch.column("x"), width), components)
            if len(w):
                own, m = w.mean(axis=0), len(w)
                about += (w - own).T @ (w - own) + np.outer(own - mean, own - mean) * (n * m / (n + m))
                mean, n = mean + (own - mean) * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([about.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "about"])

    parts = vectors.mapInArrow(products, "n long, mean array<double>, about array<double>")
    n = F.sum("n").alias("n")
    entry = lambda c: parts.select("n", "mean", F.posexplode(c).alias("i", "v"))
    means = {r["i"]: r["m"] for r in entry("mean").groupBy("i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m")).collect()}  # components rows
    mean = F.array(*[F.lit(means.get(i, 0.0)) for i in range(components)])
    off = lambda at: F.element_at("mean", at.cast("int") + 1) - F.element_at(mean, at.cast("int") + 1)
    row, column = F.floor(F.col("i") / components), F.col("i") % components
    about = entry("about").groupBy("i").agg((F.sum(F.col("v") + F.col("n") * off(row) * off(column)) / F.sum("n")).alias("v"), n)
    error = about.agg(F.max(F.abs(F.col("v") - F.when(row == column, 1.0).otherwise(0.0)))).first()[0]
    return float(error or 0.0)


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """vec_id, n, deviation, and of each component its number, the whitened value, its share of the variance and the
    identity error: one row for each vector and component.

    Each component c of a vector counts as the whole number floor(scale * c) + offset. The fit is over the n distinct vectors of such, centred,
    with divisor n; deviation is the sum of (n * x - S)**2 over the dimensions, exact, null beyond 64 bits. Vectors that are null or hold
    null or non-finite components take no part. Shorter vectors are filled with components 0. Repeated rows count once in
    the fit and are whitened each; a null id stays. Directions without variance are no components, so there are fewer rows with fewer
    dimensions, and none for a single distinct vector, vectors without dimensions or empty tables. Equal eigenvalues leave the choice of their
    eigenvectors open; it is the same for all rows. Components beyond 2**60 are held there. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    scratch = Scratch(spark, "whiten")
    own = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("v")).where(_usable(F.col("v")))
    width = own.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], schema)
    rows = own.select("vec_id", whole(F.col("v"), width, scale, offset).alias("x"))
    distinct = scratch.table(rows.select("x").distinct(), "distinct")
    found = fit(distinct, scratch, width)
    most = min(components, len(found.values))
    if not most:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(found)  # d * d numbers
    error = _identity_error(distinct, model, width, most)
    scratch.drop("distinct")
    share = found.values[:most] / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column("x"), width), model.value
            white = m.apply(x, most)
            each = lambda values: np.repeat(values, most)
            apart = deviations(times_n(x, m.n, m.sums))
            ids = pa.array(np.arange(batch.num_rows)).take(pa.array(each(np.arange(batch.num_rows))))
            columns = [batch.column("vec_id").take(ids), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(ids), m.n)), pa.array(apart, pa.int64()).take(ids)]
            columns += [pa.array(white.ravel()), pa.array(np.tile(share, batch.num_rows)), pa.array(np.full(len(ids), error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def deviations(apart: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exactly; None beyond 64 bits."""
    if apart.dtype != object and apart.shape[1] * float(np.abs(apart).max(initial=0)) ** 2 < _SAFE:
        return (apart**2).sum(axis=1).tolist()
    sums = [sum(int(a) ** 2 for a in row) for row in apart]
    return [s if s < 1 << 63 else None for s in sums]


def op11_whiten(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
