"""Exact inner-product top-k by ball trees.

Vectors are dealt to shards of a bounded size; each shard is a ball tree (centre, radius, least id of every node). Queries
come in blocks. The inner product of a query with anything in a ball is at most <query, centre> + |query| * radius.

0. Cells. A sample of ``SAMPLE_CELLS`` rows is split as a ball tree is, into a cell for each ``SHARD_ROWS`` rows of the table, ``MOST_CELLS`` at most.
   A row is of the cell whose centre is nearest; a cell's rows are dealt to shards by a hash, and its queries to blocks. So balls and blocks
   are small where the data are in groups, and which cell a row is in changes no result.
1. Blocks meet the roots of all shards, ``ROOTS`` in a row: pairs of a block and a shard remain whose bound reaches the kth score of a
   query, which starts at that over a fixed sample of the vectors. A pair is two numbers and a bound for each query.
2. A block takes its shards in the order of their bounds, in rounds of ever more (``FIRST``, then ``GROWTH`` times as many). A round
   leaves out the pairs whose bounds do not reach the kth scores that all rounds before have found, and only then ships blocks
   and trees. A tree is searched by branch and bound: children in the order of the bound, no node with a bound below the current
   kth score (or equal, with every id in the ball larger). That score is shared by all shards that a task searches, and after the
   round by all tasks.
3. The best k of each query after a round are a ranking of k rows for each query and shard at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

LEAF = 64
SHARD_ROWS, BLOCK_ROWS, SAMPLE_ROWS = 4096, 256, 1024
SAMPLE_CELLS, MOST_CELLS = 16_384, 1024
ROOTS, FIRST, GROWTH = 256, 4, 8
LEAST = np.iinfo(np.int64).min
EXACT = float(1 << 53)


def whole(vectors: list, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as floats that are whole numbers; shorter vectors are filled with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return np.floor(out * scale)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly; those beyond 64 bits are held at its ends."""
    d = min(q.shape[1], v.shape[1])
    q, v = q[:, :d], v[:, :d]
    if d * max(np.abs(q).max(initial=0), 1) * max(np.abs(v).max(initial=0), 1) < EXACT:
        return (q @ v.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in v] for x in q]
    return np.array([[min(max(s, -(1 << 63)), (1 << 63) - 1) for s in row] for row in exact], np.int64).reshape(len(q), len(v))


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.centre, self.radius, self.least, self.child, self.span = [], [], [], [], []
        self.order = np.arange(len(ids))
        self._build(0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _build(self, a: int, b: int) -> int:
        own = self.vectors[self.order[a:b]]
        centre = own.mean(axis=0)
        apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = len(self.span)
        self.centre.append(centre)
        self.radius.append(float(apart.max(initial=0.0)) * (1 + 1e-9))
        self.least.append(int(self.ids[self.order[a:b]].min()))
        self.span.append((a, b))
        self.child.append(None)
        if b - a > LEAF:
            axis = own[apart.argmax()] - centre
            by = np.lexsort((self.ids[self.order[a:b]], (own - centre) @ axis))
            self.order[a:b] = self.order[a:b][by]
            middle = (a + b) // 2
            self.child[node] = (self._build(a, middle), self._build(middle, b))
        return node


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball, what no inner product exceeds. Rounding is covered by a part in 1e9 of the terms' size."""
    d = min(queries.shape[1], centres.shape[1])
    norm = np.sqrt((queries**2).sum(axis=1))
    reach = norm[:, None] * (radii + 1e-9 * np.sqrt((centres**2).sum(axis=1)))[None, :]
    return np.floor(queries[:, :d] @ centres[:, :d].T + reach + 1e-6)


def cells(vectors: np.ndarray, most: int) -> np.ndarray:
    """Centres of ``most`` cells at most: the widest group is halved along the way to its farthest row until there are so many."""
    groups = [vectors] if len(vectors) else []
    wide = [float(np.abs(g - g.mean(axis=0)).sum()) for g in groups]
    while groups and len(groups) < most and max(wide) > 0:
        k = int(np.argmax(wide))
        own = groups[k]
        away = own - own.mean(axis=0)
        along = away @ away[(away**2).sum(axis=1).argmax()]
        side = along > np.median(along)
        side = side if 0 < side.sum() < len(own) else along == along.max()
        if not 0 < side.sum() < len(own):
            wide[k] = 0.0
            continue
        groups[k : k + 1] = [own[side], own[~side]]
        wide[k : k + 1] = [float(np.abs(g - g.mean(axis=0)).sum()) for g in groups[k : k + 2]]
    return np.array([g.mean(axis=0) for g in groups]) if groups else np.zeros((1, vectors.shape[1]))


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = min(vectors.shape[1], centres.shape[1])
    return ((centres**2).sum(axis=1)[None, :] - 2 * vectors[:, :d] @ centres[:, :d].T).argmin(axis=1)


def _upwards(x: np.ndarray) -> np.ndarray:
    """As four-byte floats, none of them smaller."""
    out = x.astype(np.float32)
    return np.where(out < x, np.nextafter(out, np.float32(np.inf)), out)


class Search:
    """The best k of a block of queries so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kth: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.kth, self.kth_id = kth.copy(), np.full(len(ids), np.iinfo(np.int64).max)
        self.best: list[list[tuple[int, int]]] = []

    def over(self, tree: BallTree) -> Iterator[tuple[int, int, int]]:
        """(query, id, score) of the best k in the tree that may be among the best of all; kth scores go on to the next."""
        self.best = [[] for _ in self.ids]
        self.bound = bounds(self.vectors, tree.centre, tree.radius)
        self._visit(tree, 0, np.arange(len(self.ids)))
        for i, best in enumerate(self.best):
            for score, vec in best:
                yield int(self.ids[i]), vec, score

    def _visit(self, tree: BallTree, node: int, active: np.ndarray) -> None:
        bound = self.bound[active, node]
        active = active[(bound > self.kth[active]) | ((bound == self.kth[active]) & (tree.least[node] <= self.kth_id[active]))]
        if not len(active):
            return
        if tree.child[node] is None:
            self._leaf(tree, node, active)
            return
        left, right = tree.child[node]
        first = self.bound[active, left] >= self.bound[active, right]
        for near, far, own in ((left, right, active[first]), (right, left, active[~first])):
            self._visit(tree, near, own)
            self._visit(tree, far, own)

    def _leaf(self, tree: BallTree, node: int, active: np.ndarray) -> None:
        a, b = tree.span[node]
        score = products(self.vectors[active], tree.vectors[a:b])
        hit = (score >= self.kth[active][:, None]) & (tree.ids[a:b][None, :] != self.ids[active][:, None])
        for row in np.flatnonzero(hit.any(axis=1)):
            q, own = active[row], hit[row]
            merged = self.best[q] + list(zip(score[row][own].tolist(), tree.ids[a:b][own].tolist()))
            merged.sort(key=lambda x: (-x[0], x[1]))
            self.best[q] = merged[: self.k]
            if len(merged) >= self.k and (merged[self.k - 1][0] > self.kth[q] or (merged[self.k - 1][0] == self.kth[q] and merged[self.k - 1][1] < self.kth_id[q])):
                self.kth[q], self.kth_id[q] = merged[self.k - 1]


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, scale: float = 1024.0, stats: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors with the largest inner product of floor(scale * component).

    Ties go to the smaller id. A row is no candidate for the query of its own id. Vectors that are null or hold null
    or non-finite components, and rows with a null id, take no part. Where dimensions differ, the shorter vector counts as
    filled with zeros. Repeated candidate rows are candidates each; of queries of one id the least vector counts. Fewer
    candidates than k: all of them. Empty tables give no rows; other columns are not read. ``stats`` takes the number of pairs of a block
    and a shard (``pairs``), and of those that are searched (``searched``).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    clean = lambda df: df.select(df[vec_id].cast("long").alias("id"), df[embedding].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    rows = clean(vectors)
    count = rows.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(1, -(-count // SHARD_ROWS))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()  # bounded
    sample = spark.sparkContext.broadcast((sample["id"].to_numpy(np.int64), whole(list(sample["v"]), scale)))

    def build(table: pa.Table) -> pa.Table:
        tree, shard = BallTree(table.column("id").to_numpy(), whole(table.column("v").to_pylist(), scale)), table.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "centre": pa.array([tree.centre[0].tobytes()], pa.binary()), "radius": [float(tree.radius[0])]})

    def gather(table: pa.Table) -> pa.Table:
        ids, own = table.column("id").to_numpy(), whole(table.column("v").to_pylist(), scale)
        some_ids, some = sample.value
        score = np.where(some_ids[None, :] == ids[:, None], LEAST, products(own, some))
        kth = np.sort(score, axis=1)[:, -k] if score.shape[1] > k else np.full(len(ids), LEAST)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "queries": pa.array([pickle.dumps((ids, own, kth))], pa.binary())})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, queries_, roots in zip(*(batch.column(c).to_pylist() for c in ("block", "queries", "roots"))):
                _, own, kth = pickle.loads(queries_)
                width = max(len(r["centre"]) for r in roots) // 8
                centres = np.zeros((len(roots), width))
                for row, r in zip(centres, roots):
                    row[: len(r["centre"]) // 8] = np.frombuffer(r["centre"])
                bound = bounds(own, centres, np.array([r["radius"] for r in roots]))
                gain = (bound - kth[:, None]).max(axis=0)
                at = np.flatnonzero(gain >= 0)
                lines = _upwards(bound[:, at]).T
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int32()), pa.array([roots[i]["shard"] for i in at], pa.int32()), pa.array(gain[at], pa.float64()), pa.array([x.tobytes() for x in lines], pa.binary())], ["block", "shard", "gain", "bounds"])

    def alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for queries_, line, known in zip(*(batch.column(c).to_pylist() for c in ("queries", "bounds", "known"))):
                keep.append(bool((np.frombuffer(line, np.float32) >= current(pickle.loads(queries_), known)).any()))
            yield batch.select(["block", "shard"]).filter(pa.array(keep, pa.bool_()))

    def current(queries_: tuple, known: list | None) -> np.ndarray:
        """kth scores of a block: of the sample, or what the rounds before have found."""
        ids, _, kth = queries_
        better = {x["id"]: x["kth"] for x in known or []}
        return np.maximum(kth, np.array([better.get(i, LEAST) for i in ids.tolist()], np.int64))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Search] = {}
        for batch in batches:
            found = []
            for block, queries_, known, tree in zip(*(batch.column(c).to_pylist() for c in ("block", "queries", "known", "tree"))):
                if block not in blocks:
                    own = pickle.loads(queries_)
                    blocks[block] = Search(own[0], own[1], current(own, known), k)
                found += blocks[block].over(pickle.loads(tree))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    some = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_CELLS).toPandas()  # bounded
    centres = spark.sparkContext.broadcast(cells(whole(list(some["v"]), scale), min(MOST_CELLS, shards)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest(whole(batch.column("v").to_pylist(), scale), centres.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    def dealt(df: DataFrame, most: int, name: str) -> DataFrame:
        """(id, v, number): the rows of a cell in parts of about ``most``, by a hash; the parts of all cells numbered on."""
        placed = scratch.table(df.mapInArrow(place, "id long, v array<double>, cell int"), f"{name}-placed")
        sizes, before, numbers = dict(placed.groupBy("cell").count().collect()), 0, []  # MOST_CELLS rows
        for cell in sorted(sizes):
            parts = -(-sizes[cell] // most)
            numbers.append((cell, before, parts))
            before += parts
        own = spark.createDataFrame(numbers, "cell int, before int, parts int")
        return placed.join(F.broadcast(own), "cell").select("id", "v", (F.col("before") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int").alias(name))

    trees = scratch.table(dealt(rows, SHARD_ROWS, "shard").groupBy("shard").applyInArrow(build, "shard int, tree binary, centre binary, radius double"), "trees")
    shards = trees.agg(F.max("shard")).first()[0] + 1
    asked = scratch.table(dealt(clean(queries).groupBy("id").agg(F.min("v").alias("v")), BLOCK_ROWS, "block"), "asked")
    block_of = asked.select(F.col("id").alias("query_id"), "block")
    blocks = scratch.table(asked.groupBy("block").applyInArrow(gather, "block int, queries binary"), "blocks")
    scratch.drop("shard-placed", "block-placed")
    roots = trees.groupBy(F.floor(F.col("shard") / ROOTS).cast("int").alias("part")).agg(F.collect_list(F.struct("shard", "centre", "radius")).alias("roots"))  # ROOTS at most
    parts = F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // ROOTS))).alias("part")
    pairs = blocks.select("block", "queries", parts).join(roots, "part").mapInArrow(reach, "block int, shard int, gain double, bounds binary")
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("gain"), "shard")))
    pairs = scratch.table(ranked.drop("gain"), "pairs")
    most = pairs.agg(F.max("k")).first()[0] or 0
    if stats is not None:
        stats["pairs"] = shards * blocks.count()
    best, known, low, n = None, None, 0, 0
    while low < most or best is None:
        high = low + FIRST * GROWTH**n
        state = blocks.join(known, "block", "left") if known is not None else blocks.withColumn("known", F.lit(None).cast("array<struct<id:bigint,kth:bigint>>"))
        live = pairs.where((F.col("k") > low) & (F.col("k") <= high)).join(state, "block").mapInArrow(alive, "block int, shard int")
        if stats is not None:
            live = scratch.table(live, f"live{n}")
            stats["searched"] = stats.get("searched", 0) + live.count()
        found = live.join(state, "block").join(trees.select("shard", "tree"), "shard").select("block", "queries", "known", "tree").mapInArrow(search, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        every = found if best is None else best.drop("rank").unionByName(found)
        best = scratch.table(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"best{n}")
        kth = best.where(F.col("rank") == k).join(block_of, "query_id").select("block", F.struct(F.col("query_id").alias("id"), F.col("score").alias("kth")).alias("x"))
        known, low, n = kth.groupBy("block").agg(F.collect_list("x").alias("known")), high, n + 1  # a block's queries are BLOCK_ROWS or so
    scratch.drop("trees", "blocks", "asked", "pairs", *[f"best{i}" for i in range(n - 1)])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_topk(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
