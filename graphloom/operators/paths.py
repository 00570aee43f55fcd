"""Paths and PageRank: rounds of joins; what a round leaves is checkpointed to the shared folder."""

from __future__ import annotations

import functools
import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph
from .navigation import few, incident, incident_to, without

_ADAPTIVE = "spark.sql.adaptive.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without one, a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def checkpointed_by(df: DataFrame, key: str) -> DataFrame:
    """Cut lineage in the shared folder, by ``key`` and sorted by it, so that joins on it move and sort the other side alone. An adaptive
    plan does not tell a checkpoint how its rows lie, so this one plan is not adaptive."""
    spark = df.sparkSession
    laid = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    before = spark.conf.get(_ADAPTIVE, None)
    spark.conf.set(_ADAPTIVE, "false")
    try:
        return checkpointed(laid)
    finally:
        spark.conf.unset(_ADAPTIVE) if before is None else spark.conf.set(_ADAPTIVE, before)


def levels(edges: DataFrame, start: DataFrame, most: int | None = None, target: int | None = None) -> DataFrame:
    """(node, depth, parent): breadth-first over edges in both directions from ``start`` (column node).

    A node's parent is the one reached first, then the one with the smallest edge seq: rank in the level before, then seq. Stops
    where nothing new is found, at the target, or after ``most`` rounds if that is given. Edges are written once, by node, so a
    round moves its front only; a level is appended, and compared with the two before it, as no edge leads further back.
    """
    around = checkpointed_by(incident(edges).select("node", "other", "seq"), "node")
    first = start.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("rank")).distinct()
    found, done = [checkpointed(first)], None
    for depth in itertools.count(1) if most is None else range(1, most + 1):
        step = found[-1].select("node", F.col("rank").alias("r")).join(around, "node").groupBy(F.col("other").alias("found")).agg(F.min(F.struct("r", "seq", F.col("node").alias("parent"))).alias("x"))
        for before in found[-2:]:
            step = step.join(before.select(F.col("node").alias("found")), "found", "left_anti")
        new = checkpointed(step.select(F.col("found").alias("node"), F.lit(depth).alias("depth"), F.col("x.parent").alias("parent"), F.col("x.seq").alias("rank")))
        more = new.agg(F.count(F.lit(1)), F.max((F.col("node") == target).cast("int")) if target is not None else F.lit(0)).first()
        if not more[0]:
            break
        found.append(new)
        if len(found) > 32:  # a long search: what is settled becomes one table
            settled = functools.reduce(DataFrame.unionByName, found[:-2])
            done, found = checkpointed(settled if done is None else done.unionByName(settled)), found[-2:]
        if more[1]:
            break
    return functools.reduce(DataFrame.unionByName, found if done is None else [done, *found]).select("node", "depth", "parent")


def shortest_path(graph: Graph, a: int, b: int, most: int | None = None) -> list[int]:
    """Nodes of a shortest undirected path of at most ``most`` edges, or none. Of several that one whose edges' seqs, read from ``a`` on,
    are the least. Only the path comes to the driver.

    The search goes from both ends, each round from the one whose front is smaller, until a front meets the other's. A row of a front
    carries the nodes and seqs of the best way to its end, so a path is read where fronts meet and nothing is walked back. Edges come
    from the stored adjacency; without one, from the edges at a small front, or from all by node, written once.
    """
    spark = graph.edges.sparkSession
    if a == b:
        return [a]
    around: DataFrame | None = None

    def edges_at(front: DataFrame, ids: list[int] | None) -> DataFrame:
        nonlocal around
        if graph.adjacency is not None:
            return graph.adjacency.of(front, ids).select("node", "other", F.col("edge_seq").alias("seq"))
        if around is None and ids is not None:
            return incident_to(graph.edges, front, ids).select("node", "other", "seq")
        if around is None:
            around = checkpointed_by(incident(graph.edges).select("node", "other", "seq"), "node")
        return around

    fronts = [[(spark.createDataFrame([(end, [end], [])], "node long, nodes array<long>, seqs array<long>"), [end])] for end in (a, b)]
    sizes = [1, 1]
    for _ in itertools.count() if most is None else range(most):
        side = int(sizes[1] < sizes[0])
        front, ids = fronts[side][-1]
        onward = (lambda old, new: F.concat(F.array(new), old)) if side else (lambda old, new: F.concat(old, F.array(new)))
        reached = front.join(edges_at(front, ids), "node").select(F.col("other").alias("node"), onward(F.col("nodes"), F.col("other")).alias("nodes"), onward(F.col("seqs"), F.col("seq")).alias("seqs"))
        reached = reached.groupBy("node").agg(F.min(F.struct("seqs", "nodes")).alias("x")).select("node", "x.nodes", "x.seqs")
        for before, known in fronts[side][-2:]:
            reached = without(reached, "node", before, known)
        new = checkpointed(reached)
        there = fronts[1 - side][-1][0].select("node", F.col("nodes").alias("n"), F.col("seqs").alias("s"))
        (n1, s1), (n2, s2) = [("nodes", "seqs"), ("n", "s")][:: -1 if side else 1]
        met = new.join(there, "node").select(F.concat(s1, s2).alias("seqs"), F.concat(n1, F.slice(n2, 2, 1 << 30)).alias("nodes"))
        found = met.orderBy("seqs", "nodes").first()
        if found:
            return list(found["nodes"])
        own = few(new)
        sizes[side] = len(own) if own is not None else new.count()
        fronts[side] = [(front, ids), (new, own)]
        if not sizes[side]:
            return []
    return []


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(node, rank) of the ends of edges: (1-d)/N + d * sum of rank / out-degree over the edges as they repeat. What sinks hold is
    lost. Parallel edges are counted first, so a round moves a row for each distinct pair.

    No rank depends on what a sink held in a round before, so sinks and the edges into them take part in the last round only."""
    pairs = checkpointed(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    ends = pairs.select(F.col("src").alias("node"), "n").unionByName(pairs.select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("n")))
    nodes = checkpointed_by(ends.groupBy("node").agg(F.sum("n").alias("deg")), "node")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    sources = nodes.where("deg is not null")

    def shares(of: DataFrame) -> DataFrame:
        return of.join(sources, F.col("src") == F.col("node")).select("src", "dst", (F.col("n").cast("double") / F.col("deg")).alias("share"))

    def onward(to: DataFrame, over: DataFrame, ranks: DataFrame) -> DataFrame:
        flow = over.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        return to.join(flow, F.col("node") == F.col("dst"), "left").select("node", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("flow", F.lit(0.0))).alias("rank"))

    if rounds < 1:
        return nodes.select("node", F.lit(1.0 / n).alias("rank"))
    # By src in a form that Spark knows, so that a round shuffles flows, not edges.
    inner = checkpointed_by(shares(pairs.join(sources.select(F.col("node").alias("dst")), "dst", "left_semi")), "src")
    ranks = sources.select("node", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds - 1):
        ranks = onward(sources, inner, ranks)
        if k % every == every - 1:
            ranks = checkpointed_by(ranks, "node")
    return onward(nodes, shares(pairs), ranks)
