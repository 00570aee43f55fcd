"""A graph's edges by node, stored: each edge from both of its ends, and beside them what a traversal shows of a node, by node.

What is shown of the other node is joined when neighbours are read, to the rows read alone: names and files are not written, nor moved, once for
each edge. Rows are bucketed and sorted by node, so a few nodes are a filter that reads their buckets only, and many are a join in which the
stored side is not shuffled. Nodes with more edges than a bucket is meant to hold (hubs) are kept apart, in files ranged by node and other
end, so that no bucket grows with one node and a join over them may be split.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.navigation import end_rows, few, shown_of
from ..schema import Graph

ROWS_PER_BUCKET, LEAST_BUCKETS = 1_000_000, 16


@dataclass
class Adjacency:
    near: DataFrame
    hubs: DataFrame | None = None
    shown: DataFrame | None = None
    buckets: int | None = None

    def neighbors(self, front: DataFrame) -> DataFrame:
        """The rows of the nodes in ``front`` with what is shown of the other node. A few other nodes of a small front are a filter, too."""
        ids = few(front)
        rows = self.of(front, ids)
        if self.shown is None:  # stored with the other node's columns in each row, by an earlier version
            return rows
        others = few(rows.select(F.col("other").alias("node"))) if ids is not None else None
        return rows.join(self.shown if others is None else self.shown.where(F.col("other").isin(others)), "other")

    def of(self, front: DataFrame, ids: list[int] | None = None) -> DataFrame:
        """The rows of the nodes in ``front`` (column node), which are ``ids`` where they are known to be few."""
        ids = few(front) if ids is None else ids
        asked = front.select("node").distinct()
        # A front in more parts than there are buckets would have the stored side shuffled to it.
        near = self.near.where(F.col("node").isin(ids)) if ids is not None else self.near.join(asked.repartition(self.buckets, "node") if self.buckets else asked, "node")
        if self.hubs is None:
            return near
        return near.unionByName(self.hubs.where(F.col("node").isin(ids)) if ids is not None else self.hubs.join(asked, "node"))


def fits(graph: Graph) -> bool:
    """Whether nodes and edges have the columns that an adjacency shows."""
    return {"id", "name", "node_type", "source"} <= set(graph.nodes.columns) and {"src", "dst", "relation_type", "confidence", "seq"} <= set(graph.edges.columns)


def write(graph: Graph, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Adjacency:
    """Store the adjacency of ``graph`` in an empty folder. A bucket is written by one task, or by several if it is large."""
    spark = graph.nodes.sparkSession
    rows = end_rows(graph)
    degrees = graph.edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    total, most = degrees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-total // rows_per_bucket))
    if most > rows_per_bucket:
        hubs = degrees.where(F.col("n") > rows_per_bucket).select("node")  # total / rows_per_bucket at most
        rows.join(hubs, "node", "left_semi").repartitionByRange("node", "other").sortWithinPartitions("node").write.parquet(f"{path}/hubs")
        rows = rows.join(hubs, "node", "left_anti")
    for place, part, key in ((f"{path}/shown-{buckets}", shown_of(graph.nodes), "other"), (f"{path}/near-{buckets}", rows, "node")):
        part.hint("rebalance", buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", place).mode("overwrite").saveAsTable(_name(place))
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Adjacency | None:
    """The adjacency stored in a folder, if there is one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*")
    found = {x.getPath().getName(): x.getPath().toString() for x in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder) or []}
    near, shown = (next((x for x in found if x.startswith(kind)), None) for kind in ("near-", "shown-"))
    if near is None:
        return None
    return Adjacency(_table(spark, f"{path}/{near}", "node"), spark.read.parquet(f"{path}/hubs") if "hubs" in found else None, _table(spark, f"{path}/{shown}", "other") if shown else None, int(near.removeprefix("near-")))


def _table(spark: SparkSession, place: str, key: str) -> DataFrame:
    """The bucketed files of a place, whose name ends in the number of buckets."""
    name = _name(place)
    if not spark.catalog.tableExists(name):
        columns = spark.read.parquet(place).schema.toDDL()
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(place.rsplit('-', 1)[1])} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _name(place: str) -> str:
    return "graphloom_" + hashlib.md5(place.encode()).hexdigest()
