"""Look-ups and traversals. Ties are broken by the smallest seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..schema import Graph
from .discover import contained


def normal(name: Column) -> Column:
    """Lower case, without white space of any kind at its ends."""
    return F.lower(F.btrim(name, F.lit(WHITE)))


def means(query: str, name: str) -> int | None:
    """The rule of ``lookup`` by which ``query`` means a node of that name without aliases, or None."""
    key, own = query.strip(WHITE).lower(), name.strip(WHITE).lower()
    part = len(key.encode()) >= 6 and (key in own or (len(own.encode()) >= 6 and own in key))
    return 1 if own == key else 2 if own == toggled(key) else 3 if part else None


def all_names(nodes: DataFrame) -> DataFrame:
    """(key, id, seq): each node's normalised name and its other non-empty aliases, once each."""
    names = F.array_distinct(F.concat(F.array(normal(F.col("name"))), F.filter(F.transform("aliases", normal), lambda a: a != "")))
    return nodes.select(F.explode(names).alias("key"), "id", "seq")


def toggled(key: str) -> str:
    """With the last s taken off, or one put on."""
    return key[:-1] if key.endswith("s") else key + "s"


def lookup(nodes: DataFrame, name: str) -> DataFrame:
    """The node that a name means, or no row: exact name or alias; else the name with its last s toggled; else, from six
    bytes on, a node whose name contains it or (from six bytes on) is contained in it. One scan and a top-1."""
    key = name.strip(WHITE).lower()
    own = normal(F.col("name"))
    names = F.concat(F.array(own), F.filter(F.transform("aliases", normal), lambda a: a != ""))
    part = F.lit(len(key.encode()) >= 6) & (own.contains(key) | ((F.octet_length(own) >= 6) & F.lit(key).contains(own)))
    step = F.when(F.array_contains(names, key), 1).when(F.array_contains(names, toggled(key)), 2).when(part, 3)
    return nodes.withColumn("step", step).where("step is not null").orderBy("step", "seq").limit(1)


def lookup_many(nodes: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """(query, id, step) by the rules of ``lookup`` for many names at once: equi-joins, then for what they leave the joins on grams
    of ``contained``, both ways."""
    all_asked = names.select(F.col(column).alias("query"), normal(F.col(column)).alias("k")).distinct()
    asked = all_asked.select("query", F.explode(F.array(F.struct(F.lit(1).alias("step"), F.col("k").alias("key")), F.struct(F.lit(2).alias("step"), F.when(F.col("k").endswith("s"), F.expr("left(k, length(k) - 1)")).otherwise(F.concat("k", F.lit("s"))).alias("key")))).alias("x")).select("query", "x.*")
    found = asked.join(all_names(nodes), "key").groupBy("query").agg(F.min(F.struct("step", "seq", "id")).alias("x"))
    found = found.select("query", "x.id", "x.step")
    rest = all_asked.where(F.octet_length("k") >= 6).join(found.select("query"), "query", "left_anti")
    keys = rest.select(F.col("k").alias("id"), F.col("k").alias("text"), F.col("k").alias("name")).distinct()
    own = nodes.select("id", normal(F.col("name")).alias("text"), normal(F.col("name")).alias("name"))
    inside = contained(own, keys).select(F.col("name_id").alias("k"), F.col("text_id").alias("id"))
    around = contained(keys, own.where(F.octet_length("name") >= 6)).select(F.col("text_id").alias("k"), F.col("name_id").alias("id"))
    part = inside.unionByName(around).join(nodes.select("id", "seq"), "id").groupBy("k").agg(F.min(F.struct("seq", "id")).alias("x"))
    return found.unionByName(rest.join(part, "k").select("query", "x.id", F.lit(3).alias("step")))


def nodes_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    """Exact type, case included."""
    return nodes.where(F.col("node_type") == node_type)


FEW = 1000


def few(front: DataFrame, most: int = FEW) -> list[int] | None:
    """The distinct nodes of a front (column node) if there are at most ``most``, as a filter that scans and stored buckets can use; else None."""
    rows = front.select("node").distinct().limit(most + 1).collect()
    return None if len(rows) > most else [r["node"] for r in rows]


def without(rows: DataFrame, column: str, front: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """``rows`` of which ``column`` is not in the front (column node), whose nodes are ``ids`` where they are known to be few."""
    ids = few(front) if ids is None else ids
    return rows.join(front.select(F.col("node").alias(column)), column, "left_anti") if ids is None else rows.where(~F.col(column).isin(ids)) if ids else rows


def incident(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: (node, other, direction) beside its columns."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("outgoing").alias("direction")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("incoming").alias("direction")))
    return edges.withColumn("x", F.explode(ends)).select("*", "x.*").drop("x")


def incident_to(edges: DataFrame, of: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """``incident`` of the nodes ``of`` alone: edges are cut to those at them before any is doubled. A few nodes are a filter."""
    ids = few(of) if ids is None else ids
    ends = []
    for end, other, direction in (("src", "dst", "outgoing"), ("dst", "src", "incoming")):
        own = edges.where(F.col(end).isin(ids)) if ids is not None else edges.join(of.select(F.col("node").alias(end)).distinct(), end, "left_semi")
        ends.append(own.select(*edges.columns, F.col(end).alias("node"), F.col(other).alias("other"), F.lit(direction).alias("direction")))
    return ends[0].unionByName(ends[1])


def end_rows(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """One row for each edge and end, or for each edge at the nodes ``of``: node, other, and what is shown of the edge."""
    said = [F.col("evidence").alias("edge_evidence")] if "evidence" in graph.edges.columns else []
    around = incident(graph.edges) if of is None else incident_to(graph.edges, of)
    return around.select("node", "other", "relation_type", "direction", F.col("confidence").alias("edge_confidence"), F.col("seq").alias("edge_seq"), *said)


def shown_of(nodes: DataFrame) -> DataFrame:
    """What is shown of a node as the other end of an edge."""
    return nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("node_type").alias("other_type"), F.col("source").alias("other_source"))


def neighbor_rows(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """``end_rows`` with what is shown of the other node, which must be there."""
    return end_rows(graph, of).join(shown_of(graph.nodes), "other")


def neighbors(graph: Graph, of: DataFrame) -> DataFrame:
    """One row for each edge at the nodes ``of`` (column node): the other node, relation, direction, confidence, and evidence where
    the graph has it. From the stored adjacency where the graph has one."""
    return graph.adjacency.neighbors(of) if graph.adjacency is not None else neighbor_rows(graph, of)


def neighbors_by_type(graph: Graph, of: DataFrame, node_type: str) -> DataFrame:
    return neighbors(graph, of).where(F.lower("other_type") == node_type.lower())


def follow(graph: Graph, of: DataFrame, relation: str) -> DataFrame:
    """Targets of outgoing edges of a relation, case ignored."""
    out = graph.edges.where(F.lower("relation_type") == relation.lower()).join(of, F.col("src") == F.col("node")).select("node", F.col("dst").alias("other"))
    return out.join(graph.nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other")


def explore(graph: Graph, name: str) -> DataFrame:
    """The node that a name means with one row for each of its relations, and one without any: name, node_type, definition, number of
    ``relations``, and of each its direction, relation_type, other node's name and type, confidence and edge_seq; where the graph has
    evidence also the node's and the edge's. A hub's relations are rows, not a list in one."""
    said = ["evidence"] if "evidence" in graph.nodes.columns else []
    node = lookup(graph.nodes, name).select(F.col("id").alias("node"), "name", "node_type", "definition", *said)
    around = neighbors(graph, node.select("node")).drop("other", "other_source")
    count = around.groupBy("node").agg(F.count(F.lit(1)).alias("relations"))
    out = node.join(F.broadcast(count), "node", "left").join(around, "node", "left").drop("node")  # one row
    return out.withColumn("relations", F.coalesce("relations", F.lit(0).cast("long")))


def inbound_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("inbound"))


def references_to(graph: Graph, name: str) -> DataFrame:
    """Edges from code into every node of that exact name (else the looked-up node): (source_file, source_line, target, ref_type)."""
    exact = graph.nodes.where(normal(F.col("name")) == name.strip(WHITE).lower()).select("id", "name")
    other = lookup(graph.nodes, name).where("step > 1").select("id", "name")
    target = exact.unionByName(other).withColumnRenamed("id", "dst").withColumnRenamed("name", "target")
    kind = F.expr("case relation_type when 'reads' then 'ReadsField' when 'writes' then 'WritesField' when 'uses_type' then 'UsesType' else 'Calls' end")
    return graph.edges.where("source.kind = 'CodeAnalysis'").join(target, "dst").select(F.col("source.file").alias("source_file"), F.lit(0).cast("long").alias("source_line"), "target", kind.alias("ref_type"))


def recent(nodes: DataFrame, k: int = 10) -> DataFrame:
    return nodes.orderBy(F.desc("created_at"), "seq").limit(k)


def topics(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Each type, its number of nodes and its first names; names of a hot type are ranked, not gathered."""
    from pyspark.sql import Window

    order = Window.partitionBy("node_type").orderBy("seq")
    counts = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
    first = nodes.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).groupBy("node_type").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("x"))
    return counts.join(first, "node_type").select("node_type", "n", F.array_join(F.transform("x", lambda x: x["name"]), ", ").alias("names"))


def stats(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("source.kind") == "Memory").alias("memory_nodes"), F.countDistinct("node_type").alias("node_types"))
    e = graph.edges.agg(F.count(F.lit(1)).alias("edge_count"), F.countDistinct("relation_type").alias("edge_types"))
    return n.join(F.broadcast(e))  # one row each


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def relation_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


def quality_metrics(graph: Graph) -> DataFrame:
    """Orphans and their share, share of related_to (case ignored), average degree; zero for an empty graph."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    orphans = graph.nodes.join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_count"))
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    e = graph.edges.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.lower("relation_type") == "related_to").alias("vague"))
    one = n.join(F.broadcast(e)).join(F.broadcast(orphans))  # one row each
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return one.select("orphan_count", ratio(F.col("orphan_count"), F.col("n")).alias("orphan_ratio"), ratio(F.col("vague"), F.col("m")).alias("related_to_ratio"), ratio(F.col("m") * 2, F.col("n")).alias("average_degree"))
