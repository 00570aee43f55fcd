"""Facts that are added, superseded, promoted, related and forgotten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..schema import EVIDENCE, Graph
from .mutation import remove_nodes, upsert_edges
from .navigation import lookup_many, means, normal
from .ranking import is_code, parse_tier, relevance, tier_weight


def with_reason(definition: Column, reason: Column) -> Column:
    """The reason is appended unless the text has it."""
    return F.when(reason.isNotNull() & ~F.coalesce(definition, F.lit("")).contains(reason), F.concat(F.coalesce(definition, F.lit("")), F.lit(" (reason: "), reason, F.lit(")"))).otherwise(definition)


def new_facts(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (ord, name, type, tier, definition, reason) of which the name finds no node; the first of each name."""
    known = lookup_many(nodes, facts).select(F.col("query").alias("name")).distinct()
    first = facts.groupBy(normal(F.col("name")).alias("k")).agg(F.min_by(F.struct("ord", "name", "type", "tier", "definition", "reason"), F.col("ord")).alias("x")).select("x.*")
    return first.join(known, "name", "left_anti").withColumn("definition", with_reason(F.col("definition"), F.col("reason")))


def supersede(nodes: DataFrame, superseded: DataFrame) -> DataFrame:
    """nodes with superseded_by set for the names in ``superseded`` (old, by): the id in by, 0 if it is unknown."""
    found = lookup_many(nodes, superseded, "old").select(F.col("query").alias("old"), "id").join(superseded, "old").groupBy("id").agg(F.min(F.coalesce("by", F.lit(0).cast("long"))).alias("new_by"))
    return nodes.join(found, "id", "left").withColumn("superseded_by", F.coalesce("new_by", "superseded_by")).drop("new_by")


def promote(nodes: DataFrame, promotions: DataFrame) -> DataFrame:
    """nodes with the tier raised for the names in ``promotions`` (name, new_tier); never lowered."""
    found = lookup_many(nodes, promotions).select(F.col("query").alias("name"), "id").join(promotions, "name")
    best = found.groupBy("id").agg(F.max_by("new_tier", tier_weight(F.col("new_tier"))).alias("new_tier"))
    higher = tier_weight(F.col("new_tier")) > tier_weight(F.col("tier"))
    return nodes.join(best, "id", "left").withColumn("tier", F.when(F.coalesce(higher, F.lit(False)), F.col("new_tier")).otherwise(F.col("tier"))).drop("new_tier")


def relate(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges (src, dst, relation_type, confidence 0.8) of the relations (src_name, dst_name, type) with both ends known."""
    ends = relations.select(F.explode(F.array("src_name", "dst_name")).alias("name")).distinct()
    found = lookup_many(nodes, ends).select("query", "id")
    out = relations.join(found.select(F.col("query").alias("src_name"), F.col("id").alias("src")), "src_name").join(found.select(F.col("query").alias("dst_name"), F.col("id").alias("dst")), "dst_name")
    return out.where("src <> dst").select("src", "dst", F.col("type").alias("relation_type"), F.lit(0.8).cast("float").alias("confidence"))


def forgotten(nodes: DataFrame, now: int, threshold: float = 0.05) -> DataFrame:
    """Nodes, not from code, whose relevance is under the threshold."""
    score = relevance(F.col("tier"), F.col("created_at"), now, F.col("superseded_by"), F.lit(False))
    return nodes.where(~F.coalesce(is_code(), F.lit(False))).withColumn("relevance", score).where(F.col("relevance") < threshold)


def garbage_collect(graph: Graph, now: int, threshold: float = 0.05) -> Graph:
    return remove_nodes(graph, forgotten(graph.nodes, now, threshold))


def reconcile(graph: Graph, batch: dict, now: int) -> tuple[Graph, dict]:
    """Fold one session's facts into the graph, in its order: add, supersede, promote, relate; each step sees those before it.

    A fact is added unless a look-up of its name finds a node or a fact added before it, with its evidence (document ``conversation``)
    where it has any. A superseded name takes the id of what the first fact that names it means, else 0. Tiers are raised, never lowered.
    Relations are edges of confidence 0.8 from a conversation, merged with those that are there. Unknown types and self loops are errors.
    The batch is one session's, so it is folded on the driver, after one look-up of all its names; the graph is joined with it.
    """
    spark = graph.nodes.sparkSession
    report: dict = {"added": 0, "superseded": 0, "promoted": 0, "edges_added": 0, "edges_new": 0, "errors": []}
    nodes, edges = graph.nodes, graph.edges
    types = {r["name"].lower() for r in graph.node_types.collect()} if graph.node_types is not None else set()
    relation_types = {r["name"].lower() for r in graph.edge_types.collect()} if graph.edge_types is not None else set()
    facts = [f for f in batch.get("new_facts", []) if f.get("name", "").strip(WHITE)]
    over, raised, relations = batch.get("superseded", []), batch.get("promotions", []), batch.get("relations", [])
    asked = {f["name"] for f in facts} | {f["supersedes"] for f in facts if f.get("supersedes")} | {s["old"] for s in over} | {p["name"] for p in raised} | {r[k] for r in relations for k in ("from", "to")}
    known: dict[str, tuple[int, int]] = {}
    if asked:  # all names of the batch at once; what the batch adds itself is looked up beside
        found = lookup_many(nodes, spark.createDataFrame([(x,) for x in sorted(asked)], "name string"))
        known = {r["query"]: (r["step"], r["id"]) for r in found.collect()}
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    added: list[list] = []

    def find(name: str) -> int | None:
        own = [(step, 1, k) for k, x in enumerate(added, 1) if (step := means(name, x[0]))]
        there = [(known[name][0], 0, known[name][1])] if name in known else []
        best = min(own + there, default=None)
        return None if best is None else top[0] + best[2] if best[1] else best[2]

    for f in facts:
        if find(f["name"]) is not None:
            continue
        kind = f.get("type") or f.get("fact_type") or "TechnicalFact"
        if types and kind.lower() not in types:
            report["errors"].append(f"Add '{f['name']}': unknown node type: {kind}")
            continue
        definition, reason, said = f.get("definition") or "", f.get("reason") or "", f.get("evidence_text") or ""
        if reason and reason not in definition:
            definition = f"{definition} (reason: {reason})"
        added.append([f["name"], kind, definition, f.get("tier") or "Minor", [("conversation", None, said, 0, 0)] if said else []])
    report["added"] = len(added)
    if added:
        made = spark.createDataFrame([(top[0] + k, top[1] + k, name, kind, definition, [], 0.9, now, now, tier, said) for k, (name, kind, definition, tier, said) in enumerate(added, 1)],
            f"id long, seq long, name string, node_type string, definition string, aliases array<string>, confidence double, created_at long, last_referenced long, tier string, evidence {EVIDENCE.simpleString()}")
        source = F.struct(*[(F.lit("Conversation") if f.name == "kind" else F.lit(None).cast(f.dataType)).alias(f.name) for f in nodes.schema["source"].dataType])
        made = made.withColumn("tier", parse_tier(F.col("tier"))).withColumn("confidence", F.col("confidence").cast(nodes.schema["confidence"].dataType)).withColumn("source", source)
        nodes = nodes.unionByName(made.select(*[c for c in made.columns if c in nodes.columns]), allowMissingColumns=True)
    old: dict[int, int] = {}
    for name in [s["old"] for s in over] + [f["supersedes"] for f in facts if f.get("supersedes")]:
        if (at := find(name)) is not None and at not in old:
            new = next((f["name"] for f in facts if f.get("supersedes") == name), None)
            old[at] = (find(new) if new else None) or 0
    report["superseded"] = len(old)
    if old:
        change = spark.createDataFrame(list(old.items()), "id long, new_by long")
        nodes = nodes.join(F.broadcast(change), "id", "left").withColumn("superseded_by", F.coalesce("new_by", "superseded_by")).drop("new_by")  # a batch's
    up = [(at, p["new_tier"]) for p in raised if (at := find(p["name"])) is not None]
    if up:
        change = spark.createDataFrame(up, "id long, new_tier string").withColumn("new_tier", parse_tier(F.col("new_tier")))
        change = change.groupBy("id").agg(F.max_by("new_tier", tier_weight(F.col("new_tier"))).alias("new_tier"))
        higher = F.coalesce(tier_weight(F.col("new_tier")) > tier_weight(F.col("tier")), F.lit(False))
        report["promoted"] = nodes.join(F.broadcast(change), "id").where(higher).count()
        nodes = nodes.join(F.broadcast(change), "id", "left").withColumn("tier", F.when(higher, F.col("new_tier")).otherwise(F.col("tier"))).drop("new_tier")
    pairs = []
    for r in relations:
        ends = find(r["from"]), find(r["to"])
        if None in ends:
            continue
        wrong = "self-loop" if ends[0] == ends[1] else f"unknown edge type: {r['type']}" if relation_types and r["type"].lower() not in relation_types | {"mentions"} else None
        if wrong:
            report["errors"].append(f"Edge '{r['from']}'->'{r['to']}': {wrong}")
        else:
            pairs.append((*ends, r["type"], 0.8, {"kind": "Conversation"}, []))
    if pairs:
        edges, fresh = upsert_edges(edges, pairs)
        report["edges_added"], report["edges_new"] = len(pairs), sum(fresh)
    return Graph(nodes, edges, graph.documents, graph.node_types, graph.edge_types, graph.domain), report
