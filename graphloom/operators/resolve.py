"""Entity resolution by name, alias and longest common subsequence, and ingestion of extraction batches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVIDENCE, Graph
from .mutation import upsert_edges
from .navigation import all_names, normal

THRESHOLD = 0.85


WORD = 62
_FULL = (1 << WORD) - 1


def similarity(a: Column, b: Column) -> Column:
    """2 LCS / (|a| + |b|) over characters; 1 if both are empty, 0 if one is.

    Bit-parallel: a word has a bit for each of 62 characters of ``a``, so that sums stay in 64 bits. A character of ``b`` changes all words by
    (v + (v & m)) | (v - (v & m)), m being the bits where ``a`` has it, with a carry to the next word. The subsequence has as many
    characters as bits become 0. JVM-side; the work is |b| steps for each 62 characters of ``a``.
    """
    ca, cb = F.split(a, ""), F.split(b, "")
    words = F.ceil(F.size(ca) / F.lit(WORD)).cast("int")
    one, zero, full = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(_FULL).cast("long")
    size = lambda w: F.least(F.lit(WORD), F.size(ca) - w * WORD)
    valid = lambda w: F.when(size(w) == WORD, full).otherwise(F.call_function("shiftleft", one, size(w)) - 1)

    def mask(x: Column, w: Column) -> Column:
        own = F.slice(ca, w * WORD + 1, F.lit(WORD))
        bits = F.transform(own, lambda y, i: F.when(y == x, F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda s, y: s.bitwiseOR(y))

    every = F.sequence(F.lit(0), words - 1)
    letters = F.array_distinct(F.filter(cb, lambda x: F.array_contains(ca, x)))
    masks = F.map_from_arrays(letters, F.transform(letters, lambda x: F.transform(every, lambda w: mask(x, w))))
    start = F.struct(F.transform(every, valid).alias("v"), masks.alias("m"))

    def step(state: Column, x: Column) -> Column:
        v, m = state["v"], F.try_element_at(state["m"], x)

        def word(s: Column, w: Column) -> Column:
            own = F.element_at(v, w + 1)
            hit = own.bitwiseAND(F.element_at(m, w + 1))
            total = own + hit + s["carry"]
            new = total.bitwiseOR(own - hit).bitwiseAND(valid(w))
            return F.struct(F.call_function("shiftright", total, F.lit(WORD)).alias("carry"), F.concat(s["out"], F.array(new)).alias("out"))

        moved = F.aggregate(every, F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out")), word)["out"]
        return F.struct(F.when(m.isNull(), v).otherwise(moved).alias("v"), state["m"].alias("m"))

    left = F.aggregate(cb, start, step)["v"]
    lcs = F.size(ca) - F.aggregate(left, F.lit(0), lambda s, x: s + F.bit_count(x))
    both = (F.length(a) + F.length(b)).cast("double")
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(lcs * 2.0 / both)


def lcs_similarity(a: str, b: str) -> float:
    """The same on the driver, for a batch's own names."""
    if not a or not b:
        return float(a == b)
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(cur[-1], prev[j + 1]))
        prev = cur
    return 2 * prev[-1] / (len(a) + len(b))


def _kept(m: Column, n: Column, threshold: float) -> Column:
    """What a common subsequence of names of these lengths has at least."""
    return F.ceil((m + n) * (threshold / 2) - 1e-9).cast("int")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(q, key): pairs of names of the two sides (column s) that may have the similarity, and all that do.

    A character that is left out costs a name at most two of its character pairs, one put in at most one. So of names of lengths m and n
    that are similar enough all but ``lost`` pairs are kept, in their order, and no further apart than what is left out or put in. With the pairs of
    both sides by their frequency among ``right``, then text and place, similar names share one of the first lost + 1 at nearly the same place: the
    join is on that, the rarest first, so no key has a share of all. Names that may lose all their pairs (none at the usual threshold but single
    characters, which only equal ones resemble) are joined by length.
    """
    ratio = threshold / (2 - threshold)
    lengths = F.sequence(F.ceil(F.col("m") * ratio - 1e-9).cast("int"), F.floor(F.col("m") / ratio + 1e-9).cast("int"))

    def lost(m: Column, n: Column) -> Column:
        kept = _kept(m, n, threshold)
        return F.when(kept <= F.least(m, n), (m - kept) * 2 + (n - kept)).otherwise(-1)

    most = F.aggregate(lengths, F.lit(-1), lambda s, n: F.greatest(s, lost(F.col("m"), n)))
    sized = lambda df: df.select("s").distinct().withColumn("m", F.length("s")).where("m > 0").withColumn("lost", most).where("lost >= 0")
    a = sized(left)
    wanted = a.select(F.explode(lengths).alias("m")).distinct()  # lengths
    b = sized(right).join(F.broadcast(wanted), "m", "left_semi")
    pairs = lambda df: df.where("m > 1").select("s", "m", "lost", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda i: F.substr(F.col("s"), i, F.lit(2)))).alias("at", "gram"))
    often = pairs(b).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))

    def first(df: DataFrame, s: str, m: str, at: str) -> DataFrame:
        ranked = pairs(df).join(often, "gram", "left").groupBy("s", "m", "lost").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram", "at"))).alias("x"))
        return ranked.select(F.col("s").alias(s), F.col("m").alias(m), F.explode(F.slice("x", F.lit(1), F.col("lost") + 1)).alias("x")).select(s, m, F.col("x.gram").alias("gram"), F.col("x.at").alias(at))

    m, n = F.col("m1"), F.col("m2")
    kept = _kept(m, n, threshold)
    near = (kept <= F.least(m, n)) & (F.abs(F.col("at1") - F.col("at2")) <= F.greatest(m, n) - kept)
    found = first(a, "q", "m1", "at1").join(first(b, "key", "m2", "at2"), "gram").where(near).select("q", "key")
    weak = F.col("lost") >= F.col("m") - 1
    by_length = a.withColumn("n", F.explode(lengths)).select(F.col("s").alias("q"), "n", weak.alias("w1")).join(b.select(F.col("s").alias("key"), F.col("m").alias("n"), weak.alias("w2")), "n").where("w1 or w2")
    return found.unionByName(by_length.select("q", "key")).distinct()


def resolve(names: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query, id, score) of the node that each name means: exact name or alias, else the most similar name or alias of at
    least the threshold, ties to the smallest seq. Blank names mean nothing.

    Similar names come from ``similar_pairs``; pairs with fewer characters in common than the threshold needs go before the subsequence is
    computed.
    """
    asked = names.select(F.col(names.columns[0]).alias("query")).distinct().withColumn("q", normal(F.col("query"))).where("q <> ''")
    keys = all_names(nodes)
    exact = asked.join(keys, F.col("q") == F.col("key")).groupBy("query").agg(F.min(F.struct("seq", "id")).alias("x")).select("query", "x.id", F.lit(1.0).alias("score"))
    rest = asked.join(exact.select("query"), "query", "left_anti")
    pairs = similar_pairs(rest.select(F.col("q").alias("s")), keys.select(F.col("key").alias("s")), threshold)
    letters = F.array_distinct(F.split("q", ""))
    count = lambda text, x: F.length(text) - F.length(F.replace(text, x, F.lit("")))
    common = F.aggregate(letters, F.lit(0), lambda s, x: s + F.least(count(F.col("q"), x), count(F.col("key"), x)))
    pairs = pairs.where(common * 2.0 >= (F.length("q") + F.length("key")) * (threshold - 1e-9))
    scored = pairs.withColumn("score", similarity(F.col("q"), F.col("key"))).where(F.col("score") >= threshold)
    scored = rest.join(scored, "q").join(keys, "key")
    best = scored.groupBy("query").agg(F.max(F.struct("score", (-F.col("seq")).alias("s"), "id")).alias("x")).select("query", "x.id", "x.score")
    return exact.unionByName(best)


@dataclass
class IngestReport:
    entities_added: int = 0
    entities_merged: int = 0
    rejected: int = 0
    edges_added: int = 0
    edges_deduped: int = 0
    errors: list[str] = field(default_factory=list)


def parse_extraction(text: str, document: str | None = None) -> dict:
    """A batch from extraction JSON, with the defaults for missing fields."""
    raw = json.loads(text)
    entities = [{"name": e.get("name", ""), "type": e.get("type") or "concept", "definition": e.get("definition") or "", "aliases": e.get("aliases") or [], "confidence": float(e.get("confidence", 0.7)), "evidence": e.get("evidence_text") or e.get("definition") or "", "document": document or "memory"} for e in raw.get("entities", [])]
    relations = [{"source": r.get("source", ""), "target": r.get("target", ""), "type": r.get("type") or "related_to", "confidence": float(r.get("confidence", 0.7)), "evidence": r.get("evidence_text") or "", "document": document or "memory"} for r in raw.get("relations", [])]
    return {"entities": entities, "relations": relations}


def _said(one: dict) -> list[tuple]:
    """The evidence of an entity or relation of a batch."""
    return [(one.get("document"), None, one["evidence"], 0, 0)] if one.get("evidence") else []


def _source(like: DataFrame) -> Column:
    """Source of what a batch adds, from its column document: the document, or memory; in the shape of the graph's."""
    memory = F.coalesce(F.col("document") == "memory", F.lit(True))
    parts = {"kind": F.when(memory, "Memory").otherwise("Document"), "name": F.when(~memory, F.col("document"))}
    return F.struct(*[parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema["source"].dataType])


def ingest(graph: Graph, batch: dict, now: int = 0, threshold: float = THRESHOLD) -> tuple[Graph, IngestReport]:
    """Fold a batch (one extraction, so small) into the graph, in its order: each entity sees those before it.

    Matches in the graph are found by one resolution join over the batch's names; the fold over the matches is sequential by
    nature and touches the batch only. Changes are applied with one join and one union for nodes; of the edges only those with the
    ends and relation of a new one are merged. Where the graph has evidence, a node's goes on with each entity's, an edge's with
    texts that it has not. Unknown types are errors where the graph has an ontology; mentions are always known.
    """
    spark, report = graph.nodes.sparkSession, IngestReport()
    entities = [e for e in batch.get("entities", []) if e["name"].strip()]
    relations = batch.get("relations", [])
    names = sorted({e["name"] for e in entities} | {r[k] for r in relations for k in ("source", "target") if r[k].strip()})
    found: dict[str, tuple[int, float]] = {}
    if names:
        asked = spark.createDataFrame([(x,) for x in names], "name string")
        found = {r["query"]: (r["id"], r["score"]) for r in resolve(asked, graph.nodes, threshold).collect()}  # one row for each name of the batch
    ids = sorted({i for i, _ in found.values()})
    columns = ["id", "name", "definition", "aliases", "confidence"]
    held = {r["id"]: r.asDict() for r in graph.nodes.join(spark.createDataFrame([(i,) for i in ids], "id long"), "id", "left_semi").select(columns).collect()} if ids else {}
    top = graph.nodes.agg(F.max("id"), F.max("seq")).first()
    next_id, next_seq = (top[0] or 0) + 1, (top[1] or 0) + 1
    types = {r["name"].lower() for r in graph.node_types.collect()} if graph.node_types is not None else set()
    relation_types = {r["name"].lower() for r in graph.edge_types.collect()} if graph.edge_types is not None else set()
    added: dict[int, dict] = {}
    said: dict[int, list] = {}

    def find(name: str) -> int | None:
        key = name.strip().lower()
        at = found.get(name)
        if at and at[1] == 1.0:
            return at[0]
        best, best_score = (at[0], at[1]) if at else (None, threshold)
        for i, node in added.items():
            keys = [node["name"].strip().lower(), *(a.strip().lower() for a in node["aliases"])]
            if key in keys:
                return i
            for own in keys:
                score = lcs_similarity(key, own)
                if score > best_score or (best is None and score >= threshold):
                    best, best_score = i, score
        return best

    named: dict[str, int] = {}
    for e in entities:
        at = find(e["name"])
        if at is None:
            if types and e["type"].lower() not in types:
                report.rejected += 1
                report.errors.append(f"unknown node type: {e['type']}")
                continue
            at, next_id = next_id, next_id + 1
            added[at] = {"id": at, "seq": next_seq, "name": e["name"].strip(), "node_type": e["type"], "definition": e["definition"], "aliases": list(e["aliases"]), "confidence": e["confidence"], "created_at": now, "tier": "Minor", "document": e.get("document")}
            next_seq += 1
            report.entities_added += 1
        else:
            node = added.get(at) or held[at]
            old = node["definition"] or ""
            if e["confidence"] > node["confidence"] or (e["confidence"] == node["confidence"] and len(e["definition"].encode()) > len(old.encode())):
                node["definition"] = e["definition"]
            node["confidence"] = max(node["confidence"], e["confidence"])
            node["aliases"] = list(node["aliases"] or []) + [a for a in e["aliases"] if a not in (node["aliases"] or [])]
            report.entities_merged += 1
        said.setdefault(at, []).extend(_said(e))
        named.setdefault(e["name"], at)
    has_evidence = "evidence" in graph.nodes.columns
    change = spark.createDataFrame([(i, n["definition"], list(n["aliases"] or []), float(n["confidence"]), said.get(i, [])) for i, n in held.items()], f"id long, c_definition string, c_aliases array<string>, c_confidence double, c_evidence {EVIDENCE.simpleString()}")
    nodes = graph.nodes.join(change, "id", "left")
    for c in ("definition", "aliases", "confidence"):
        nodes = nodes.withColumn(c, F.when(F.col("c_confidence").isNotNull(), F.col(f"c_{c}").cast(graph.nodes.schema[c].dataType)).otherwise(F.col(c)))
    if has_evidence:
        none = F.array().cast(EVIDENCE)
        nodes = nodes.withColumn("evidence", F.when(F.size(F.coalesce("c_evidence", none)) > 0, F.concat(F.coalesce("evidence", none), "c_evidence")).otherwise(F.col("evidence")))
    nodes = nodes.select(graph.nodes.columns)
    if added:
        fields = ("id", "seq", "name", "node_type", "definition", "aliases", "confidence", "created_at", "tier", "document")
        new = spark.createDataFrame([(*(n[k] for k in fields), said.get(i, [])) for i, n in added.items()], f"id long, seq long, name string, node_type string, definition string, aliases array<string>, confidence double, created_at long, tier string, document string, evidence {EVIDENCE.simpleString()}")
        new = new.withColumn("confidence", F.col("confidence").cast(nodes.schema["confidence"].dataType)).withColumn("source", _source(nodes)).drop("document")
        new = new if has_evidence else new.drop("evidence")
        nodes = nodes.unionByName(new, allowMissingColumns=True)
    pairs = []
    for r in relations:
        if r["source"].strip().lower() == r["target"].strip().lower():
            report.edges_deduped += 1
            continue
        ends = [named.get(r[k]) or find(r[k]) for k in ("source", "target")]
        if None in ends:
            report.errors.append(f"unknown end: {r['source']} -> {r['target']}")
        elif relation_types and r["type"].lower() not in relation_types | {"mentions"}:
            report.errors.append(f"unknown edge type: {r['type']}")
        elif ends[0] != ends[1]:
            document = r.get("document")
            source = {"kind": "Memory"} if document in (None, "memory") else {"kind": "Document", "name": document}
            pairs.append((*ends, r["type"], r["confidence"], source, _said(r)))
    edges = graph.edges
    if pairs:
        edges, new = upsert_edges(edges, pairs)
        report.edges_added += sum(new)
        report.edges_deduped += len(new) - sum(new)
    return Graph(nodes, edges, graph.documents, graph.node_types, graph.edge_types, graph.domain), report
