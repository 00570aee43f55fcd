"""A graph and its path, with the operators as methods. Results are DataFrames, or text where a report is asked for."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import chunks
from .operators import discover, evaluate, impact, lifecycle, mutation, navigation, paths, ranking, reports, resolve
from .plans import prompts, resolution
from .schema import Graph
from .sources import code, conversations, graph_file, store


@dataclass
class BootstrapReport:
    """What a bootstrap found: numbers of files and entities, and the texts of conversations (session_id, text) and of document chunks."""

    files: int
    entities: int
    conversations: DataFrame
    documents: DataFrame


class KnowledgeGraph:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder, self.graph = spark, path, store.load_or_create(spark, path)

    def save(self) -> None:
        """Write the graph as a whole version."""
        store.save(self.graph, self.folder)
        self.graph = store.load(self.spark, self.folder)

    def save_changes(self) -> None:
        """Write what differs from what is stored."""
        store.append(self.graph, self.folder)
        self.graph = store.load(self.spark, self.folder)

    def import_file(self, path: str, magic: str) -> None:
        """Take the graph of a binary file, or of a folder of them, in place of this one; ``magic`` is what such files begin with."""
        self.graph = graph_file.read_graph(self.spark, path, magic)

    # sources
    def _bases(self) -> dict[str, str]:
        """The bases that were indexed, and what is before the paths of each one's files."""
        files = self.graph.nodes.where("node_type = 'File' and properties is not null")
        rows = files.select(F.col("properties")["base"].alias("base"), F.col("properties")["prefix"].alias("prefix")).where("base is not null").distinct().collect()  # bases
        return {r["base"]: r["prefix"] for r in rows}

    @staticmethod
    def _prefix(base: str, bases: dict[str, str]) -> str:
        """Nothing for the first base; for a further one its folder's name, with a number if another has that."""
        if base in bases or not bases:
            return bases.get(base, "")
        name = base.rstrip("/").rsplit("/", 1)[-1]
        return next(x for x in (f"{name}-{k}/" if k > 1 else f"{name}/" for k in itertools.count(1)) if x not in bases.values())

    def _index(self, base: str, prefix: str, files: DataFrame, packages: DataFrame | None, now: int) -> None:
        """Fold files into the graph; file nodes keep the base that they are of."""
        self.graph = resolution.reindex(self.graph, files, packages, now)
        new = (F.col("node_type") == "File") & F.col("properties").isNull()
        mark = F.create_map(F.lit("base"), F.lit(base), F.lit("prefix"), F.lit(prefix))
        self.graph.nodes = self.graph.nodes.withColumn("properties", F.when(new, mark).otherwise(F.col("properties")))

    def bootstrap(self, base: str, now: int = 0, patterns: list[str] | None = None) -> tuple[int, int]:
        """Index the code below a folder (with ``patterns`` the files that match one), with its package manifests. Files that were below the same
        base and are not there any more go; those of other bases stay, and so do nodes of other sources, with their ids and their edges to
        what is still there. Returns files and entities."""
        base, bases = base.rstrip("/"), self._bases()
        prefix = self._prefix(base, bases)
        under = lambda df: df.withColumn("path", F.concat(F.lit(prefix), "path"))
        files = under(code.code_files(self.spark, base, patterns))
        packages = resolution.package_entries(under(code.package_manifests(self.spark, base)), files.select("path"))
        own = self.graph.nodes.where((F.col("node_type") == "File") & F.coalesce(F.col("properties")["base"] == base, F.lit(not bases)))
        left = own.select(F.col("source.file").alias("path")).distinct().join(files.select("path"), "path", "left_anti")
        self._index(base, prefix, files.unionByName(left.withColumn("text", F.lit(None).cast("string"))), packages, now)
        self.graph.nodes, self.graph.edges = paths.checkpointed(self.graph.nodes), paths.checkpointed(self.graph.edges)
        found = self.graph.nodes.where(ranking.is_code() & (F.col("node_type") != "File"))
        return files.count(), found.join(files.select(F.col("path").alias("p")), F.col("source.file") == F.col("p"), "left_semi").count()

    def bootstrap_all(self, base: str, config: store.Config, transcripts: str | None = None, now: int = 0) -> BootstrapReport:
        """All three channels: code that the configuration's patterns name is indexed; conversations (of the project's folder below
        ``transcripts``, if the configuration wants them) and the configured documents, paths below the base or URIs, give texts for extraction."""
        files, entities = self.bootstrap(base, now, config.code)
        local = base.removeprefix("file://")
        folder = conversations.find_project(transcripts, local) if transcripts and config.conversations else None
        texts = conversations.conversations(conversations.read_messages(self.spark, f"file://{folder}")) if folder else self.spark.createDataFrame([], "session_id string, text string")
        return BootstrapReport(files, entities, texts, conversations.documents(self.spark, [x if x.startswith("/") or "://" in x else f"{base.rstrip('/')}/{x}" for x in config.documents]))

    def reindex(self, base: str, path: str, now: int = 0) -> None:
        """Read one file below ``base`` again, or drop it if it is gone; nothing else is parsed, nothing else goes."""
        base, prefix = base.rstrip("/"), self._prefix(base.rstrip("/"), self._bases())
        files = code.code_files(self.spark, base).where(F.col("path") == path).withColumn("path", F.lit(prefix + path))
        gone = self.spark.createDataFrame([(prefix + path, None)], "path string, text string").join(files.select("path"), "path", "left_anti")
        self._index(base, prefix, files.unionByName(gone), None, now)

    def update_ontology(self, text: str) -> None:
        """Add suggested types, a node type's parent and a relation's from and to types with them; the first domain that is named stays."""
        raw = json.loads(text)
        texts = lambda x: [t for t in x if isinstance(t, str)] if isinstance(x, list) else []
        shapes = {
            "node_types": ("suggested_entity_types", "name string, description string, parent string, seq int", lambda t: (t.get("parent"),)),
            "edge_types": ("suggested_relation_types", "name string, description string, from_types array<string>, to_types array<string>, seq int", lambda t: (texts(t.get("from_types")), texts(t.get("to_types")))),
        }
        for part, (key, shape, more) in shapes.items():
            rows = [(t.get("name") or "", t.get("description") or "", *more(t), k) for k, t in enumerate(raw.get(key) or [])]
            new, own = self.spark.createDataFrame(rows, shape), getattr(self.graph, part)
            setattr(self.graph, part, mutation.merge_ontology(own if own is not None else new.limit(0), new))
        if isinstance(raw.get("domain"), str) and raw["domain"] and not self.domain():
            self.graph.domain = self.spark.createDataFrame([(raw["domain"],)], "name string")

    def domain(self) -> str:
        row = self.graph.domain.first() if self.graph.domain is not None else None
        return row["name"] if row else ""

    def get_ontology(self) -> tuple[DataFrame | None, DataFrame | None]:
        return self.graph.node_types, self.graph.edge_types

    def ingest_document(self, name: str, text: str, now: int = 0) -> resolve.IngestReport:
        own = self.graph.documents if self.graph.documents is not None else self.spark.createDataFrame([], "name string")
        self.graph.documents = mutation.add_document(own, name)
        return self.ingest(resolve.parse_extraction(text, name), now)

    def ingest_memory(self, text: str, now: int = 0) -> resolve.IngestReport:
        return self.ingest(resolve.parse_extraction(text), now)

    def ingest(self, batch: dict[str, Any], now: int = 0) -> resolve.IngestReport:
        self.graph, report = resolve.ingest(self.graph, batch, now)
        return report

    # navigation
    def _one(self, name: str) -> DataFrame:
        return navigation.lookup(self.graph.nodes, name).select(F.col("id").alias("node"))

    def lookup(self, name: str) -> DataFrame:
        return navigation.lookup(self.graph.nodes, name)

    def neighbors(self, name: str) -> DataFrame:
        return navigation.neighbors(self.graph, self._one(name))

    def neighbors_by_type(self, name: str, node_type: str) -> DataFrame:
        return navigation.neighbors_by_type(self.graph, self._one(name), node_type)

    def follow(self, name: str, relation: str) -> DataFrame:
        return navigation.follow(self.graph, self._one(name), relation)

    def path(self, a: str, b: str) -> list[int]:
        ends = [self._one(x).first() for x in (a, b)]
        return paths.shortest_path(self.graph, ends[0]["node"], ends[1]["node"]) if all(ends) else []

    def connect(self, a: str, b: str) -> str:
        """The path as text."""
        ids = self.path(a, b)
        if not ids:
            return f"No path found between {a} and {b}"
        names = {r["id"]: r["name"] for r in self.graph.nodes.where(F.col("id").isin(ids)).select("id", "name").collect()}
        out = names[ids[0]]
        for x, y in zip(ids, ids[1:]):
            edge = self.graph.edges.where(((F.col("src") == x) & (F.col("dst") == y)) | ((F.col("src") == y) & (F.col("dst") == x))).orderBy("seq").first()
            out += f" --[{edge['relation_type']}]--> {names[y]}"
        return out

    def explore(self, name: str) -> DataFrame:
        return navigation.explore(self.graph, name)

    def stats(self) -> DataFrame:
        return navigation.stats(self.graph)

    def topics(self) -> DataFrame:
        return navigation.topics(self.graph.nodes)

    def recent(self, k: int = 10) -> DataFrame:
        return navigation.recent(self.graph.nodes, k)

    def quality_metrics(self) -> DataFrame:
        return navigation.quality_metrics(self.graph)

    def impact(self, name: str, depth: int = 1) -> DataFrame:
        return impact.impact(self.graph, name, depth)

    def impact_report(self, name: str, depth: int = 1) -> str:
        return impact.impact_report(self.graph, name, depth)

    def impact_of_text(self, event: str, depth: int = 1) -> str:
        return impact.impact_of_text(self.graph, event, depth)

    def file_rule(self, path: str) -> str:
        return reports.file_rule(self.graph, path)

    def impact_from_change(self, event: str) -> str:
        return impact.impact_from_change(self.graph, event)

    def relevant(self, query: str, tokens: int = 500) -> DataFrame:
        return ranking.find_relevant(self.graph.nodes, query, tokens)

    def context(self, now: int, tokens: int = 2000) -> DataFrame:
        return ranking.context_report(self.graph.nodes, now, tokens)

    def file_context(self, path: str, tokens: int = 300) -> DataFrame:
        return ranking.file_context(self.graph.nodes, path, tokens)

    def module_map(self) -> DataFrame:
        return reports.module_map(self.graph)

    # changes
    def _add_edges(self, new: DataFrame) -> int:
        """New edges with ids behind those in use, numbered in parts: each part of a range by its own rank and the sizes of those before."""
        top = self.graph.edges.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
        rows = paths.checkpointed(new.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
        sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
        sizes = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size"))  # a row for each partition
        k = F.col("before") + F.col("at") - F.col("first") + 1
        rows = rows.join(F.broadcast(sizes.drop("size")), "part").withColumn("id", k + top[0]).withColumn("seq", k + top[1]).drop("part", "at", "first", "before")
        n = rows.count()
        self.graph.edges = self.graph.edges.unionByName(rows, allowMissingColumns=True)
        return n

    def connect_orphans(self) -> int:
        return self._add_edges(discover.connect_orphans(self.graph))

    def discover_connections(self) -> int:
        return self._add_edges(discover.discover_connections(self.graph))

    def garbage_collect(self, now: int, threshold: float = 0.05) -> int:
        gone = lifecycle.forgotten(self.graph.nodes, now, threshold).count()
        self.graph = lifecycle.garbage_collect(self.graph, now, threshold)
        return gone

    def reconcile(self, text: str, now: int, threshold: float = 0.05) -> dict:
        """Fold one session's facts in (``lifecycle.reconcile``), then forget."""
        self.graph, report = lifecycle.reconcile(self.graph, json.loads(text), now)
        report["gc_removed"] = self.garbage_collect(now, threshold)
        return report

    # text
    @staticmethod
    def chunk_text(text: str, target: int = 4000, overlap: int = 500) -> list[tuple[str, int, int, int]]:
        return chunks(text, target, overlap)

    def analyze_content(self, text: str) -> str:
        return prompts.analyze_content(text, self.graph)

    def prepare_extraction(self, text: str, document: str) -> str:
        return prompts.prepare_extraction(self.graph, text, document)

    def prepare_memory(self, text: str) -> str:
        return prompts.prepare_memory(self.graph, text)

    def export_json(self, path: str) -> None:
        store.export_json(self.graph, path)

    def accuracy(self, folder: str, repo_dirs: dict[str, str], case: str | None = None) -> str:
        """The report of an evaluation suite over local checkouts."""
        _, cases = store.load_suite(self.spark, folder)
        rows = [r for r in cases.collect() if case is None or r["name"] == case]  # a suite is a few files
        if not rows:
            raise ValueError("no such case")
        graphs = {r: resolution.bootstrap_code(code.code_files(self.spark, repo_dirs[r])) for r in {x["repo"] for x in rows}}
        predicted = None
        for r in rows:
            found = impact.reference_files(graphs[r["repo"]], r["entity"]).select(F.lit(r["name"]).alias("case"), "file")
            predicted = found if predicted is None else predicted.unionByName(found)
        expected = cases.select(F.col("name").alias("case"), F.explode("expected_files").alias("file")).where(F.col("case").isin([r["name"] for r in rows]))
        return evaluate.report(evaluate.accuracy(predicted, expected))
