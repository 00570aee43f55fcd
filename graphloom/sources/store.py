"""Graphs on disk: versioned Parquet folders and changes to them behind numbered heads, JSON export, name index and rules as text, configuration."""

from __future__ import annotations

import functools
import json
import re
import tomllib
import uuid
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..schema import EDGES, NODES, Graph
from . import adjacency

FORMAT_VERSION = 1
HEAD = "HEAD-"
PARTS = ("nodes", "edges", "documents", "node_types", "edge_types", "domain")
MOST_CHANGES, CHANGE_FILES = 16, 8


class StoreError(Exception):
    """A folder that holds no graph, or one of another format version."""


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _heads(spark: SparkSession, path: str) -> list[str]:
    """Names of the heads, newest first."""
    fs, target = _fs(spark, f"{path}/{HEAD}*")
    return sorted((x.getPath().getName() for x in fs.globStatus(target) or []), reverse=True)


def _head(spark: SparkSession, path: str) -> dict:
    """What the newest head says: the version, and the changes on top of it, oldest first."""
    heads = _heads(spark, path)
    if not heads:
        raise StoreError(f"no graph in {path}")
    try:
        head = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{heads[0]}").collect()))
        form, version = head["format"], head["version"]
    except (ValueError, KeyError, TypeError) as bad:
        raise StoreError(f"{path}/{heads[0]} cannot be read") from bad
    if form != FORMAT_VERSION:
        raise StoreError(f"format {form} is not {FORMAT_VERSION}")
    return {"version": version, "changes": head.get("changes", [])}


def _set_head(spark: SparkSession, path: str, version: str, changes: list[str]) -> None:
    """A head of the next number, by one rename."""
    heads, name = _heads(spark, path), (changes or [version])[-1]
    number = int(heads[0][len(HEAD) :].split("-")[0]) + 1 if heads else 1
    fs, draft = _fs(spark, f"{path}/.draft-{name}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"format": FORMAT_VERSION, "version": version, "changes": changes}).encode()))
    out.close()
    if not fs.rename(draft, _fs(spark, f"{path}/{HEAD}{number:012d}-{name}")[1]):
        raise StoreError(f"the head of version {version} cannot be written to {path}")


def save(graph: Graph, path: str) -> str:
    """Write a new version with its adjacency (if nodes and edges have its columns), then its head. No head is replaced or removed, so readers and a writer
    that stops anywhere leave the newest whole version. Returns the version."""
    spark, version = graph.nodes.sparkSession, uuid.uuid4().hex
    for name in PARTS:
        part = getattr(graph, name)
        if part is not None:
            part.write.parquet(f"{path}/{version}/{name}")
    if adjacency.fits(graph):
        adjacency.write(_read(spark, f"{path}/{version}"), f"{path}/{version}/adjacency")
    _set_head(spark, path, version, [])
    return version


def _changed(old: DataFrame, new: DataFrame, own: str, theirs: str) -> DataFrame:
    """Rows of ``new`` that ``old`` has not or has otherwise, by id; and ids that are gone, as rows of nulls."""
    digest = lambda df: F.md5(F.to_json(F.struct(*[df[c] for c in sorted(df.columns)])))
    before = old.select(F.col("id").alias("old_id"), digest(old).alias(theirs))
    both = new.withColumn(own, digest(new)).join(before, F.col("id") == F.col("old_id"), "full")
    both = both.where(~F.col(own).eqNullSafe(F.col(theirs))).withColumn("gone", F.col("id").isNull())
    return both.withColumn("id", F.coalesce("id", "old_id")).select(*new.columns, "gone")


def append(graph: Graph, path: str) -> str:
    """Write what differs from the newest head, and a head that names it: nodes and edges by id, and the small tables whole. What is
    written grows with the change. After ``MOST_CHANGES`` of them all becomes one version. A folder without a graph gets a first one."""
    spark = graph.nodes.sparkSession
    if not _heads(spark, path):
        return save(graph, path)
    head, old = _head(spark, path), load(spark, path)
    if len(head["changes"]) >= MOST_CHANGES:
        return save(graph, path)
    name = uuid.uuid4().hex
    for part in ("nodes", "edges"):
        rows = _changed(getattr(old, part), getattr(graph, part), "own_digest", "old_digest")
        rows.coalesce(CHANGE_FILES).write.parquet(f"{path}/{name}/{part}")
    for part in PARTS[2:]:
        if getattr(graph, part) is not None:
            getattr(graph, part).write.parquet(f"{path}/{name}/{part}")
    _set_head(spark, path, head["version"], [*head["changes"], name])
    return name


def _read(spark: SparkSession, folder: str) -> Graph:
    read = {}
    for name in PARTS:
        fs, target = _fs(spark, f"{folder}/{name}")
        read[name] = spark.read.parquet(f"{folder}/{name}") if fs.exists(target) else None
    return Graph(**read)


def load(spark: SparkSession, path: str) -> Graph:
    """The version of the newest head with its changes: of each id the last one. A version without changes has its adjacency."""
    head = _head(spark, path)
    found = _read(spark, f"{path}/{head['version']}")
    if found.nodes is None or found.edges is None:
        raise StoreError(f"version {head['version']} in {path} is incomplete")
    if not head["changes"]:
        found.adjacency = adjacency.read(spark, f"{path}/{head['version']}/adjacency")
        return found
    later = [_read(spark, f"{path}/{name}") for name in head["changes"]]
    if any(x.nodes is None or x.edges is None for x in later):
        raise StoreError(f"a change of version {head['version']} in {path} is missing")
    for part in ("nodes", "edges"):
        base = getattr(found, part)
        logged = functools.reduce(DataFrame.unionByName, (getattr(x, part).withColumn("change", F.lit(k)) for k, x in enumerate(later)))
        last = logged.groupBy("id").agg(F.max_by(F.struct(*[c for c in logged.columns if c != "id"]), "change").alias("x")).select("id", "x.*")
        kept = base.join(logged.select("id").distinct(), "id", "left_anti")
        setattr(found, part, kept.select(base.columns).unionByName(last.where("not gone").select(base.columns)))
    for part in PARTS[2:]:
        setattr(found, part, next((getattr(x, part) for x in reversed(later) if getattr(x, part) is not None), getattr(found, part)))
    return found


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def load_or_create(spark: SparkSession, path: str) -> Graph:
    return load(spark, path) if _heads(spark, path) else empty(spark)


def export_json(graph: Graph, path: str) -> None:
    """Nodes and edges as JSON lines in two folders."""
    for name in ("nodes", "edges"):
        getattr(graph, name).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def write_index(index: DataFrame, path: str) -> None:
    """Sorted lines name|type|references|files."""
    index.select(F.concat_ws("|", "name", "node_type", F.col("refs").cast("string"), "files").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def rule_name(path: str) -> str:
    return re.sub(r"[/\\.]", "-", path)


def write_rules(graph: Graph, path: str) -> None:
    """The module map, the decisions, and the rules of each file, a folder for each kind; files are a partition column."""
    reports.module_map(graph).orderBy(F.desc("refs_in"), "file").coalesce(1).write.mode("overwrite").json(f"{path}/module-map")
    reports.decisions(graph.nodes).orderBy("seq").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/decisions")
    rules = reports.file_rules(graph).withColumn("rule", F.regexp_replace("file", r"[/\\.]", "-"))
    rules.repartition("rule").sortWithinPartitions("rule", "k").write.mode("overwrite").partitionBy("rule").json(f"{path}/files")


# The defaults of the configuration, and the extensions of code.
@dataclass
class Config:
    code: list[str] = field(default_factory=lambda: [f"**/*.{e}" for e in ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "cs")])
    documents: list[str] = field(default_factory=list)
    conversations: bool = True
    threshold_pct: int = 85
    budget: int = 2000
    depth: int = 2
    snapshot_every: int = 20


def load_config(path: str) -> Config:
    """Configuration of a TOML file; a missing one is the defaults, an invalid one too, with a warning."""
    file = Path(path)
    if not file.exists():
        return Config()
    try:
        raw = tomllib.loads(file.read_text())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as bad:
        warnings.warn(f"{path}: {bad}; the defaults hold", stacklevel=2)
        return Config()
    own, base = raw.get("sources", {}), Config()
    extraction, impact = raw.get("extraction", {}), raw.get("impact", {})
    return Config(own.get("code", base.code), own.get("documents", []), own.get("conversations", True), extraction.get("threshold_pct", base.threshold_pct), raw.get("bootstrap", {}).get("budget", base.budget), impact.get("depth", base.depth), extraction.get("snapshot_every", base.snapshot_every))


def load_suite(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(repositories, cases) of an evaluation suite: repos.toml, and a TOML file for each case."""
    top = Path(folder)
    repos = tomllib.loads((top / "repos.toml").read_text()) if (top / "repos.toml").exists() else {}
    rows = sorted((r.get("name", k), r.get("url", ""), r.get("commit", "")) for k, r in (repos.items() if not isinstance(repos.get("repositories"), list) else ((r["name"], r) for r in repos["repositories"])))
    clean = lambda p: re.sub(r"^(\./)+", "", p.strip().replace("\\", "/"))
    cases = []
    for file in sorted((top / "cases").glob("*.toml")):
        case = tomllib.loads(file.read_text())
        cases.append((case.get("name", file.stem), case.get("repo", ""), case.get("entity", ""), sorted({clean(p) for p in case.get("expected_files", [])})))
    return spark.createDataFrame(rows, "name string, url string, commit string"), spark.createDataFrame(sorted(cases), "name string, repo string, entity string, expected_files array<string>")
