"""Structured reports over a graph, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Graph
from .navigation import inbound_counts
from .ranking import is_code


def source_files(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_code()).select(F.col("source.file").alias("file")).distinct()


def module_map(graph: Graph) -> DataFrame:
    """(file, entities, refs_in, remark) of each code file: entities but files and imports, references into any node but files."""
    code = graph.nodes.where(is_code()).select("id", "node_type", F.col("source.file").alias("file"))
    entities = F.count_if(~F.col("node_type").isin("File", "Import")).alias("entities")
    refs = F.sum(F.when(F.col("node_type") != "File", F.coalesce("inbound", F.lit(0))).otherwise(0)).alias("refs_in")
    out = code.join(inbound_counts(graph.edges), "id", "left").groupBy("file").agg(entities, refs)
    return out.withColumn("remark", F.when(F.col("refs_in") > 100, "caution").when(F.col("refs_in") == 0, "leaf").otherwise(""))


def decisions(nodes: DataFrame, kinds: tuple[str, ...] = ("Decision", "TechnicalFact")) -> DataFrame:
    """Active decisions and facts above Minor, Critical first."""
    mark = F.when(F.col("tier") == "Critical", "!").otherwise("-")
    return nodes.where(F.col("node_type").isin(*kinds) & F.col("superseded_by").isNull() & F.col("tier").isin("Critical", "Significant")).select(F.concat(mark, F.lit(" "), F.col("name")).alias("line"), "tier", "seq")


def file_rules(graph: Graph, top: int = 10, least: int = 3) -> DataFrame:
    """For each file with more than ``least`` entities its ``top`` entities by references: reads, writes and other uses."""
    code = graph.nodes.where(is_code() & ~F.col("node_type").isin("File", "Import")).select("id", "seq", "name", F.col("source.file").alias("file"))
    large = code.groupBy("file").agg(F.count(F.lit(1)).alias("entities")).where(F.col("entities") > least)
    kind = lambda k: F.count_if(F.col("relation_type") == k)
    uses = graph.edges.groupBy(F.col("dst").alias("id")).agg(kind("reads").alias("reads"), kind("writes").alias("writes"), F.count(F.lit(1)).alias("refs"))
    ranked = code.join(large, "file").join(uses, "id").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("refs"), "seq"))).where(F.col("k") <= top)
    return ranked.select("file", "entities", "k", "name", "refs", "reads", "writes")


def file_rule(graph: Graph, path: str, top: int = 10) -> str:
    """The rule of one file as text: its types with their references and how many files read and write each field, the functions and
    methods that are referenced most, and what to run before a change. A file's entities are few."""
    own = graph.nodes.where(is_code() & (F.col("source.file") == path) & ~F.col("node_type").isin("File", "Import")).select("id", "seq", "name", "node_type")
    kind = lambda k: F.count_if(F.col("relation_type") == k)
    uses = graph.edges.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(kind("reads").alias("reads"), kind("writes").alias("writes"), F.count(F.lit(1)).alias("refs"))
    rows = own.join(uses, "id", "left").na.fill(0, ["reads", "writes", "refs"]).orderBy(F.desc("refs"), "seq").collect()
    types = [r for r in rows if r["node_type"] in ("Struct", "Enum", "Trait")]
    functions = [r for r in rows if r["node_type"] in ("Function", "Method")]
    lines = ["---", "paths:", f'  - "{path}"', "---", ""]
    for t in types:
        lines.append(f"{t['name']}: {t['refs']} references")
        for f in rows:
            if f["node_type"] == "Field" and f["name"].startswith(t["name"] + ".") and f["reads"] + f["writes"]:
                lines.append(f"  .{f['name'][len(t['name']) + 1 :]}: read in {f['reads']} files, written in {f['writes']}")
    lines += ["", *[f"{f['name']} ({f['node_type']}): {f['refs']} references" for f in functions[:top] if f["refs"]]] if functions else []
    lines += ["", "Before a change of a type: impact NAME shows all references"] if types else []
    lines += ["Before a function is renamed: impact NAME"] if functions else []
    return "\n".join(lines) + "\n"
