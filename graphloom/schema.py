"""Column layout of a property graph."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("file", T.StringType())])
EVIDENCE = T.ArrayType(T.StructType([T.StructField("document", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text_snippet", T.StringType()), T.StructField("offset_start", T.LongType()), T.StructField("offset_end", T.LongType())]))
PROPERTIES = T.MapType(T.StringType(), T.StringType())

NODES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("name", T.StringType()), T.StructField("node_type", T.StringType()),
    T.StructField("definition", T.StringType()), T.StructField("properties", PROPERTIES), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("confidence", T.FloatType()),
    T.StructField("source", SOURCE), T.StructField("created_at", T.LongType()), T.StructField("evidence", EVIDENCE), T.StructField("tier", T.StringType()),
    T.StructField("superseded_by", T.LongType()), T.StructField("last_referenced", T.LongType()),
])
EDGES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("relation_type", T.StringType()),
    T.StructField("properties", PROPERTIES), T.StructField("confidence", T.FloatType()), T.StructField("source", SOURCE), T.StructField("evidence", EVIDENCE),
])
ENTITIES = "name string, entity_type string, definition string, file string, line_start long, line_end long"
REFERENCES = "source_file string, source_line long, target_name string, ref_type string"

# Tiers and their weights, and the labels of code and of decisions.
TIER_WEIGHT = {"Critical": 1.0, "Significant": 0.6, "Minor": 0.3}
REFERENCE_RELATION = {"Calls": "calls", "MethodCall": "calls", "ReadsField": "reads", "WritesField": "writes", "UsesType": "uses_type"}
FACT_TYPES = ["Decision", "TechnicalFact", "ErrorResolution"]


@dataclass
class Graph:
    """Nodes and edges as DataFrames with the columns above; names need not be unique, ``seq`` is the order of insertion.

    ``adjacency`` is the stored adjacency of these nodes and edges, if there is one; it goes when either is replaced."""

    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame | None = None
    node_types: DataFrame | None = None
    edge_types: DataFrame | None = None
    domain: DataFrame | None = None
    adjacency: Any = None

    def __setattr__(self, name: str, value: Any) -> None:
        super().__setattr__(name, value)
        if name in ("nodes", "edges"):
            super().__setattr__("adjacency", None)
