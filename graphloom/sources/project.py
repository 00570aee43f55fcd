"""A property graph over the driver's star-schema tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph
from ..session import table

NOW = 1_700_000_000
TABLES = ("region", "nation", "supplier", "customer", "part", "lineitem")


def _node(base: int, key: str, name: str, kind: str, definition: str, source: str, file: str, tier: str) -> str:
    return f"""SELECT {base} + CAST({key} AS BIGINT) AS id, {base} + CAST({key} AS BIGINT) AS seq, {name} AS name, '{kind}' AS node_type, {definition} AS definition,
    CAST(0.5 AS DOUBLE) + CAST({key} % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, '{source}' AS source_kind, {file} AS source_file,
    {NOW} - CAST({key} % 400 AS BIGINT) * 86400 AS created_at, {tier} AS tier, CASE WHEN {key} % 97 = 0 THEN CAST(0 AS BIGINT) END AS superseded_by"""


_BY_BALANCE = "CASE WHEN {0} > 8000 THEN 'Critical' WHEN {0} > 4000 THEN 'Significant' ELSE 'Minor' END"
NODES_SQL = "\nUNION ALL ".join([
    _node(1_000_000, "r_regionkey", "r_name", "Region", "'Region ' || r_name", "Document", "CAST(NULL AS STRING)", "'Critical'") + " FROM {region}",
    _node(2_000_000, "n_nationkey", "n_name", "Nation", "n_name || ' lies in ' || r_name", "Document", "CAST(NULL AS STRING)", "'Critical'") + " FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    _node(10_000_000, "s_suppkey", "s_name", "Supplier", "s_name || ' is based in ' || n_name", "CodeAnalysis", "'src/' || n_name || '.py'", _BY_BALANCE.format("s_acctbal")) + " FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    _node(100_000_000, "c_custkey", "c_name", "Customer", "c_mktsegment || ' buyer from ' || n_name", "Conversation", "CAST(NULL AS STRING)", _BY_BALANCE.format("c_acctbal")) + " FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
    _node(200_000_000, "p_partkey", "p_name", "Part", "p_brand || ' ' || p_type", "CodeAnalysis", "'lib/' || p_brand || '.py'", "'Minor'") + " FROM {part}",
])


def _edge(base: int, key: str, src: str, dst: str, relation: str, confidence: str, source: str, file: str) -> str:
    return f"SELECT {base} + {key} AS id, {base} + {key} AS seq, {src} AS src, {dst} AS dst, {relation} AS relation_type, {confidence} AS confidence, '{source}' AS source_kind, {file} AS source_file"


EDGES_SQL = "\nUNION ALL ".join([
    _edge(2_000_000, "CAST(n_nationkey AS BIGINT)", "2000000 + CAST(n_nationkey AS BIGINT)", "1000000 + CAST(n_regionkey AS BIGINT)", "'in_region'", "CAST(1 AS DOUBLE)", "Document", "CAST(NULL AS STRING)") + " FROM {nation}",
    _edge(10_000_000, "CAST(s_suppkey AS BIGINT)", "10000000 + CAST(s_suppkey AS BIGINT)", "2000000 + CAST(s_nationkey AS BIGINT)", "'based_in'", "CAST(1 AS DOUBLE)", "Document", "CAST(NULL AS STRING)") + " FROM {supplier}",
    _edge(100_000_000, "CAST(c_custkey AS BIGINT)", "100000000 + CAST(c_custkey AS BIGINT)", "2000000 + CAST(c_nationkey AS BIGINT)", "'based_in'", "CAST(1 AS DOUBLE)", "Document", "CAST(NULL AS STRING)") + " FROM {customer}",
    _edge(1_000_000_000, "CAST(l_orderkey AS BIGINT) * 10 + CAST(l_linenumber AS BIGINT)", "10000000 + CAST(l_suppkey AS BIGINT)", "200000000 + CAST(l_partkey AS BIGINT)",
          "CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'reads' ELSE 'writes' END", "CAST(0.5 AS DOUBLE) + CAST(CAST(l_quantity AS BIGINT) % 50 AS DOUBLE) / CAST(100 AS DOUBLE)", "CodeAnalysis", "'src/' || n_name || '.py'")
    + " FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey",
])

#: For DuckDB: the common tables n and e.
GRAPH_CTE = f"WITH RECURSIVE n AS ({NODES_SQL}), e AS ({EDGES_SQL})".format(**{t: t for t in TABLES}).replace("AS STRING", "AS VARCHAR")


def flat_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODES_SQL, **{t: table(spark, sf_dir, t) for t in TABLES if t != "lineitem"})


def flat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDGES_SQL, **{t: table(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "lineitem")})


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The projected graph. Nodes and edges carry source as (kind, file), the parts that operators read."""
    source = F.struct(F.col("source_kind").alias("kind"), F.col("source_file").alias("file")).alias("source")
    nodes = flat_nodes(spark, sf_dir).select("id", "seq", "name", "node_type", "definition", F.array().cast("array<string>").alias("aliases"), "confidence", source, "created_at", "tier", "superseded_by")
    edges = flat_edges(spark, sf_dir).select("id", "seq", "src", "dst", "relation_type", "confidence", source)
    return Graph(nodes, edges)
