"""Changes to a graph. Each takes and returns DataFrames; ids go on from the largest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVIDENCE, Graph


def merge_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One edge for each (src, dst, lower(relation)): the first one's columns, the largest confidence, how many were ``merged``, and
    where ``edges`` have evidence that of all, in order, once for each text.

    Self loops, and with ``nodes`` edges of which an end is missing, are no edges. Direction counts. Aggregates: a hot pair is
    combined before the shuffle, and so are its repeated texts.
    """
    real = edges.where("src <> dst")
    if nodes is not None:
        for end in ("src", "dst"):
            real = real.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    own = [c for c in edges.columns if c not in ("src", "dst", "confidence", "seq", "evidence")]
    real = real.withColumn("relation_key", F.lower("relation_type"))
    key = ["src", "dst", "relation_key"]
    columns = ["seq", "src", "dst", "confidence", "merged", *[f"x.{c}" for c in own]]
    if "evidence" not in edges.columns:
        first = F.min_by(F.struct(*own), F.col("seq")).alias("x")
        merged = real.groupBy(*key).agg(first, F.max("confidence").alias("confidence"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("merged"))
        return merged.select(*columns)
    # A row for each edge and text, an edge without a text has one: summed by text, then by edge, with nothing joined back.
    texts = real.select(*key, "seq", "confidence", F.struct(*own).alias("x"), F.posexplode_outer("evidence").alias("k", "said")).withColumn("edges", (F.coalesce("k", F.lit(0)) == 0).cast("long"))
    at = F.struct("seq", "k")
    by_text = texts.groupBy(*key, F.col("said").isNotNull().alias("there"), F.col("said.text_snippet").alias("text")).agg(
        F.min_by("said", at).alias("said"), F.min(at).alias("at"), F.max("confidence").alias("confidence"), F.sum("edges").alias("edges"), F.min_by("x", "seq").alias("x"), F.min("seq").alias("seq")
    )
    all_ = F.transform(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("at", "text", "said")))), lambda x: x["said"]).alias("evidence")
    merged = by_text.groupBy(*key).agg(F.min_by("x", "seq").alias("x"), F.max("confidence").alias("confidence"), F.min("seq").alias("seq"), F.sum("edges").alias("merged"), all_)
    return merged.select(*columns, "evidence")


def upsert_edges(edges: DataFrame, pairs: list[tuple]) -> tuple[DataFrame, list[bool]]:
    """``edges`` with a batch's (src, dst, relation, confidence, source row, evidence rows) in its order: one that is there, case of the relation ignored,
    takes the larger confidence and the texts that it has not; others go behind all. Also whether each made a new edge. Only edges at the batch's
    ends and relations are merged."""
    spark = edges.sparkSession
    top = edges.agg(F.max("id"), F.max("seq")).first()
    kind = edges.schema["source"].dataType
    shape = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("seq", T.LongType()), ("src", T.LongType()), ("dst", T.LongType()), ("relation_type", T.StringType()), ("confidence", T.DoubleType()), ("source", kind), ("evidence", EVIDENCE))])
    fresh = spark.createDataFrame([((top[0] or 0) + k, (top[1] or 0) + k, a, b, r, c, {n: s.get(n) for n in kind.names}, said) for k, (a, b, r, c, s, said) in enumerate(pairs, 1)], shape)
    fresh = fresh.withColumn("confidence", F.col("confidence").cast(edges.schema["confidence"].dataType))
    fresh = fresh if "evidence" in edges.columns else fresh.drop("evidence")
    keys = fresh.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.lower("relation_type").alias("k")).distinct()
    same = (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")) & (F.lower("relation_type") == F.col("k"))
    touched = edges.join(keys, same, "left_semi")
    there = {(r["src"], r["dst"], r["k"]) for r in touched.select("src", "dst", F.lower("relation_type").alias("k")).distinct().collect()}  # of the batch's pairs
    new = []
    for a, b, r, *_ in pairs:
        new.append((a, b, r.lower()) not in there)
        there.add((a, b, r.lower()))
    merged = merge_edges(touched.unionByName(fresh, allowMissingColumns=True)).select(edges.columns)
    return edges.join(keys, same, "left_anti").unionByName(merged), new


def remove_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """Without the nodes ``gone`` (column id) and the edges at them."""
    ids = gone.select("id")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return Graph(graph.nodes.join(ids, "id", "left_anti"), edges.select(graph.edges.columns), graph.documents, graph.node_types, graph.edge_types, graph.domain)


def allowed(labels: DataFrame, column: str, ontology: DataFrame | None, always: tuple[str, ...] = ()) -> DataFrame:
    """``labels`` with a column error (null: allowed). An empty ontology (column name) allows all; case is ignored."""
    if ontology is None or not ontology.limit(1).count():
        return labels.withColumn("error", F.lit(None).cast("string"))
    known = ontology.select(F.lower("name").alias("ontology_key"), F.lit(True).alias("known")).distinct()
    out = labels.join(known, F.lower(F.col(column)) == F.col("ontology_key"), "left")
    fine = F.col("known") | F.lower(F.col(column)).isin(*always) if always else F.col("known")
    return out.withColumn("error", F.when(~F.coalesce(fine, F.lit(False)), F.concat(F.lit(f"unknown {column}: "), F.col(column)))).drop("ontology_key", "known")


def merge_ontology(own: DataFrame, new: DataFrame) -> DataFrame:
    """Types (name, description, seq, and what else either has) of both, the first of each name; case is ignored and what is there stays."""
    both = own.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "o"]
    return both.groupBy(F.lower("name").alias("k")).agg(F.min_by(F.struct(*columns), F.struct("o", "seq")).alias("x")).select("x.*")


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (columns of nodes but id and seq, and ord) behind ``nodes``. Numbering is by rank of ord; the batch is small."""
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("i"), F.coalesce(F.max("seq"), F.lit(0)).alias("s"))
    ranked = new.withColumn("k", F.row_number().over(Window.orderBy("ord"))).join(F.broadcast(top))  # one row
    return nodes.unionByName(ranked.withColumn("id", F.col("i") + F.col("k")).withColumn("seq", F.col("s") + F.col("k")).drop("i", "s", "k", "ord"), allowMissingColumns=True)


def add_document(documents: DataFrame, name: str) -> DataFrame:
    return documents.unionByName(documents.sparkSession.createDataFrame([(name,)], "name string")).distinct()
