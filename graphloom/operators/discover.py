"""Edges that texts imply: a definition that contains another node's name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Graph

try:
    import ahocorasick
except ImportError:  # names are then joined by grams
    ahocorasick = None

GRAMS = (16, 8, 4)
#: An automaton has at most so many names, and bytes of them; a worker holds some 40 bytes for each.
MOST_NAMES, MOST_BYTES = 200_000, 4 << 20


def _grams(text: str) -> Column:
    """The distinct strings of ``k`` characters in a column."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("k") + 1), lambda j: F.substr(F.col(text), j, F.col("k"))))


@lru_cache(2)
def _automaton(token: str, names: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, name)
    found.make_automaton()
    return found


def contained(texts: DataFrame, names: DataFrame, most_names: int = MOST_NAMES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(text_id, name_id) where the lower-case name (four bytes or more) is in the lower-case text.

    Names within the two bounds go to the tasks as one automaton, which reads each text once: what is shuffled is what is found.
    More names than that are joined with the distinct texts by grams. Equal names are one until their texts are found. Null texts and names
    hold nothing.
    """
    t = texts.select(F.col("id").alias("text_id"), F.lower("text").alias("t")).where("t is not null")
    n = names.select(F.col("id").alias("name_id"), F.lower("name").alias("n")).where(F.octet_length("n") >= 4)
    own = n.select("n").distinct()
    few = tuple(r["n"] for r in own.limit(most_names + 1).collect()) if ahocorasick else None
    if few is None or len(few) > most_names or sum(len(x.encode()) for x in few) > most_bytes:
        # Names first: one that most texts hold then meets each distinct text once.
        return _by_grams(t, own).join(n, "n").select("t", "name_id").join(t, "t").select("text_id", "name_id")
    return _by_automaton(t, few).join(n, "n").select("text_id", "name_id")


def _by_automaton(t: DataFrame, names: tuple[str, ...]) -> DataFrame:
    schema = T.StructType([T.StructField("text_id", t.schema["text_id"].dataType), T.StructField("n", T.StringType())])
    if not names:
        return t.sparkSession.createDataFrame([], schema)
    sent, token = t.sparkSession.sparkContext.broadcast(names), uuid.uuid4().hex  # within the bounds

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(token, sent.value)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column("t").to_pylist()):
                hits = sorted({name for _, name in own.iter(text)})
                at += [k] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["text_id", "n"])

    return t.mapInArrow(find, schema)


def _by_grams(t: DataFrame, names: DataFrame) -> DataFrame:
    """A text that holds a name holds all its k-grams, so pairs come from an equi-join on a gram and are then verified. k is the
    largest of ``GRAMS`` that a name has; names of four bytes or more but fewer than four characters have their own length as k.
    Of its grams a name takes the one that the fewest names have, so names with a common beginning or end do not meet in one key.

    Equal texts are one here, only lengths that names have are cut, and what is dealt out by gram are two hashes; the text itself is
    joined with what its hash finds. ``t`` has a text once for each row of its own, ``names`` each name once."""
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = F.length("n")
    for size in reversed(GRAMS):
        k = F.when(F.length("n") >= size, size).otherwise(k)
    own = names.withColumn("k", k).select("n", "k", F.explode(_grams("n")).alias("gram"))
    among = own.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    own = own.join(among, "gram").groupBy("n").agg(F.min_by(F.struct("k", "gram"), F.struct("names", "gram")).alias("x")).select("n", "x.*")
    sizes = sorted(r["k"] for r in own.select("k").distinct().collect())  # six at most
    if not sizes:
        return t.select("t", F.lit("").alias("n")).limit(0)
    texts = t.select("t").distinct().withColumn("h", F.xxhash64("t"))
    # A text makes many rows, so tasks are by number here, not by the bytes of what they read.
    grams = texts.repartition(parts, "h").select("h", "t", F.explode(F.array(*map(F.lit, sizes))).alias("k")).where(F.length("t") >= F.col("k"))
    grams = grams.select("h", F.explode(F.transform(_grams("t"), lambda g: F.xxhash64(g))).alias("g"))
    met = grams.join(own.select("n", F.xxhash64("gram").alias("g")), "g").select("h", "n")
    return met.join(texts, "h").where(F.col("t").contains(F.col("n"))).select("t", "n").distinct()


def _pairs(graph: Graph, texts: DataFrame, names: DataFrame) -> DataFrame:
    found = contained(texts, names).where("text_id <> name_id")
    return found.select(F.col("text_id").alias("src"), F.col("name_id").alias("dst"))


def _as_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(nodes.select(F.col("id").alias("src"), "source"), "src").select("src", "dst", F.lit("mentions").alias("relation_type"), F.lit(0.5).alias("confidence"), "source")


def discover_connections(graph: Graph) -> DataFrame:
    """New mentions edges: definitions of ten bytes or more that contain a name, if no edge joins the two in either direction."""
    texts = graph.nodes.select("id", F.col("definition").alias("text")).where(F.octet_length("text") >= 10)
    # Both directions have one key, and an anti-join needs no distinct edges: most differ, so making them so would only sort them twice.
    ends = [F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")]
    found = _pairs(graph, texts, graph.nodes).select("src", "dst", *ends).join(graph.edges.select(*ends), ["low", "high"], "left_anti")
    return _as_edges(found.select("src", "dst"), graph.nodes)


def connect_orphans(graph: Graph) -> DataFrame:
    """New mentions edges of nodes without any edge: to the nodes that their definition names; else from those that name them.
    Each edge once."""
    from .paths import checkpointed

    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    orphans = checkpointed(graph.nodes.join(ends, "id", "left_anti").select("id", "name", "definition"))  # read four times
    text = lambda df: df.select("id", F.col("definition").alias("text")).where("text is not null")
    out = _pairs(graph, text(orphans), graph.nodes)
    into = _pairs(graph, text(graph.nodes), orphans)
    into = into.join(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    return _as_edges(out.unionByName(into).distinct(), graph.nodes)
