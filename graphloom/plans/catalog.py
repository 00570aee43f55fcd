"""Queries over the driver's tables and their SQL. Names follow the operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as tx
from ..functions import transcript as tr
from ..operators import discover, evaluate, impact, lifecycle, mutation, navigation, paths, ranking, reports, resolve
from ..schema import Graph
from ..session import table
from ..sources import store
from ..sources.project import GRAPH_CTE, NOW, flat_edges, flat_nodes, graph
from ..streaming import monitor
from . import resolution

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, over_graph: bool = True):
    """Register a function (spark, sf_dir, graph or None) with its SQL; over_graph: the SQL goes on from the tables n and e."""

    def put(f):
        QUERIES[name] = lambda spark, d: f(spark, d, graph(spark, d) if over_graph else None)
        if sql:
            ORACLES[name] = GRAPH_CTE + sql if over_graph else sql
        return f

    return put


def r9(c) -> F.Column:
    return F.round(c, 9)


def one(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node long")


_SYM = ", s AS (SELECT src AS node, dst AS other, 'outgoing' AS direction, relation_type, confidence, seq FROM e UNION ALL SELECT dst, src, 'incoming', relation_type, confidence, seq FROM e)"


@query("node_scan", " SELECT id, name, node_type, definition, round(confidence, 9) AS confidence, created_at, tier, coalesce(superseded_by, -1) AS superseded_by FROM n")
def node_scan(spark, d, g):
    return flat_nodes(spark, d).select("id", "name", "node_type", "definition", r9("confidence").alias("confidence"), "created_at", "tier", F.coalesce("superseded_by", F.lit(-1).cast("long")).alias("superseded_by"))


@query("edge_scan", " SELECT id, src, dst, relation_type, round(confidence, 9) AS confidence, source_file FROM e")
def edge_scan(spark, d, g):
    return flat_edges(spark, d).select("id", "src", "dst", "relation_type", r9("confidence").alias("confidence"), "source_file")


@query("graph_stats", " SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM n WHERE source_kind = 'Memory') AS memory_nodes, (SELECT count(DISTINCT node_type) FROM n) AS node_types, (SELECT count(*) FROM e) AS edge_count, (SELECT count(DISTINCT relation_type) FROM e) AS edge_types")
def graph_stats(spark, d, g):
    return navigation.stats(g)


@query("type_histogram", " SELECT node_type, count(*) AS n FROM n GROUP BY node_type")
def type_histogram(spark, d, g):
    return navigation.type_histogram(g.nodes)


@query("relation_histogram", " SELECT relation_type, count(*) AS n FROM e GROUP BY relation_type")
def relation_histogram(spark, d, g):
    return navigation.relation_histogram(g.edges)


@query("quality_metrics", """, o AS (SELECT count(*) AS c FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)), k AS (SELECT count(*) AS nn FROM n), m AS (SELECT count(*) AS mm, count(*) FILTER (WHERE lower(relation_type) = 'related_to') AS v FROM e)
SELECT c AS orphan_count, round(coalesce(CAST(c AS DOUBLE) / nullif(nn, 0), 0), 9) AS orphan_ratio, round(coalesce(CAST(v AS DOUBLE) / nullif(mm, 0), 0), 9) AS related_to_ratio, round(coalesce(CAST(2 * mm AS DOUBLE) / nullif(nn, 0), 0), 9) AS average_degree FROM o, k, m""")
def quality_metrics(spark, d, g):
    q = navigation.quality_metrics(g)
    return q.select("orphan_count", *[r9(c).alias(c) for c in q.columns[1:]])


@query("topics", ", k AS (SELECT node_type, name, row_number() OVER (PARTITION BY node_type ORDER BY seq) AS k FROM n) SELECT node_type, max(c) AS n, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 10) AS names FROM (SELECT *, count(*) OVER (PARTITION BY node_type) AS c FROM k) GROUP BY node_type")
def topics(spark, d, g):
    return navigation.topics(g.nodes)


@query("recent_topk", " SELECT id, name, created_at FROM n ORDER BY created_at DESC, seq LIMIT 10")
def recent_topk(spark, d, g):
    return navigation.recent(g.nodes).select("id", "name", "created_at")


for _name, _asked in (("exact", " nation_7 "), ("plural", "nation_7s"), ("substring", "supplier#0000")):
    _key = _asked.strip()
    _toggle = navigation.toggled(_key)

    @query(f"lookup_{_name}", f""", k AS (SELECT id, name, seq, CASE WHEN lower(trim(name)) = '{_key}' THEN 1 WHEN lower(trim(name)) = '{_toggle}' THEN 2
        WHEN strlen('{_key}') >= 6 AND (contains(lower(trim(name)), '{_key}') OR (strlen(lower(trim(name))) >= 6 AND contains('{_key}', lower(trim(name))))) THEN 3 END AS step FROM n)
        SELECT id, name, CAST(step AS INTEGER) AS step FROM k WHERE step IS NOT NULL ORDER BY step, seq LIMIT 1""")
    def lookup(spark, d, g, asked=_asked):
        return navigation.lookup(g.nodes, asked).select("id", "name", "step")


@query("lookup_many", """, q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT r_name || 's' FROM region UNION SELECT upper(s_name) FROM supplier),
c AS (SELECT query, id, seq, CASE WHEN lower(trim(name)) = lower(trim(query)) THEN 1 ELSE 2 END AS step FROM q JOIN n ON lower(trim(name)) IN (lower(trim(query)), CASE WHEN lower(trim(query)) LIKE '%s' THEN left(lower(trim(query)), length(lower(trim(query))) - 1) ELSE lower(trim(query)) || 's' END)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY step, seq) AS k FROM c) SELECT query, id, CAST(step AS INTEGER) AS step FROM r WHERE k = 1""")
def lookup_many(spark, d, g):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).union(table(spark, d, "region").select(F.concat("r_name", F.lit("s")))).union(table(spark, d, "supplier").select(F.upper("s_name")))
    return navigation.lookup_many(g.nodes, names)


@query("nodes_by_type", " SELECT id, name FROM n WHERE node_type = 'Supplier'")
def nodes_by_type(spark, d, g):
    return navigation.nodes_by_type(g.nodes, "Supplier").select("id", "name")


@query("neighbors", _SYM + " SELECT node, other, other_name, s.relation_type, direction, round(s.confidence, 9) AS confidence FROM s JOIN (SELECT id, name AS other_name FROM n) m ON m.id = s.other WHERE node IN (1000001, 2000003)")
def neighbors(spark, d, g):
    return navigation.neighbors(g, one(spark, 1_000_001, 2_000_003)).select("node", "other", "other_name", "relation_type", "direction", r9("edge_confidence").alias("confidence"))


@query("neighbors_by_type", _SYM + " SELECT node, other, n.name AS other_name FROM s JOIN n ON n.id = s.other WHERE node = 2000003 AND lower(node_type) = 'customer'")
def neighbors_by_type(spark, d, g):
    return navigation.neighbors_by_type(g, one(spark, 2_000_003), "customer").select("node", "other", "other_name")


@query("follow", " SELECT src AS node, dst AS other, name AS other_name FROM e JOIN n ON n.id = e.dst WHERE src = 10000005 AND lower(relation_type) = 'calls'")
def follow(spark, d, g):
    return navigation.follow(g, one(spark, 10_000_005), "CALLS").select("node", "other", "other_name")


@query("explore", _SYM + ", k AS (SELECT * FROM n WHERE lower(name) = 'nation_7' ORDER BY seq LIMIT 1) SELECT k.name, k.node_type, k.definition, count(*) OVER () AS relations, s.direction, s.relation_type, m.name AS other_name, round(s.confidence, 9) AS confidence FROM k JOIN s ON s.node = k.id JOIN n m ON m.id = s.other")
def explore(spark, d, g):
    return navigation.explore(g, "Nation_7").select("name", "node_type", "definition", "relations", "direction", "relation_type", "other_name", r9("edge_confidence").alias("confidence"))


@query("inbound_counts", " SELECT dst AS id, count(*) AS inbound FROM e GROUP BY dst")
def inbound_counts(spark, d, g):
    return navigation.inbound_counts(g.edges)


_PART = "(SELECT min(p_name) FROM part)"
_REF = "CASE relation_type WHEN 'reads' THEN 'ReadsField' WHEN 'writes' THEN 'WritesField' WHEN 'uses_type' THEN 'UsesType' ELSE 'Calls' END"


def part_name(spark, d) -> str:
    """The first part name: a parameter of the queries, one value."""
    return table(spark, d, "part").agg(F.min("p_name")).first()[0]


@query("references_to", f", t AS (SELECT id, name FROM n WHERE lower(trim(name)) = lower(trim({_PART}))) SELECT source_file, CAST(0 AS BIGINT) AS source_line, name AS target, {_REF} AS ref_type FROM e JOIN t ON t.id = e.dst WHERE source_kind = 'CodeAnalysis'")
def references_to(spark, d, g):
    return navigation.references_to(g, part_name(spark, d))


@query("reference_files", f", t AS (SELECT id FROM n WHERE lower(trim(name)) = lower(trim({_PART}))) SELECT DISTINCT source_file AS file FROM e JOIN t ON t.id = e.dst WHERE source_kind = 'CodeAnalysis'")
def reference_files(spark, d, g):
    return impact.reference_files(g, part_name(spark, d))


def _levels(k: int) -> str:
    out = [", a0 AS (SELECT CAST(1000000 AS BIGINT) AS node, 0 AS depth)"]
    for i in range(1, k + 1):
        out.append(f", a{i} AS (SELECT * FROM a{i - 1} UNION ALL SELECT DISTINCT other, {i} FROM (SELECT DISTINCT node, other FROM s) s JOIN (SELECT node AS f FROM a{i - 1} WHERE depth = {i - 1}) ON f = s.node WHERE other NOT IN (SELECT node FROM a{i - 1}))")
    return "".join(out)


@query("bfs_levels", _SYM + _levels(8) + " SELECT node, CAST(depth AS INTEGER) AS depth FROM a8")
def bfs_levels(spark, d, g):
    return paths.levels(g.edges, one(spark, 1_000_000)).select("node", "depth")


@query("shortest_path_len", _SYM + _levels(8) + " SELECT CAST(depth AS BIGINT) AS length FROM a8 WHERE node = 200000001")
def shortest_path_len(spark, d, g):
    found = paths.shortest_path(g, 1_000_000, 200_000_001)
    return spark.createDataFrame([(len(found) - 1,)] if found else [], "length long")


def _pagerank(rounds: int) -> str:
    out = [", p AS (SELECT src, dst, count(*) AS c FROM e GROUP BY src, dst), o AS (SELECT src AS os, sum(c) AS deg FROM p GROUP BY src), sh AS (SELECT src, dst, CAST(c AS DOUBLE) / deg AS share FROM p JOIN o ON os = src), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), k0 AS MATERIALIZED (SELECT node, CAST(1 AS DOUBLE) / (SELECT count(*) FROM v) AS rank FROM v)"]
    for i in range(1, rounds + 1):
        out.append(f", k{i} AS MATERIALIZED (SELECT v.node, CAST(0.15 AS DOUBLE) / (SELECT count(*) FROM v) + CAST(0.85 AS DOUBLE) * coalesce(f, 0) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank * share) AS f FROM sh JOIN k{i - 1} ON k{i - 1}.node = src GROUP BY dst) ON dst = v.node)")
    return "".join(out)


@query("pagerank20", _pagerank(20) + " SELECT node, round(rank, 9) AS rank FROM k20")
def pagerank20(spark, d, g):
    return paths.pagerank(g.edges).select("node", r9("rank").alias("rank"))


_SAID = "CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR) || '@' || relation_type"


@query("edge_merge", f""", r AS (SELECT *, {_SAID} AS said FROM e WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
t AS (SELECT src, dst, lower(relation_type) AS k, string_agg(said, ',' ORDER BY q, said) AS evidence FROM (SELECT src, dst, relation_type, said, min(seq) AS q FROM r GROUP BY ALL) GROUP BY ALL)
SELECT min_by(id, seq) AS id, r.src, r.dst, min_by(relation_type, seq) AS relation_type, round(max(confidence), 9) AS confidence, count(*) AS merged, any_value(evidence) AS evidence FROM r JOIN t ON t.src = r.src AND t.dst = r.dst AND t.k = lower(relation_type) GROUP BY r.src, r.dst, lower(relation_type)""")
def edge_merge(spark, d, g):
    said = F.concat(F.round(F.col("confidence") * 100).cast("long").cast("string"), F.lit("@"), "relation_type")
    none = F.lit(None)
    edges = g.edges.withColumn("evidence", F.array(F.struct(none.cast("string").alias("document"), none.cast("int").alias("page"), said.alias("text_snippet"), none.cast("long").alias("offset_start"), none.cast("long").alias("offset_end"))))
    texts = F.array_join(F.transform("evidence", lambda x: x["text_snippet"]), ",").alias("evidence")
    return mutation.merge_edges(edges, g.nodes).select("id", "src", "dst", "relation_type", r9("confidence").alias("confidence"), "merged", texts)


@query("node_remove", ", x AS (SELECT id FROM n WHERE tier = 'Critical' AND node_type = 'Supplier') SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM x)) AS nodes, (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM x) AND dst NOT IN (SELECT id FROM x)) AS edges")
def node_remove(spark, d, g):
    left = mutation.remove_nodes(g, g.nodes.where("tier = 'Critical' and node_type = 'Supplier'").select("id"))
    return left.nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(left.edges.agg(F.count(F.lit(1)).alias("edges"))))


@query("ontology_filter", " SELECT id, CASE WHEN lower(node_type) NOT IN ('region', 'nation', 'part') THEN 'unknown node_type: ' || node_type END AS error FROM n")
def ontology_filter(spark, d, g):
    known = spark.createDataFrame([("REGION",), ("nation",), ("Part",)], "name string")
    return mutation.allowed(g.nodes, "node_type", known).select("id", "error")


@query("ontology_merge", """ SELECT name, description FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY o, seq) AS k FROM (SELECT r_name AS name, 'own' AS description, r_regionkey AS seq, 0 AS o FROM region
    UNION ALL SELECT lower(r_name), 'new', r_regionkey, 1 FROM region UNION ALL SELECT n_name, 'new', n_nationkey + 100, 1 FROM nation)) WHERE k = 1""")
def ontology_merge(spark, d, g):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    own = region.select(F.col("r_name").alias("name"), F.lit("own").alias("description"), F.col("r_regionkey").alias("seq"))
    new = region.select(F.lower("r_name").alias("name"), F.lit("new").alias("description"), F.col("r_regionkey").alias("seq")).union(nation.select("n_name", F.lit("new"), F.col("n_nationkey") + 100))
    return mutation.merge_ontology(own, new).select("name", "description")


_IMPACT = _SYM + f", t AS (SELECT id FROM n WHERE lower(trim(name)) = 'nation_7'), d1 AS (SELECT DISTINCT other, n.name, s.relation_type, direction, coalesce(source_file, 'semantic') AS place FROM s JOIN n ON n.id = s.other WHERE s.node IN (SELECT id FROM t))"


@query("impact_direct", _IMPACT + " SELECT DISTINCT CAST(1 AS INTEGER) AS depth, name, relation_type, direction, place FROM d1")
def impact_direct(spark, d, g):
    return impact.impact(g, "NATION_7", 1)


@query("impact_two_hop", _IMPACT + """ SELECT DISTINCT CAST(1 AS INTEGER) AS depth, name, relation_type, direction, place FROM d1
    UNION SELECT DISTINCT CAST(2 AS INTEGER), n.name, s.relation_type, s.direction, coalesce(source_file, 'semantic') FROM s JOIN n ON n.id = s.other WHERE s.node IN (SELECT other FROM d1) AND s.other NOT IN (SELECT id FROM t)""")
def impact_two_hop(spark, d, g):
    return impact.impact(g, "NATION_7", 2)


_SAVED: dict[tuple, Graph] = {}


def saved(spark: SparkSession, d: str, g: Graph) -> Graph:
    """The graph as a session's first use of it has stored it in the shared folder, with its adjacency."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _SAVED:
        folder = f"{paths.shared_folder(spark)}/graph-{hashlib.md5(d.encode()).hexdigest()}"
        store.append(g, folder)
        _SAVED[key] = store.load(spark, folder)
    return _SAVED[key]


@query("impact_stored", ORACLES["impact_two_hop"].removeprefix(GRAPH_CTE))
def impact_stored(spark, d, g):
    return impact.impact(saved(spark, d, g), "NATION_7", 2)


@query("breaking_changes", " , p AS (SELECT lower(source_file || CASE WHEN contains(source_file, '1') THEN '/Serial' WHEN contains(source_file, '2') THEN '/python/x' ELSE '' END) AS f, source_file FROM e) SELECT source_file, w AS warning FROM (SELECT DISTINCT source_file, unnest([CASE WHEN contains(f, 'storage') OR contains(f, 'serial') THEN 'stored data may fail to deserialise' END, CASE WHEN contains(f, 'python') THEN 'Python callers may break' END]) AS w FROM p) WHERE w IS NOT NULL")
def breaking_changes(spark, d, g):
    file = F.col("source.file")
    mark = F.when(file.contains("1"), "/Serial").when(file.contains("2"), "/python/x").otherwise("")
    places = g.edges.select(file.alias("source_file"), F.concat(file, mark).alias("place")).where("place is not null").distinct()
    return impact.breaking_changes(places, "source_file")


@query("pattern_groups", f""", f AS (SELECT CASE {_REF} WHEN 'ReadsField' THEN 'reads' WHEN 'WritesField' THEN 'writes' ELSE 'calls' END || ' ' || name AS pattern, regexp_extract(e.source_file, '[^/]*$') AS base FROM e JOIN n ON n.id = e.dst WHERE e.source_kind = 'CodeAnalysis'),
b AS (SELECT DISTINCT pattern, base FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY base) AS k FROM b)
SELECT pattern, (SELECT count(*) FROM f WHERE f.pattern = k.pattern) AS n, count(*) AS total_files, string_agg(base, ', ' ORDER BY base) FILTER (WHERE k <= 5) AS example_files FROM k GROUP BY pattern""")
def pattern_groups(spark, d, g):
    kind = F.expr("case relation_type when 'reads' then 'ReadsField' when 'writes' then 'WritesField' else 'Calls' end").alias("ref_type")
    refs = g.edges.where("source.kind = 'CodeAnalysis'").join(g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst").select(F.col("source.file").alias("source_file"), "target", kind)
    return impact.pattern_groups(refs)


_INDEX = """, o AS (SELECT id, seq, node_type, regexp_extract(name, '[^.:]*$') AS short FROM n WHERE node_type IN ('Part', 'Supplier')), c AS (SELECT dst, count(*) AS inbound FROM e GROUP BY dst),
h AS (SELECT short, min_by(node_type, o.seq) AS node_type, max(inbound) AS refs FROM o JOIN c ON c.dst = o.id WHERE strlen(short) >= 3 GROUP BY short),
f AS (SELECT short, source_file, row_number() OVER (PARTITION BY short ORDER BY source_file) AS k FROM (SELECT DISTINCT short, source_file FROM o JOIN e ON e.dst = o.id WHERE e.source_kind = 'CodeAnalysis')),
i AS (SELECT h.short AS name, node_type, refs, coalesce((SELECT string_agg(source_file, ',' ORDER BY source_file) FROM f WHERE f.short = h.short AND k <= 10), '') AS files FROM h)"""


@query("name_index", _INDEX + " SELECT * FROM i")
def name_index(spark, d, g):
    return impact.name_index(g)


@query("quick_impact", _INDEX + f" SELECT * FROM i WHERE contains('def ' || {_PART} || '(): pass', name)")
def quick_impact(spark, d, g):
    return impact.quick_impact(impact.name_index(g), f"def {part_name(spark, d)}(): pass")


def _changed(file: str) -> str:
    return f""", k AS (SELECT *, regexp_extract(name, '[^.:]*$') AS short FROM n WHERE source_kind = 'CodeAnalysis'), c AS (SELECT *, CASE WHEN source_file = {file} AND strlen(short) >= 3 THEN 1 WHEN strlen(short) >= 6 THEN 2 END AS step FROM k WHERE contains('call ' || {_PART} || ' here', short))
SELECT id, name FROM c WHERE step = (SELECT min(step) FROM c)"""


@query("impact_from_text", _changed("'no/such/file.xyz'"))
def impact_from_text(spark, d, g):
    return impact.changed_entities(g, "no/such/file.xyz", f"call {part_name(spark, d)} here").select("id", "name")


@query("impact_from_file", _changed(f"(SELECT 'lib/' || min(p_brand) || '.py' FROM part WHERE p_name = {_PART})"))
def impact_from_file(spark, d, g):
    name = part_name(spark, d)
    file = table(spark, d, "part").where(F.col("p_name") == name).agg(F.min("p_brand")).first()[0]
    return impact.changed_entities(g, f"./lib/{file}.py", f"call {name} here").select("id", "name")


_REL = f"CASE WHEN superseded_by IS NOT NULL THEN CAST(0 AS DOUBLE) WHEN source_kind = 'CodeAnalysis' AND {{code}} THEN CASE tier WHEN 'Critical' THEN 1.0 WHEN 'Significant' THEN 0.6 ELSE 0.3 END WHEN tier = 'Critical' THEN 1.0 WHEN tier = 'Significant' THEN CAST(0.6 AS DOUBLE) * exp(CAST(-0.01 AS DOUBLE) * ({NOW} - created_at) / 86400.0) ELSE CAST(0.3 AS DOUBLE) * exp(CAST(-0.05 AS DOUBLE) * ({NOW} - created_at) / 86400.0) END"


@query("relevance_scores", f" SELECT id, round(CAST({_REL.format(code='true')} AS DOUBLE), 9) AS score FROM n")
def relevance_scores(spark, d, g):
    return g.nodes.select("id", r9(ranking.relevance(F.col("tier"), F.col("created_at"), NOW, F.col("superseded_by"), ranking.is_code())).alias("score"))


@query("gc_survivors", f" SELECT id, name FROM n WHERE NOT (source_kind <> 'CodeAnalysis' AND CAST({_REL.format(code='false')} AS DOUBLE) < 0.05)")
def gc_survivors(spark, d, g):
    return lifecycle.garbage_collect(g, NOW).nodes.select("id", "name")


@query("context_prefix", f""", k AS (SELECT name, tier, seq, round(CAST({_REL.format(code='true')} AS DOUBLE), 12) AS score, '- ' || name || ': ' || coalesce(definition, '') || chr(10) AS l FROM n),
h AS (SELECT *, CASE WHEN lag(tier) OVER (ORDER BY score DESC, seq) IS DISTINCT FROM tier THEN '## ' || tier || chr(10) ELSE '' END || l AS line FROM k WHERE score > 0.01)
SELECT name, tier, line FROM (SELECT *, 19 + sum(strlen(line)) OVER (ORDER BY score DESC, seq) AS used FROM h) WHERE used <= 8000""")
def context_prefix(spark, d, g):
    return ranking.context_report(g.nodes, NOW).select("name", "tier", "line")


@query("file_context", """, l AS (SELECT *, '- ' || name || ': ' || coalesce(definition, '') || chr(10) AS line FROM n),
a AS (SELECT CAST(1 AS INTEGER) AS phase, name, line, sum(strlen(line)) OVER (ORDER BY seq) AS used FROM l WHERE source_kind = 'CodeAnalysis' AND source_file = 'src/NATION_7.py'), b AS (SELECT * FROM a WHERE used <= 1200),
c AS (SELECT CAST(2 AS INTEGER) AS phase, name, line, coalesce((SELECT max(used) FROM b), 0) + sum(strlen(line)) OVER (ORDER BY seq) AS used FROM l WHERE source_kind IN ('Conversation', 'Document', 'Memory') AND (contains(coalesce(definition, ''), 'NATION_7.py') OR contains(name, 'NATION_7.py')))
SELECT phase, name, line FROM b UNION ALL SELECT phase, name, line FROM c WHERE used <= 1200""")
def file_context(spark, d, g):
    return ranking.file_context(g.nodes, "src/NATION_7.py").select("phase", "name", "line")


_SCORE = "(CASE WHEN contains(lower(name), 'nation_1') THEN 2 ELSE 0 END + CASE WHEN contains(lower(definition), 'nation_1') THEN 1 ELSE 0 END + CASE WHEN contains(lower(name), 'buyer') THEN 2 ELSE 0 END + CASE WHEN contains(lower(definition), 'buyer') THEN 1 ELSE 0 END)"


@query("keyword_scores", f" SELECT id, CAST({_SCORE} AS DOUBLE) AS score FROM n WHERE {_SCORE} > 0")
def keyword_scores(spark, d, g):
    return ranking.keyword_scores(g.nodes, "Nation_1 buyer in").select("id", "score")


@query("keyword_relevance", f", k AS (SELECT name, node_type, seq, CAST({_SCORE} AS DOUBLE) AS score, '- [' || node_type || '] ' || name || ': ' || definition || chr(10) AS line FROM n WHERE {_SCORE} > 0) SELECT name, node_type, score, line FROM (SELECT *, sum(strlen(line)) OVER (ORDER BY score DESC, seq) AS used FROM k) WHERE used <= 2000")
def keyword_relevance(spark, d, g):
    return ranking.find_relevant(g.nodes, "Nation_1 buyer in").select("name", "node_type", "score", "line")


@query("document_keywords", "SELECT doc_id, CAST(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'idiot') THEN 1 ELSE 0 END AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'idiot')", over_graph=False)
def document_keywords(spark, d, g):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("name"), F.col("text").alias("definition"), F.lit("Document").alias("node_type"))
    return ranking.keyword_scores(docs, "the idiot").select(F.col("id").alias("doc_id"), "score")


def _lcs(pairs: str) -> str:
    """Common tables that go on from ``pairs`` (a, b; lower case, not empty) to lcs (a, b, length): a row of the table for each character of a."""
    return f"""{pairs}, lcs_rows AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b)), lambda x: 0) AS v FROM (SELECT DISTINCT a, b FROM pairs)
    UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(v[k], CASE WHEN b[k] = a[i + 1] THEN coalesce(v[k - 1], 0) + 1 ELSE 0 END)))) FROM lcs_rows WHERE i < length(a)),
lcs AS (SELECT a, b, v[length(b)] AS length FROM lcs_rows WHERE i = length(a))"""


@query("lcs_similarity", "WITH RECURSIVE pairs AS (SELECT lower(n_name) AS a, lower(s_name) AS b FROM nation JOIN supplier ON n_nationkey = s_nationkey UNION SELECT lower(n_name), lower(c_name) FROM nation JOIN customer ON n_nationkey = c_nationkey)" + _lcs("") + " SELECT a, b, round(CAST(2 * length AS DOUBLE) / (length(a) + length(b)), 9) AS score FROM lcs", over_graph=False)
def lcs_similarity(spark, d, g):
    nation = table(spark, d, "nation")
    pairs = [nation.join(table(spark, d, t), F.col("n_nationkey") == F.col(f"{t[0]}_nationkey")).select(F.lower("n_name").alias("a"), F.lower(f"{t[0]}_name").alias("b")) for t in ("supplier", "customer")]
    return pairs[0].union(pairs[1]).distinct().select("a", "b", r9(resolve.similarity(F.col("a"), F.col("b"))).alias("score"))


@query("entity_resolution", """, q AS (SELECT r_name || 'x' AS query FROM region UNION SELECT upper(n_name) FROM nation), c AS (SELECT query, id, seq, name FROM q JOIN n ON lower(n.name) = lower(query)) SELECT query, min_by(id, seq) AS id, CAST(1 AS DOUBLE) AS score FROM c GROUP BY query
    UNION ALL SELECT query, id, score FROM (SELECT q.query, n.id, round(CAST(2 * (length(n.name)) AS DOUBLE) / (length(n.name) + length(q.query)), 9) AS score, row_number() OVER (PARTITION BY q.query ORDER BY length(n.name) DESC, seq) AS k FROM q JOIN n ON starts_with(lower(q.query), lower(n.name)) AND length(q.query) = length(n.name) + 1 AND node_type = 'Region' WHERE lower(q.query) NOT IN (SELECT lower(name) FROM n)) WHERE k = 1 AND score >= 0.85""")
def entity_resolution(spark, d, g):
    names = table(spark, d, "region").select(F.concat("r_name", F.lit("x")).alias("q")).union(table(spark, d, "nation").select(F.upper("n_name")))
    found = resolve.resolve(names, g.nodes)
    return found.select("query", "id", r9("score").alias("score"))


@query("ingest_merge", """, x AS (SELECT * FROM (VALUES ('region_ingested', 'new place', 0.7)) t(name, definition, c)), a AS (SELECT min_by(id, seq) AS id FROM n WHERE lower(name) = (SELECT lower(min(r_name)) FROM region))
SELECT id, name, CASE WHEN id = (SELECT id FROM a) THEN 'a longer and surer definition' ELSE definition END AS definition, round(CASE WHEN id = (SELECT id FROM a) THEN greatest(confidence, CAST(0.99 AS DOUBLE)) ELSE confidence END, 9) AS confidence FROM n
UNION ALL SELECT (SELECT max(id) FROM n) + 1, 'zzqxkvjw', 'new place', 0.7""")
def ingest_merge(spark, d, g):
    first = table(spark, d, "region").agg(F.min("r_name")).first()[0]
    batch = {"entities": [{"name": first.lower(), "type": "Region", "definition": "a longer and surer definition", "aliases": [], "confidence": 0.99}, {"name": "zzqxkvjw", "type": "Region", "definition": "new place", "aliases": [], "confidence": 0.7}], "relations": []}
    return resolve.ingest(g, batch)[0].nodes.select("id", "name", "definition", r9("confidence").alias("confidence"))


@query("reconcile_supersede", ", t AS (SELECT min_by(id, seq) AS id FROM n GROUP BY lower(name) HAVING lower(name) IN (SELECT lower(n_name) FROM nation)) SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN CAST(0 AS BIGINT) ELSE coalesce(superseded_by, -1) END AS superseded_by FROM n")
def reconcile_supersede(spark, d, g):
    old = table(spark, d, "nation").select(F.col("n_name").alias("old"), F.lit(None).cast("long").alias("by"))
    return lifecycle.supersede(g.nodes, old).select("id", F.coalesce("superseded_by", F.lit(-1).cast("long")).alias("superseded_by"))


@query("reconcile_promote", ", t AS (SELECT min_by(id, seq) AS id FROM n GROUP BY lower(name) HAVING lower(name) IN (SELECT lower(c_name) FROM customer)) SELECT id, CASE WHEN id IN (SELECT id FROM t) AND tier = 'Minor' THEN 'Significant' ELSE tier END AS tier FROM n")
def reconcile_promote(spark, d, g):
    up = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("Significant").alias("new_tier"))
    return lifecycle.promote(g.nodes, up).select("id", "tier")


@query("reconcile_relate", " SELECT CAST(s.id AS BIGINT) AS src, t.id AS dst, 'near' AS relation_type FROM nation JOIN region ON n_regionkey = r_regionkey JOIN n s ON s.name = n_name AND s.node_type = 'Nation' JOIN n t ON t.name = r_name AND t.node_type = 'Region'")
def reconcile_relate(spark, d, g):
    rel = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src_name"), F.col("r_name").alias("dst_name"), F.lit("near").alias("type"))
    return lifecycle.relate(g.nodes, rel).select("src", "dst", "relation_type")


@query("reconcile_full", """, k AS (SELECT r_name, min(r_regionkey) OVER () AS k0, r_regionkey AS k, row_number() OVER (ORDER BY r_regionkey) AS i FROM region), a AS (SELECT min_by(id, seq) AS id FROM n WHERE lower(name) = (SELECT lower(min_by(n_name, n_nationkey)) FROM nation)),
b AS (SELECT n.id FROM nation JOIN region ON n_regionkey = r_regionkey JOIN n ON n.name = r_name AND node_type = 'Region' ORDER BY n_nationkey LIMIT 1), m AS (SELECT max(id) AS m FROM n), x AS (SELECT max(id) AS x FROM e)
SELECT 'node' AS part, id, name AS label, CASE WHEN id = (SELECT id FROM b) THEN 'Critical' ELSE tier END AS tier, CASE WHEN id = (SELECT id FROM a) THEN (SELECT m + 1 FROM m) ELSE coalesce(superseded_by, -1) END AS x, CAST(0 AS BIGINT) AS y, round(confidence, 9) AS confidence FROM n
UNION ALL SELECT 'node', (SELECT m FROM m) + i, 'view of r' || CAST(k AS VARCHAR), 'Significant', CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0.9 AS DOUBLE) FROM k
UNION ALL SELECT 'edge', id, relation_type, '', src, dst, CASE WHEN src = (SELECT id FROM a) AND dst = (SELECT id FROM b) THEN greatest(round(confidence, 9), CAST(0.8 AS DOUBLE)) ELSE round(confidence, 9) END FROM e
UNION ALL SELECT 'edge', (SELECT x FROM x) + 1, 'near', '', (SELECT id FROM a), (SELECT id FROM b), CAST(0.8 AS DOUBLE)
UNION ALL SELECT 'edge', (SELECT x FROM x) + 3, 'about', '', (SELECT m FROM m) + 1, (SELECT id FROM a), CAST(0.8 AS DOUBLE)""")
def reconcile_full(spark, d, g):
    keys = [r[0] for r in table(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # a session's facts: one for each region
    first = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("n_name", "r_name").first()
    facts = [{"name": f"view of r{k}", "type": "Decision", "tier": "Significant", "definition": "seen", "evidence_text": "said"} for k in keys] + [{"name": f" View of R{keys[0]}", "type": "Decision"}]
    facts[0]["supersedes"] = first["n_name"]
    pair = {"from": first["n_name"], "to": first["r_name"]}
    relations = [pair | {"type": "near"}, pair | {"type": "IN_REGION"}, {"from": facts[0]["name"], "to": first["n_name"], "type": "about"}, pair | {"type": "Near"}]
    batch = {"new_facts": facts, "superseded": [{"old": first["n_name"]}], "promotions": [{"name": first["r_name"], "new_tier": "Critical"}], "relations": relations}
    done, _ = lifecycle.reconcile(g, batch, NOW)
    zero = F.lit(0).cast("long").alias("y")
    nodes = done.nodes.select(F.lit("node").alias("part"), "id", F.col("name").alias("label"), "tier", F.coalesce("superseded_by", F.lit(-1).cast("long")).alias("x"), zero, r9("confidence").alias("confidence"))
    return nodes.unionByName(done.edges.select(F.lit("edge").alias("part"), "id", F.col("relation_type").alias("label"), F.lit("").alias("tier"), F.col("src").alias("x"), F.col("dst").alias("y"), r9("confidence").alias("confidence")))


_CONTAINS = "SELECT a.id AS src, b.id AS dst, 'mentions' AS relation_type, CAST(0.5 AS DOUBLE) AS confidence FROM n a JOIN n b ON a.id <> b.id AND strlen(lower(b.name)) >= 4 AND contains(lower(a.definition), lower(b.name))"


@query("discover_connections", f" SELECT * FROM ({_CONTAINS} AND strlen(a.definition) >= 10) x WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.src = x.src AND e.dst = x.dst) OR (e.src = x.dst AND e.dst = x.src))")
def discover_connections(spark, d, g):
    return discover.discover_connections(g).drop("source").withColumn("confidence", F.col("confidence").cast("double"))


# A graph with orphans: every third customer and supplier is based nowhere.
_FEWER = "f AS (SELECT * FROM e WHERE NOT (relation_type = 'based_in' AND src % 3 = 0))"


@query("connect_orphans", f""", {_FEWER}, o AS (SELECT id FROM n WHERE id NOT IN (SELECT src FROM f UNION SELECT dst FROM f)), c AS ({_CONTAINS})
    SELECT * FROM c WHERE src IN (SELECT id FROM o) UNION SELECT * FROM c WHERE dst IN (SELECT id FROM o) AND NOT EXISTS (SELECT 1 FROM c q WHERE q.src = c.dst AND q.dst = c.src AND q.src IN (SELECT id FROM o))""")
def connect_orphans(spark, d, g):
    fewer = Graph(g.nodes, g.edges.where("not (relation_type = 'based_in' and src % 3 = 0)"))
    return discover.connect_orphans(fewer).drop("source").withColumn("confidence", F.col("confidence").cast("double"))


#: The chunk rule as recursive SQL. Characters become as many ASCII letters as they have bytes (white ones the control character 31), so
#: that positions are bytes; then come sentences, runs of them, and the runs' overlaps.
_CHUNKS = r"""WITH RECURSIVE plain AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{85}\x{a0}]', chr(31) || chr(31), 'g'),
    '[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', repeat(chr(31), 3), 'g'), '[\x{80}-\x{7ff}]', 'xx', 'g'), '[\x{800}-\x{ffff}]', 'xxx', 'g') AS t
  FROM documents WHERE text <> ''
), bytes AS (SELECT doc_id, regexp_replace(t, '[^\x{0}-\x{7f}]', 'xxxx', 'g') AS t FROM plain),
long AS (SELECT * FROM bytes WHERE length(t) > 4000),
steps(doc_id, a, b, rest, behind) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), t, CAST(0 AS BIGINT) FROM long
  UNION ALL
  SELECT doc_id, behind, behind + stop, ltrim(substr(rest, stop + 1), ' ' || chr(10) || chr(13)), behind + stop + (length(rest) - stop) - length(ltrim(substr(rest, stop + 1), ' ' || chr(10) || chr(13)))
  FROM (SELECT *, least(coalesce(nullif(length(regexp_extract(rest, '^[\s\S]{21,}?[.!?][ \n\r]')), 0) - 1, length(rest)), coalesce(nullif(length(regexp_extract(rest, '^[\s\S]*?\n\n')), 0) - 1, length(rest))) AS stop FROM steps WHERE rest <> '')
), spans AS (
  SELECT s.doc_id, a, b, b - a AS size, row_number() OVER (PARTITION BY s.doc_id ORDER BY a) AS k, sum(b - a) OVER (PARTITION BY s.doc_id ORDER BY a) AS total
  FROM steps s JOIN long USING (doc_id) WHERE a >= 0 AND regexp_matches(substr(t, a + 1, b - a), '[^\x09-\x0d\x1f ]')
), runs(doc_id, first, last, n) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM spans)
  UNION ALL
  SELECT r.doc_id, r.last + 1, max(s.k), r.n + 1 FROM runs r JOIN spans f ON f.doc_id = r.doc_id AND f.k = r.last + 1
    JOIN spans s ON s.doc_id = r.doc_id AND s.k >= f.k AND (s.k = f.k OR s.total - f.total + f.size <= 4000) GROUP BY ALL
), extended AS (
  SELECT r.doc_id, r.n AS index, r.last, coalesce(min(e.k), r.first) AS first FROM runs r LEFT JOIN runs p ON p.doc_id = r.doc_id AND p.n = r.n - 1 AND p.n >= 0
    LEFT JOIN spans f ON f.doc_id = r.doc_id AND f.k = r.first
    LEFT JOIN spans e ON e.doc_id = r.doc_id AND e.k >= p.first AND e.k < r.first AND f.total - f.size - e.total + e.size <= 500
  WHERE r.n >= 0 GROUP BY r.doc_id, r.n, r.last, r.first
), offsets AS (
  SELECT x.doc_id, x.index, f.a AS start_offset, l.b AS end_offset FROM extended x JOIN spans f ON f.doc_id = x.doc_id AND f.k = x.first JOIN spans l ON l.doc_id = x.doc_id AND l.k = x.last
), chunked AS (
  SELECT doc_id, CAST(index AS BIGINT) AS index, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset, CAST(length(trim(substr(t, start_offset + 1, end_offset - start_offset), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(31) || ' ')) AS BIGINT) AS n_bytes FROM offsets JOIN bytes USING (doc_id)
UNION ALL
SELECT doc_id, 0, 0, length(t), length(t) FROM bytes WHERE doc_id NOT IN (SELECT doc_id FROM spans)
)"""


@query("chunk_counts", f"{_CHUNKS} SELECT doc_id, count(*) AS chunks FROM chunked GROUP BY doc_id", over_graph=False)
def chunk_counts(spark, d, g):
    return tx.chunk_table(table(spark, d, "documents")).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"))


@query("chunk_offsets", f"{_CHUNKS} SELECT doc_id, index, start_offset, end_offset, n_bytes FROM chunked", over_graph=False)
def chunk_offsets(spark, d, g):
    return tx.chunk_table(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "index", "start_offset", "end_offset", F.octet_length("text").cast("long").alias("n_bytes"))


@query("chunk_lateral", f"{_CHUNKS} SELECT doc_id, index, start_offset, end_offset, CAST(n_bytes AS INTEGER) AS n_bytes FROM chunked", over_graph=False)
def chunk_lateral(spark, d, g):
    """The chunks of chunk_offsets, by SQL."""
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, c.index, c.start_offset, c.end_offset, octet_length(c.text) AS n_bytes FROM {documents} d, LATERAL chunks(d.text, 4000, 500) c", documents=table(spark, d, "documents"))


# The tables hold no prose that states facts, so each turn's whole text goes on behind a phrase that depends on its number.
_PHRASES = ["we decided to use ", "the bug is in\t", "instead of that use ", "replacing it with ", "x calls ", "After changing a, b broke "]
_FACTS = " UNION ALL ".join(f"SELECT id, '{kind}' AS fact_type, unnest(regexp_extract_all(t, '(?i){pattern.replace(chr(39), chr(39) * 2)}', 0)) AS fact FROM s" for kind, pattern in tx.FACT_PATTERNS)


@query("snapshot_facts", f"WITH s AS (SELECT conv_id AS id, ['{"', '".join(_PHRASES)}'][CAST(turn % 6 AS INTEGER) + 1] || coalesce(text, '') || ' ' || chr(9) AS t FROM conversations) SELECT id, fact_type, trim(fact, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32)) AS fact FROM ({_FACTS})", over_graph=False)
def snapshot_facts(spark, d, g):
    said = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("turn") % 6).cast("int") + 1)
    turns = table(spark, d, "conversations").select("conv_id", F.concat(said, F.coalesce("text", F.lit("")), F.lit(" \t")).alias("text"))
    return tx.facts(turns, doc_id="conv_id")


_MESSAGES = "WITH m AS (SELECT conv_id AS session_id, turn AS ord, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND text <> '')"


def messages(spark, d) -> DataFrame:
    own = table(spark, d, "conversations").where("role in ('user', 'assistant') and text <> ''")
    return own.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("ts"))


@query("turn_dedup", "WITH m AS (SELECT conv_id, turn, role, text, turn // 4 AS ts FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''), g AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER w = 'assistant' AND lag(ts) OVER w = ts THEN 0 ELSE 1 END AS b FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), k AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY strlen(text) DESC, turn) AS k FROM k) SELECT conv_id AS session_id, (SELECT min(turn) FROM r q WHERE q.conv_id = r.conv_id AND q.s = r.s) AS ord, text AS content FROM r WHERE k = 1", over_graph=False)
def turn_dedup(spark, d, g):
    return tr.dedup_turns(messages(spark, d).withColumn("ts", F.floor(F.col("ord") / 4).cast("string"))).select("session_id", "ord", "content")


@query("flow_text", _MESSAGES + ", p AS (SELECT session_id, string_agg('[' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ']: ' || content || chr(10) || chr(10), '' ORDER BY ord) AS text FROM m GROUP BY session_id) SELECT session_id, text FROM p", over_graph=False)
def flow_text(spark, d, g):
    return tr.flow_text(messages(spark, d), 10_000_000)


@query("user_text", _MESSAGES + " SELECT session_id, string_agg(content || chr(10) || chr(10), '' ORDER BY ord) AS text FROM m WHERE role = 'user' AND strlen(content) >= 15 AND NOT (starts_with(content, '<command-') OR starts_with(content, '<local-command') OR starts_with(content, '/') OR starts_with(content, 'Caveat:') OR contains(content, 'Extract entities') OR contains(content, 'knowledge graph') OR contains(content, 'Return ONLY valid JSON')) GROUP BY session_id", over_graph=False)
def user_text(spark, d, g):
    return tr.user_text(messages(spark, d), 10_000_000)


def _substantive(most: int) -> str:
    """The rule of ``substantive_text`` as SQL; a cut keeps whole characters."""
    cut = "CASE WHEN strlen({0}) <= {1} THEN {0} ELSE left({0}, list_max(list_filter(range(0, {1} + 1), lambda i: strlen(left({0}, i)) <= {1}))){2} END"
    return f"""{_MESSAGES}, b AS (
      SELECT session_id, ord, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS who, CASE WHEN role = 'user' THEN content ELSE {cut.format("content", 300, " || '...'")} END AS body FROM m WHERE strlen(content) >= 15
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n, sum(strlen(who) + strlen(body) + 10) OVER (PARTITION BY session_id) <= {most} AS fits FROM b
    ), p AS (
      SELECT *, CASE WHEN fits OR k < n // 5 THEN 0 WHEN k >= 2 * n // 5 AND k < 3 * n // 5 THEN 1 WHEN k >= 4 * n // 5 THEN 2 END AS section FROM r
    ), q AS (
      SELECT *, CASE WHEN NOT fits AND section > 0 AND row_number() OVER (PARTITION BY session_id, section ORDER BY ord) = 1
        THEN repeat(chr(10) || '[...]' || chr(10) || chr(10), CASE WHEN section = 2 AND n = 3 THEN 2 WHEN 2 * section * n // 5 > 0 THEN 1 ELSE 0 END) ELSE '' END || '[' || who || ']: ' || body || chr(10) || chr(10) AS piece FROM p WHERE section IS NOT NULL
    ), w AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY session_id, section ORDER BY ord) - strlen(piece) AS before FROM q),
    t AS (SELECT session_id, string_agg(piece, '' ORDER BY ord) AS text FROM w WHERE before < CASE WHEN fits THEN {most} WHEN section = 0 THEN {int(most * 0.2)} ELSE {int(most * 0.4)} END GROUP BY session_id)
    SELECT session_id, {cut.format("text", most, "")} AS text FROM t"""


@query("substantive_text", _substantive(50_000), over_graph=False)
def substantive_text(spark, d, g):
    return tr.substantive_text(messages(spark, d))


@query("substantive_sections", _substantive(1_000), over_graph=False)
def substantive_sections(spark, d, g):
    """With a budget that most conversations are over, so that sections, marks and cuts show."""
    return tr.substantive_text(messages(spark, d), 1_000)


@query("usage_last", "WITH k AS (SELECT user_id, event_id, CAST(event_id % 200000 AS BIGINT) AS used FROM events WHERE event_type <> 'click') SELECT user_id, max_by(used, event_id) AS used_tokens, max_by(used, event_id) * 100 // 200000 AS used_pct, CAST(200000 AS BIGINT) AS window_size, max_by(used, event_id) * 100 // 200000 >= 85 AS should_extract FROM k GROUP BY user_id", over_graph=False)
def usage_last(spark, d, g):
    log = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "click", F.col("event_id") % 200_000).alias("used_tokens"))
    return monitor.last_usage(log, "user_id", "event_id")


@query("tick_actions", "WITH t AS (SELECT user_id, event_id, event_id % 37 = 0 AS x FROM events), g AS (SELECT *, sum(CAST(x AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, s, x ORDER BY event_id) AS r FROM g) SELECT user_id, event_id, CASE WHEN x THEN 'Extract' WHEN r % 20 = 0 THEN 'Snapshot' ELSE 'None' END AS action, CAST(CASE WHEN x THEN 0 ELSE r % 20 END AS BIGINT) AS counter FROM r", over_graph=False)
def tick_actions(spark, d, g):
    ticks = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 37 == 0).alias("extract"))
    return monitor.tick_actions(ticks, "user_id", ["event_id"]).select("user_id", "event_id", "action", "counter")


_CASES = "WITH p AS (SELECT d.source AS c, d.doc_id AS f FROM documents d WHERE d.n_chars > 1000), x AS (SELECT d.source AS c, d.doc_id AS f FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1), j AS (SELECT coalesce(p.c, x.c) AS c, p.f AS pf, x.f AS xf FROM p FULL JOIN x ON p.c = x.c AND p.f = x.f), k AS (SELECT c, count(*) FILTER (WHERE pf IS NOT NULL AND xf IS NOT NULL) AS tp, count(*) FILTER (WHERE xf IS NULL) AS fp, count(*) FILTER (WHERE pf IS NULL) AS fn FROM j GROUP BY c)"
_RATIOS = "round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"


def _cases(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    predicted = docs.where("n_chars > 1000").select(F.col("source").alias("case"), F.col("doc_id").alias("file"))
    expected = docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select(F.col("source").alias("case"), F.col("doc_id").alias("file"))
    return evaluate.accuracy(predicted, expected)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r9(c).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in df.columns])


@query("accuracy_by_case", _CASES + f' SELECT c AS "case", tp, fp, fn, {_RATIOS} FROM k', over_graph=False)
def accuracy_by_case(spark, d, g):
    return _rounded(_cases(spark, d))


@query("accuracy_total", _CASES + f", s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM k) SELECT tp, fp, fn, {_RATIOS} FROM s", over_graph=False)
def accuracy_total(spark, d, g):
    return _rounded(evaluate.micro_average(_cases(spark, d)))


@query("module_map", ", c AS (SELECT dst, count(*) AS inbound FROM e GROUP BY dst), k AS (SELECT source_file AS file, count(*) AS entities, CAST(sum(coalesce(inbound, 0)) AS BIGINT) AS refs_in FROM n LEFT JOIN c ON c.dst = n.id WHERE source_kind = 'CodeAnalysis' GROUP BY source_file) SELECT *, CASE WHEN refs_in > 100 THEN 'caution' WHEN refs_in = 0 THEN 'leaf' ELSE '' END AS remark FROM k")
def module_map(spark, d, g):
    return reports.module_map(g)


@query("decisions", " SELECT CASE tier WHEN 'Critical' THEN '!' ELSE '-' END || ' ' || name AS line, tier FROM n WHERE node_type IN ('Customer', 'Nation') AND superseded_by IS NULL AND tier IN ('Critical', 'Significant')")
def decisions(spark, d, g):
    return reports.decisions(g.nodes, ("Customer", "Nation")).drop("seq")


@query("file_rules", ", c AS (SELECT id, seq, name, source_file AS file, count(*) OVER (PARTITION BY source_file) AS entities FROM n WHERE source_kind = 'CodeAnalysis'), u AS (SELECT dst, count(*) AS refs, count(*) FILTER (WHERE relation_type = 'reads') AS reads, count(*) FILTER (WHERE relation_type = 'writes') AS writes FROM e GROUP BY dst), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY refs DESC, seq) AS k FROM c JOIN u ON u.dst = c.id WHERE entities > 3) SELECT file, entities, CAST(k AS INTEGER) AS k, name, refs, reads, writes FROM r WHERE k <= 10")
def file_rules(spark, d, g):
    return reports.file_rules(g)


@query("source_files", " SELECT DISTINCT source_file AS file FROM n WHERE source_kind = 'CodeAnalysis'")
def source_files(spark, d, g):
    return reports.source_files(g.nodes)


# Resolution of references, over names and files that the tables give.
_ENTITIES = "en AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS BIGINT) AS seq, p_name AS name, 'lib/' || p_brand || '.py' AS file FROM part UNION ALL SELECT 10000000 + CAST(s_suppkey AS BIGINT), 10000000 + CAST(s_suppkey AS BIGINT), s_name, 'src/' || n_name || '.py' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_IMPORTS = "im AS (SELECT DISTINCT 'src/' || n_name || '.py' AS file, 'lib/Brand#' || CAST(n_nationkey % 5 + 1 AS VARCHAR) || '.py' AS target FROM nation UNION SELECT 'lib/Brand#' || CAST(r_regionkey % 5 + 1 AS VARCHAR) || '.py', 'src/NATION_' || CAST(r_regionkey AS VARCHAR) || '.py' FROM region)"
_CLOSURE = "cl AS (SELECT file, target, min(hops) AS hops FROM (SELECT file, target, 1 AS hops FROM im UNION ALL SELECT a.file, b.target, 2 FROM im a JOIN im b ON b.file = a.target WHERE a.file <> b.target) GROUP BY file, target)"
_USES = "rf AS (SELECT DISTINCT 'src/' || n_name || '.py' AS source_file, p_name AS target_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey UNION SELECT 'src/NATION_0.py', s_name FROM supplier)"


def _code(spark, d):
    nation, supplier, part, region = (table(spark, d, t) for t in ("nation", "supplier", "part", "region"))
    based = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    own = F.concat(F.lit("src/"), "n_name", F.lit(".py"))
    brand = lambda k: F.concat(F.lit("lib/Brand#"), (F.col(k) % 5 + 1).cast("string"), F.lit(".py"))
    entities = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.concat(F.lit("lib/"), "p_brand", F.lit(".py")).alias("file"))
    entities = entities.union(based.select(10_000_000 + F.col("s_suppkey"), 10_000_000 + F.col("s_suppkey"), "s_name", own)).withColumn("entity_type", F.lit("Struct"))
    imported = nation.select(own.alias("file"), brand("n_nationkey").alias("target")).union(region.select(brand("r_regionkey"), F.concat(F.lit("src/NATION_"), F.col("r_regionkey").cast("string"), F.lit(".py")))).distinct()
    uses = table(spark, d, "lineitem").join(based, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(own.alias("source_file"), F.col("p_name").alias("target_name"))
    uses = uses.union(supplier.select(F.lit("src/NATION_0.py"), "s_name")).distinct().withColumn("source_line", F.lit(0).cast("long")).withColumn("ref_type", F.lit("Calls"))
    return entities, imported, uses


@query("unique_global", f"WITH {_ENTITIES} SELECT name AS key, max(id) AS id FROM en GROUP BY name HAVING count(DISTINCT id) = 1", over_graph=False)
def unique_global(spark, d, g):
    return resolution.unique_global(resolution.lookup_keys(_code(spark, d)[0])).select("key", "id")


@query("import_closure", f"WITH {_IMPORTS}, {_CLOSURE} SELECT file, target, CAST(hops AS INTEGER) AS hops FROM cl", over_graph=False)
def import_closure(spark, d, g):
    return resolution.import_closure(_code(spark, d)[1])


@query("tiered_resolution", f"""WITH {_ENTITIES}, {_IMPORTS}, {_CLOSURE}, {_USES}, ca AS (SELECT rf.*, en.id, en.seq, CASE WHEN en.file = rf.source_file THEN 1 WHEN cl.hops IS NOT NULL THEN cl.hops + 1
    WHEN strlen(rf.target_name) >= 4 AND (SELECT count(*) FROM en q WHERE q.name = rf.target_name) = 1 THEN 4 END AS tier FROM rf JOIN en ON en.name = rf.target_name LEFT JOIN cl ON cl.file = rf.source_file AND cl.target = en.file),
k AS (SELECT *, row_number() OVER (PARTITION BY source_file, target_name ORDER BY tier, seq) AS k FROM ca WHERE tier IS NOT NULL) SELECT source_file, target_name, id AS dst, CAST(tier AS INTEGER) AS tier FROM k WHERE k = 1""", over_graph=False)
def tiered_resolution(spark, d, g):
    entities, imported, uses = _code(spark, d)
    return resolution.resolve_references(uses, entities, imported).select("source_file", "target_name", "dst", "tier")
