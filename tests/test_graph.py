"""Graph operators on small graphs with known facts."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.api import KnowledgeGraph
from graphloom.operators import discover, evaluate, impact, lifecycle, mutation, navigation, paths, ranking, reports, resolve
from graphloom.sources import adjacency, store
from graphloom.schema import EDGES, EVIDENCE, NODES, Graph

NODE = "id long, seq long, name string, node_type string, definition string, aliases array<string>, confidence double, source struct<kind:string,file:string>, created_at long, tier string, superseded_by long"
EDGE = "id long, seq long, src long, dst long, relation_type string, confidence double, source struct<kind:string,file:string>"
DAY = 86400


def make(spark, nodes, edges):
    rows = [(i, i, n.get("name"), n.get("type", "Concept"), n.get("text"), n.get("aliases", []), n.get("confidence", 0.7), (n.get("kind", "Document"), n.get("file")), n.get("at", 0), n.get("tier", "Minor"), n.get("over")) for i, n in enumerate(nodes, 1)]
    links = [(k, k, a, b, r, c, ("CodeAnalysis" if f else "Document", f)) for k, (a, b, r, c, f) in enumerate([(*e, *(0.5, None)[len(e) - 3 :]) if len(e) < 5 else e for e in edges], 1)]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(links, EDGE))


def shuffled(spark, run):
    """What ``run`` returns, and the number of rows that its stages shuffle."""
    context, none = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList()

    def total():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(x := stages.apply(k)).stageId(): x.shuffleWriteRecords() for k in range(stages.size())}

    before = total()
    got = run()
    return got, sum(n for k, n in total().items() if k not in before)


@pytest.fixture
def people(spark):
    return make(spark, [{"name": "Ada", "type": "Person"}, {"name": "Engines", "type": "Project"}, {"name": "Budget Of Engines", "type": "Metric"}, {"name": "Alone"}], [(1, 2, "works_on"), (2, 3, "has_budget")])


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_lookup_ladder(spark, people):
    assert names(navigation.lookup(people.nodes, " ada ")) == ["Ada"]
    assert names(navigation.lookup(people.nodes, "engine")) == ["Engines"]
    assert names(navigation.lookup(people.nodes, "budget of")) == ["Budget Of Engines"]
    assert names(navigation.lookup(people.nodes, "nothing")) == []
    many = navigation.lookup_many(people.nodes, spark.createDataFrame([("ADA",), ("Engine",), ("none",)], "name string"))
    assert {(r["query"], r["id"]) for r in many.collect()} == {("ADA", 1), ("Engine", 2)}


def test_neighbours_paths_and_stats(spark, people):
    one = spark.createDataFrame([(2,)], "node long")
    assert sorted(r["other_name"] for r in navigation.neighbors(people, one).collect()) == ["Ada", "Budget Of Engines"]
    assert [r["other_name"] for r in navigation.follow(people, one, "HAS_BUDGET").collect()] == ["Budget Of Engines"]
    assert paths.shortest_path(people, 1, 3) == [1, 2, 3]
    assert paths.shortest_path(people, 1, 4) == [] and paths.shortest_path(people, 1, 1) == [1]
    row = navigation.stats(people).first()
    assert (row["node_count"], row["edge_count"]) == (4, 2)
    q = navigation.quality_metrics(people).first()
    assert (q["orphan_count"], q["orphan_ratio"], q["average_degree"]) == (1, 0.25, 1.0)
    empty = Graph(people.nodes.limit(0), people.edges.limit(0))
    assert navigation.quality_metrics(empty).first()["average_degree"] == 0
    seen = navigation.explore(people, "Engines").collect()
    assert {(r["relations"], r["direction"], r["other_name"]) for r in seen} == {(2, "incoming", "Ada"), (2, "outgoing", "Budget Of Engines")}
    assert [(r["name"], r["relations"], r["other_name"]) for r in navigation.explore(people, "alone").collect()] == [("Alone", 0, None)]


def test_edge_merge_keeps_the_first_spelling_and_is_idempotent(spark):
    g = make(spark, [{"name": x} for x in "abc"], [(1, 2, "Uses", 0.3, None), (1, 2, "uses", 0.9, None), (2, 1, "uses", 0.1, None), (3, 3, "uses", 0.5, None), (1, 9, "uses", 0.5, None)])
    merged = mutation.merge_edges(g.edges, g.nodes)
    rows = {(r["src"], r["dst"], r["relation_type"], r["confidence"]) for r in merged.collect()}
    assert rows == {(1, 2, "Uses", 0.9), (2, 1, "uses", 0.1)}
    assert mutation.merge_edges(merged).count() == 2


def test_evidence(spark):
    """Merged edges have each text once, in order; ingestion appends a node's and merges an edge's; look-ups show both."""
    said = lambda *texts: [("d", None, t, 0, 0) for t in texts]
    rows = [(1, 1, 1, 2, "uses", 0.3, ("Document", None), said("a", "b")), (2, 2, 1, 2, "USES", 0.9, ("Document", None), said("b", "c")), (3, 3, 2, 1, "uses", 0.1, ("Document", None), None)]
    edges = spark.createDataFrame(rows, EDGE + f", evidence {EVIDENCE.simpleString()}")
    merged = {r["src"]: [x["text_snippet"] for x in r["evidence"]] for r in mutation.merge_edges(edges).collect()}
    assert merged == {1: ["a", "b", "c"], 2: []}
    kg = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    batch = lambda text, doc: resolve.parse_extraction(json.dumps({"entities": [{"name": "Alpha", "evidence_text": text}, {"name": "Beta"}], "relations": [{"source": "Alpha", "target": "Beta", "type": "has", "evidence_text": t} for t in ("x", text)]}), doc)
    for text, doc in (("one", "notes"), ("two", None), ("one", None)):
        kg, report = resolve.ingest(kg, batch(text, doc))
    assert (report.edges_added, report.edges_deduped) == (0, 2)
    node = kg.nodes.where("name = 'Alpha'").first()
    assert [x["text_snippet"] for x in node["evidence"]] == ["one", "two", "one"] and (node["source"]["kind"], node["source"]["name"]) == ("Document", "notes")
    assert [[x["text_snippet"] for x in r["evidence"]] for r in kg.edges.collect()] == [["x", "one", "two"]]
    seen = navigation.explore(kg, "alpha").first()
    assert len(seen["evidence"]) == 3 and [x["document"] for x in seen["edge_evidence"]] == ["notes", "notes", "memory"]
    kg.edge_types = spark.createDataFrame([("owns",)], "name string")
    _, report = resolve.ingest(kg, {"entities": [], "relations": [{"source": "Alpha", "target": "Beta", "type": t, "confidence": 0.5} for t in ("OWNS", "mentions", "likes")]})
    assert report.edges_added == 2 and report.errors == ["unknown edge type: likes"]


def test_ontology(spark, people):
    known = spark.createDataFrame([("person",)], "name string")
    assert mutation.allowed(people.nodes, "node_type", known).where("error is null").count() == 1
    assert mutation.allowed(people.nodes, "node_type", known.limit(0)).where("error is null").count() == 4


def test_similarity_and_resolution(spark):
    random.seed(3)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(0, 9))) for _ in range(60)]
    pairs = list(itertools.product(words[:12], words[12:24]))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", resolve.similarity(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        assert r["s"] == pytest.approx(resolve.lcs_similarity(r["a"], r["b"]))
    g = make(spark, [{"name": "Quarterly Report", "aliases": ["QR"]}, {"name": "Other"}], [])
    ask = spark.createDataFrame([("quarterly report",), ("qr",), ("Quarterly Reprt",), ("zzz",), (" ",)], "name string")
    assert {(r["query"], r["id"]) for r in resolve.resolve(ask, g.nodes).collect()} == {("quarterly report", 1), ("qr", 1), ("Quarterly Reprt", 1)}


def test_ingest(spark):
    g = make(spark, [{"name": "Alpha", "text": "short", "confidence": 0.7}], [])
    batch = resolve.parse_extraction(json.dumps({"entities": [{"name": "alpha", "definition": "a longer text", "aliases": ["First"], "confidence": 0.95}, {"name": "Beta", "type": "Metric"}], "relations": [{"source": "Alpha", "target": "Beta", "type": "has"}, {"source": "Alpha", "target": "nobody here"}, {"source": "Beta", "target": " beta"}]}))
    out, report = resolve.ingest(g, batch)
    assert (report.entities_merged, report.entities_added, report.edges_added, report.edges_deduped, len(report.errors)) == (1, 1, 1, 1, 1)
    assert out.nodes.where("id = 1").first()["definition"] == "a longer text"
    assert names(navigation.lookup(out.nodes, "first")) == ["Alpha"]
    again, report = resolve.ingest(out, {"entities": [], "relations": batch["relations"][:1] * 2})
    assert (report.edges_added, report.edges_deduped, again.edges.count()) == (0, 2, 1)


def test_impact(spark):
    g = make(spark, [{"name": "Core", "type": "Struct", "kind": "CodeAnalysis", "file": "core.rs"}, {"name": "a", "kind": "CodeAnalysis", "file": "src/storage.rs"}, {"name": "b", "kind": "CodeAnalysis", "file": "src/python.rs"}, {"name": "c"}],
             [(2, 1, "reads", 1.0, "./src/storage.rs"), (3, 1, "calls", 1.0, "src/storage.rs"), (4, 3, "uses")])
    direct = impact.impact(g, "core")
    assert names(direct) == ["a", "b"]
    assert sorted(r[0] for r in impact.breaking_changes(direct).collect()) == ["Python callers may break", "stored data may fail to deserialise"]
    assert (2, "c") in {(r["depth"], r["name"]) for r in impact.impact(g, "Core", 2).collect()}
    assert impact.impact(g, "unknown").count() == 0
    assert [r["file"] for r in impact.reference_files(g, "Core").collect()] == ["src/storage.rs"]
    assert impact.impact_from_change(g, "no json") == "" and impact.impact_from_change(g, '{"old_string": ""}') == ""
    report = json.loads(impact.impact_from_change(g, json.dumps({"tool_input": {"file_path": "x/core.rs", "old_string": "struct Core {}"}})))
    assert "reads Core: 1" in report["hookSpecificOutput"]["additionalContext"]


def test_impact_reports(spark):
    g = make(spark, [{"name": "Core", "type": "Struct", "kind": "CodeAnalysis", "file": "core.rs"}, {"name": "a", "kind": "CodeAnalysis", "file": "src/storage.rs"}, {"name": "Core.size", "type": "Field", "kind": "CodeAnalysis", "file": "core.rs"}, {"name": "far"}, {"name": "Lone", "kind": "CodeAnalysis", "file": "core.rs"}],
             [(2, 1, "reads", 1.0, "src/storage.rs"), (2, 1, "reads", 1.0, "src/other.rs"), (2, 3, "writes", 1.0, "x.rs"), (4, 2, "uses")])
    report = impact.impact_report(g, "Core", 2)
    assert "References (1):\n- ← a (reads) [Concept] in src/storage.rs\n" in report and "Indirect (2):\n- a → Core.size (writes) in core.rs\n- a → far (uses) in semantic\n" in report
    assert report.endswith("Breaking changes:\n- src/storage.rs: stored data may fail to deserialise\n")
    assert impact.impact_report(g, "none") == "No entity found: none" and "No references found." in impact.impact_report(g, "Lone")
    text = impact.impact_of_text(g, json.dumps({"old_string": "struct Core { size } Lone"}))
    assert text.count("## Impact") == 1 and impact.impact_of_text(g, "x") == impact.impact_of_text(g, "[]") == impact.impact_of_text(g, "{}") == ""
    rule = reports.file_rule(g, "core.rs")
    assert "Core: 2 references\n  .size: read in 0 files, written in 1\n" in rule and "Before a change of a type" in rule and "Before a function" not in rule


def test_patterns(spark):
    rows = [(f"d{k % 3}/f{k}.rs", 1, "go", "Calls") for k in range(12)] + [("a/f0.rs", 2, "go", "ReadsField")]
    groups = impact.pattern_groups(spark.createDataFrame(rows, "source_file string, source_line long, target string, ref_type string"))
    found = {r["pattern"]: (r["n"], r["total_files"]) for r in groups.collect()}
    assert found == {"calls go": (12, 12), "reads go": (1, 1)}
    assert "+9" in impact.format_patterns(groups)


def test_relevance(spark):
    rows = [("Critical", 0, 100 * DAY, None, False), ("Significant", 0, 70 * DAY, None, False), ("Minor", 0, 14 * DAY, None, False), ("Critical", 0, 0, 0, False), ("Minor", 0, 900 * DAY, None, True), ("Minor", 10, 0, None, False)]
    df = spark.createDataFrame(rows, "tier string, created_at long, now long, superseded_by long, code boolean")
    got = [r[0] for r in df.select(ranking.relevance(F.col("tier"), F.col("created_at"), F.col("now"), F.col("superseded_by"), F.col("code"))).collect()]
    assert got[0] == 1.0 and 0.28 < got[1] < 0.31 and 0.14 < got[2] < 0.16 and got[3] == 0 and got[4] == 0.3 and got[5] == 0.3


def test_budgets(spark):
    g = make(spark, [{"name": f"n{k}", "text": "word " * 10, "tier": t} for k, t in enumerate(["Critical", "Significant", "Minor"] * 5)], [])
    tiny = ranking.context_report(g.nodes, 0, 40).collect()
    assert 0 < len(tiny) < 4 and tiny[0]["line"].startswith("## Critical\n")
    assert ranking.find_relevant(g.nodes, "of it").count() == 0
    assert ranking.find_relevant(g.nodes, "word", 20).count() < 10


def test_lifecycle(spark):
    g = make(spark, [{"name": "old fact", "type": "Decision", "tier": "Critical", "kind": "Conversation"}, {"name": "minor thing", "kind": "Conversation"}, {"name": "code", "kind": "CodeAnalysis", "file": "x.py"}], [(1, 2, "about")])
    up = spark.createDataFrame([("minor thing", "Significant"), ("old fact", "Minor")], "name string, new_tier string")
    assert [r["tier"] for r in lifecycle.promote(g.nodes, up).orderBy("id").collect()] == ["Critical", "Significant", "Minor"]
    left = lifecycle.garbage_collect(g, 365 * DAY)
    assert names(left.nodes) == ["code", "old fact"] and left.edges.count() == 0
    over = lifecycle.supersede(g.nodes, spark.createDataFrame([("old fact", None)], "old string, by long"))
    assert over.where("id = 1").first()["superseded_by"] == 0


def test_pagerank_moves_edges_into_sinks_once(spark):
    """Sinks have no part in the rounds before the last: rows that are shuffled do not grow with rounds times edges. Ranks are those of all rounds over all edges."""
    r = random.Random(5)
    pairs = [(r.randint(1, 20), k) for k in range(100, 3100)] + [(r.randint(1, 20), r.randint(1, 20)) for _ in range(60)] + [(7, 7), (3, 100), (3, 100)]
    edges = spark.createDataFrame(pairs, "src long, dst long").cache()
    edges.count()
    out, nodes = {}, {x for p in pairs for x in p}
    for a, _ in pairs:
        out[a] = out.get(a, 0) + 1
    for rounds in (0, 1, 8):
        rank = dict.fromkeys(nodes, 1 / len(nodes))
        for _ in range(rounds):
            flow = dict.fromkeys(nodes, 0.0)
            for a, b in pairs:
                flow[b] += rank[a] / out[a]
            rank = {x: 0.15 / len(nodes) + 0.85 * f for x, f in flow.items()}
        got, rows = shuffled(spark, lambda rounds=rounds: {x["node"]: x["rank"] for x in paths.pagerank(edges, rounds, every=2).collect()})
        assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) < 1e-12 for x in rank)
        assert rows < 6 * len(pairs)


def test_pagerank(spark):
    edges = spark.createDataFrame([(k, k, a, b) for k, (a, b) in enumerate([(1, 2), (3, 2), (4, 2), (2, 1), (2, 5)])], "id long, seq long, src long, dst long")
    rank = {r["node"]: r["rank"] for r in paths.pagerank(edges).collect()}
    assert rank[2] > rank[3] and abs(rank[1] - rank[5]) < 0.01 and sum(rank.values()) <= 1.0001
    assert paths.pagerank(edges.limit(0)).count() == 0


def test_containment_is_brute_force(spark):
    random.seed(5)
    texts = [(k, "".join(random.choice("ab c") for _ in range(random.randint(0, 60)))) for k in range(40)]
    keys = [(100 + k, "".join(random.choice("ab c") for _ in range(random.randint(1, 18)))) for k in range(60)] + [(200, "éé"), (201, "é")]
    texts.append((50, "xx éé yy"))
    got = discover.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(keys, "id long, name string"))
    want = {(i, j) for i, t in texts for j, n in keys if len(n.encode()) >= 4 and n in t}
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted(want)


def test_orphans(spark):
    g = make(spark, [{"name": "Parser", "text": "reads the Lexer stream"}, {"name": "Lexer", "text": "plain"}, {"name": "Other", "text": "nothing"}], [])
    assert [(r["src"], r["dst"]) for r in discover.connect_orphans(g).collect()] == [(1, 2)]
    assert [(r["src"], r["dst"]) for r in discover.discover_connections(g).collect()] == [(1, 2)]


def test_accuracy(spark):
    files = lambda x: spark.createDataFrame([("c", f) for f in x], "case string, file string")
    row = evaluate.accuracy(files("abc"), files("bcd")).first()
    assert (row["tp"], row["fp"], row["fn"]) == (2, 1, 1) and row["precision"] == row["recall"] == pytest.approx(2 / 3) and row["f1"] == pytest.approx(2 / 3)
    assert "TOTAL: precision 0.667" in evaluate.report(evaluate.accuracy(files("abc"), files("bcd")))


def test_store_and_api(spark, tmp_path):
    kg = KnowledgeGraph(spark, f"file://{tmp_path}/g")
    assert kg.graph.nodes.count() == 0
    kg.ingest_document("notes", json.dumps({"entities": [{"name": "Alpha", "type": "Thing", "definition": "names Beta here"}, {"name": "Beta", "type": "Thing"}], "relations": []}))
    kg.save()
    again = KnowledgeGraph(spark, f"file://{tmp_path}/g")
    assert names(again.graph.nodes) == ["Alpha", "Beta"]
    assert again.connect_orphans() == 1 and "--[mentions]-->" in again.connect("alpha", "beta")
    report = again.reconcile(json.dumps({"new_facts": [{"name": "Use Gamma", "type": "Decision", "tier": "Critical", "definition": "because", "reason": "speed", "supersedes": "Beta"}], "relations": [{"from": "Use Gamma", "to": "Alpha", "type": "about"}]}), 10)
    assert (report["added"], report["superseded"], report["edges_added"], report["edges_new"]) == (1, 1, 1, 1)
    assert "Known entities" in again.prepare_extraction("text", "doc")


def test_lookups_by_substring(people, spark):
    """Many names find by substring what one does, and reconciling by them neither adds nor misses a node."""
    rows = [(1, "Cell Division Process"), (2, "Mitosis Phase"), (3, "Mitosis"), (4, "abc"), (5, "Zelldü")]
    nodes = spark.createDataFrame([(i, n, i, [], "Minor", None) for i, n in rows], "id long, name string, seq long, aliases array<string>, tier string, superseded_by long")
    asked = ["cell division", "MITOSIS PHASE two", "the mitosis", "abcde", "abcdefg", "mitosi", "Zelldü 2", "nothing at all"]
    names = spark.createDataFrame([(a,) for a in asked], "name string")
    got = {r["query"]: (r["id"], r["step"]) for r in navigation.lookup_many(nodes, names).collect()}
    assert got == {a: (r["id"], r["step"]) for a in asked for r in navigation.lookup(nodes, a).collect()}
    assert got["cell division"] == (1, 3) and got["MITOSIS PHASE two"] == (2, 3) and "abcdefg" not in got
    old = lifecycle.supersede(nodes, spark.createDataFrame([("cell division", 9)], "old string, by long"))
    assert old.where("id = 1").first()["superseded_by"] == 9
    up = lifecycle.promote(nodes, spark.createDataFrame([("cell division", "Critical")], "name string, new_tier string"))
    assert up.where("id = 1").first()["tier"] == "Critical"
    tie = lifecycle.relate(nodes, spark.createDataFrame([("cell division", "the mitosis", "is")], "src_name string, dst_name string, type string")).collect()
    assert [(r["src"], r["dst"]) for r in tie] == [(1, 3)]
    fact = spark.createDataFrame([(0, "cell division", "Fact", "Minor", "", "")], "ord long, name string, type string, tier string, definition string, reason string")
    assert lifecycle.new_facts(nodes, fact).count() == 0


def test_search_has_no_depth_limit(spark):
    """A chain of 80 nodes with a side branch and a cycle: levels, parents and path."""
    pairs = [(k, k + 1) for k in range(1, 80)] + [(3, 200), (200, 201), (10, 8)]
    edges = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "src long, dst long, seq long")
    assert paths.shortest_path(Graph(None, edges), 80, 1) == [*range(80, 10, -1), 10, 8, 7, 6, 5, 4, 3, 2, 1]
    near = {r["node"]: r["depth"] for r in paths.levels(edges, spark.createDataFrame([(1,)], "node long"), 4).collect()}
    assert near == {1: 0, 2: 1, 3: 2, 4: 3, 200: 3, 5: 4, 201: 4}


def test_search_moves_edges_once(spark):
    """The edges beside a chain are shuffled when they are laid by node, and not again in each of its rounds."""
    pairs = [(k, k + 1) for k in range(12)] + [(k % 7 + 100, k + 1000) for k in range(2000)] + [(3, 100)]
    edges = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "src long, dst long, seq long").cache()
    edges.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    near, rows = shuffled(spark, lambda: {x["node"]: x["depth"] for x in paths.levels(edges, spark.createDataFrame([(0,)], "node long")).collect()})
    path, more = shuffled(spark, lambda: paths.shortest_path(Graph(None, edges), 0, 12))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert near == {k: k for k in range(13)} | {100: 4} | {k + 1000: 5 for k in range(0, 2000, 7)} and path == list(range(13))
    assert rows < 4 * len(pairs) and more < 4 * len(pairs)


def test_stored_adjacency(spark, tmp_path):
    """A saved graph's neighbours come from the buckets of the nodes asked for, also those of a hub; changed edges are not stored ones."""
    links = [(1, k, "r") for k in range(2, 60)] + [(k, k + 1, "s") for k in range(60, 99)] + [(2, 60, "t"), (5, 5, "u"), (3, 4, "t"), (4, 3, "t")]
    g = make(spark, [{"name": f"n{k}", "file": f"f{k}"} for k in range(1, 101)], links)
    stored = Graph(g.nodes, g.edges, adjacency=adjacency.write(g, f"file://{tmp_path}/a", rows_per_bucket=20))
    assert stored.adjacency.hubs is not None and {r["node"] for r in stored.adjacency.hubs.select("node").distinct().collect()} == {1}
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for nodes in ([1], [2, 60, 5], [7777], list(range(1, 101))):
        of = spark.createDataFrame([(k,) for k in nodes], "node long")
        assert rows(navigation.neighbors(stored, of)) == rows(navigation.neighbors(g, of))
    many = spark.range(1, 5000).withColumnRenamed("id", "node")
    assert rows(navigation.neighbors(stored, many)) == rows(navigation.neighbors(g, many))
    plan = stored.adjacency.of(spark.createDataFrame([(60,)], "node long"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(node,60)" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    big = stored.adjacency.near.join(many, "node")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in big and big.count("Exchange hashpartitioning") == 1  # the front alone is shuffled
    assert rows(impact.impact(stored, "n2", 2)) == rows(impact.impact(g, "n2", 2))
    assert paths.shortest_path(stored, 99, 7) == paths.shortest_path(g, 99, 7) == [*range(99, 59, -1), 2, 1, 7]
    assert adjacency.read(spark, f"file://{tmp_path}/none") is None and adjacency.read(spark, f"file://{tmp_path}/a").hubs is not None
    asked = stored.adjacency.of(spark.createDataFrame([(60,)], "node long"))
    bucket = spark.range(1).select(F.pmod(F.hash(F.lit(60).cast("long")), F.lit(16))).first()[0]
    for file in (tmp_path / "a" / "near-16").glob("part-*"):
        if f"_{bucket:05d}.c" not in file.name:
            file.unlink()
    assert sorted(r["other"] for r in asked.collect()) == [2, 61]  # no other bucket is read
    stored.edges = g.edges.limit(0)
    assert stored.adjacency is None and navigation.neighbors(stored, many).count() == 0


def test_stored_adjacency_holds_names_once(spark, tmp_path):
    """What is shown of a node is stored once, not for each edge; a front in more parts than buckets leaves the stored side in place; an edge to no node
    is no neighbour's; a folder of an earlier version, with the other node in each row, is read as well."""
    g = make(spark, [{"name": f"n{k}", "file": f"f{k}"} for k in range(1, 101)], [(k % 50 + 1, k % 97 + 1, "r") for k in range(3000)] + [(4, 7777, "r")])
    stored = Graph(g.nodes, g.edges, adjacency=adjacency.write(g, f"file://{tmp_path}/a"))
    files = list((tmp_path / "a").rglob("*.parquet"))
    assert sum(spark.read.parquet(f"file://{f}").count() for f in files if "other_name" in spark.read.parquet(f"file://{f}").columns) == 100
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    many = spark.range(1, 5000).withColumnRenamed("id", "node")
    for of in (spark.createDataFrame([(4,)], "node long"), many):
        assert rows(navigation.neighbors(stored, of)) == rows(navigation.neighbors(g, of))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    got, moved = shuffled(spark, lambda: stored.adjacency.of(many.where("node > 3950 or node = 4")).count())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == g.edges.where("src = 4").count() + g.edges.where("dst = 4").count() and moved < 5500  # the front of 1,050 twice or so, not 6,002 rows
    navigation.neighbor_rows(g).write.format("parquet").bucketBy(4, "node").sortBy("node").option("path", f"file://{tmp_path}/old/near-4").saveAsTable("earlier_adjacency")
    old = Graph(g.nodes, g.edges, adjacency=adjacency.read(spark, f"file://{tmp_path}/old"))
    assert rows(navigation.neighbors(old, many)) == rows(navigation.neighbors(g, many)) and rows(impact.impact(old, "n4", 2)) == rows(impact.impact(stored, "n4", 2)) == rows(impact.impact(g, "n4", 2))


def test_shortest_path_is_the_least_of_all(spark):
    """Random graphs against every path, in few jobs: of equally short ones the least edge numbers count; a hub is no bar."""
    r = random.Random(3)
    pairs = [(r.randint(1, 25), r.randint(1, 25)) for _ in range(45)]
    edges = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "src long, dst long, seq long").cache()
    g, best = Graph(None, edges), {}
    for start in (1, 7):
        level = {start: ((), (start,))}
        best[start] = dict(level)
        while level:
            step = {}
            for k, (a, b) in enumerate(pairs):
                for x, y in ((a, b), (b, a)):
                    if x in level and y not in best[start]:
                        step[y] = min(step.get(y, ((1 << 60,), ())), ((*level[x][0], k), (*level[x][1], y)))
            best[start] |= step
            level = step
        for end in (2, 13, 25):
            assert paths.shortest_path(g, start, end) == list(best[start].get(end, ((), ()))[1])
    hub = Graph(None, spark.createDataFrame([(0, k, k) for k in range(1, 3000)] + [(3000, 1, 3000), (2999, 3001, 3001)], "src long, dst long, seq long"))
    assert paths.shortest_path(hub, 3000, 3001) == [3000, 1, 0, 2999, 3001] and paths.shortest_path(hub, 3000, 3001, 3) == []


def test_change_log(spark, tmp_path, monkeypatch):
    """A change writes what it changes, a writer that stops before the head leaves what was there, and many changes become a version."""
    path = f"file://{tmp_path}/g"
    seed = make(spark, [{"name": f"n{k}", "text": "t" * 200} for k in range(400)], [(k, k + 1, "r") for k in range(1, 400)])
    own = store.empty(spark)
    g = Graph(own.nodes.unionByName(seed.nodes.drop("source"), allowMissingColumns=True), own.edges.unionByName(seed.edges.drop("source"), allowMissingColumns=True))
    base = store.append(g, path)
    assert (tmp_path / "g" / base / "adjacency").is_dir() and store.load(spark, path).adjacency is not None
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "g" / v).rglob("*.parquet") if "adjacency" not in str(f))
    now = store.load(spark, path)
    now.nodes = now.nodes.where("id <> 7").withColumn("definition", F.when(F.col("id") == 9, "new").otherwise(F.col("definition")))
    now.edges = now.edges.where("src <> 7 and dst <> 7").unionByName(now.edges.where("id = 1").withColumn("id", F.lit(1000).cast("long")))
    heads = len(list((tmp_path / "g").glob("HEAD-*")))
    monkeypatch.setattr(store, "_set_head", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        store.append(now, path)
    monkeypatch.undo()
    assert store.load(spark, path).nodes.count() == 400 and len(list((tmp_path / "g").glob("HEAD-*"))) == heads
    change = store.append(now, path)
    assert spark.read.parquet(f"{path}/{change}/nodes").count() == 2 and spark.read.parquet(f"{path}/{change}/edges").count() == 3
    back = store.load(spark, path)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(back.nodes) == rows(now.nodes) and rows(back.edges) == rows(now.edges) and back.adjacency is None
    assert size(change) < size(base) * 2  # a handful of rows; at this size footers are most of it
    again = store.load(spark, path)
    again.nodes = again.nodes.withColumn("definition", F.when(F.col("id") == 9, "newer").otherwise(F.col("definition"))).unionByName(seed.nodes.drop("source").where("id = 7"), allowMissingColumns=True)
    store.append(again, path)
    last = store.load(spark, path)
    assert last.nodes.where("id = 9").first()["definition"] == "newer" and last.nodes.count() == 400
    monkeypatch.setattr(store, "MOST_CHANGES", 2)
    assert store.append(last, path) != change and store.load(spark, path).adjacency is not None and rows(store.load(spark, path).nodes) == rows(again.nodes)


def test_reconcile_merges_edges_and_keeps_evidence(spark, tmp_path):
    """Two relations on one pair, evidence of a fact, white space of any kind around names, and facts that name one another."""
    kg = KnowledgeGraph(spark, f"file://{tmp_path}/g")
    kg.ingest_memory(json.dumps({"entities": [{"name": "Alpha"}, {"name": "Beta\t"}], "relations": [{"source": "Alpha", "target": "Beta", "type": "calls", "confidence": 0.3}, {"source": "Alpha", "target": "Beta", "type": "near", "confidence": 0.2}]}))
    facts = [{"name": "Cell Division Process", "type": "Decision", "evidence_text": "we said so", "reason": "speed"}, {"name": "cell division", "type": "Decision"}, {"name": "\tbeta\u2003", "type": "Decision"}]
    done = kg.reconcile(json.dumps({"new_facts": facts, "relations": [{"from": "alpha", "to": "BETA\t", "type": "NEAR"}, {"from": "Alpha", "to": "Alpha", "type": "x"}, {"from": "Alpha", "to": "unknown", "type": "x"}, {"from": "Beta", "to": "Alpha", "type": "near"}]}), 10)
    assert (done["added"], done["edges_added"], done["edges_new"], len(done["errors"])) == (1, 2, 1, 1)
    edges = {(r["src"], r["dst"], r["relation_type"]): r for r in kg.graph.edges.collect()}
    assert len(edges) == 3 and abs(edges[1, 2, "near"]["confidence"] - 0.8) < 1e-6 and abs(edges[1, 2, "calls"]["confidence"] - 0.3) < 1e-6
    assert edges[2, 1, "near"]["source"]["kind"] == "Conversation" and edges[1, 2, "near"]["source"]["kind"] == "Memory"
    fact = kg.lookup("Cell Division Process").first()
    assert [(e["document"], e["text_snippet"], e["offset_start"], e["offset_end"]) for e in fact["evidence"]] == [("conversation", "we said so", 0, 0)]
    assert fact["definition"] == " (reason: speed)" and fact["last_referenced"] == 10 and fact["source"]["kind"] == "Conversation"


def test_names_are_contained_by_automaton_and_by_grams(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé漢 ") for _ in range(r.randint(1, 9)))
    names_ = [word() for _ in range(120)] + ["ab", None, "", "ABCA", "abca", "x" * 20]
    texts = [" ".join(word() for _ in range(r.randint(0, 12))) for _ in range(80)] + [None, "", "ABCAbca", "x" * 45]
    t = spark.createDataFrame([(str(k), x, "n") for k, x in enumerate(texts)], "id string, text string, n string").repartition(3)
    n = spark.createDataFrame(list(enumerate(names_)), "id long, name string")
    want = {(str(i), k) for i, x in enumerate(texts) for k, y in enumerate(names_) if x is not None and y is not None and len(y.encode()) >= 4 and y.lower() in x.lower()}
    for bound in (200_000, 10):
        assert {tuple(x) for x in discover.contained(t, n, bound).collect()} == want
    assert len(want) > 100 and discover.contained(t, n.limit(0)).count() == 0 and discover.contained(t.limit(0), n).count() == 0
    plan = discover.contained(t, n)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def plain_lcs(a, b):
    return resolve.lcs_similarity(a, b)


def test_similarity_is_the_plain_rule(spark):
    r = random.Random(5)
    make = lambda most, letters: "".join(r.choice(letters) for _ in range(r.randint(0, most)))
    pairs = [(make(9, "ab"), make(9, "abc")) for _ in range(400)] + [(make(70, "abcdé"), make(70, "abcd漢")) for _ in range(200)] + [(make(200, "ab"), make(200, "ab")) for _ in range(20)]
    pairs += [("a" * n, "a" * m) for n, m in ((62, 62), (63, 62), (124, 125), (61, 200))] + [("", ""), ("a", ""), ("", "b"), ("😀a", "a😀")]
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, a string, b string").select("k", resolve.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(x["s"] - plain_lcs(*pairs[x["k"]])) < 1e-12 for x in got) and len(got) == len(pairs)


@pytest.mark.parametrize("threshold,n", [(0.85, 700), (0.6, 150)])
def test_similar_pairs_are_all_there(spark, threshold, n):
    """Against every pair; candidates are a small part of all, and no gram joins more than a set share of them."""
    r = random.Random(int(threshold * 100))
    stems = ["customer#0000", "supplier#00", "", "re", "connection "]
    words = sorted({r.choice(stems) + "".join(r.choice("abcdeéfgh0123456789") for _ in range(r.randint(1, 9))) for _ in range(n)})
    asked = sorted({w[: k - 1] + r.choice("xyz") + w[k + r.randint(0, 1) :] for w in words[:: max(1, n // 60)] for k in [r.randint(1, len(w))]} | {"a", "ab"})
    df = lambda x: spark.createDataFrame([(w,) for w in x], "s string")
    found = {tuple(p) for p in resolve.similar_pairs(df(asked), df(words), threshold).collect()}
    want = {(q, w) for q in asked for w in words if q != w and resolve.lcs_similarity(q, w) >= threshold}
    assert want <= found and len(want) > 20
    if threshold > 0.8:
        assert len(found) < 0.3 * len(asked) * len(words)
    nodes = spark.createDataFrame([(i, i, w, []) for i, w in enumerate(words)], "id long, seq long, name string, aliases array<string>")
    best = {x["query"]: (x["id"], round(x["score"], 9)) for x in resolve.resolve(df(asked), nodes, threshold).collect()}
    for q in asked:
        score, k = max((1.0 if q == w else resolve.lcs_similarity(q, w), -i) for i, w in enumerate(words))
        assert best.get(q) == ((-k, round(score, 9)) if score >= threshold else None)


def test_domain_and_ends_of_relation_types(spark, tmp_path):
    kg = KnowledgeGraph(spark, f"file://{tmp_path}/g")
    kg.update_ontology(json.dumps({"domain": "ships", "suggested_entity_types": [{"name": "Ship", "description": "floats", "parent": "Thing"}], "suggested_relation_types": [{"name": "owns", "description": "has", "from_types": ["Person", 3], "to_types": ["Ship"]}]}))
    kg.update_ontology(json.dumps({"domain": "other", "suggested_relation_types": [{"name": "OWNS", "from_types": ["x"]}, {"name": "sails"}]}))
    kg.save()
    again = KnowledgeGraph(spark, f"file://{tmp_path}/g")
    assert again.domain() == "ships" and again.graph.node_types.first()["parent"] == "Thing"
    kinds = {r["name"]: (r["from_types"], r["to_types"]) for r in again.get_ontology()[1].collect()}
    assert kinds == {"owns": (["Person"], ["Ship"]), "sails": ([], [])}
    asked = again.analyze_content("about ships")
    assert "- Ship (floats)" in asked and "- owns (has) [Person -> Ship]" in asked and asked.endswith("about ships")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_texts_are_cut_into_grams_once(spark):
    t = spark.createDataFrame([(k, f"seen in NATION_{k % 3}") for k in range(300)] + [(300, None), (301, "x")], "id long, text string")
    n = spark.createDataFrame([(k, f"Nation_{k % 5}") for k in range(10)] + [(10, "seen"), (11, "abc")], "id long, name string")
    got = discover.contained(t, n, 0)
    assert re.search(r"HashAggregate\(keys=\[t#", plan_of(got))
    want = [(k, j) for k in range(300) for j in (*[i for i in range(10) if i % 5 == k % 3], 10)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_edges_of_either_direction_are_left_out_without_a_distinct(spark):
    nodes = spark.createDataFrame([(1, "alpha", "alpha is not beta"), (2, "beta", "beta and gamma"), (3, "gamma", "gamma, then alpha")], "id long, name string, definition string").withColumn("source", F.lit("x"))
    edges = spark.createDataFrame([(2, 1), (2, 1), (2, 3), (1, 1)], "src long, dst long")
    got = discover.discover_connections(Graph(nodes, edges))
    assert not re.search(r"keys=\[src#\d+L, dst#\d+L\]", plan_of(got))
    assert [(r["src"], r["dst"]) for r in got.collect()] == [(3, 1)]
