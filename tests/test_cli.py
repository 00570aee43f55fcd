"""The command line over a small project, and transcripts and documents as sources."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.api import KnowledgeGraph
from graphloom.schema import Graph
from graphloom.sources import conversations, store


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src/app").mkdir(parents=True)
    (tmp_path / "src/app/errors.py").write_text("class AppError(Exception):\n    pass\n")
    (tmp_path / "src/app/main.py").write_text("from .errors import AppError\n\ndef run():\n    raise AppError('x')\n")
    return tmp_path


def call(capsys, *argv):
    code = cli.main(list(argv))
    return code, capsys.readouterr().out


def test_project(spark, project, capsys):
    graph = f"file://{project}/graph"
    base = ["--graph", graph]
    code, out = call(capsys, *base, "init", f"file://{project}/src")
    assert code == 0 and out.startswith("files 2, entities ")
    assert any(r[0].startswith("AppError|Struct|") for r in spark.read.text(f"{graph}/name-index").collect())
    assert json.loads(call(capsys, *base, "stats")[1])["node_count"] == 5
    assert "app/main.py" in call(capsys, *base, "impact", "AppError")[1]
    assert "app/main.py" in call(capsys, *base, "connect", "app/main.py", "AppError")[1]
    event = json.dumps({"file_path": "app/errors.py", "old_string": "class AppError(Exception)"})
    assert "AppError" in json.loads(call(capsys, *base, "impact-from-diff", event)[1])["hookSpecificOutput"]["additionalContext"]
    (project / "src/app/errors.py").write_text("class AppError(Exception):\n    pass\nclass Other(AppError):\n    pass\n")
    call(capsys, *base, "reindex", f"file://{project}/src", "app/errors.py")
    assert "Other" in call(capsys, *base, "lookup", "Other")[1]
    facts = json.dumps({"new_facts": [{"name": "Keep errors small", "type": "Decision", "tier": "Critical", "definition": "one class"}], "relations": [{"from": "Keep errors small", "to": "AppError", "type": "about"}]})
    done = json.loads(call(capsys, *base, "reconcile", facts)[1])
    assert (done["added"], done["edges_new"]) == (1, 1)
    assert "Keep errors small" in call(capsys, *base, "context", "--budget", "500")[1]
    # Reconcile, collect and then read a file again, all on one graph.
    (project / "src/app/errors.py").write_text("class AppError(Exception):\n    pass\nclass Third(AppError):\n    pass\n")
    call(capsys, *base, "reindex", f"file://{project}/src", "app/errors.py")
    assert "Third" in call(capsys, *base, "lookup", "Third")[1] and "Other" not in call(capsys, *base, "recent", "50")[1]
    def check_facts():
        rows = {r["name"]: r for r in map(json.loads, call(capsys, *base, "recent", "50")[1].splitlines())}
        assert "Keep errors small" in rows
        assert "--[about]-->" in call(capsys, *base, "connect", "Keep errors small", "AppError")[1]
        return rows
    ids = {n: r["id"] for n, r in check_facts().items() if r["node_type"] == "Decision"}
    report = call(capsys, *base, "impact", "AppError", "--report", "--depth", "2")[1]
    assert report.startswith("## Impact: AppError") and "- ← app/main.py (" in report and "Keep errors small (about) [Decision] in semantic" in report
    assert "AppError" in call(capsys, *base, "impact-from-diff", "--names", json.dumps({"old_string": "raise AppError()"}))[1]
    assert "AppError: " in call(capsys, *base, "file-rule", "app/errors.py")[1]
    # All channels: code with package manifests, transcripts of the project, configured documents.
    line = lambda role, content: json.dumps({"type": role, "sessionId": "s", "timestamp": content, "message": {"role": role, "content": content}})
    talk = project / "talk" / conversations.project_key(f"{project}/src")
    talk.mkdir(parents=True)
    (talk / "a.jsonl").write_text("\n".join([line("user", "explain this module to me"), line("assistant", "it is a long story indeed"), line("user", "and now the second part")]))
    (project / "src/notes.md").write_text("One sentence here. " * 400)
    (project / "conf.toml").write_text('[sources]\ndocuments = ["notes.md", "missing.md"]\n')
    (project / "src/pkg/lib").mkdir(parents=True)
    (project / "src/pkg/package.json").write_text('{"name": "@me/pkg", "main": "lib/x"}')
    (project / "src/pkg/lib/x.js").write_text("export function packed() {}\n")
    (project / "src/use.ts").write_text("import { packed } from '@me/pkg';\npacked();\n")
    again = call(capsys, "--config", str(project / "conf.toml"), *base, "bootstrap", f"file://{project}/src", "--transcripts", str(project / "talk"))[1]
    assert again.startswith("files 4") and "conversations 1, document chunks 2" in again
    assert "explain this module" in spark.read.json(f"{graph}/texts/conversations").first()["text"]
    assert "use.ts" in call(capsys, *base, "impact", "packed")[1]
    assert ids == {n: r["id"] for n, r in check_facts().items() if r["node_type"] == "Decision"}
    suite = project / "suite"
    (suite / "cases").mkdir(parents=True)
    (suite / "repos.toml").write_text('[app]\nurl = "u"\ncommit = "c"\n')
    (suite / "cases/a.toml").write_text('name = "a"\nrepo = "app"\nentity = "AppError"\nexpected_files = ["./app/main.py", "app/errors.py"]\n')
    report = call(capsys, *base, "accuracy-bench", str(suite), "--repo", f"app=file://{project}/src")[1]
    assert "TOTAL: precision 1.000 recall 1.000 f1 1.000" in report


def test_store_keeps_the_last_whole_version(spark, tmp_path, monkeypatch):
    """A writer that stops before its head is there leaves the version before; heads are never replaced."""
    kg, path = KnowledgeGraph(spark, f"file://{tmp_path}/g"), f"file://{tmp_path}/g"
    for k in range(11):
        kg.graph.nodes = spark.createDataFrame([(k, f"n{k}")], "id long, name string")
        if k < 2 or k == 10:
            kg.save()
    heads = store._heads(spark, path)
    assert len(heads) == 3 and store.load(spark, path).nodes.first()["name"] == "n10"
    kg.graph.nodes = spark.createDataFrame([(99, "lost")], "id long, name string")
    monkeypatch.setattr(store.json, "dumps", lambda x: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kg.save()
    monkeypatch.undo()
    assert store._heads(spark, path) == heads and store.load(spark, path).nodes.first()["name"] == "n10"
    (tmp_path / "g" / "HEAD-999999999999-x").write_text("no json")
    with pytest.raises(store.StoreError):
        store.load(spark, path)
    with pytest.raises(store.StoreError):
        store.load(spark, f"file://{tmp_path}/none")


def test_usage_commands(spark, tmp_path, capsys):
    log, counter = tmp_path / "log.jsonl", str(tmp_path / "tick")
    use = lambda n: json.dumps({"type": "assistant", "message": {"role": "assistant", "usage": {"input_tokens": n}}})
    log.write_text(use(8000) + "\nbad\n")
    assert json.loads(call(capsys, "monitor", str(log))[1])["used_pct"] == 4
    ticks = [json.loads(call(capsys, "tick", str(log), "--counter", counter, "--every", "3")[1]) for _ in range(4)]
    assert [t["action"] for t in ticks] == ["None", "None", "Snapshot", "None"] and ticks[3]["counter"] == 1
    log.write_text(use(178000))
    code, out = call(capsys, "tick", str(log), "--counter", counter)
    assert code == 1 and json.loads(out)["action"] == "Extract"
    assert call(capsys, "monitor", str(tmp_path / "none"))[0] == 0
    assert "Decision" in call(capsys, "snapshot", "we decided to keep the cache small")[1]


def test_sources(spark, tmp_path):
    line = lambda role, content: json.dumps({"type": role, "sessionId": "s", "timestamp": str(hash(content)), "message": {"role": role, "content": content}})
    folder = tmp_path / "-home-me-proj"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([line("user", "explain this module to me"), line("assistant", "it is a long story indeed"), line("user", "and now the second part")]))
    (folder / "b.jsonl").write_text(line("user", "alone"))
    assert conversations.find_project(str(tmp_path), "/home/me/proj") == str(folder) == conversations.find_project(str(tmp_path), "/x/proj")
    messages = conversations.read_messages(spark, f"file://{folder}")
    texts = {r["session_id"]: r["text"] for r in conversations.conversations(messages).collect()}
    assert texts["s"].startswith("[User]: explain this module") or len(texts) == 1
    assert conversations.list_projects(str(tmp_path)) == ["/home/me/proj"]
    assert conversations.summaries(messages).count() >= 1 and conversations.session_text(messages, "user").count() >= 1
    (tmp_path / "doc.md").write_text("One sentence here. " * 400)
    chunks = conversations.documents(spark, [str(tmp_path / "doc.md"), str(tmp_path / "missing.md")])
    assert chunks.count() > 1
    # Texts that begin with a bracket are texts, arrays are blocks.
    block = json.dumps({"type": "user", "sessionId": "t", "timestamp": "1", "message": {"role": "user", "content": [{"type": "text", "text": "in a block"}]}})
    (folder / "a.jsonl").write_text("\n".join([line("user", "[note] please read this"), line("assistant", '[{"type": "text", "text": "quoted"}]'), "bad", block]))
    got = [r["content"] for r in conversations.read_messages(spark, f"file://{folder}/a.jsonl").orderBy("ord").collect()]
    assert got == ["[note] please read this", '[{"type": "text", "text": "quoted"}]', "in a block"]
    bad = tmp_path / "c.toml"
    bad.write_text("not = [toml")
    with pytest.warns(UserWarning):
        assert store.load_config(str(bad)).budget == 2000


def test_two_bases_and_configured_sources(spark, tmp_path):
    """A second base leaves the first one's code, also where paths are equal; patterns say which code; documents may be URIs."""
    for name, text in (("one", "def first(): pass\n"), ("two", "def second(): pass\n")):
        (tmp_path / name / "lib").mkdir(parents=True)
        (tmp_path / name / "lib/main.py").write_text(text)
        (tmp_path / name / "lib/tool.js").write_text(f"function {name}Tool() {{}}\n")
    (tmp_path / "one/notes.txt").write_text("some notes")
    kg = KnowledgeGraph(spark, f"file://{tmp_path}/graph")
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    assert kg.bootstrap(one) == (2, 2) and kg.bootstrap(two) == (2, 2)
    found = lambda: {(r["name"], r["source"]["file"]) for r in kg.graph.nodes.where("node_type <> 'File'").collect()}
    assert found() == {("first", "lib/main.py"), ("oneTool", "lib/tool.js"), ("second", "two/lib/main.py"), ("twoTool", "two/lib/tool.js")}
    (tmp_path / "two/lib/tool.js").unlink()
    (tmp_path / "two/lib/main.py").write_text("def third(): pass\n")
    kg.save()
    kg.reindex(two, "lib/main.py")
    kg.save_changes()
    assert ("third", "two/lib/main.py") in found() and len(found()) == 4
    kg.bootstrap(two)
    assert found() == {("first", "lib/main.py"), ("oneTool", "lib/tool.js"), ("third", "two/lib/main.py")}
    config = store.Config(code=["**/*.py"], documents=["notes.txt", f"file://{tmp_path}/one/notes.txt", "file:///no/such", "hdfs-like/none.txt"])
    report = kg.bootstrap_all(one, config)
    assert report.files == 1 and [r["text"] for r in report.documents.collect()] == ["some notes"] * report.documents.count() and report.documents.count() >= 1
    assert ("oneTool", "lib/tool.js") not in found()


def test_thresholds_come_from_the_configuration(spark, tmp_path, capsys):
    usage = {"input_tokens": 100_000, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 0, "output_tokens": 5}
    (tmp_path / "log").write_text(json.dumps({"type": "assistant", "message": {"role": "assistant", "usage": usage}}) + "\n")
    (tmp_path / "c.toml").write_text("[extraction]\nthreshold_pct = 40\nsnapshot_every = 1\n")
    own = ["--config", str(tmp_path / "c.toml")]
    assert call(capsys, *own, "monitor", str(tmp_path / "log"))[0] == 1 and call(capsys, "monitor", str(tmp_path / "log"))[0] == 0
    assert json.loads(call(capsys, *own, "tick", str(tmp_path / "none"), "--counter", str(tmp_path / "n"))[1])["action"] == "Snapshot"
    assert json.loads(call(capsys, "tick", str(tmp_path / "none"), "--counter", str(tmp_path / "m"))[1])["action"] == "None"


def test_all_rows_are_printed(spark, tmp_path, capsys):
    """1,500 neighbours are 1,500 lines, and as many in a report."""
    kg = KnowledgeGraph(spark, f"file://{tmp_path}/graph")
    nodes = spark.range(1, 1502).select("id", F.col("id").alias("seq"), F.concat(F.lit("node_"), "id").alias("name"), F.lit("Function").alias("node_type"), F.lit("x").alias("definition"))
    edges = spark.range(2, 1502).select("id", F.col("id").alias("seq"), F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("calls").alias("relation_type"))
    kg.graph = Graph(kg.graph.nodes.unionByName(nodes, allowMissingColumns=True), kg.graph.edges.unionByName(edges, allowMissingColumns=True))
    kg.save()
    base = ["--graph", f"file://{tmp_path}/graph"]
    assert len(call(capsys, *base, "impact", "node_1")[1].splitlines()) == 1500
    assert call(capsys, *base, "impact", "node_1", "--report")[1].count("- → node_") == 1500
