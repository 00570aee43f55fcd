"""Command line: ``python -m graphloom.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from .api import KnowledgeGraph
from .functions.text import facts
from .operators import impact
from .session import session
from .sources import store
from .streaming import monitor


def _rows(df) -> None:
    """All rows, a partition at a time."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def _usage(spark, path: str, threshold: int, window: int):
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(Path(path).read_text().split("\n"))], "line_no long, value string") if Path(path).exists() else None
    if lines is None:
        return None
    log = monitor.read_usage(lines).withColumn("key", F.lit("log"))
    return monitor.last_usage(log, "key", "line_no", threshold, window).first()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom")
    top.add_argument("--graph", default="graph-store")
    top.add_argument("--config", help="configuration in TOML; without it the defaults hold")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        own = sub.add_parser(name)
        for names, options in arguments:
            own.add_argument(*names, **options)

    for name in ("stats", "topics"):
        add(name)
    for name in ("explore", "lookup"):
        add(name, (("name",), {}))
    add("connect", (("a",), {}), (("b",), {}))
    add("recent", (("k",), {"nargs": "?", "type": int, "default": 10}))
    for name in ("export", "sync-rules", "build-index"):
        add(name, (("out",), {}))
    for name in ("init", "bootstrap"):
        add(name, (("base",), {"nargs": "?", "default": "."}), (("--transcripts",), {"help": "folder with a folder of transcripts for each project"}))
    add("impact", (("name",), {}), (("--depth",), {"type": int, "default": 1}), (("--report",), {"action": "store_true"}))
    add("quick-impact", (("event",), {"nargs": "?"}))
    add("impact-from-diff", (("event",), {"nargs": "?"}), (("--names",), {"action": "store_true", "help": "reports of all names in the old text"}))
    add("file-rule", (("path",), {}))
    add("reindex", (("base",), {}), (("file",), {}))
    add("reconcile", (("input",), {"nargs": "?"}))
    add("snapshot", (("text",), {"nargs": "?"}))
    for name in ("monitor", "tick"):
        add(name, (("log",), {}), (("--threshold",), {"type": int, "help": "else the configuration's"}), (("--window",), {"type": int, "default": 200_000}), (("--every",), {"type": int, "help": "else the configuration's"}), (("--counter",), {"default": ".tick"}))
    add("file-context", (("path",), {}), (("--budget",), {"type": int, "default": 300}))
    add("relevant", (("query",), {}), (("--budget",), {"type": int, "default": 500}))
    add("context", (("--budget",), {"type": int}))
    add("accuracy-bench", (("folder",), {}), (("--case",), {}), (("--repo",), {"action": "append", "default": [], "help": "NAME=DIR"}))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark, now = session(), int(time.time())
    config = store.load_config(a.config) if a.config else store.Config()
    if a.command in ("monitor", "tick"):
        a.threshold = config.threshold_pct if a.threshold is None else a.threshold
        a.every = config.snapshot_every if a.every is None else a.every
    read = lambda x: x if x is not None else sys.stdin.read()
    if a.command == "monitor":
        found = _usage(spark, a.log, a.threshold, a.window)
        print(json.dumps(found.asDict() if found else {"error": "no usage"}))
        return int(bool(found and found["should_extract"]))
    if a.command == "tick":
        found, file = _usage(spark, a.log, a.threshold, a.window), Path(a.counter)
        count = (int(file.read_text().strip() or 0) if file.exists() else 0) + 1
        action = "Extract" if found and found["should_extract"] else "Snapshot" if count >= a.every else "None"
        file.write_text(str(count if action == "None" else 0))
        print(json.dumps({"action": action, "counter": count if action == "None" else 0}))
        return int(action == "Extract")
    if a.command == "snapshot":
        _rows(facts(spark.createDataFrame([(1, read(a.text))], "doc_id long, text string")).select("fact_type", "fact"))
        return 0
    kg = KnowledgeGraph(spark, a.graph)
    if a.command in ("init", "bootstrap"):
        found = kg.bootstrap_all(a.base, config, a.transcripts, now)
        kg.save()
        for name, texts in (("conversations", found.conversations), ("documents", found.documents)):
            texts.write.mode("overwrite").json(f"{a.graph}/texts/{name}")
        counts = [spark.read.schema(df.schema).json(f"{a.graph}/texts/{name}").count() for name, df in (("conversations", found.conversations), ("documents", found.documents))]
        print("files %d, entities %d, conversations %d, document chunks %d" % (found.files, found.entities, *counts))
        if a.command == "init":
            store.write_rules(kg.graph, f"{a.graph}/rules")
            store.write_index(impact.name_index(kg.graph), f"{a.graph}/name-index")
    elif a.command == "reindex":
        kg.reindex(a.base, a.file, now)
        kg.save_changes()
    elif a.command == "reconcile":
        print(json.dumps(kg.reconcile(read(a.input), now)))
        kg.save_changes()
    elif a.command == "connect":
        print(kg.connect(a.a, a.b))
    elif a.command == "export":
        kg.export_json(a.out)
    elif a.command == "sync-rules":
        store.write_rules(kg.graph, a.out)
    elif a.command == "build-index":
        store.write_index(impact.name_index(kg.graph), a.out)
    elif a.command == "quick-impact":
        event = json.loads(read(a.event))
        _rows(impact.quick_impact(impact.name_index(kg.graph), event.get("tool_input", event).get("old_string", "")))
    elif a.command == "impact-from-diff":
        print(kg.impact_of_text(read(a.event), config.depth) if a.names else kg.impact_from_change(read(a.event)))
    elif a.command == "impact" and a.report:
        print(kg.impact_report(a.name, a.depth))
    elif a.command == "file-rule":
        print(kg.file_rule(a.path))
    elif a.command == "accuracy-bench":
        print(kg.accuracy(a.folder, dict(x.split("=", 1) for x in a.repo), a.case))
    else:
        _rows({
            "stats": lambda: kg.stats(), "topics": lambda: kg.topics(), "explore": lambda: kg.explore(a.name), "lookup": lambda: kg.lookup(a.name), "recent": lambda: kg.recent(a.k), "impact": lambda: kg.impact(a.name, a.depth),
            "file-context": lambda: kg.file_context(a.path, a.budget), "relevant": lambda: kg.relevant(a.query, a.budget), "context": lambda: kg.context(now, a.budget or config.budget),
        }[a.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
