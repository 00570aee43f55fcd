"""What a change to an entity touches. Depth is one or two; every node of a matching name counts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..schema import FACT_TYPES, Graph
from .navigation import inbound_counts, lookup, neighbors, normal, without
from .paths import checkpointed
from .ranking import is_code, same_path


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def short_name(name: Column) -> Column:
    """What follows the last :: and then the last dot."""
    return F.element_at(F.split(F.element_at(F.split(name, "::"), -1), r"\."), -1)


def matching(nodes: DataFrame, name: str) -> DataFrame:
    """(node) by the first rule that finds any: exact name (no file or import); a name that ends in .name (no import); look-up."""
    key, own = name.strip(WHITE).lower(), normal(F.col("name"))
    step = F.when((own == key) & ~F.col("node_type").isin("File", "Import"), 1).when(own.endswith("." + key) & (F.col("node_type") != "Import"), 2)
    ranked = nodes.withColumn("step", step).where("step is not null").select("id", "step").unionByName(lookup(nodes, name).select("id", F.lit(3).alias("step")))
    best = ranked.agg(F.min("step").alias("best"))
    return ranked.join(F.broadcast(best), F.col("step") == F.col("best")).select(F.col("id").alias("node")).distinct()  # one row


def impact(graph: Graph, name: str, depth: int = 1) -> DataFrame:
    """(depth, name, relation_type, direction, place) of the neighbours, and at depth 2 of theirs; place: file or semantic."""
    start = checkpointed(matching(graph.nodes, name))  # read by several joins
    place = F.coalesce(F.col("other_source.file"), F.lit("semantic")).alias("place")
    direct = checkpointed(neighbors(graph, start)) if depth > 1 else neighbors(graph, start)
    out = direct.select(F.lit(1).alias("depth"), F.col("other_name").alias("name"), "relation_type", "direction", place)
    if depth > 1:
        edge_of = direct.select(F.col("other").alias("node")).distinct()
        second = without(neighbors(graph, edge_of), "other", start)
        out = out.unionByName(second.select(F.lit(2).alias("depth"), F.col("other_name").alias("name"), "relation_type", "direction", place))
    return out.distinct()


def impact_lines(graph: Graph, name: str, depth: int = 1) -> DataFrame | None:
    """What a change to an entity touches as lines (section, k1 to k4, line): references, at depth 2 indirect ones, and warnings; None if nothing
    has that name. Of each neighbour and relation the first edge counts. All are there: the order is that of section and keys."""
    start = checkpointed(matching(graph.nodes, name))
    title = graph.nodes.join(start, F.col("id") == F.col("node")).orderBy("seq").select("name").first()
    if title is None:
        return None
    place = F.coalesce(F.when(F.col("other_source.kind") == "CodeAnalysis", F.col("other_source.file")), F.lit("semantic")).alias("place")
    arrow = F.when(F.col("direction") == "outgoing", "→").otherwise("←").alias("arrow")
    first = F.min(F.struct("edge_seq", "other", arrow, F.col("other_type").alias("kind"), place)).alias("x")
    direct = checkpointed(neighbors(graph, start).groupBy(F.col("other_name").alias("name"), "relation_type").agg(first).select("name", "relation_type", "x.*"))
    spark, n = graph.nodes.sparkSession, direct.count()

    def section(k: int, rows: DataFrame, keys: list[str], *line) -> DataFrame:
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys] + [F.lit("")] * (4 - len(keys))
        return rows.select(F.lit(k).alias("section"), *[c.alias(f"k{i}") for i, c in enumerate(keys, 1)], F.concat(*[F.lit(x) if x in _PLAIN else F.coalesce(F.col(x), F.lit("")) for x in line]).alias("line"))

    def text(k: int, *lines: str) -> DataFrame:
        return spark.createDataFrame([(k, f"{i:04d}", "", "", "", x) for i, x in enumerate(lines)], "section int, k1 string, k2 string, k3 string, k4 string, line string")

    if not n:
        return text(0, f"## Impact: {title['name']}", "", "No references found.")
    out = text(0, f"## Impact: {title['name']}", "", f"References ({n}):").unionByName(section(1, direct, ["name", "relation_type"], "- ", "arrow", " ", "name", " (", "relation_type", ") [", "kind", "] in ", "place"))
    if depth > 1:
        via = direct.select(F.col("other").alias("node"), F.col("name").alias("via")).distinct()
        second = without(neighbors(graph, via.select("node").distinct()), "other", start).join(via, "node")
        second = checkpointed(second.select("via", F.col("other_name").alias("name"), "relation_type", place).distinct())
        if m := second.count():
            out = out.unionByName(text(2, "", f"Indirect ({m}):")).unionByName(section(3, second, ["via", "name", "relation_type", "place"], "- ", "via", " → ", "name", " (", "relation_type", ") in ", "place"))
    warned = breaking_changes(direct, "place")
    if warned.limit(1).count():
        out = out.unionByName(text(4, "", "Breaking changes:")).unionByName(section(5, warned, ["place", "warning"], "- ", "place", ": ", "warning"))
    return out


_PLAIN = {"- ", " ", " (", ") [", "] in ", " → ", ") in ", ": "}


def impact_report(graph: Graph, name: str, depth: int = 1) -> str:
    """``impact_lines`` as one text, all of them, fetched a partition at a time."""
    lines = impact_lines(graph, name, depth)
    if lines is None:
        return f"No entity found: {name}"
    ordered = lines.orderBy("section", "k1", "k2", "k3", "k4")
    return "\n".join(r["line"] for r in ordered.toLocalIterator()) + "\n"


def impact_of_text(graph: Graph, event: str, depth: int = 1) -> str:
    """The reports of all code entities, decisions and error resolutions whose whole name (three bytes or more) is in the old text of a
    change event; empty if the event is no change or what it names has no references."""
    try:
        old = json.loads(event).get("old_string") or ""
    except (ValueError, AttributeError):
        return ""
    known = is_code() | F.col("node_type").isin("Decision", "ErrorResolution")
    named = graph.nodes.where(F.coalesce(known, F.lit(False)) & (F.octet_length("name") >= 3) & F.lit(old).contains(F.col("name")))
    names = named.groupBy("name").agg(F.min("seq").alias("seq")).orderBy("seq").collect()  # parts of one text
    reports = [impact_report(graph, r["name"], depth) for r in names]
    return "\n".join(x for x in reports if "\nReferences (" in x)


def _warnings(path: Column) -> Column:
    return F.array_compact(F.array(F.when(path.contains("storage") | path.contains("serial"), "stored data may fail to deserialise"), F.when(path.contains("python"), "Python callers may break")))


def breaking_changes(affected: DataFrame, *columns: str) -> DataFrame:
    """Distinct warnings for the places of ``affected``, of each value of ``columns`` if given: stored formats, and the Python surface."""
    return affected.select(*columns, F.explode(_warnings(F.lower("place"))).alias("warning")).distinct()


def reference_files(graph: Graph, name: str) -> DataFrame:
    """Distinct normalised code files of the edges into any match."""
    target = matching(graph.nodes, name).withColumnRenamed("node", "dst")
    path = F.regexp_replace(F.trim(F.replace(F.col("source.file"), F.lit("\\"), F.lit("/"))), r"^(\./)+", "")
    return graph.edges.where(is_code()).join(target, "dst", "left_semi").select(path.alias("file")).distinct()


def pattern_groups(references: DataFrame) -> DataFrame:
    """References grouped by verb and target: count, number of base file names, and the first five."""
    verb = F.expr("case ref_type when 'ReadsField' then 'reads' when 'WritesField' then 'writes' when 'UsesType' then 'uses' when 'MethodCall' then 'calls .' else 'calls' end")
    name = F.col("target") if "target" in references.columns else F.col("target_name")
    keyed = references.select(F.concat(verb, F.lit(" "), name).alias("pattern"), base_name(F.col("source_file")).alias("base"))
    by_file = keyed.groupBy("pattern", "base").agg(F.count(F.lit(1)).alias("n"))
    counts = by_file.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("base").alias("total_files"))
    # Five of each pattern by rank, which Spark limits before it shuffles them.
    ranked = by_file.withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy("base"))).where("k <= 5 and base is not null")
    shown = ranked.groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "base"))), lambda x: x["base"]), ", ").alias("example_files"))
    return counts.join(shown, "pattern", "left").select("pattern", "n", "total_files", F.coalesce("example_files", F.lit("")).alias("example_files"))


def format_patterns(patterns: DataFrame) -> str:
    """The report as text; a list of patterns is small."""
    rows = patterns.orderBy(F.desc("n"), "pattern").collect()
    if not rows:
        return ""
    lines = [f"{sum(r['n'] for r in rows)} references in {sum(r['total_files'] for r in rows)} files"]
    for r in rows:
        names = r["example_files"].split(", ")
        shown = ", ".join(names) if r["total_files"] <= 5 else f"{', '.join(names[:3])} +{r['total_files'] - 3}"
        lines.append(f"- {r['pattern']}: {r['n']} ({shown})")
    return "\n".join(lines)


def name_index(graph: Graph, least: int = 3) -> DataFrame:
    """(name, node_type, refs, files) of code entities by short name: type of the first, most inbound references of one node,
    its first ten referencing files."""
    kinds = ["Function", "Method", "Struct", "Field", "Enum", "Trait", "Const", "Part", "Supplier"]
    own = graph.nodes.where(F.col("node_type").isin(*kinds)).select("id", "seq", "node_type", short_name(F.col("name")).alias("short")).where(F.octet_length("short") >= least)
    heads = own.join(inbound_counts(graph.edges), "id").groupBy("short").agg(F.min_by("node_type", "seq").alias("node_type"), F.max("inbound").alias("refs"))
    files = graph.edges.where(is_code()).select(F.col("dst").alias("id"), F.col("source.file").alias("file")).distinct().join(own.select("id", "short"), "id").select("short", "file").distinct()
    # The first ten by rank: an entity that all files use does not gather them.
    ranked = files.withColumn("k", F.row_number().over(Window.partitionBy("short").orderBy("file"))).where("k <= 10")
    listed = ranked.groupBy("short").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "file"))), lambda x: x["file"]), ",").alias("files"))
    return heads.join(listed, "short", "left").select(F.col("short").alias("name"), "node_type", "refs", F.coalesce("files", F.lit("")).alias("files"))


def quick_impact(index: DataFrame, old_text: str) -> DataFrame:
    """Index rows whose name the text contains."""
    return index.where(F.lit(old_text).contains(F.col("name")))


def changed_entities(graph: Graph, path: str, old_text: str) -> DataFrame:
    """Nodes that a change touches: those of the file with a short name (three bytes or more) in the text, else any code or fact
    node with a short name of six bytes or more in it."""
    short = short_name(F.col("name"))
    hit = F.lit(old_text).contains(short)
    there = is_code() & same_path(F.col("source.file"), F.lit(path)) & ~F.col("node_type").isin("File", "Import") & (F.octet_length(short) >= 3)
    anywhere = (is_code() | F.col("node_type").isin(*FACT_TYPES)) & ~F.col("node_type").isin("File", "Import") & (F.octet_length(short) >= 6)
    found = graph.nodes.where(hit & (F.coalesce(there, F.lit(False)) | F.coalesce(anywhere, F.lit(False)))).withColumn("step", F.when(F.coalesce(there, F.lit(False)), 1).otherwise(2))
    best = found.agg(F.min("step").alias("best"))
    return found.join(F.broadcast(best), F.col("step") == F.col("best")).drop("step", "best")  # one row


def impact_from_change(graph: Graph, event: str) -> str:
    """The pattern report of a change event as a JSON envelope; empty if the event is no change or touches nothing."""
    try:
        found = json.loads(event)
    except ValueError:
        return ""
    found = found.get("tool_input", found) if isinstance(found, dict) else {}
    old, path = found.get("old_string") or "", found.get("file_path") or ""
    if not old:
        return ""
    touched = changed_entities(graph, path, old).select(F.col("id").alias("dst"), F.col("name").alias("target"))
    kind = F.expr("case relation_type when 'reads' then 'ReadsField' when 'writes' then 'WritesField' when 'uses_type' then 'UsesType' else 'Calls' end")
    references = graph.edges.where(is_code()).join(touched, "dst").select(F.col("source.file").alias("source_file"), "target", kind.alias("ref_type"))
    report = format_patterns(pattern_groups(references))
    return json.dumps({"hookSpecificOutput": {"hookEventName": "PreToolUse", "additionalContext": report}}) if report else ""
