"""From extracted entities and references to a graph: imports to files, names to definitions, references to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.mutation import remove_nodes
from ..operators.paths import checkpointed
from ..operators.ranking import is_code
from ..schema import Graph
from ..sources import code
from ..sources.vocabulary import EXTENSIONS

# What an import may leave out, in the order in which it is tried.
SUFFIXES = [f".{e}" for e in ("py", "ts", "tsx", "js", "jsx", "rs", "go", "java", "cs")]
INDEXES = ["/index.ts", "/index.js", "/index.tsx", "/__init__.py", "/mod.rs"]


def module_of(text: Column) -> Column:
    """Module that an import statement names: a quoted specifier first; ``from X import``; ``import X`` up to a comma; ``use a::b``;
    else the statement. White space is collapsed and an end mark stripped."""
    one = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r";$", "")
    quoted = F.regexp_extract(one, r"""['"]([^'"]+)['"]""", 1)
    source = F.regexp_extract(one, r"^from (\S+) import", 1)
    plain = F.regexp_extract(one, r"^import (?:static )?([^,\s]+)", 1)
    used = F.regexp_extract(one, r"^(?:pub )?use (?:(?:crate|self|super)::)*([A-Za-z_]\w*)", 1)
    return F.when(quoted != "", quoted).when(source != "", source).when(plain != "", plain).when(used != "", used).otherwise(one)


def _directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def _under(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _climbed(path: Column) -> Column:
    """A path with ``./`` and ``x/../`` taken out."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, p: F.when(p.isin(".", ""), done).when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(p))))
    return F.array_join(parts, "/")


def imported_files(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(file, target, whole): the files that imports (file, text) mean; whole: all names (import *).

    Candidates are paths with a rank, joined by equality to the files: a package's entry; for relative modules the folder, dots
    resolved, with extensions and then indexes; for others the same folder; then any file that ends in the module's path at a
    path boundary. The least rank wins, then the least path.
    """
    asked = imports.select("file", module_of(F.col("text")).alias("module"), F.col("text").contains("import *").alias("whole")).distinct()
    module, here = F.col("module"), _directory(F.col("file"))
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    python = module.rlike(r"^\.+[A-Za-z_]|^\.+$")
    up = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise(F.lit(""))
    relative = F.when(python & ~module.startswith("./") & ~module.startswith("../"), F.concat(up, F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/")))).otherwise(module)
    is_relative = module.startswith(".")
    bare = F.when(module.contains("/"), module).otherwise(F.replace(F.replace(module, F.lit("::"), F.lit("/")), F.lit("."), F.lit("/")))
    base = F.when(is_relative, _climbed(_under(here, relative))).otherwise(_climbed(_under(here, bare)))
    forms = ["", *SUFFIXES, *INDEXES]
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat(base, F.lit(s)).alias("path")) for k, s in enumerate(forms)])
    exact = asked.select("*", F.explode(tries).alias("x")).join(files.select(F.col("path").alias("target")), F.col("x.path") == F.col("target")).select("file", "module", "whole", "target", F.col("x.rank").alias("rank"))
    # Every tail of a file's path, without what an import may leave out, is a key for the last rule.
    bared = F.regexp_replace(F.regexp_replace(F.col("path"), r"\.(" + "|".join(EXTENSIONS) + ")$", ""), r"/(index|__init__|mod)$", "")
    parts = F.split(bared, "/")
    tails = files.select(F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    ends = asked.where(~is_relative).withColumn("tail", bare).join(tails, "tail").select("file", "module", "whole", "target", F.lit(100).alias("rank"))
    found = exact.unionByName(ends)
    if packages is not None:
        entry = asked.join(packages.select("module", F.col("entry").alias("target")), "module").select("file", "module", "whole", "target", F.lit(-1).alias("rank"))
        found = found.unionByName(entry)
    best = found.where("file <> target").groupBy("file", "module", "whole").agg(F.min(F.struct("rank", "target")).alias("x"))
    return best.groupBy("file", F.col("x.target").alias("target")).agg(F.max("whole").alias("whole"))


def package_entries(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(module, entry) of package manifests (path, text): name with the file of exports["."], exports, main or src/index.ts; also each
    sub-path that exports names. Entries that are no file are tried with extensions and as src/index."""
    j = F.from_json("text", "name string, main string, exports string")
    read = manifests.select(_directory(F.col("path")).alias("dir"), j.alias("j")).where("j.name is not null")
    table = F.from_json("j.exports", "map<string,string>")
    target = lambda v: F.coalesce(F.get_json_object(v, "$.import"), F.get_json_object(v, "$.default"), F.get_json_object(v, "$.require"), v)
    subs = F.transform(F.filter(F.map_entries(table), lambda e: e["key"].startswith(".")), lambda e: F.struct(F.when(e["key"] == ".", F.col("j.name")).otherwise(F.concat(F.col("j.name"), F.substring(e["key"], 2, 10_000))).alias("module"), target(e["value"]).alias("entry")))
    alone = F.array(F.struct(F.col("j.name").alias("module"), F.coalesce(F.when(~F.col("j.exports").startswith("{"), F.col("j.exports")), F.col("j.main"), F.lit("src/index.ts")).alias("entry")))
    rows = read.select("dir", F.explode(F.when(F.coalesce(F.size(subs), F.lit(0)) > 0, subs).otherwise(alone)).alias("x")).select("dir", "x.module", "x.entry")
    base = _climbed(_under(F.col("dir"), F.col("entry")))
    stem = F.regexp_replace(base, r"\.\w+$", "")
    forms = [base, *[F.concat(stem, F.lit(s)) for s in (".ts", ".tsx", ".js", ".jsx", ".py")], _climbed(_under(F.col("dir"), F.lit("src/index.ts")))]
    tried = rows.select("module", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), f.alias("path")) for k, f in enumerate(forms)])).alias("x"))
    return tried.join(files.select("path"), F.col("x.path") == F.col("path")).groupBy("module").agg(F.min(F.struct("x.rank", "path")).alias("y")).select("module", F.col("y.path").alias("entry"))


def lookup_keys(entities: DataFrame) -> DataFrame:
    """(key, id, seq, file, name) of definitions: the name, and what follows its last :: and dot."""
    short = F.element_at(F.split(F.element_at(F.split("name", "::"), -1), r"\."), -1)
    own = entities.where(~F.col("entity_type").isin("Import", "File"))
    return own.select(F.explode(F.array_distinct(F.array("name", short))).alias("key"), "id", "seq", "file", "name")


def unique_global(keys: DataFrame) -> DataFrame:
    """(key, id, seq) of the keys that one definition has."""
    return keys.groupBy("key").agg(F.countDistinct("id").alias("n"), F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq")).where("n = 1").drop("n")


def import_closure(imported: DataFrame) -> DataFrame:
    """(file, target, hops): imports, and imports of imports."""
    direct = imported.select("file", "target").distinct()
    second = direct.join(direct.select(F.col("file").alias("target"), F.col("target").alias("further")), "target").select("file", F.col("further").alias("target")).where("file <> target")
    return direct.withColumn("hops", F.lit(1)).unionByName(second.withColumn("hops", F.lit(2))).groupBy("file", "target").agg(F.min("hops").alias("hops"))


def resolve_references(references: DataFrame, entities: DataFrame, imported: DataFrame) -> DataFrame:
    """references with dst and tier: same file 1, imported file 2, import of an import 3, a key (four bytes or more) that one
    definition in all has 4; the first by seq within a tier. References without any are dropped.

    Tiers 1 to 3 are equi-joins on (file, key), so a hub name meets its definitions only where files do; the last tier joins on
    the unique keys.
    """
    refs = references.withColumn("ref", F.monotonically_increasing_id()) if "ref" not in references.columns else references
    keys = lookup_keys(entities)
    reach = import_closure(imported).select("file", "target", (F.col("hops") + 1).alias("tier"))
    files = references.select(F.col("source_file").alias("file")).distinct()
    reach = reach.unionByName(files.select("file", F.col("file").alias("target"), F.lit(1).alias("tier")))
    near = reach.join(keys.select(F.col("file").alias("target"), "key", "id", "seq"), "target").groupBy("file", "key").agg(F.min(F.struct("tier", "seq", "id")).alias("x"))
    got = refs.join(near.select(F.col("file").alias("source_file"), F.col("key").alias("target_name"), "x"), ["source_file", "target_name"], "left")
    lone = unique_global(keys).select(F.col("key").alias("target_name"), F.struct(F.lit(4).alias("tier"), F.col("seq"), F.col("id")).alias("g")).where(F.octet_length("target_name") >= 4)
    got = got.join(lone, "target_name", "left").withColumn("hit", F.coalesce("x", "g")).where("hit is not null")
    return got.select("source_file", "source_line", "target_name", "ref_type", F.col("hit.id").alias("dst"), F.col("hit.tier").alias("tier"))


def _numbered(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(id, seq, name, entity_type, definition, file) of all entities and files. Numbers go by file, line and name: ranks of a
    sort, not of one task's counter."""
    keyed = entities.withColumn("order", F.struct("file", "line_start", "name", "entity_type"))
    parts = keyed.select("file", "name", "entity_type", "definition", "line_start", "order")
    file_rows = files.select(F.col("path").alias("file"), F.col("path").alias("name"), F.lit("File").alias("entity_type"), F.concat(F.lit("Source file "), F.col("path")).alias("definition"), F.lit(0).cast("long").alias("line_start"), F.struct(F.col("path").alias("file"), F.lit(0).cast("long").alias("line_start"), F.lit("").alias("name"), F.lit("File").alias("entity_type")).alias("order"))
    every = parts.unionByName(file_rows)
    # A file's first number is the number of rows in files before it; files are few against entities.
    sizes = every.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    ranged = checkpointed(sizes.repartitionByRange("file").withColumn("part", F.spark_partition_id()))
    parts_ = ranged.groupBy("part").agg(F.sum("n").alias("in_part")).withColumn("earlier", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part"))  # a row for each partition
    within = F.sum("n").over(Window.partitionBy("part").orderBy("file")) - F.col("n")
    starts = ranged.join(F.broadcast(parts_.select("part", "earlier")), "part").select("file", (F.col("earlier") + within).alias("before"))
    numbered = every.join(starts, "file").withColumn("id", F.col("before") + F.row_number().over(Window.partitionBy("file").orderBy("order", "definition")))
    return numbered.select("id", F.col("id").alias("seq"), "name", "entity_type", "definition", "file")


def _nodes(numbered: DataFrame, now: int) -> DataFrame:
    source = F.struct(F.lit("CodeAnalysis").alias("kind"), F.col("file")).alias("source")
    return numbered.select("id", "seq", "name", F.col("entity_type").alias("node_type"), "definition", F.array().cast("array<string>").alias("aliases"), F.lit(1.0).alias("confidence"), source, F.lit(now).cast("long").alias("created_at"), F.lit("Minor").alias("tier"), F.lit(None).cast("long").alias("superseded_by"))


def _edges(known: DataFrame, references: DataFrame, imported: DataFrame) -> DataFrame:
    """Merged edges from files: of resolved references, and of wildcard imports. An edge's id is a hash of 62 bits."""
    resolved = resolve_references(references, known, imported)
    relation = F.expr("case ref_type when 'ReadsField' then 'reads' when 'WritesField' then 'writes' when 'UsesType' then 'uses_type' else 'calls' end").alias("relation_type")
    file_ids = known.where("entity_type = 'File'").select(F.col("file").alias("source_file"), F.col("id").alias("src"))
    edges = resolved.join(file_ids, "source_file").select("src", "dst", relation, "source_file", "tier")
    wild = imported.where("whole").select(F.col("file").alias("source_file"), F.col("target").alias("file")).join(known.where("not startswith(name, '_') and entity_type not in ('File', 'Import')").select("file", F.col("id").alias("dst")), "file")
    edges = edges.unionByName(wild.join(file_ids, "source_file").select("src", "dst", F.lit("uses_type").alias("relation_type"), "source_file", F.lit(2).alias("tier")))
    merged = edges.where("src <> dst").groupBy("src", "dst", "relation_type", "source_file").agg(F.min("tier").alias("tier"))
    eid = F.shiftrightunsigned(F.xxhash64("src", "dst", "relation_type"), 2)
    return merged.select(eid.alias("id"), eid.alias("seq"), "src", "dst", "relation_type", F.lit(1.0).alias("confidence"), F.struct(F.lit("CodeAnalysis").alias("kind"), F.col("source_file").alias("file")).alias("source"), "tier")


def _imports(known: DataFrame) -> DataFrame:
    return known.where("entity_type = 'Import'").select("file", F.col("name").alias("text"))


def code_graph(entities: DataFrame, references: DataFrame, files: DataFrame, packages: DataFrame | None = None, now: int = 0) -> Graph:
    """Nodes of all entities and files, and edges of references and wildcard imports."""
    numbered = _numbered(entities, files)
    return Graph(_nodes(numbered, now), _edges(numbered, references, imported_files(_imports(numbered), files, packages)))


def bootstrap_code(files: DataFrame, packages: DataFrame | None = None, now: int = 0) -> Graph:
    """The graph of source files (path, text); each is parsed once, and what it gives is written."""
    found = checkpointed(code.extracted(files))
    return code_graph(code.entities(found), code.references(found), files.select("path"), packages, now)


def reindex(graph: Graph, changed: DataFrame, packages: DataFrame | None = None, now: int = 0) -> Graph:
    """``graph`` after files ``changed`` (path, text; null text: deleted) replace what it has of their paths.

    Only these files are parsed; imports and definitions of the others are read from the graph. Ids of what stays do not move, new
    ones go on from the largest. Edges from elsewhere into a replaced entity, those of decisions and facts included, lead to the
    first new one of the same name and type in the same file; where there is none they go. Nodes that are not code stay.
    """
    paths = changed.select(F.col("path").alias("p")).distinct()
    of_paths = lambda df, how: df.join(paths, is_code() & (F.col("source.file") == F.col("p")), how)
    gone = of_paths(graph.nodes, "left_semi")
    kept = remove_nodes(graph, gone)
    there = changed.where("text is not null").select("path", "text")
    top = graph.nodes.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    found = checkpointed(code.extracted(there))
    numbered = _numbered(code.entities(found), there.select("path"))
    numbered = checkpointed(numbered.withColumn("id", F.col("id") + top[0]).withColumn("seq", F.col("seq") + top[1]))
    known = kept.nodes.where(is_code()).select("id", "seq", "name", F.col("node_type").alias("entity_type"), F.col("source.file").alias("file")).unionByName(numbered.drop("definition"))
    imported = imported_files(_imports(known), known.where("entity_type = 'File'").select(F.col("file").alias("path")), packages)
    here = there.select(F.col("path").alias("file"))
    # Wildcard imports of the other files are among their edges.
    imported = imported.join(here.withColumn("own", F.lit(True)), "file", "left").withColumn("whole", F.col("whole") & F.col("own").isNotNull()).drop("own")
    fresh = _edges(known, code.references(found), imported)
    named = numbered.groupBy("file", "name", "entity_type").agg(F.min(F.struct("seq", "id")).alias("x"))
    old = gone.select(F.col("id").alias("dst"), F.col("source.file").alias("file"), "name", F.col("node_type").alias("entity_type"))
    again = of_paths(graph.edges, "left_anti").join(old, "dst").join(named, ["file", "name", "entity_type"])
    again = again.join(gone.select(F.col("id").alias("src")), "src", "left_anti").withColumn("dst", F.col("x.id")).select(graph.edges.columns)
    edges = of_paths(kept.edges, "left_anti").unionByName(again).unionByName(fresh, allowMissingColumns=True)
    return Graph(kept.nodes.unionByName(_nodes(numbered, now), allowMissingColumns=True), edges, graph.documents, graph.node_types, graph.edge_types, graph.domain)
