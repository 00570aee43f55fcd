"""Extraction and resolution of code."""

from graphloom.operators import impact
from graphloom.plans import resolution
from graphloom.schema import Graph
from graphloom.sources import code, store

RUST = "use std::io;\nconst MAX: u32 = 3;\npub struct Node { pub id: u64 }\nenum Kind { A }\ntrait Run { fn go(&self); }\nimpl Node {\n  pub fn new() -> Node { let x = helper(1); x.name = 2; Graph::load(x); x.save(); x }\n}\nfn helper(n: u64) -> Kind { n.id }\n"


def kinds(text, path):
    return {(e[0], e[1]) for e in code.parse_file(text, path).entities}


def refs(text, path):
    return {(r[2], r[3]) for r in code.parse_file(text, path).references}


def test_rust():
    assert {("use std::io;", "Import"), ("MAX", "Const"), ("Node", "Struct"), ("Node.id", "Field"), ("Kind", "Enum"), ("Run", "Trait"), ("new", "Method"), ("helper", "Function")} <= kinds(RUST, "a.rs")
    assert {("helper", "Calls"), ("name", "WritesField"), ("load", "Calls"), ("save", "MethodCall"), ("id", "ReadsField"), ("Kind", "UsesType")} <= refs(RUST, "a.rs")
    assert not any(n == "u64" for n, _ in refs(RUST, "a.rs"))
    new = next(e for e in code.parse_file(RUST, "a.rs").entities if e[0] == "new")
    assert new[2].startswith("Node::new") and new[4] == 7


def test_python_and_fallback():
    text = "import os\nfrom m import Foo\nclass A(Base):\n    size = 1\n    def run(self, k: int):\n        self.v = foo(k, name=2)\n        return self.w.go()\n"
    assert {("A", "Struct"), ("A.size", "Field"), ("run", "Method"), ("import os", "Import")} <= kinds(text, "b.py")
    assert {("Base", "UsesType"), ("Foo", "UsesType"), ("foo", "Calls"), ("go", "MethodCall"), ("v", "WritesField"), ("name", "WritesField"), ("w", "ReadsField")} <= refs(text, "b.py")
    assert kinds("class B:\n  def x(:\n", "c.py") == {("B", "Struct"), ("x", "Method")}
    assert code.parse_file("anything", "d.txt").entities == []


def test_other_languages():
    ts = "export interface Shape { area: number }\nexport class Box implements Shape { area: number; go(): void { this.run(); } }\nfunction make(): Box { return new Box(); }\n"
    assert {("Shape", "Trait"), ("Box", "Struct"), ("go", "Method"), ("make", "Function")} <= kinds(ts, "a.ts") and ("run", "MethodCall") in refs(ts, "a.ts")
    go = "package m\nimport \"fmt\"\nfunc Run() { helper() }\nfunc (s *Server) Start() {}\n"
    assert {("Run", "Function"), ("Start", "Method")} <= kinds(go, "a.go") and ("helper", "Calls") in refs(go, "a.go")
    java = "import b.Repo;\npublic class Ctl {\n  private final Repo repo;\n  public Ctl(Repo r) { this.repo = r; }\n  String show(int id) { return null; }\n}\n"
    assert {("Ctl", "Struct"), ("Ctl.repo", "Field"), ("show", "Method"), ("import b.Repo;", "Import")} <= kinds(java, "A.java") and ("Repo", "UsesType") in refs(java, "A.java")
    cs = "using System;\nclass P { public int Age { get; set; } public void Go() { Do(); } }\n"
    assert {("P", "Struct"), ("P.Age", "Field"), ("Go", "Method")} <= kinds(cs, "a.cs")


FILES = [
    ("app/errors.py", "class AppError(Exception):\n    pass\n"),
    ("app/main.py", "from .errors import AppError\nfrom app.util import *\ndef run():\n    raise AppError('x')\n"),
    ("app/util.py", "def helper():\n    return 1\ndef _hid():\n    pass\n"),
    ("web/a.ts", "import { Box } from './lib/box';\nexport function go() { helperOnly(1); }\n"),
    ("web/lib/box.ts", "export class Box { area: number; }\nexport function helperOnly(x: number) {}\n"),
    ("src/Repo.java", "public interface Repo { void go(); }\n"),
    ("src/Ctl.java", "import a.Repo;\npublic class Ctl { private final Repo repo; }\n"),
]


def edges(graph):
    n = {r["id"]: r["name"] for r in graph.nodes.collect()}
    return {(n[e["src"]], e["relation_type"], n[e["dst"]], e["tier"]) for e in graph.edges.collect()}


def test_bootstrap_and_reindex(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    g = resolution.bootstrap_code(files)
    found = edges(g)
    assert {("app/main.py", "calls", "AppError", 2), ("app/main.py", "uses_type", "helper", 2), ("web/a.ts", "calls", "helperOnly", 2), ("src/Ctl.java", "uses_type", "Repo", 4)} <= found
    assert not any(e[2] == "_hid" for e in found)
    assert [r["file"] for r in impact.reference_files(g, "AppError").collect()] == ["app/main.py"]
    changed = spark.createDataFrame([("app/errors.py", "class AppError(Exception):\n    pass\nclass Fresh:\n    pass\n"), ("src/Repo.java", None)], "path string, text string")
    # A decision about an entity keeps its edge where the entity stays, by name, and loses it where it goes.
    ids = {(r["name"], r["source"]["file"]): r["id"] for r in g.nodes.collect()}
    top = max(ids.values())
    about = [(top + 1, top + 1, "Small errors", "Decision", top + 2), (top + 2, top + 2, "Newer", "Decision", None)]
    facts = spark.createDataFrame(about, "id long, seq long, name string, node_type string, superseded_by long")
    ends = [(k, k, top + 1, next(i for (n, _), i in ids.items() if n == name), "about") for k, name in enumerate(("AppError", "Repo"), 1)]
    linked = spark.createDataFrame(ends, "id long, seq long, src long, dst long, relation_type string")
    before = Graph(g.nodes.unionByName(facts, allowMissingColumns=True), g.edges.unionByName(linked, allowMissingColumns=True))
    after = resolution.reindex(before, changed)
    rows = {r["name"]: r for r in after.nodes.collect()}
    assert "Fresh" in rows and "Repo" not in rows and ("app/main.py", "calls", "AppError", 2) in edges(after)
    assert (rows["Small errors"]["id"], rows["Small errors"]["superseded_by"], rows["Newer"]["id"]) == (top + 1, top + 2, top + 2)
    assert {(a, r, b) for a, r, b, _ in edges(after) if r == "about"} == {("Small errors", "about", "AppError")}
    kept = {(r["name"], r["source"]["file"]): r["id"] for r in after.nodes.where("source.kind = 'CodeAnalysis'").collect()}
    assert all(kept[x] == ids[x] for x in kept if x in ids and x[1] != "app/errors.py") and kept["AppError", "app/errors.py"] > top + 2
    assert edges(after) - {x for x in edges(after) if x[1] == "about"} <= edges(resolution.bootstrap_code(files.join(changed, "path", "left_anti").unionByName(changed.where("text is not null"))))


def test_scan_and_index(spark, tmp_path):
    for path, text in FILES:
        p = tmp_path / "tree" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "tree/node_modules").mkdir()
    (tmp_path / "tree/node_modules/x.js").write_text("function no() {}")
    files = code.code_files(spark, f"file://{tmp_path}/tree")
    assert {r["path"] for r in files.collect()} == {p for p, _ in FILES}
    g = resolution.bootstrap_code(files)
    store.write_index(impact.name_index(g), f"file://{tmp_path}/index")
    assert any(r[0].startswith("AppError|Struct|") for r in spark.read.text(f"file://{tmp_path}/index").collect())
    assert store.load_config(str(tmp_path / "none.toml")).threshold_pct == 85


def test_package_entries(spark):
    files = spark.createDataFrame([("pkg/src/index.ts", ""), ("pkg/lib/x.js", ""), ("use/a.ts", "")], "path string, text string")
    manifests = spark.createDataFrame([("pkg/package.json", '{"name": "@me/pkg", "main": "lib/x"}')], "path string, text string")
    entries = resolution.package_entries(manifests, files)
    assert [(r["module"], r["entry"]) for r in entries.collect()] == [("@me/pkg", "pkg/lib/x.js")]
    imports = spark.createDataFrame([("use/a.ts", "import { y } from '@me/pkg';")], "file string, text string")
    assert [r["target"] for r in resolution.imported_files(imports, files, entries).collect()] == ["pkg/lib/x.js"]


def types(text, path):
    """(line, name) of all type references, repeated ones too."""
    return sorted((r[1], r[2]) for r in code.parse_file(text, path).references if r[3] == "UsesType")


def test_go_selectors_are_reads_and_types_stand_everywhere():
    text = (
        "package m\ntype Server struct {\n\tmu sync.Mutex\n\ta, b *Conn\n\tBase\n\tfn func(Ctx, *Req) (Resp, error)\n}\n"
        "type Iface interface {\n\tDo(x Arg, y ...Rest) (Out, error)\n\tEmbedded\n}\ntype (\n\tPair map[Key]Val\n\tAll []Pair\n)\nvar x, y Kind = 1, 2\n"
        "func (s *Server) Start(ctx context.Context, n int) (*Result, error) {\n\ts.count = s.total\n\tz := &Foo{Name: s.name}\n\tif s.x == y {\n\t\treturn nil, err\n\t}\n"
        "\tswitch v := q.(type) {\n\tcase Alpha, *Beta:\n\t\tfmt.Println(v.w)\n\t}\n\tm := make(map[string]Made)\n\tu := q.(Cast)\n\treturn helper(m, s.do(u.f)), nil\n}\n"
    )
    assert types(text, "a.go") == [
        (2, "Server"), (3, "Mutex"), (4, "Conn"), (5, "Base"), (6, "Ctx"), (6, "Req"), (6, "Resp"), (8, "Iface"), (9, "Arg"), (9, "Out"), (9, "Rest"), (10, "Embedded"), (13, "Key"), (13, "Pair"), (13, "Val"),
        (14, "All"), (14, "Pair"), (16, "Kind"), (17, "Context"), (17, "Result"), (17, "Server"), (19, "Foo"), (24, "Alpha"), (24, "Beta"), (27, "Made"), (28, "Cast"),
    ]
    other = refs(text, "a.go")
    assert {n for n, k in other if k == "ReadsField"} == {"count", "total", "name", "x", "w", "f"} and {n for n, k in other if k == "Calls"} == {"helper"}
    assert not any(k in ("WritesField", "MethodCall") for _, k in other)


def test_rust_types_in_every_position():
    text = (
        "impl<'a, T: Clone> Walk<'a> for Tree<T> where T: Send {\n  fn go(&'a self, n: &'a Node, m: HashMap<Key, Vec<Item>>) -> Result<Out, Err> {\n"
        "    let x: Box<dyn Shape> = Box::new(Circle { r: 1, k: Other::make() });\n    let y = z as Num; let q = it.collect::<Bag>(); let s = r#\"a \" : Not\"#;\n    match e { _ => Foo { y: x } }\n  }\n}\n"
        "enum E { A(B, C), D { f: G } }\nstruct P(Q, pub R);\ntype Al = Map<S, fn(U) -> V>;\n"
    )
    assert types(text, "a.rs") == sorted(
        [(1, x) for x in ("T", "Clone", "Walk", "Tree", "T", "T", "Send")] + [(2, x) for x in ("Node", "Key", "Item", "Out", "Err")] + [(3, "Shape"), (3, "Circle"), (4, "Num"), (4, "Bag"), (5, "Foo")]
        + [(8, x) for x in "EBCG"] + [(9, x) for x in "PQR"] + [(10, x) for x in ("Al", "Map", "S", "U", "V")]
    )
    assert {n for n, k in refs(text, "a.rs") if k == "Calls"} == {"new", "make"}


def test_script_and_java_types_in_every_position():
    ts = (
        "export class Box<T extends Lim> extends Base<Arg> implements Shape, Other { size?: Num; private m: Map<Key, Val[]> = new Map<K2, V2>();\n"
        "  go(x: In, y?: { z: Zed }): Promise<Out> { const q: Loc = a ? b : c; const o = { k: NotType, f: (e: Ev) => e as Casted }; switch (a) { case Foo: break; default: call<Gen>(1); } return o; } }\n"
        "interface I extends J<K> { f(x: L): M | N; g: (a: O) => P }\ntype U = V | { w: W } | X[];\nexport function f(a: AA = d, ...r: BB[]): a is CC {}\n"
    )
    assert types(ts, "a.ts") == sorted(
        [(1, x) for x in ("Box", "T", "Lim", "Arg", "Shape", "Other", "Num", "Key", "Val", "K2", "V2", "Map")] + [(2, x) for x in ("In", "Zed", "Out", "Loc", "Ev", "Casted", "Gen")]
        + [(3, x) for x in "IJKLMNOP"] + [(4, x) for x in "UVWX"] + [(5, x) for x in ("AA", "BB", "CC")]
    )
    java = (
        "import a.b.Skip;\n@Service(\"x\") public class Ctl<T extends Lim & Two> extends Base<Arg> implements A, B<C> {\n  private final Map<Key, List<Val>> m = new HashMap<>();\n  @Inject Repo repo; Foo[] arr;\n"
        "  public <R> R go(Req r, int n, final Opt... o) throws Err, Bad { Loc l = (Cast) x; if (a < b && c > d) { return foo(e, f); } for (Item i : items) { i.run(); }\n"
        "    try { } catch (E1 | E2 e) { } Object z = Thing.class; if (z instanceof Tst t) {} return null; } }\n"
    )
    assert types(java, "A.java") == sorted(
        [(2, x) for x in ("T", "Lim", "Two", "Base", "Arg", "A", "B", "C")] + [(3, x) for x in ("Map", "Key", "List", "Val", "HashMap")] + [(4, "Repo"), (4, "Foo")]
        + [(5, x) for x in ("R", "R", "Req", "Opt", "Err", "Bad", "Loc", "Cast", "Item")] + [(6, x) for x in ("E1", "E2", "Thing", "Tst")]
    )


def test_broken_code_ends_and_costs_only_its_place():
    for path in ("a.go", "a.rs", "a.ts", "A.java", "a.cs", "a.js"):
        for text in ("", "{", "}}}(((", "type", "func (", "impl <", "class A<", "x: Map<", "struct P(", "case", "a = [", "'", "fn f(a: &'a", "type X [", "interface {", "}\nfunc G(a Foo", "<" * 2000):
            code.parse_file(text, path)
    assert (2, "Good") in types("fn broken(a: Map<, {\nfn f(x: Good) {}\n", "a.rs")


def test_one_parse_gives_both(spark):
    files = spark.createDataFrame([*FILES, ("none.txt", "x"), ("null.py", None)], "path string, text string")
    found = code.extracted(files).collect()
    assert sum(r["entity"] for r in found) == code.entities(files).count() and sum(not r["entity"] for r in found) == code.references(files).count()
    assert all((r["name"] is None) != r["entity"] for r in found)
