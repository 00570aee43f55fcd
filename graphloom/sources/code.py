"""Entities and references of source files, in the executors.

Python goes through its own parser; other languages, and Python that does not parse, through a tokenizer and a stack of
braces, with types by their positions (``positions``; in C# and JavaScript, whose grammars have none, capitalised names in a few
places). Each file is parsed once, for entities and references together. Calls of members are references in Rust, Python and
scripts only; a selector of Go that is not called is a read, assigned to or not. Names of imports are the whole statement; fields
are ``Parent.field``; lines count from 1.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITIES, REFERENCES
from .positions import TypeNames
from .vocabulary import BUILTINS, DEPENDENCY_DIRS, EXTENSIONS, LANGUAGE, PRIMITIVES

_REST = r"|[A-Za-z_$][\w$]*!?|\d[\w.]*|::|->|=>|==|!=|<=|>=|[-+*/%&|^]=|\n|[^\s\w]"
_OPEN = r"//[^\n]*|/\*.*?\*/"
_SHORT = r"|'(?:\\(?:x[0-9a-fA-F]{2}|u\{?[0-9a-fA-F]+\}?|.)|[^'\\\n])'"
_DOUBLE = r"|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`"
TOKEN = {
    "rust": re.compile(_OPEN + r"|\bb?r(?P<hashes>#*)\".*?\"(?P=hashes)|\"(?:\\.|[^\"\\])*\"" + _SHORT + r"|'[A-Za-z_]\w*" + _REST, re.S),
    "go": re.compile(_OPEN + r"|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`" + _SHORT + _REST, re.S),
    "java": re.compile(_OPEN + r"|\"\"\".*?\"\"\"" + _DOUBLE + _SHORT + _REST, re.S),
    "csharp": re.compile(_OPEN + _DOUBLE + _SHORT + r"|'(?:\\.|[^'\\\n])*'" + _REST, re.S),
    "script": re.compile(_OPEN + _DOUBLE + r"|'(?:\\.|[^'\\\n])*'" + _REST, re.S),
}
NOT_CALLED = set("if for while switch catch return match fn func function new sizeof typeof await in of do else throw super this self class struct enum interface impl using lock foreach when yield async".split())
GO_WORDS = set("type var const import case defer go range select chan map".split())
TYPE_BEFORE = {":", "->", "<", "&", "extends", "implements", "new", "impl", "for", "throws", "dyn", "is", "as"}
MODIFIERS = set("public private protected internal static final abstract sealed readonly virtual override async export default declare pub const unsafe extern partial volatile transient synchronized native get set".split())


@dataclass
class Found:
    language: str
    path: str
    lines: list[str]
    entities: list[tuple] = field(default_factory=list)
    references: list[tuple] = field(default_factory=list)

    def entity(self, name: str, kind: str, line: int, end: int, parent: str = "", definition: str | None = None) -> None:
        if not name:
            return
        first = definition if definition is not None else (self.lines[line - 1].strip() if line <= len(self.lines) else "")
        if kind == "Field":
            name = f"{parent}.{name}" if parent else name
        elif parent and definition is None:
            first = f"{parent}::{name} — {first}"
        self.entities.append((name, kind, first, self.path, line, max(line, end)))

    def refer(self, name: str, kind: str, line: int) -> None:
        stop = PRIMITIVES if kind == "UsesType" else BUILTINS if kind == "Calls" else {}
        if name and name not in stop.get(self.language, ()):
            self.references.append((self.path, line, name, kind))


def _dotted(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


class _Python(ast.NodeVisitor):
    def __init__(self, found: Found):
        self.f, self.parent, self.depth, self.written = found, "", 0, set()

    def _import(self, node) -> None:
        text = " ".join(x.strip() for x in self.f.lines[node.lineno - 1 : node.end_lineno])
        self.f.entity(text, "Import", node.lineno, node.end_lineno, "", text)
        for a in node.names:
            last = a.name.rsplit(".", 1)[-1]
            if last[:1].isupper():
                self.f.refer(last, "UsesType", node.lineno)

    visit_Import = visit_ImportFrom = _import

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.f.entity(node.name, "Struct", node.lineno, node.end_lineno)
        for base in sorted({_dotted(b) for b in node.bases if _dotted(b)[:1].isupper()}):
            self.f.refer(base, "UsesType", node.lineno)
        outer, self.parent, depth, self.depth = self.parent, node.name, self.depth, 0
        self.generic_visit(node)
        self.parent, self.depth = outer, depth

    def _function(self, node) -> None:
        self.f.entity(node.name, "Method" if self.parent else "Function", node.lineno, node.end_lineno, self.parent)
        if self.parent:
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                if a.annotation is not None and a.arg != "self":
                    self.f.entity(a.arg, "Field", a.lineno, a.lineno, self.parent)
        self.depth += 1
        self.generic_visit(node)
        self.depth -= 1

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _assign(self, node) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        for t in targets:
            if isinstance(t, ast.Name) and not self.depth and not isinstance(node, ast.AugAssign):
                self.f.entity(t.id, "Field" if self.parent else "Const", node.lineno, node.end_lineno, self.parent)
            for x in ast.walk(t):
                if isinstance(x, ast.Attribute) and not isinstance(x.ctx, ast.Load) or x is t and isinstance(t, ast.Attribute):
                    self.written.add(id(x))
        self.generic_visit(node)

    visit_Assign = visit_AnnAssign = visit_AugAssign = _assign

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name):
            self.f.refer(node.func.id, "Calls", node.lineno)
        elif isinstance(node.func, ast.Attribute):
            self.f.refer(node.func.attr, "MethodCall", node.lineno)
            self.visit(node.func.value)
        else:
            self.visit(node.func)
        for k in node.keywords:
            if k.arg and len(k.arg.encode()) >= 3 and k.arg not in BUILTINS["python"]:
                self.f.refer(k.arg, "WritesField", node.lineno)
            self.visit(k.value)
        for a in node.args:
            self.visit(a)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.f.refer(node.attr, "WritesField" if id(node) in self.written else "ReadsField", node.lineno)
        self.visit(node.value)


def _tokens(text: str, language: str) -> list[tuple[str, int]]:
    out, line = [], 1
    for m in TOKEN[language].finditer(text):
        t = m[0]
        if t != "\n" and not t.startswith(("//", "/*")):
            out.append((t, line))
        line += t.count("\n")
    return out


def _word(t: str) -> bool:
    return t[:1].isalpha() or t != "" and t[0] in "_$"


@dataclass
class _Scope:
    name: str
    kind: str
    depth: int
    started: bool = False


def _braces(found: Found, text: str) -> None:
    """Declarations by keyword or by shape, in the scope that the open braces give; references by what is before and behind."""
    language = found.language
    tokens = _tokens(text, language)
    typed = language in ("rust", "go", "java") or found.path.endswith((".ts", ".tsx"))
    positions = TypeNames(tokens, language) if typed else None
    types, members = (positions.at, positions.members) if typed else ((), ())
    scopes: list[_Scope] = []
    depth, paren, i, n = 0, 0, 0, len(tokens)
    kinds = {"class": "Struct", "struct": "Struct", "record": "Struct", "interface": "Trait", "trait": "Trait", "enum": "Enum"}
    at = lambda k: tokens[k][0] if 0 <= k < n else ""
    declared: set[int] = set()

    def block_end(k: int) -> int:
        """Line of the brace that closes the next one to open, or of the end of the statement."""
        level = 0
        for j in range(k, n):
            t = tokens[j][0]
            if t == "{":
                level += 1
            elif t == "}":
                level -= 1
                if level <= 0:
                    return tokens[j][1]
            elif t == ";" and level == 0:
                return tokens[j][1]
        return tokens[-1][1] if tokens else 1

    def declare(k: int, kind: str, parent: str = "", definition: str | None = None) -> None:
        declared.add(k)
        found.entity(tokens[k][0].rstrip("!"), kind, tokens[k][1], block_end(k), parent, definition)

    def statement(k: int) -> tuple[str, int]:
        parts, line, level, j = [], tokens[k][1], 0, k
        while j < n and not (tokens[j][0] == ";" and level == 0) and not (language in ("script", "go") and tokens[j][1] != tokens[j - 1][1] and level == 0 and j > k):
            level += (tokens[j][0] in "{(") - (tokens[j][0] in "})")
            declared.add(j)
            parts.append(tokens[j][0])
            j += 1
        last = tokens[j - 1][1]
        return " ".join(x.strip() for x in found.lines[line - 1 : last]).strip(), j

    while i < n:
        t, line = tokens[i]
        top = scopes[-1] if scopes else None
        body = top is not None and top.started and depth == top.depth + 1 and paren == 0
        if t == "{":
            depth += 1
            if top is not None and not top.started and depth == top.depth + 1:
                top.started = True
        elif t == "}":
            depth -= 1
            if top is not None and top.started and depth <= top.depth:
                scopes.pop()
        elif t == "(":
            paren += 1
        elif t == ")":
            paren = max(paren - 1, 0)
        elif t == ";" and top is not None and not top.started:
            scopes.pop()
        elif _word(t):
            after = at(i + 1)
            if t in ("import", "use", "using") and paren == 0 and (t != "import" or after not in ("(", ".")) and (t == "import" or language in ("rust", "csharp")) and not (t == "using" and after in ("(", "var")):
                if language == "rust" and t != "use" or top is not None and top.started and language != "rust":
                    i += 1
                    continue
                text_, j = statement(i)
                found.entity(text_, "Import", line, line, "", text_)
                if language == "script":
                    for k in range(i, j):
                        w = tokens[k][0]
                        if _word(w) and len(w) >= 2 and w not in ("import", "from", "as", "type", "default"):
                            found.refer(w, "UsesType", tokens[k][1])
                i = j
                continue
            if t == "impl" and language == "rust":
                j, name, level = i + 1, "", 0
                while j < n and at(j) not in ("{", ";"):
                    w = at(j)
                    level += (w == "<") - (w == ">")
                    name = "" if w == "for" else w if _word(w) and level == 0 and w not in ("where", "dyn") and not name else name
                    j += 1
                scopes.append(_Scope(name, "impl", depth))
            elif t in kinds and _word(after) and after not in MODIFIERS and (i == 0 or at(i - 1) not in (".", "::")) and not (language == "go"):
                declare(i + 1, kinds[t], "", f"struct {after}" if language == "rust" and t == "struct" else None)
                scopes.append(_Scope(after, kinds[t], depth))
            elif t == "type" and language == "script" and _word(after) and at(i + 2) in ("=", "<"):
                declare(i + 1, "Struct")
            elif t == "fn" and language == "rust" and _word(after):
                inside = next((s.name for s in reversed(scopes) if s.kind in ("impl", "Trait") and s.started), "")
                declare(i + 1, "Method" if inside else "Function", inside)
            elif t == "func" and language == "go":
                j = i + 1
                if after == "(":
                    while j < n and at(j) != ")":
                        j += 1
                    declare(j + 1, "Method") if _word(at(j + 1)) else None
                elif _word(after):
                    declare(i + 1, "Function")
            elif t == "function" and language == "script" and _word(at(i + 1) if at(i + 1) != "*" else at(i + 2)):
                declare(i + 1 if at(i + 1) != "*" else i + 2, "Function")
            elif t in ("const", "static") and language == "rust" and _word(after) and at(i + 2) == ":":
                declare(i + 1, "Const")
            elif t == "const" and language == "script" and _word(after) and not (top and top.kind == "Enum" and body):
                if after != "enum":
                    declare(i + 1, "Const")
            elif body and i not in declared and t not in MODIFIERS and t not in NOT_CALLED and top.kind in ("Struct", "Trait", "Enum"):
                before = at(i - 1)
                if language == "rust":
                    if top.kind == "Struct" and after == ":" and before in ("{", ",", "pub", ")"):
                        declare(i, "Field", top.name, found.lines[line - 1].strip())
                elif language == "script":
                    fresh = before in ("{", "}", ";", ",") or before in MODIFIERS or tokens[i - 1][1] != line or before == "#"
                    if top.kind == "Enum":
                        if after == "=":
                            declare(i, "Field", top.name)
                    elif fresh and after in ("(", "<") and top.kind == "Struct":
                        declare(i, "Method", top.name)
                    elif fresh and after in (":", "=", ";", "?", "!"):
                        declare(i, "Field", top.name)
                elif language in ("java", "csharp") and top.kind != "Enum":
                    typed = _word(before) and before not in ("return", "throw", "else", "new") or before in (">", "]", "?")
                    if after == "(" and (typed or t == top.name):
                        declare(i, "Method", top.name)
                    elif typed and (after in ("=", ";", ",") or after == "{" and language == "csharp"):
                        declare(i, "Field", top.name)
            if i in types:
                found.refer(t, "UsesType", line)
            elif i not in declared and i not in members:
                before, name = at(i - 1), t.rstrip("!")
                if after == "(" and (t not in NOT_CALLED and (language != "go" or t not in GO_WORDS) or before in (".", "::")):
                    if before == ".":
                        found.refer(name, "MethodCall", line) if language in ("script", "rust") else None
                    elif before == "new":
                        found.refer(name, "UsesType", line)
                    elif language not in ("java",) or before == "::":
                        found.refer(name, "Calls", line)
                elif before == "." and at(i - 2) != "." and language in ("script", "rust", "go", "csharp", "java") and not t[:1].isdigit():
                    writes = after == "=" or len(after) == 2 and after[1] == "=" and after[0] in "+-*/%&|^"
                    found.refer(name, "WritesField" if writes and language != "go" else "ReadsField", line) if language in ("script", "rust", "go") else None
                elif not typed and t[:1].isupper() and not (body and top.kind == "Enum") and (before in TYPE_BEFORE or language == "csharp" and (_word(after) or after in ("<", "[")) or before == ","):
                    found.refer(name, "UsesType", line)
        i += 1


def parse_file(text: str, path: str) -> Found:
    """Entities and references of one file; of an unknown extension none."""
    language = LANGUAGE.get(path.rsplit(".", 1)[-1] if "." in path else "")
    found = Found(language or "", path, text.split("\n"))
    if language == "python":
        try:
            _Python(found).visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            found.entities.clear()
            found.references.clear()
            for k, line in enumerate(found.lines, 1):
                if m := re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line):
                    found.entity(m[3], "Struct" if m[2] == "class" else "Method" if m[1] else "Function", k, k)
    elif language:
        _braces(found, text)
    return found


def normal_path(path):
    """Forward slashes, and no leading ./ ."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def _below(spark: SparkSession, base: str, names: str) -> DataFrame:
    """(path, text) of the files below ``base`` whose names match, hidden ones included, without dependency folders and unreadable files."""
    root = base.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(base)
    relative = F.element_at(F.split(F.col("path"), F.lit(re.escape(root.split(":", 1)[-1].lstrip("/")))), -1)
    parts = F.split(relative, "/")
    own = raw.select(relative.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), parts.alias("parts"))
    return own.where(F.col("text").isNotNull() & ~F.arrays_overlap("parts", F.array(*[F.lit(x) for x in DEPENDENCY_DIRS]))).select(normal_path(F.col("path")).alias("path"), "text")


def glob_pattern(glob: str) -> str:
    """A regular expression of whole paths: ** and the slash behind it are any folders, * and ? stop at a slash."""
    parts = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob.removeprefix("./"))) + "$"


def code_files(spark: SparkSession, base: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, text) of the code files below ``base``; with ``patterns`` of those whose path one of them names."""
    files = _below(spark, base, "*.{" + ",".join(EXTENSIONS) + "}")
    return files if patterns is None else files.where(F.col("path").rlike("|".join(map(glob_pattern, patterns)) if patterns else "^\\b\\B$"))


def package_manifests(spark: SparkSession, base: str) -> DataFrame:
    """(path, text) of the package manifests below ``base``."""
    return _below(spark, base, "package.json")


def extracted(files: DataFrame) -> DataFrame:
    """Entities and references of files (path, text) by one parse of each: the columns of both, those of the other null, and ``entity``."""
    columns = [("entity", pa.bool_())] + [(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in f"{ENTITIES}, {REFERENCES}".split(", ")]
    width = len(ENTITIES.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                found = parse_file(text or "", path or "")
                rows = [(True, *e, *[None] * (len(columns) - 1 - width)) for e in found.entities] + [(False, *[None] * width, *r) for r in found.references]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(columns)], [name for name, _ in columns])

    return files.select("path", "text").mapInArrow(run, f"entity boolean, {ENTITIES}, {REFERENCES}")


def entities(found: DataFrame) -> DataFrame:
    """Entities of what ``extracted`` gives, or of files (path, text)."""
    rows = found if "entity" in found.columns else extracted(found)
    return rows.where("entity").select(*[x.split()[0] for x in ENTITIES.split(", ")])


def references(found: DataFrame) -> DataFrame:
    """References of what ``extracted`` gives, or of files (path, text)."""
    rows = found if "entity" in found.columns else extracted(found)
    return rows.where("not entity").select(*[x.split()[0] for x in REFERENCES.split(", ")])
