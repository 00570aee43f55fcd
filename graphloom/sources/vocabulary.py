"""Fixed values of code extraction: extensions, folders that are skipped, and names that are no references."""

EXTENSIONS = ["rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "cs"]
LANGUAGE = {"rs": "rust", "py": "python", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "go": "go", "java": "java", "cs": "csharp"}
DEPENDENCY_DIRS = [
    "node_modules", ".next", "dist", "build", "target", "__pycache__", ".venv", "venv", "env", ".git",
    "vendor", ".tox", "site-packages", ".mypy_cache", ".pytest_cache", "coverage", ".nuxt", ".output", "out", ".svelte-kit",
]

_JVM_BUILTINS = ["System", "String", "Integer", "Boolean", "Double", "Float", "Object", "Class", "Math", "Arrays", "Collections", "Console", "Convert"]
_JVM_PRIMITIVES = ["int", "long", "short", "byte", "float", "double", "boolean", "char", "void", "String", "Object", "var", "dynamic"]
BUILTINS = {
    "rust": ["println", "eprintln", "format", "vec", "panic", "assert", "assert_eq", "assert_ne", "unreachable", "todo", "unimplemented", "dbg", "write", "writeln", "Some", "None", "Ok", "Err"],
    "python": [
        "print", "len", "range", "enumerate", "zip", "map", "filter", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "isinstance", "issubclass", "type", "super", "property",
        "staticmethod", "classmethod", "hasattr", "getattr", "setattr", "open", "sorted", "reversed", "min", "max", "sum", "any", "all", "abs", "round", "id", "hash", "repr", "ord", "chr", "hex",
    ],
    "script": ["console", "require", "setTimeout", "setInterval", "parseInt", "parseFloat", "isNaN", "Array", "Object", "Promise", "JSON", "Math", "Date", "Error", "Map", "Set", "RegExp", "Number", "String", "Boolean", "Symbol"],
    "go": ["fmt", "log", "make", "len", "cap", "append", "copy", "delete", "new", "panic", "recover", "close", "print", "println"],
    "java": _JVM_BUILTINS,
    "csharp": _JVM_BUILTINS,
}
PRIMITIVES = {
    "rust": [
        "Self", "str", "bool", "u8", "u16", "u32", "u64", "u128", "i8", "i16", "i32", "i64", "i128", "f32", "f64", "usize", "isize",
        "String", "Vec", "Option", "Result", "HashMap", "HashSet", "Box", "Arc", "Rc", "Path", "PathBuf", "Cow", "BTreeMap", "BTreeSet",
    ],
    "python": ["str", "int", "float", "bool", "None", "list", "dict", "set", "tuple", "bytes", "type", "object", "Any", "Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable"],
    "script": ["string", "number", "boolean", "void", "null", "undefined", "any", "never", "unknown", "object", "Array", "Promise", "Record", "Partial", "Required", "Readonly", "Pick", "Omit"],
    "go": ["int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "string", "bool", "byte", "rune", "error", "any", "comparable"],
    "java": _JVM_PRIMITIVES,
    "csharp": _JVM_PRIMITIVES,
}
