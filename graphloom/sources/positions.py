"""Where the tokens of a file name types, in Rust, TypeScript, Java and Go.

One pass with a stack of brackets. A type is read by a small recursive function wherever the shapes around ask for one: behind a colon
or an arrow, before a declared name, in lists of parameters, in the arguments of another type. What does not read as a type marks
nothing and the pass goes on at the next token, so broken code costs only the place that is broken. Each place is named once. The
names of declared types and type parameters count as places; constructors of TypeScript and annotations of Java do not.
"""

from __future__ import annotations

from collections import namedtuple

Open = namedtuple("Open", "kind seen ternary")

_COMMON = "if else for while do switch case default return break continue const struct interface import package"
RESERVED = {
    "rust": set(f"{_COMMON} match let static fn enum trait impl use mod pub in as where super loop unsafe move ref await async dyn mut extern type".split()),
    "script": set(f"{_COMMON} let var static function class enum export public private protected abstract new throw try catch finally instanceof extends implements in of as this super yield await async typeof delete".split()),
    "java": set(f"{_COMMON} static class enum public private protected abstract final native synchronized new throw throws try catch finally instanceof extends implements this super".split()),
    "go": set(f"{_COMMON} goto fallthrough defer go var func range type select chan map".split()),
}
PREFIX = {"rust": set("& * mut dyn impl const ref move ? !".split()), "script": set("| & readonly keyof unique asserts".split()), "java": {"final"}, "go": set("* . - < ~ <-".split())}
JOINED = {"rust": {"+"}, "script": {"|", "&"}, "java": {"&", "|"}, "go": {"|"}}
MODIFIER = set("public private protected static final abstract native synchronized default transient volatile strictfp sealed non".split())
CONTROL = {"rust": set("struct enum union trait impl fn mod match if while for loop unsafe else extern".split()), "go": set("if for switch select func".split())}
DEEPEST = 60
CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}


def word(t: str) -> bool:
    return t[:1].isalpha() or t[:1] in "_$" and t != ""


class TypeNames:
    """``at`` has the indexes of the tokens that name types, ``members`` of those that name variants and signatures, which look like calls."""

    def __init__(self, tokens: list[tuple[str, int]], language: str):
        self.tokens, self.language, self.n = tokens, language, len(tokens)
        self.at: set[int] = set()
        self.members: set[int] = set()
        self.depth = 0
        self.reserved = RESERVED[language]
        self.type_braces: set[int] = set()
        self.stack: list[Open] = []
        self.seen, self.ternary, self.switch = set(), 0, False
        step = getattr(self, f"_{language}")
        k = 0
        while k < self.n:
            k = self._skipped(k)
            if k < self.n:
                self._line(k)
                step(k, self.tok(k))
                self._bracket(k, self.tok(k))
                k += 1

    def tok(self, k: int) -> str:
        return self.tokens[k][0] if 0 <= k < self.n else ""

    def name(self, k: int) -> bool:
        return word(self.tok(k)) and self.tok(k) not in self.reserved

    def top(self) -> str:
        return self.stack[-1].kind if self.stack else "block"

    def close(self, k: int) -> int:
        """Index behind the bracket that closes the one at ``k``; the end if none does."""
        level, opening = 0, self.tok(k)
        for j in range(k, self.n):
            level += (self.tok(j) == opening) - (self.tok(j) == CLOSING[opening])
            if level == 0:
                return j + 1
        return self.n

    def _skipped(self, k: int) -> int:
        """Behind attributes and names of annotations."""
        while self.language == "rust" and self.tok(k) == "#" and "[" in (self.tok(k + 1), self.tok(k + 2)):
            k = self.close(k + 1 if self.tok(k + 1) == "[" else k + 2)
        while self.language in ("java", "script") and self.tok(k) == "@" and word(self.tok(k + 1)) and self.tok(k + 1) != "interface":
            k += 2
            while self.tok(k) == "." and word(self.tok(k + 1)):
                k += 2
        return k

    def _starts(self, k: int) -> bool:
        """Whether a line's end before ``k`` ends a statement of Go."""
        before = self.tok(k - 1)
        return k == 0 or self.tokens[k][1] != self.tokens[k - 1][1] and (word(before) and before not in self.reserved - {"return", "break", "continue", "fallthrough"} or before[:1].isdigit() or before[:1] in "\"'`)]}")

    def _line(self, k: int) -> None:
        if self.language == "go" and self._starts(k) and self.top() != "(":
            self.seen = set()

    def _bracket(self, k: int, t: str) -> None:
        if t in ("{", "(", "["):
            self.stack.append(Open(self._kind(k) if t == "{" else self._group() if t == "(" else t, self.seen, self.ternary))
            self.seen, self.ternary = set(), 0
        elif t in ("}", ")", "]"):
            if self.stack:
                was = self.stack.pop()
                self.seen, self.ternary = (set(), 0) if t == "}" and was.kind not in ("literal", "type", "fields", "methods") else (was.seen, was.ternary)
        elif t == ";":
            self.seen, self.ternary = set(), 0
        elif word(t):
            self.seen.add(t)

    def _group(self) -> str:
        """Go's groups of declarations stand in parentheses."""
        last = next(iter(self.seen & {"type", "var", "const"}), "") if self.language == "go" and len(self.seen) == 1 else ""
        return {"type": "types", "var": "vars", "const": "vars"}.get(last, "(")

    def _kind(self, k: int) -> str:
        before = self.tok(k - 1)
        if self.language == "script":
            if k in self.type_braces or "interface" in self.seen:
                return "type"
            if "class" in self.seen:
                return "class"
            if "enum" in self.seen or before in ("=", "(", ",", ":", "return", "?", "[", "&", "|", ".", "default", "import", "export", "const", "let", "var", "yield", "await") or "import" in self.seen:
                return "literal"
            return "block"
        if self.language == "rust":
            if self.top() == "enum":
                return "fields"
            if "enum" in self.seen:
                return "enum"
            literal = (before[:1].isupper() or before == ">") and not self.seen & CONTROL["rust"]
            if literal and before != ">":
                self.at.add(k - 1)
            return "literal" if literal else "block"
        if self.language == "go":
            if before in ("struct", "interface"):
                return "fields" if before == "struct" else "methods"
            if self.switch:
                self.switch = False
                return "switch"
            if (self.name(k - 1) or before == "]") and not self.seen & CONTROL["go"]:
                if before != "]":
                    self.at.add(k - 1)
                return "literal"
        return "block"

    # types
    def read(self, k: int) -> int:
        """Marks the names of the type at ``k``; the index behind it, or -1 where there is none."""
        marks: list[int] = []
        end = self.type(k, marks)
        if end > 0:
            self.at.update(marks)
        return end

    def read_all(self, k: int) -> int:
        """Types between commas."""
        end = self.read(k)
        while end > 0 and self.tok(end) == ",":
            k, end = end, self.read(end + 1)
        return end if end > 0 else k

    def type(self, k: int, marks: list[int]) -> int:
        """As ``read``, into ``marks``; what is nested deeper than ``DEEPEST`` is no type."""
        if self.depth >= DEEPEST:
            return -1
        self.depth += 1
        end = self._type(k, marks)
        self.depth -= 1
        return end

    def _type(self, k: int, marks: list[int]) -> int:
        own = self.language
        while self.tok(k) in PREFIX[own] or own == "rust" and self.tok(k)[:1] == "'" or own == "go" and self.tok(k) == "chan":
            k += 1
        t = self.tok(k)
        if t == "(":
            k = self.go_params(k) if own == "go" else self.series(k, marks, strict=False)
            return self.type(k + 1, marks) if k > 0 and self.tok(k) in ("=>", "->") else self.tail(k, marks)
        if t == "[":
            return self.type(self.close(k), marks) if own == "go" else self.tail(self.series(k, marks, strict=False), marks)
        if t == "{" and own == "script":
            self.type_braces.add(k)
            return self.tail(self.close(k), marks)
        if own == "go" and t in ("struct", "interface", "func", "map"):
            if t == "map":
                return self.type(self.close(k + 1), marks) if self.tok(k + 1) == "[" and self.type(k + 2, marks) > 0 else -1
            return self.go_signature(k + 1) if t == "func" else self.close(k + 1) if self.tok(k + 1) == "{" else -1
        if own == "rust" and (t == "fn" or t == "<"):
            return self.type(k + 1, marks) if t == "fn" else self.series(k, marks)
        if own == "java" and t == "?":
            return self.type(k + 2, marks) if self.tok(k + 1) in ("extends", "super") else k + 1
        if own == "script" and word(t) and self.tok(k + 1) == "is":
            return self.type(k + 2, marks)
        if own == "script" and (t[:1] in "\"'`" and t or t[:1].isdigit() or t in ("this", "typeof", "new")):
            return self.type(k + 1, marks) if t in ("typeof", "new") else self.tail(k + 1, marks)
        if not self.name(k) and not (own == "rust" and t in ("Self", "super")):
            return -1
        while self.tok(k + 1) in (".", "::") and word(self.tok(k + 2)) and self.tok(k + 2) != "class":
            if own == "java":
                marks.append(k)
            k += 2
        marks.append(k)
        k += 1
        if own == "rust" and self.tok(k) == "::" and self.tok(k + 1) == "<":
            k += 1
        if own == "rust" and self.tok(k) == "(":  # Fn(A) -> B
            k = self.series(k, marks, strict=False)
            return self.type(k + 1, marks) if k > 0 and self.tok(k) == "->" else k
        if self.tok(k) == "<" and own != "go":
            k = self.series(k, marks)
        elif own == "go" and self.tok(k) == "[" and self.tok(k + 1) != "]":
            k = self.series(k, marks)
        return self.tail(k, marks)

    def tail(self, k: int, marks: list[int]) -> int:
        """Behind empty or indexed brackets and further alternatives or bounds."""
        if k < 0:
            return k
        while self.language in ("script", "java") and self.tok(k) == "[" and (self.language == "script" or self.tok(k + 1) == "]"):
            k = self.close(k)
        while self.language == "java" and self.tok(k) == ".":
            k += 1
        if self.tok(k) in JOINED[self.language]:
            end = self.type(k + 1, marks)
            return end if end > 0 else k
        return k

    def series(self, k: int, marks: list[int], strict: bool = True) -> int:
        """The types between the bracket at ``k`` and its end, with their bounds and defaults; -1 if something else is there, or
        if not ``strict``, only what reads as a type."""
        end = CLOSING[self.tok(k)]
        k += 1
        while k < self.n and self.tok(k) != end:
            if self.language == "rust" and self.tok(k) == "pub":
                k = self.close(k + 1) if self.tok(k + 1) == "(" else k + 1
            if self.language in ("script", "rust") and end == ")" and word(self.tok(k)) and (self.tok(k + 1) == ":" or self.tok(k + 1) == "?" and self.tok(k + 2) == ":"):
                k += 2 if self.tok(k + 1) == ":" else 3
            got = k + 1 if self.tok(k)[:1] == "'" and self.language == "rust" and self.tok(k + 1) in (",", ":", end, "+") else self.type(k, marks)
            while got > 0 and self.tok(got) in (":", "=", "extends", "super", "in"):
                then = self.type(got + 1, marks)
                got = then if then > 0 else got + 2 if self.language == "rust" else -1
            if got < 0 or self.tok(got) not in (",", ";", end):
                if strict and not (self.language == "rust" and self.tok(k) in ("{", "const") or self.tok(k)[:1].isdigit()):
                    return -1
                got = max(got, k)
                while got < self.n and self.tok(got) not in (",", end):
                    got = self.close(got) if self.tok(got) in ("(", "[", "{") else got + 1
            if self.tok(got) == ";":
                while got < self.n and self.tok(got) != end:
                    got += 1
            k = got + (self.tok(got) == ",")
        return k + 1 if k < self.n else -1

    # languages
    def _rust(self, k: int, t: str) -> None:
        if "use" in self.seen:
            return
        if t in ("struct", "enum", "trait", "union", "type") and self.name(k + 1):
            self.at.add(k + 1)
            end = self.series(k + 2, marks := []) if self.tok(k + 2) == "<" else k + 2
            self.at.update(marks if end > 0 and end != k + 2 else [])
            if t == "struct" and self.tok(end) == "(":
                self._list(end)
            elif t == "type" and self.tok(end) == "=":
                self.read(end + 1)
        elif t == "impl":
            end = self._list(k + 1) if self.tok(k + 1) == "<" else k + 1
            end = self.read(end) if end > 0 else end
            if self.tok(end) == "for":
                self.read(end + 1)
        elif t == "fn" and self.tok(k + 2) == "<":
            self._list(k + 2)
        elif t in ("->", "as", "dyn", "where") or t == ":" and self.top() != "literal" and (word(self.tok(k - 1)) or self.tok(k - 1) in (")", "]", ">")):
            self.read(k + 1)
        elif t == "::" and self.tok(k + 1) == "<":
            self._list(k + 1)
        elif self.top() == "enum" and word(t) and self.tok(k + 1) == "(":
            self.members.add(k)
            self._list(k + 1)

    def _list(self, k: int) -> int:
        marks: list[int] = []
        end = self.series(k, marks, strict=self.tok(k) == "<")
        self.at.update(marks if end > 0 else [])
        return end

    def _script(self, k: int, t: str) -> None:
        if "import" in self.seen and "=" not in self.seen:
            return
        member = self.tok(k - 1) == "."
        if self.top() == "type" and word(t) and self.tok(k + 1) in ("(", "<") and self.tok(k - 1) in ("{", ";", ",", "}"):
            self.members.add(k)
        if t in ("class", "interface", "type") and self.name(k + 1) and not member and (t != "type" or self.tok(k + 2) in ("=", "<")):
            self.at.add(k + 1)
            end = self._list(k + 2) if self.tok(k + 2) == "<" else k + 2
            if t == "type" and self.tok(end) == "=":
                self.read(end + 1)
        elif t == "extends" and "class" in self.seen:
            end = self.type(k + 1, marks := [])
            self.at.update(marks[1:] if end > 0 else [])
        elif t in ("extends", "implements") and self.seen & {"interface", "class"}:
            self.read_all(k + 1)
        elif t in ("as", "satisfies", "extends") and not member and (t != "as" or "export" not in self.seen or "=" in self.seen or self.seen & {"const", "let", "function", "class"}):
            self.read(k + 1)
        elif t == "?" and self.tok(k - 1) != "?" and self.tok(k + 1) not in (".", "?", ":", ")", ",", "]", "=", ";", ""):
            self.ternary += 1
            if "type" in self.seen:
                self.read(k + 1)
        elif t == ":":
            if self.ternary:
                self.ternary -= 1
                if "type" in self.seen:
                    self.read(k + 1)
            elif self.top() == "block" and self.seen & {"case", "default"} and self.tok(k - 1) != ")":
                self.seen -= {"case", "default"}
            elif self.tok(k - 1) == ")" and "case" not in self.seen or self.top() in ("(", "class", "type") or self.top() == "block" and self.seen & {"let", "const", "var"}:
                self.read(k + 1)
        elif t == "<" and (self.name(k - 1) or self.tok(k - 1) in ("=", "(", ",")) and not member:
            end = self.series(k, marks := [])
            if end > 0 and self.tok(end) == "(":
                self.at.update(marks)

    def _java(self, k: int, t: str) -> None:
        before = self.tok(k - 1)
        if self.seen & {"import", "package"}:
            return
        if t in ("extends", "implements", "throws", "permits"):
            self.read_all(k + 1)
        elif t in ("new", "instanceof"):
            self.read(k + 1)
        elif t in ("class", "interface", "record") and self.tok(k + 2) == "<" or t == "<" and (before in MODIFIER or before in ("{", "}", ";")):
            self._list(k if t == "<" else k + 2)
        elif self.tok(k + 1) == "." and self.tok(k + 2) == "class" and t[:1].isupper():
            self.at.add(k)
        elif self.name(k) and (k == 0 or before in ("{", "}", ";", "(", ")", ",", ">", ":") or before in MODIFIER or self.tok(k - 2) == "@"):
            end = self.type(k, marks := [])
            if end > 0 and self.name(end) or end > 0 and before == "(" and self.tok(end) == ")" and t[:1].isupper() and (word(self.tok(end + 1)) and self.tok(end + 1) != "throws" or self.tok(end + 1)[:1] in ("(", '"') or self.tok(end + 1)[:1].isdigit()):
                self.at.update(marks)

    def _go(self, k: int, t: str) -> None:
        starts = self._starts(k) or self.tok(k - 1) in ("{", ";", "(")
        top, line = self.top(), self.tokens[k][1]
        if t == "type" and self.name(k + 1) or top == "types" and starts and self.name(k):
            self.go_type(k + 1 if t == "type" else k)
        elif t in ("var", "const") and self.name(k + 1) or top == "vars" and starts and self.name(k):
            self.go_named(k + 1 if t in ("var", "const") else k)
        elif t == "func":
            end = self.go_params(k + 1) if self.tok(k + 1) == "(" and self.name(self.close(k + 1)) and self.tok(self.close(k + 1) + 1) in ("(", "[") else k + 1
            end = end + 1 if self.name(end) else end
            end = self.go_params(end) if self.tok(end) == "[" else end
            self.go_signature(end)
        elif top == "fields" and starts and (word(t) or t == "*"):
            follows = self.tok(k + 1) if k + 1 < self.n and self.tokens[k + 1][1] == line else ""
            self.read(k) if t == "*" or follows == "" or follows[:1] in ".}\"`" or follows == ";" else self.go_named(k)
        elif top == "methods" and starts:
            if word(t) and self.tok(k + 1) == "(":
                self.members.add(k)
                self.go_signature(k + 1)
            else:
                self.read(k)
        elif t == "[" and self.tok(k + 1) == "]" or t == "map" and self.tok(k + 1) == "[" or t == "chan":
            self.read(k)
        elif t == "[" and self.tok(k + 2) == "]" and not (word(self.tok(k - 1)) or self.tok(k - 1) in (")", "]")) and self.tokens[min(k + 3, self.n - 1)][1] == line:
            self.read(k)
        elif t == "." and self.tok(k + 1) == "(":
            self.switch = self.switch or self.tok(k + 2) == "type"
            self.read(k + 2) if self.tok(k + 2) != "type" else None
        elif t in ("make", "new") and self.tok(k + 1) == "(" and self.tok(k - 1) != ".":
            self.read(k + 2)
        elif t == "case" and top == "switch":
            self.read_all(k + 1)

    def go_type(self, k: int) -> None:
        self.at.add(k)
        generic = self.tok(k + 1) == "[" and self.name(k + 2) and self.tok(k + 3) != "]"
        end = self.go_params(k + 1) if generic else k + 1
        self.read(end + (self.tok(end) == "="))

    def go_named(self, k: int) -> None:
        """Names between commas, and their type if one is behind them in the line."""
        while self.tok(k + 1) == "," and word(self.tok(k + 2)):
            k += 2
        if k + 1 < self.n and self.tokens[k + 1][1] == self.tokens[k][1] and self.tok(k + 1) not in ("=", ")"):
            self.read(k + 1)

    def go_params(self, k: int) -> int:
        """Parameters, named or not: if any has a name all have, and those without a type share the next one's."""
        end, parts, j = self.close(k), [], k + 1
        while j < end - 1:
            start = j
            while j < end - 1 and self.tok(j) != ",":
                j = self.close(j) if self.tok(j) in ("(", "[", "{") else j + 1
            parts.append((start, j))
            j += 1
        behind = lambda a: self.tok(a + 1)
        named = [self.name(a) and self.tok(a) != "chan" and b > a + 1 and (behind(a) != "." or self.tok(a + 2) == ".") and (behind(a) != "[" or self.tok(a + 2) == "]" or self.close(a + 1) < b) and behind(a) != "|" for a, b in parts]
        named = [x and self.tok(a) != "map" for x, (a, _) in zip(named, parts)]
        for (a, b), own in zip(parts, named):
            if own or not any(named):
                self.read(a + 1 if own else a)
        return end

    def go_signature(self, k: int) -> int:
        """Parameters and result."""
        if self.tok(k) != "(":
            return -1
        end = self.go_params(k)
        if self.tok(end) == "(" and self.tokens[end][1] == self.tokens[end - 1][1]:
            return self.go_params(end)
        if end < self.n and self.tokens[end][1] == self.tokens[end - 1][1] and self.tok(end) != "{":
            got = self.read(end)
            return got if got > 0 else end
        return end
