"""Declarations and imports of source files, by a grammar of patterns over tokens.

Each language is a small reader over the significant tokens that keeps a stack of open
scopes; ``extract`` never raises and gives nothing for languages without a reader.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from lodestar.operators.lexer import Token, lex, significant


class Symbol(NamedTuple):
    name: str
    kind: str
    line: int
    col: int
    signature: str
    doc: str
    parent: str | None


class Import(NamedTuple):
    target: str  # a name or module as written
    source: str  # the module or path it comes from
    line: int


class Found(NamedTuple):
    symbols: list[Symbol]
    imports: list[Import]
    module_doc: str


class Reader:
    """Tokens of a file with a cursor, the source's lines, and the comments between tokens."""

    def __init__(self, text: str, language: str, tokens: list[Token] | None = None):
        self.all = lex(text, language) if tokens is None else tokens
        self.t = significant(self.all)
        self.values, self.kinds, self.n = [t.value for t in self.t], [t.kind for t in self.t], len(self.t)
        self.lines = text.split("\n")
        self.symbols: list[Symbol] = []
        self.imports: list[Import] = []
        self.comment_ends: dict[int, str] = {}
        for c in self.all:
            if c.kind == "comment":
                last = c.line + c.value.count("\n")
                body = bare(c.value)
                self.comment_ends[last] = f"{self.comment_ends.get(c.line - 1, '')} {body}".strip()

    def at(self, i: int) -> Token:
        return self.t[i] if 0 <= i < len(self.t) else Token("punct", "", 0, 0, -1)

    def v(self, i: int) -> str:
        return self.values[i] if 0 <= i < self.n else ""

    def word(self, i: int) -> bool:
        return 0 <= i < self.n and self.kinds[i] == "ident"

    def add(self, i: int, kind: str, parent: str | None = None, doc: str = "") -> None:
        tok = self.at(i)
        signature = self.lines[tok.line - 1].strip()[:160] if tok.line else ""
        above = next((self.comment_ends[k] for k in (tok.line - 1, tok.line) if k in self.comment_ends), "")
        self.symbols.append(Symbol(tok.value, kind, tok.line, tok.col, signature, (doc or above)[:400], parent))

    def match(self, i: int, opening: str, closing: str) -> int:
        """The place after the bracket that closes the one at i."""
        depth, values = 0, self.values
        while i < self.n:
            depth += (values[i] == opening) - (values[i] == closing)
            i += 1
            if depth == 0:
                return i
        return i


def bare(comment: str) -> str:
    """A comment without its marks."""
    return re.sub(r"^[\s/*#!<-]+|[\s*/>-]+$", "", comment)


def text_of(tok: Token) -> str:
    return tok.value.strip("\"'`")


def python(r: Reader) -> None:
    stack: list[tuple[int, str, str]] = []  # column, name, kind
    docs = {d.line: d.value.strip("\"' \n")for d in r.all if d.kind == "docstring"}
    i = 0
    while i < r.n:
        if r.kinds[i] != "keyword":
            i += 1
            continue
        tok = r.at(i)
        first = r.at(i - 1).line != tok.line or r.v(i - 1) in (";", ":")
        if tok.value in ("class", "def") and tok.kind == "keyword" and r.word(i + 1):
            column = r.at(i - 1).col if r.v(i - 1) == "async" else tok.col
            while stack and stack[-1][0] >= column:
                stack.pop()
            owner = stack[-1] if stack else None
            kind = "class" if tok.value == "class" else "method" if owner and owner[2] == "class" else "function"
            end = i + 2
            while end < len(r.t) and r.v(end) != ":":
                end = r.match(end, r.v(end), {"(": ")", "[": "]"}[r.v(end)]) if r.v(end) in "([" else end + 1
            doc = docs.get(r.at(end).line + 1, "")
            r.add(i + 1, kind, owner[1] if owner else None, doc)
            stack.append((column, r.v(i + 1), kind))
            i += 1
        elif first and tok.value == "import" and tok.kind == "keyword":
            j = i + 1
            while j < len(r.t) and r.at(j).line == tok.line and r.v(j) != ";":
                name = ""
                while j < len(r.t) and r.at(j).line == tok.line and r.v(j) not in (",", "as", ";"):
                    name, j = name + r.v(j), j + 1
                if name:
                    r.imports.append(Import(name, name, tok.line))
                while j < len(r.t) and r.at(j).line == tok.line and r.v(j) not in (",", ";"):
                    j += 1
                j += r.v(j) == ","
            i = j - 1
        elif first and tok.value == "from" and tok.kind == "keyword":
            j, module = i + 1, ""
            while j < len(r.t) and r.v(j) != "import" and r.at(j).line == tok.line:
                module, j = module + r.v(j), j + 1
            if r.v(j) == "import":
                stop = r.match(j + 1, "(", ")") if r.v(j + 1) == "(" else next((k for k in range(j, len(r.t)) if r.at(k).line != r.at(j).line), len(r.t))
                k = j + 1
                while k < stop:
                    if r.v(k) == "as":
                        k += 2
                        continue
                    if r.word(k) or r.v(k) == "*":
                        r.imports.append(Import(r.v(k), module, tok.line))
                    k += 1
                i = stop - 1
        i += 1


def _scoped(r: Reader, step: Callable[[int, list[tuple[str, str]], list], int]) -> None:
    """Walks tokens with a stack of (name, kind) scopes; step returns the next place and may set what the next { opens."""
    stack: list[tuple[str, str]] = []
    pending: list = [None]
    i = 0
    while i < r.n:
        kind = r.kinds[i]
        if kind == "ident" or kind == "keyword":  # no step begins with anything else
            i = step(i, stack, pending)
            continue
        value = r.values[i] if kind == "punct" else ""
        if value == "{":
            stack.append(pending[0] or ("", "block"))
            pending[0] = None
        elif value == "}":
            if stack:
                stack.pop()
        elif value == ";":
            pending[0] = None
        i += 1


CONTROL = frozenset("if for while switch catch return new throw else do sizeof typeof function super case await with".split())


def javascript(r: Reader) -> None:
    def step(i: int, stack: list, pending: list) -> int:
        v, top = r.v(i), stack[-1] if stack else ("", "")
        if v in ("class", "interface", "enum", "namespace") and r.word(i + 1):
            r.add(i + 1, {"namespace": "module"}.get(v, v), top[0] or None)
            pending[0] = (r.v(i + 1), "class" if v == "class" else v)
            return i + 2
        if v == "type" and r.word(i + 1) and r.v(i + 2) in ("=", "<"):
            r.add(i + 1, "type", top[0] or None)
            return i + 2
        if v == "function":
            k = i + 1 + (r.v(i + 1) == "*")
            if r.word(k):
                r.add(k, "function", top[0] or None)
                pending[0] = (r.v(k), "function")
            return k + 1
        if v in ("const", "let", "var") and r.word(i + 1):
            k = i + 2
            while k < len(r.t) and r.v(k) not in ("=", ";") and r.at(k).line == r.at(i).line:
                k += 1
            if r.v(k) == "=":
                arrow = r.v(k + 1) in ("function", "async") or r.v(k + 1) == "(" and _arrow(r, r.match(k + 1, "(", ")")) or r.word(k + 1) and r.v(k + 2) == "=" and r.v(k + 3) == ">"
                if arrow or v == "const":
                    if top[1] in ("", "module", "namespace"):
                        r.add(i + 1, "function" if arrow else "const", top[0] or None)
                return k + 1 + (r.v(k + 1) == "function")
            return i + 2
        if v == "import":
            k, names = i + 1, []
            if r.v(k) == "(":
                if r.at(k + 1).kind == "string":
                    r.imports.append(Import(text_of(r.at(k + 1)), text_of(r.at(k + 1)), r.at(i).line))
                return k + 1
            while k < len(r.t) and r.at(k).kind != "string" and r.v(k) != ";":
                if r.v(k) == "as":
                    k += 2
                    continue
                if r.at(k).kind == "ident" and r.v(k) not in ("from", "type"):
                    names.append(r.v(k))
                k += 1
            if r.at(k).kind == "string":
                source = text_of(r.at(k))
                r.imports += [Import(n, source, r.at(i).line) for n in names or [source]]
            return k + 1
        if v == "require" and r.v(i + 1) == "(" and r.at(i + 2).kind == "string":
            r.imports.append(Import(text_of(r.at(i + 2)), text_of(r.at(i + 2)), r.at(i).line))
            return i + 3
        if top[1] in ("class", "interface") and r.v(i + 1) == "(" and (r.word(i) or v in ("constructor", "get", "set", "delete")) and v not in CONTROL and r.v(i - 1) not in (".", "=", "new", "("):
            after = r.match(i + 1, "(", ")")
            k = after
            while k < len(r.t) and r.v(k) not in ("{", ";", "}", "="):
                k += 1
            if r.v(k) == "{" or top[1] == "interface":
                r.add(i, "method", top[0])
                pending[0] = (v, "function")
                return k
        return i + 1

    _scoped(r, step)


def _arrow(r: Reader, i: int) -> bool:
    """Whether an arrow follows a parameter list, after a return type at most."""
    for k in range(i, min(i + 12, len(r.t))):
        if r.v(k) == "=" and r.v(k + 1) == ">":
            return True
        if r.v(k) in (";", "{", ")"):
            return False
    return False


def rust(r: Reader) -> None:
    kinds = {"struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "type": "type", "const": "const", "static": "const", "union": "struct"}

    def step(i: int, stack: list, pending: list) -> int:
        v = r.v(i)
        owner = next((s for s in reversed(stack) if s[1] in ("impl", "trait", "module")), ("", ""))
        if v == "fn" and r.word(i + 1):
            r.add(i + 1, "method" if owner[1] in ("impl", "trait") else "function", owner[0] or None)
            pending[0] = (r.v(i + 1), "function")
            return i + 2
        if v == "const" and r.v(i + 1) == "fn":
            return i + 1
        if v in kinds and r.word(i + 1) and r.v(i - 1) not in (".", "*"):
            r.add(i + 1, kinds[v], owner[0] or None)
            if v in ("trait", "mod"):
                pending[0] = (r.v(i + 1), kinds[v])
            return i + 2
        if v == "impl":
            k, depth, names = i + 1, 0, []
            while k < len(r.t) and r.v(k) not in ("{", ";"):
                depth += (r.v(k) == "<") - (r.v(k) == ">")
                if depth == 0 and r.v(k) == "for":
                    names = []
                elif depth == 0 and r.word(k):
                    names.append(r.v(k))
                k += 1
            pending[0] = (names[-1] if names else "", "impl")
            return k
        if v == "use":
            k = i + 1
            while k < len(r.t) and r.v(k) != ";":
                k += 1
            for path in _use_paths("".join(f" {r.v(j)} " if r.v(j) == "as" else r.v(j) for j in range(i + 1, k))):
                r.imports.append(Import(path, path, r.at(i).line))
            return k
        return i + 1

    _scoped(r, step)


def _use_paths(text: str, head: str = "") -> list[str]:
    """Paths of a use declaration, groups spelled out."""
    if "{" not in text:
        path = (head + text).split(" as ")[0].strip().removesuffix("::self").rstrip(":")
        return [path] if path else []
    before, rest = text.split("{", 1)
    inner, depth, parts = "", 0, []
    for c in rest.rsplit("}", 1)[0]:
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(inner)
            inner = ""
        else:
            inner += c
    return [p for part in [*parts, inner] if part.strip() for p in _use_paths(part.strip(), head + before)]


def c_family(language: str) -> Callable[[Reader], None]:
    types = {"class": "class", "struct": "struct", "enum": "enum", "union": "struct", "interface": "interface", "record": "class", "namespace": "module"}

    def read(r: Reader) -> None:
        if language != "java":
            for n, line in enumerate(r.lines, 1):
                if m := re.match(r'\s*#\s*include\s*[<"]([^>"]+)[>"]', line):
                    r.imports.append(Import(m[1], m[1], n))

        def step(i: int, stack: list, pending: list) -> int:
            v, top = r.v(i), stack[-1] if stack else ("", "")
            if v in types and r.at(i).kind in ("keyword", "ident") and r.word(i + 1) and (language == "java" or v not in ("interface", "record")) and r.v(i - 1) not in (".", "<", ","):
                after = r.v(i + 2)
                if after in ("{", ":", "extends", "implements", "<", "final", "(", "permits"):
                    if after != "(" or v == "record":
                        r.add(i + 1, types[v], top[0] or None)
                        pending[0] = (r.v(i + 1), "type" if types[v] != "module" else "module")
                        return i + 2
                return i + 1
            if v == "typedef":
                k = i + 1
                while k < len(r.t) and r.v(k) != ";":
                    k = r.match(k, "{", "}") if r.v(k) == "{" else k + 1
                if r.word(k - 1):
                    r.add(k - 1, "type", top[0] or None)
                return k
            if language == "java" and v in ("import", "package"):
                k, name = i + 1, ""
                while k < len(r.t) and r.v(k) != ";":
                    name, k = name + (r.v(k) if r.v(k) != "static" else ""), k + 1
                if v == "package":
                    r.add(k - 1, "module")
                else:
                    r.imports.append(Import(name, name, r.at(i).line))
                return k
            if r.word(i) and r.v(i + 1) == "(" and v not in CONTROL and top[1] in ("", "type", "module"):
                before = r.at(i - 1)
                typed = before.kind in ("ident", "keyword") and before.value not in ("return", "new", "throw", "else", "case", "goto") or before.value in ("*", "&", ">", "]", "~", ":")
                after = r.match(i + 1, "(", ")")
                k = after
                while r.at(k).kind in ("keyword", "ident") and r.v(k) not in CONTROL or r.v(k) in (",", "."):
                    k += 1
                own = top[1] == "type" and v == top[0]
                if (typed or own) and (r.v(k) in ("{", ";", ":") or r.v(k) == "=" and language == "cpp") and (r.v(k) != ";" or typed):
                    declared = r.v(k) != ";" or top[1] == "type"
                    if declared:
                        r.add(i, "method" if top[1] == "type" or r.v(i - 1) == ":" else "function", top[0] or None)
                        pending[0] = (v, "function")
                    return k
                return after
            return i + 1

        _scoped(r, step)

    return read


def go(r: Reader) -> None:
    i = 0
    while i < r.n:
        if r.kinds[i] not in ("ident", "keyword"):
            i += 1
            continue
        v = r.v(i)
        if v == "func" and r.at(i).kind == "keyword":
            k = i + 1
            parent = None
            if r.v(k) == "(":
                end = r.match(k, "(", ")")
                names = [r.v(j) for j in range(k, end) if r.word(j)]
                parent, k = names[-1] if names else None, end
            if r.word(k) and r.v(k + 1) in ("(", "["):
                r.add(k, "function", parent)
            i = k
        elif v == "type" and r.at(i).kind == "keyword":
            if r.v(i + 1) == "(":
                end, j, depth = r.match(i + 1, "(", ")"), i + 2, 0
                while j < end:
                    depth += (r.v(j) in "{(") - (r.v(j) in "})")
                    if depth == 0 and r.word(j) and r.at(j).line != r.at(j - 1).line:
                        r.add(j, r.v(j + 1) if r.v(j + 1) in ("struct", "interface") else "type")
                    j += 1
                i = end - 1
            elif r.word(i + 1):
                r.add(i + 1, r.v(i + 2) if r.v(i + 2) in ("struct", "interface") else "type")
        elif v == "package" and r.word(i + 1):
            r.add(i + 1, "module")
        elif v == "import":
            end = r.match(i + 1, "(", ")") if r.v(i + 1) == "(" else i + 3
            for j in range(i + 1, min(end, len(r.t))):
                if r.at(j).kind == "string":
                    r.imports.append(Import(text_of(r.at(j)), text_of(r.at(j)), r.at(j).line))
                    if r.v(i + 1) != "(":
                        break
        i += 1


def ruby(r: Reader) -> None:
    openers = frozenset("class module def begin case do if unless while until for".split())
    stack: list[tuple[str, str]] = []
    for i, tok in enumerate(r.t):
        if r.kinds[i] not in ("ident", "keyword"):
            continue
        first = r.at(i - 1).line != tok.line
        if tok.value in ("require", "require_relative") and r.at(i + 1).kind == "string":
            r.imports.append(Import(text_of(r.at(i + 1)), text_of(r.at(i + 1)), tok.line))
        elif tok.kind != "keyword":
            continue
        elif tok.value in ("class", "module") and r.word(i + 1) and first:
            r.add(i + 1, tok.value, stack[-1][0] or None if stack else None)
            stack.append((r.v(i + 1), tok.value))
        elif tok.value == "def":
            k = i + 3 if r.v(i + 1) == "self" and r.v(i + 2) == "." else i + 1
            owner = next((s for s in reversed(stack) if s[1] in ("class", "module")), None)
            r.add(k, "method" if owner else "function", owner[0] if owner else None)
            stack.append(("", "def"))
        elif tok.value in openers and (first or tok.value in ("do", "begin", "case")):
            if not (tok.value == "do" and any(r.v(j) in ("while", "until", "for") for j in range(max(0, i - 12), i) if r.at(j).line == tok.line)):
                stack.append(("", tok.value))
        elif tok.value == "end" and stack:
            stack.pop()


def shell(r: Reader) -> None:
    for i, tok in enumerate(r.t):
        if tok.value == "function" and r.word(i + 1):
            r.add(i + 1, "function")
        elif r.word(i) and r.v(i + 1) == "(" and r.v(i + 2) == ")" and r.v(i - 1) != "function" and r.at(i - 1).line != tok.line:
            r.add(i, "function")
        elif tok.value in ("source", ".") and r.at(i - 1).line != tok.line and r.at(i + 1).line == tok.line:
            rest = r.lines[tok.line - 1].strip().split(None, 1)
            if len(rest) > 1:
                target = rest[1].split()[0].strip("\"'")
                r.imports.append(Import(target, target, tok.line))


def markdown(r: Reader) -> None:
    for n, line in enumerate(r.lines, 1):
        if m := re.match(r"(#{1,4})[ \t]+(.*)", line):
            r.symbols.append(Symbol(m[2].strip(), "heading", n, 1, line.strip()[:160], "", None))


#: What reads each language; more can be registered.
READERS: dict[str, Callable[[Reader], None]] = {
    "python": python, "javascript": javascript, "typescript": javascript, "rust": rust, "c": c_family("c"), "cpp": c_family("cpp"), "java": c_family("java"), "go": go, "ruby": ruby, "shell": shell, "markdown": markdown,
}


def extract(text: str, language: str | None, tokens: list[Token] | None = None) -> Found:
    """Declarations in order, imports, and the module's own documentation; of the text's tokens where these are at hand."""
    read = READERS.get(language or "")
    if read is None:
        return Found([], [], "")
    try:
        r = Reader(text, language, tokens)
        read(r)
        doc = next((t.value.strip("\"' \n") for t in r.all[:1] if t.kind == "docstring"), "") or next((bare(t.value) for t in r.all[:1] if t.kind == "comment"), "")
        return Found(r.symbols, r.imports, doc[:400])
    except Exception:  # a file that can't be read has no symbols; the rest of the corpus goes on
        return Found([], [], "")


def calls(tokens: list[Token]) -> list[tuple[int, str, int]]:
    """(place, name, line) of identifiers that an opening bracket follows, of all tokens of a text."""
    out, last = [], None
    for i, t in enumerate(tokens):
        if t.kind in ("comment", "docstring"):
            continue
        if last and t.kind == "punct" and t.value == "(":
            out.append(last)
        last = (i, t.value, t.line) if t.kind == "ident" else None
    return out
