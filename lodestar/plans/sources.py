"""Small sources in each language, with what is declared and imported in them, for the queries over code.

Each part of the table ``part`` makes one file of each language: @K@ stands for its key.
The facts are written out by hand; the queries' SQL gives them for every part.
"""

from __future__ import annotations

from typing import NamedTuple


class Source(NamedTuple):
    path: str
    text: str
    symbols: tuple[tuple[str, str, int], ...]  # name, kind, line, in order
    imports: tuple[tuple[str, str], ...] = ()  # target, source, in order


SOURCES: dict[str, Source] = {
    "python": Source(
        "py/m@K@.py",
        'import os\nfrom lib.box@K@ import Box, lid as top\n\nclass Shelf@K@(Box):\n    """Holds boxes."""\n\n    def put(self, x):\n        # no check\n        return top(x, 0x1F)\n\ndef free@K@(n):\n    return n + 1.5\n',
        (("Shelf@K@", "class", 4), ("put", "method", 7), ("free@K@", "function", 11)),
        (("os", "os"), ("Box", "lib.box@K@"), ("lid", "lib.box@K@")),
    ),
    "javascript": Source(
        "js/app@K@.js",
        'import { one, two as zwei } from "./parts@K@";\nimport "./side";\nexport class Pen@K@ {\n  draw(x) { if (x) { stroke(x); } return 1; }\n}\nexport function load@K@() { helper(); }\nconst twice = (n) => n * 2;\nconst LIMIT = 3;\n',
        (("Pen@K@", "class", 3), ("draw", "method", 4), ("load@K@", "function", 6), ("twice", "function", 7), ("LIMIT", "const", 8)),
        (("one", "./parts@K@"), ("two", "./parts@K@"), ("./side", "./side")),
    ),
    "typescript": Source(
        "ts/ui@K@.ts",
        "interface Shape@K@ { area(): number; }\ntype Id = string;\nclass Box@K@<T> {\n  async open(k: string): Promise<T> { return this.go(k); }\n}\n",
        (("Shape@K@", "interface", 1), ("area", "method", 1), ("Id", "type", 2), ("Box@K@", "class", 3), ("open", "method", 4)),
    ),
    "rust": Source(
        "rs/dot@K@.rs",
        "use std::io::{self, Read};\nuse crate::geo@K@::Point as P;\npub struct Dot@K@ { x: u8 }\npub enum Hue { Red }\n/* a /* nested */ note */\nimpl Dot@K@ {\n    fn two(&self) {}\n}\nconst TOP: u8 = 1;\nfn free@K@(n: u8) -> u8 { n }\n",
        (("Dot@K@", "struct", 3), ("Hue", "enum", 4), ("two", "method", 7), ("TOP", "const", 9), ("free@K@", "function", 10)),
        (("std::io", "std::io"), ("std::io::Read", "std::io::Read"), ("crate::geo@K@::Point", "crate::geo@K@::Point")),
    ),
    "c": Source(
        "c/pair@K@.c",
        '#include <stdio.h>\n#include "own@K@.h"\ntypedef struct { int a; } pair@K@_t;\nstatic int add(int a, int b) { return mul(a, b); }\npair@K@_t *make@K@(void) { return go(); }\n',
        (("pair@K@_t", "type", 3), ("add", "function", 4), ("make@K@", "function", 5)),
        (("stdio.h", "stdio.h"), ("own@K@.h", "own@K@.h")),
    ),
    "cpp": Source(
        "cpp/button@K@.cpp",
        '#include "button@K@.hpp"\nnamespace ui {\nclass Button@K@ : public Base {\npublic:\n  int size() const;\n};\n}\n',
        (("ui", "module", 2), ("Button@K@", "class", 3), ("size", "method", 5)),
        (("button@K@.hpp", "button@K@.hpp"),),
    ),
    "java": Source(
        "java/Till@K@.java",
        "package shop;\nimport java.util.List;\npublic class Till@K@ {\n  private int sum = 0;\n  public List<String> names(String k) { return find(k); }\n}\n",
        (("shop", "module", 1), ("Till@K@", "class", 3), ("names", "method", 5)),
        (("java.util.List", "java.util.List"),),
    ),
    "go": Source(
        "go/web@K@.go",
        'package web\nimport (\n  "fmt"\n  m "math"\n)\ntype Site@K@ struct { name string }\ntype Opener interface { Open() }\nfunc New@K@(n string) *Site@K@ { return nil }\nfunc (s *Site@K@) Open() { fmt.Println(s) }\n',
        (("web", "module", 1), ("Site@K@", "struct", 6), ("Opener", "interface", 7), ("New@K@", "function", 8), ("Open", "function", 9)),
        (("fmt", "fmt"), ("math", "math")),
    ),
    "ruby": Source(
        "rb/zoo@K@.rb",
        "require 'set'\nmodule Zoo@K@\n  class Cat\n    def purr\n      1\n    end\n    def self.all; end\n  end\nend\ndef free@K@\nend\n",
        (("Zoo@K@", "module", 2), ("Cat", "class", 3), ("purr", "method", 4), ("all", "method", 7), ("free@K@", "function", 10)),
        (("set", "set"),),
    ),
    "shell": Source("sh/up@K@.sh", "function up@K@ { :; }\ndown() {\n  echo hi # note\n}\n", (("up@K@", "function", 1), ("down", "function", 2))),
    "markdown": Source("md/read@K@.md", "# Part @K@\ntext\n## Two\n#### Four\n##### Five\n", (("Part @K@", "heading", 1), ("Two", "heading", 3), ("Four", "heading", 4))),
}

#: Tokens by kind in each file of some languages: ident, keyword, number, string, punct, comment, docstring.
TOKENS: dict[str, tuple[int, ...]] = {
    "python": (16, 9, 2, 0, 16, 1, 1),
    "shell": (4, 1, 0, 0, 8, 1, 0),
    "c": (15, 10, 0, 1, 26, 0, 0),
}
