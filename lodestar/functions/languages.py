"""Programming languages by file name, with their comments, strings and keywords."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    exts: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    nested: bool = False
    docstrings: bool = False
    backtick: bool = False
    keywords: frozenset[str] = field(default_factory=frozenset)


def _k(words: str) -> frozenset[str]:
    return frozenset(words.split())


SLASH, C_BLOCK = ("//",), (("/*", "*/"),)

# Extensions, names, comment marks and keywords of the languages that are told apart.
LANGUAGES: dict[str, Language] = {
    "python": Language((".py", ".pyw", ".pyi"), line=("#",), docstrings=True, keywords=_k("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case True False None")),
    "javascript": Language((".js", ".mjs", ".cjs", ".jsx"), line=SLASH, block=C_BLOCK, backtick=True, keywords=_k("async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return static super switch this throw try typeof var void while with yield true false null undefined")),
    "typescript": Language((".ts", ".tsx", ".mts", ".cts"), line=SLASH, block=C_BLOCK, backtick=True, keywords=_k("abstract any as asserts async await bigint boolean break case catch class const constructor continue declare debugger default delete do else enum export extends false finally for from function get implements import in infer instanceof interface is keyof let module namespace never new null number object of package override private protected public readonly require return set static string super switch symbol this throw true try type typeof undefined unique unknown var void while with yield")),
    "rust": Language((".rs",), line=SLASH, block=C_BLOCK, nested=True, keywords=_k("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while")),
    "c": Language((".c", ".h"), line=SLASH, block=C_BLOCK, keywords=_k("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while")),
    "cpp": Language((".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", ".h++", ".ipp", ".inl"), line=SLASH, block=C_BLOCK, keywords=_k("alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class compl concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq")),
    "java": Language((".java",), line=SLASH, block=C_BLOCK, keywords=_k("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed permits non-sealed var yield")),
    "go": Language((".go",), line=SLASH, block=C_BLOCK, backtick=True, keywords=_k("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")),
    "ruby": Language((".rb", ".rake", ".gemspec"), line=("#",), keywords=_k("BEGIN END alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield")),
    "shell": Language((".sh", ".bash", ".zsh"), line=("#",), keywords=_k("if then else elif fi for while until do done case esac function in select time coproc return local readonly export unset set shift source alias unalias trap exit")),
    "json": Language((".json", ".jsonl", ".geojson")),
    "yaml": Language((".yml", ".yaml"), line=("#",)),
    "toml": Language((".toml",), line=("#",)),
    "markdown": Language((".md", ".markdown", ".mdx")),
    "html": Language((".html", ".htm", ".xhtml"), block=(("<!--", "-->"),)),
    "css": Language((".css", ".scss", ".less"), block=C_BLOCK, line=SLASH),
    "sql": Language((".sql",), line=("--",), block=C_BLOCK, keywords=_k("select from where insert into values update set delete create table index view alter drop join inner left right full outer on group by order having limit offset union all distinct as and or not null primary key foreign references default check unique")),
    "dockerfile": Language(names=("Dockerfile", "Containerfile"), line=("#",)),
    "makefile": Language(names=("Makefile", "makefile", "GNUmakefile", "CMakeLists.txt"), line=("#",)),
}


def classify(path: Column) -> Column:
    """The language of a path: by its exact name, else by its extension in lower case; else null."""
    base = F.element_at(F.split(path, "/"), -1)
    # A leading dot begins no extension.
    ext = F.lower(F.regexp_extract(base, r"[^.].*?(\.[^.]+)$", 1))
    pairs = [(n, lang) for lang, spec in LANGUAGES.items() for n in spec.names]
    by_name = F.create_map(*(F.lit(x) for p in pairs for x in p))
    pairs = [(e, lang) for lang, spec in LANGUAGES.items() for e in spec.exts]
    by_ext = F.create_map(*(F.lit(x) for p in pairs for x in p))
    return F.coalesce(F.try_element_at(by_name, base), F.try_element_at(by_ext, ext))


def resolve(wanted: list[str]) -> list[str]:
    """Known languages of a list; auto stands for all."""
    names = [w.strip().lower() for w in wanted]
    return sorted(LANGUAGES) if "auto" in names else [n for n in names if n in LANGUAGES]
