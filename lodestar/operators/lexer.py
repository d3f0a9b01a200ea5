"""Source text to tokens, in one pass for each file; Spark runs it as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

from lodestar.functions.languages import LANGUAGES, Language


class Token(NamedTuple):
    kind: str  # ident, keyword, number, string, comment, docstring or punct
    value: str
    line: int  # from 1
    col: int  # from 1
    offset: int


IDENT = re.compile(r"[^\W\d]\w*")
NUMBER = re.compile(r"0[xX][0-9A-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[A-Za-z]*")
LIFETIME = re.compile(r"'[A-Za-z_]\w*(?!')")


def _string(text: str, at: int, quote: str) -> int:
    """Where a quoted string ends; a single-quoted or double-quoted one ends at its line's end at the latest."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == quote:
            return i + 1
        if c == "\n" and quote != "`":
            return i
        i += 1
    return n


def _block(text: str, at: int, opening: str, closing: str, nested: bool) -> int:
    depth, i = 1, at + len(opening)
    while depth:
        end = text.find(closing, i)
        if end < 0:
            return len(text)
        inner = text.find(opening, i, end) if nested else -1
        if inner >= 0:
            depth, i = depth + 1, inner + len(opening)
        else:
            depth, i = depth - 1, end + len(closing)
    return i


@cache
def _master(language: str | None) -> re.Pattern:
    """One pattern for a language's tokens, in the order in which they are tried; white space is its first part, which has no name."""
    spec = LANGUAGES.get(language or "", Language())
    parts = [r"\s+"]
    if spec.docstrings:
        parts.append("(?P<docstring>" + "|".join(f"{q}(?:.*?{q}|.*)" for q in ('"""', "'''")) + ")")
    for opening, closing in spec.block:
        a, b = re.escape(opening), re.escape(closing)
        parts.append(f"(?P<block>{a})" if spec.nested else f"(?P<comment>{a}(?:.*?{b}|.*))")
    if spec.line:
        # A second kind of comment takes a name of its own.
        parts.append("(?P<remark>(?:" + "|".join(map(re.escape, spec.line)) + r")[^\n]*)")
    if language == "rust":
        parts.append("(?P<tick>')")
    quotes = [(q, rf"(?:[^{q}\\\n]|\\.)*+") for q in ('"', "'")] + ([("`", r"(?:[^`\\]|\\.)*+")] if spec.backtick else [])
    parts.append("(?P<string>" + "|".join(rf"{q}{body}(?:{q}|\\\Z)?" for q, body in quotes) + ")")
    # Blanks after a token go with it, so that few matches are of white space.
    parts += [rf"(?:(?P<ident>{IDENT.pattern})|(?P<number>{NUMBER.pattern})|(?P<punct>.))[^\S\n]*"]
    return re.compile("|".join(parts), re.DOTALL)


def tokens(text: str, language: str | None) -> Iterator[Token]:
    """All tokens of a text, one after the other; white space is skipped, and anything unknown is a punctuation mark."""
    spec = LANGUAGES.get(language or "", Language())
    keywords, master, new = spec.keywords, _master(language), tuple.__new__
    i, line, bol, n = 0, 1, 0, len(text)
    while i < n:
        for m in master.finditer(text, i):
            kind, i = m.lastgroup, m.start()
            if kind == "ident":
                value = m["ident"]
                yield new(Token, ("keyword" if value in keywords else "ident", value, line, i - bol + 1, i))
                continue
            if kind == "punct" or kind == "number":
                yield new(Token, (kind, m[kind], line, i - bol + 1, i))
                continue
            end, jump = m.end(), False
            if kind == "remark":
                kind = "comment"
            elif kind == "block":
                jump, kind, end = True, "comment", _block(text, i, *next(b for b in spec.block if text.startswith(b[0], i)), spec.nested)
            elif kind == "tick":
                life = LIFETIME.match(text[i : i + 64])
                jump, (kind, end) = True, ("ident", i + life.end()) if life else ("string", _string(text, i, "'"))
            value = text[i:end]
            if kind:
                yield new(Token, (kind, value, line, i - bol + 1, i))
            if breaks := value.count("\n"):
                line += breaks
                bol = i + value.rindex("\n") + 1
            if jump:  # these end where the pattern doesn't tell
                i = end
                break
        else:
            return


def lex(text: str, language: str | None) -> list[Token]:
    """All tokens of a text."""
    return list(tokens(text, language))


def significant(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind not in ("comment", "docstring")]
