"""Secrets: fixed patterns, and strings that look random to character Markov models.

Everything here is DataFrame operations. Two first-order Markov models over the characters
of tokens are trained from labelled samples: random strings (made by rule: base64 and
hexadecimal digests of numbers, in several shapes) and ordinary identifiers: all tokens of all
documents that are shorter than ``least_chars``, whole and joined by the usual
separators, half and half with the keywords of programming languages. Each distinct token counts by the logarithm of its frequency. Longer tokens, which may be secrets
themselves, are never learned from. A token of at least ``least_chars`` characters is a secret
when its log-likelihood ratio, random against ordinary, reaches ``bits`` bits a character and
``evidence`` bits in all, so that short tokens must look the more random. (Sixteen characters
are what a 64-bit identifier takes in hexadecimal digits: by default tokens are longer.) Only the table of
ratios, of fixed size, passes through the driver.

Matches' places come from the lengths of the pieces between them, in code points, summed up
in blocks, so that the work grows hardly faster than a text's matches.

Defined cases: null text is empty and has no spans; null ids keep their row; repeated rows
are scanned each; empty tables give no rows, with models made from the random samples alone;
very long texts are scanned whole; a token that any base span touches is that span's, whatever
its ratio; a ratio equal to the threshold reaches it; columns beside the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.languages import LANGUAGES
from lodestar.functions.text import STOPWORDS

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so asking for their length in the pattern drops the same matches as a filter.
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
TOKEN = "[A-Za-z0-9+/_=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = (ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62], ALPHABET[62:])
NONE = "cast(array() as array<struct<start:int,end:int,value:string>>)"
#: How many occurrences a character's overall share weighs among those after one character.
BACK = 4.0
#: Matches whose places are summed up at once.
BLOCK = 64


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def found(text: Column, pattern: str, hint: Column | None = None, value: int = 0) -> Column:
    """All leftmost non-overlapping matches: array<struct<start,end,value>>, value being a group."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("match"), (F.regexp_extract_all(text, p, F.lit(value)) if value else whole).alias("value"))

    def length(x: Column) -> Column:
        return F.length(x["before"]) + F.coalesce(F.length(x["match"]), F.lit(0))

    def append(acc: Column, one: Column, step: Column) -> Column:
        return F.struct((acc["at"] + step).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(block: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["before"])
            return append(acc, F.struct(start.alias("start"), (start + F.coalesce(F.length(x["match"]), F.lit(0))).alias("end"), x["value"].alias("value")), length(x))

        return F.aggregate(block, F.struct(first.alias("at"), F.expr(NONE).alias("out")), step, lambda acc: acc["out"])

    def in_blocks(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda k: F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)))
        return bound(blocks, lambda b: F.flatten(F.zip_with(b, firsts(b), placed)))

    def firsts(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + length(x)))
        return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), lambda acc, n: append(acc, acc["at"], n), lambda acc: acc["out"])

    all_of = bound(parts, lambda p: F.when(F.size(p) <= BLOCK, placed(p, F.lit(0))).otherwise(in_blocks(p)))
    some = text.rlike(pattern)
    # The last piece stands after the last match.
    return F.when(some if hint is None else hint & some, F.filter(all_of, lambda x: x["value"].isNotNull())).otherwise(F.expr(NONE))


def pairs_of(tokens: DataFrame) -> DataFrame:
    """(a, b, n): the weight with which character b follows a in the column ``token``; a is empty at the start."""
    chars = F.split("token", "")
    pairs = F.transform(chars, lambda c, i: F.struct(F.when(i == 0, F.lit("")).otherwise(F.get(chars, i - 1)).alias("a"), c.alias("b")))
    return tokens.select("weight", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("weight").alias("n"))


def ordinary(docs: DataFrame, text_col: str, least_chars: int) -> DataFrame:
    """(token, weight): each token below ``least_chars`` characters, joined to itself by separators."""
    short = f"(?<!{TOKEN}){TOKEN}{{2,{least_chars - 1}}}+(?!{TOKEN})"
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(short), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.select(F.concat("w", F.lit("_"), "w", F.lit("-"), "w", F.lit("/"), "w").alias("token"), F.log2(F.col("n") + 1).alias("weight"))


def ratios(docs: DataFrame, text_col: str = "text", *, least_chars: int = 17, samples: int = 4000) -> list[float]:
    """Log2 ratios of b after a, random against ordinary, at index place(a) * size + place(b); place 0 is the start."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = docs.sparkSession.range(samples).select(
        F.element_at(F.array(F.base64(F.unhex(digest)), digest, F.upper(F.base64(F.unhex(digest))), F.translate(F.base64(F.unhex(digest)), "+/=", "Ab0")), (F.col("id") % 4 + 1).cast("int")).alias("token"),
        F.lit(1.0).alias("weight"),
    )
    counts = pairs_of(random).select(F.lit("r").alias("k"), "a", "b", "n").unionByName(pairs_of(ordinary(docs, text_col, least_chars)).select(F.lit("o").alias("k"), "a", "b", "n"))
    table = {(r["k"], r["a"], r["b"]): r["n"] for r in counts.collect() if (r["a"] == "" or r["a"] in ALPHABET) and r["b"] in ALPHABET}
    table |= {("w", a, b): n for (a, b), n in known_words().items()}
    r, o, w = (shares({(a, b): n for (of, a, b), n in table.items() if of == k}) for k in "row")
    return [math.log2(x / (0.5 * y + 0.5 * z)) for x, y, z in zip(r, o, w, strict=True)]


def known_words() -> dict[tuple[str, str], float]:
    """Pairs of characters in the words that programs are made of, in small letters and with a capital, and joined."""
    out: dict[tuple[str, str], float] = {}
    words = sorted({w for spec in LANGUAGES.values() for w in spec.keywords if w.isalpha()} | set(STOPWORDS))
    for w in (v for word in words for v in (word, word.capitalize())):
        token = f"{w}_{w}-{w}/{w}"
        for a, b in zip(["", *token], token, strict=False):
            out[a, b] = out.get((a, b), 0) + 1
    return out


def shares(n: dict[tuple[str, str], float]) -> list[float]:
    """P(b after a) at index place(a) * size + place(b).

    A character that hasn't been seen after this one is as likely as it is anywhere: half by
    itself, half by its class, so that no small letter is a surprise among small letters.
    """
    single = {b: sum(n.get((a, b), 0) for a in ["", *ALPHABET]) + 0.5 for b in ALPHABET}
    of_class = {c: sum(single[b] for b in members) / len(members) for members in CLASSES for c in members}
    anywhere = {b: (single[b] + of_class[b]) / 2 / sum(single.values()) for b in ALPHABET}
    out = []
    for a in ["", *ALPHABET]:
        total = sum(n.get((a, b), 0) for b in ALPHABET)
        out += [(n.get((a, b), 0) + BACK * anywhere[b]) / (total + BACK) for b in ALPHABET]
    return out


def likelihood_ratio(token: Column, table: list[float]) -> Column:
    """Bits a character in favour of randomness."""
    size = len(ALPHABET)
    known = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    total = F.aggregate(places, F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("s")), lambda acc, p: F.struct(p.alias("a"), (acc["s"] + F.element_at(known, acc["a"] * size + p)).alias("s")), lambda acc: acc["s"])
    return total / F.length(token)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 17, bits: float = 1.0, evidence: float = 40.0, **how) -> DataFrame:
    """One row for each document: doc_id, spans array<struct<kind,start,end>> by start, then kind."""
    table = ratios(docs, text_col, least_chars=least_chars, **how)
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(found(text, ASSIGN, value=2), lambda x: F.length(x["value"]) >= 6).alias("assign"),
        found(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        found(text, HEX).alias("hex"),
        found(text, f"{TOKEN}{{{least_chars},}}+").alias("token"),
    )

    def named(k: int) -> Column:
        return F.transform(KINDS[k] if k < 3 else "token", lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))

    rows = rows.withColumn("base", F.concat(named(0), named(1), named(2)))
    fresh = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.withColumn("token", fresh).withColumn("token", F.filter("token", lambda t: likelihood_ratio(t["value"], table) >= F.greatest(F.lit(bits), evidence / F.length(t["value"]))))
    names = F.array(*map(F.lit, KINDS))
    every = F.transform(F.array_sort(F.concat("base", named(3))), lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    return rows.select("doc_id", every.alias("spans"))
