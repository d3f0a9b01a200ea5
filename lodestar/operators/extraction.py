"""Lexing and symbol extraction as tables. A file is the unit of work; files don't depend on each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestar.operators import lexer, symbols
from lodestar.shipping import bounded_batches, ship

TOKENS = "path string, pos int, kind string, value string, line int, col int, offset int"
SYMBOLS = "path string, ord int, name string, kind string, line int, col int, signature string, doc string, parent string"
IMPORTS = "path string, language string, ord int, target string, source string, line int"
PARSED = "path string, language string, what string, ord int, name string, kind string, source string, line int, col int, signature string, doc string, parent string"
#: Rows of a batch on its way back to Spark: a file's tokens are many times its size in Python.
ROWS = 5_000


def batched(rows: Iterator[tuple], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ROWS, each made once the one before is gone."""
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), fields, strict=True)], schema=fields)


def _rows(files: DataFrame, of: Callable[[str, str | None, str | None], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows of each file(path, language, text), in batches of bounded size whatever files there are."""
    fields = pa.schema([(name, {"string": pa.string(), "int": pa.int32()}[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((row for b in batches for file in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in of(*file)), fields)

    ship(files.sparkSession)
    bounded_batches(files.sparkSession)
    return files.select("path", "language", "text").mapInArrow(run, schema)


def tokens(files: DataFrame) -> DataFrame:
    """All tokens of files(path, language, text)."""
    return _rows(files, lambda path, language, text: ((path, i, *t) for i, t in enumerate(lexer.tokens(text or "", language))), TOKENS)


def declared(files: DataFrame) -> DataFrame:
    """All symbols of files, in order."""
    return _rows(files, lambda path, language, text: ((path, i, *s) for i, s in enumerate(symbols.extract(text or "", language).symbols)), SYMBOLS)


def imported(files: DataFrame) -> DataFrame:
    """All imports of files, in order."""
    return _rows(files, lambda path, language, text: ((path, language, i, *x) for i, x in enumerate(symbols.extract(text or "", language).imports)), IMPORTS)


def parsed(files: DataFrame) -> DataFrame:
    """Symbols, imports and calls of files, told apart by ``what``, from one lexing of each."""

    def of(path: str, language: str | None, text: str | None) -> Iterator[tuple]:
        found = lexer.lex(text or "", language)
        told = symbols.extract(text or "", language, found)
        for i, s in enumerate(told.symbols):
            yield path, language, "symbol", i, s.name, s.kind, None, s.line, s.col, s.signature, s.doc, s.parent
        for i, x in enumerate(told.imports):
            yield path, language, "import", i, x.target, None, x.source, x.line, None, None, None, None
        for i, name, line in symbols.calls(found):
            yield path, language, "call", i, name, None, None, line, None, None, None, None

    return _rows(files, of, PARSED)


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, imports, calls(path, pos, name, line)) of what was parsed."""
    one = rows.where("what = 'symbol'").select(*(c.split()[0] for c in SYMBOLS.split(", ")))
    two = rows.where("what = 'import'").select("path", "language", "ord", F.col("name").alias("target"), "source", "line")
    return one, two, rows.where("what = 'call'").select("path", F.col("ord").alias("pos"), "name", "line")


@udtf(returnType="kind: string, value: string, line: int, col: int, offset: int")
class Lex:
    """For SQL: LATERAL lex(text, language)."""

    def eval(self, text: str, language: str):
        yield from lexer.lex(text or "", language)


@udtf(returnType="name: string, kind: string, line: int, col: int, signature: string, doc: string, parent: string")
class ExtractSymbols:
    """For SQL: LATERAL extract_symbols(text, language)."""

    def eval(self, text: str, language: str):
        yield from symbols.extract(text or "", language).symbols


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("lex", Lex)
    spark.udtf.register("extract_symbols", ExtractSymbols)


def token_stats(tokens: DataFrame) -> DataFrame:
    """(path, one column for each kind, code): tokens of each kind, and all but comments."""
    kinds = ("ident", "keyword", "number", "string", "punct", "comment", "docstring")
    return tokens.groupBy("path").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.count_if(~F.col("kind").isin("comment", "docstring")).alias("code"))
