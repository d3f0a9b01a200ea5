"""A corpus as tables: files, postings, term statistics, symbols.

files(path, dir array, name, language, text, size, lines) is the common shape; adapters make
it from documents, web pages or a scanned repository. The walk order of a repository is the
order of (dir, name): a folder's files stand before those of its subfolders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.checkpoints import cut, written
from lodestar.functions import text as T


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as files source/lang/doc_<id>.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    return with_places(docs.select(path.alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("text")))


def from_pages(pages: DataFrame) -> DataFrame:
    """Web pages as files named by their address without scheme and parameters."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return with_places(pages.select(path.alias("path"), F.lit("html").alias("language"), F.coalesce("html", F.lit("")).alias("text")))


def with_places(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return files.select("path", F.slice(parts, 1, F.size(parts) - 1).alias("dir"), F.element_at(parts, -1).alias("name"), "language", "text", F.octet_length("text").cast("bigint").alias("size"), T.line_count("text").alias("lines"))


def terms(files: DataFrame, id_cols: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row for each word of each file. Two generators in a row cost less than nested array functions."""
    runs = files.select(*id_cols, F.explode(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))).alias("r"))
    words = runs.select(*id_cols, F.explode(F.regexp_extract_all("r", F.lit(T.WORD), F.lit(0))).alias("w"))
    return words.select(*id_cols, F.lower("w").alias("term")).where(~F.col("term").isin(*T.STOPWORDS))


def postings(files: DataFrame, id_cols: tuple[str, ...] = ("path",)) -> DataFrame:
    """(path, term, cnt, tf): how often a file holds a word, and its share of all the file's words."""
    counts = terms(files, id_cols).groupBy(*id_cols, "term").agg(F.count("*").alias("cnt"))
    return counts.withColumn("tf", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*id_cols)))


def term_stats(posts: DataFrame, n_files: int | F.Column) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + N / (1 + df)), N being all files."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1.0 + n_files / (1.0 + F.col("df"))))


def headings(files: DataFrame) -> DataFrame:
    """Markdown headings to level 4: (path, line, level, name)."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "row"))
    mark = F.regexp_extract("row", "^(#{1,4})[ \t]+([^\n]*)", 1)
    return lines.select("path", (F.col("at") + 1).alias("line"), F.length(mark).alias("level"), F.trim(F.regexp_extract("row", "^(#{1,4})[ \t]+([^\n]*)", 2)).alias("name")).where(F.col("level") > 0)


def html_symbols(pages: DataFrame) -> DataFrame:
    """Headings of web pages as symbols: (path, ord, name, kind, line)."""
    files = from_pages(pages)
    found = files.select("path", "dir", F.posexplode(F.regexp_extract_all("text", F.lit("<h1>([^<]*)</h1>"), F.lit(1))).alias("ord", "name"))
    return found.select("path", "dir", "ord", "name", F.lit("heading").alias("kind"), F.lit(1).alias("line"))


def summary(files: DataFrame) -> DataFrame:
    """One row: files, lines, bytes, languages."""
    return files.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"), F.count_distinct("language").alias("languages"))


def build(files: DataFrame) -> dict[str, DataFrame | Callable]:
    """Every table of an index of files(path, dir, name, language, text, size, lines): what ``index_store.save`` takes.

    files without their texts, postings, term statistics, symbols, imports, nodes and edges.
    Files are lexed once, at once; the rest is lazy, and term statistics are counted from the
    saved postings.
    """
    from lodestar.operators import extraction, graph, resolve

    posts = postings(files)
    symbols, imports, calls = extraction.parts(written(extraction.parsed(files)))
    nodes, edges = graph.build(files, symbols, resolve.imports_to_files(imports, files), resolve.bound(calls, symbols))
    n = files.count()
    return {"files": files.drop("text"), "postings": posts, "terms": lambda saved: term_stats(saved("postings"), n), "symbols": symbols, "imports": imports, "nodes": nodes, "edges": edges}


def index_summary(files: DataFrame, symbols: DataFrame, edges: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(metric, value): files, lines, bytes, distinct symbol names and edges, files of each language, and files skipped for each reason."""
    def named(df: DataFrame, metric: str | F.Column, value: F.Column | str) -> DataFrame:
        metric = F.lit(metric) if isinstance(metric, str) else metric
        return df.select(metric.alias("metric"), F.col(value).cast("bigint").alias("value") if isinstance(value, str) else value.cast("bigint").alias("value"))

    one = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    out = one.select(F.explode(F.create_map(*(x for c in ("files", "lines", "bytes") for x in (F.lit(c), F.col(c).cast("bigint"))))).alias("metric", "value"))
    out = out.unionByName(named(symbols.agg(F.count_distinct("name").alias("n")), "symbols", "n")).unionByName(named(edges.agg(F.count("*").alias("n")), "edges", "n"))
    out = out.unionByName(named(language_counts(files), F.concat(F.lit("language "), F.coalesce("language", F.lit("text"))), "files"))
    return out if skipped is None else out.unionByName(named(skipped, F.concat(F.lit("skipped "), "reason"), "files"))


def summary_markdown(files: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(part, place, line): lines of an index summary: figures, languages by their files, symbols by their rank."""
    from lodestar.operators import graph

    figures = index_summary(files, symbols, edges).where(~F.col("metric").startswith("language ") & (F.col("metric") != "bytes"))
    order = F.array_position(T.strings("files", "lines", "symbols", "edges"), F.col("metric"))
    label = F.when(F.col("metric") == "edges", "graph edges").otherwise(F.col("metric"))
    one = figures.select(F.lit(0).alias("part"), order.cast("int").alias("place"), F.concat(F.lit("| "), label, F.lit(" | "), F.when(F.col("metric") == "lines", T.human_count("value")).otherwise(F.col("value").cast("string")), F.lit(" |")).alias("line"))
    languages = language_counts(files).withColumn("k", F.row_number().over(Window.orderBy(F.desc("files"), "language")))  # a row a language
    two = languages.select(F.lit(1).alias("part"), F.col("k").alias("place"), F.concat(F.lit("* "), F.coalesce("language", F.lit("text")), F.lit(": "), F.col("files").cast("string"), F.lit(" files")).alias("line"))
    ranks = graph.page_rank(nodes, edges, iterations=15).withColumn("rank", F.round("rank", 12))
    ranked = symbols.withColumn("id", graph.symbol_id(F.col("path"), F.col("name"), F.col("line"))).dropDuplicates(["id"]).join(ranks, "id").orderBy(F.desc("rank"), "path", "ord").limit(limit)
    ranked = ranked.withColumn("k", F.row_number().over(Window.orderBy(F.desc("rank"), "path", "ord")))  # limited above
    three = ranked.select(F.lit(2).alias("part"), F.col("k").alias("place"), F.concat(F.lit("* `"), "name", F.lit("` ("), "kind", F.lit(") — `"), "path", F.lit("`")).alias("line"))
    return one.unionByName(two).unionByName(three)


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows with their ``place`` in an order, from 1: sorted by ranges, and counted on from range to range."""
    ranged = cut(rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = sorted((r["_part"], r["n"], r["first"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("first")).collect())  # a row a partition
    before, offsets = 0, []
    for part, n, first in counts:
        offsets.append((part, before - first))
        before += n
    offset = rows.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return ranged.join(F.broadcast(offset), "_part").withColumn("place", F.col("_row") + F.col("_offset") + 1).drop("_part", "_row", "_offset")


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")


def largest(files: DataFrame, limit: int = 6) -> DataFrame:
    return files.select("path", "language", "lines", "size").orderBy(F.desc("size"), "path").limit(limit)
