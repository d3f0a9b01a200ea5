"""Context packs: ordered sections about a query, admitted while they fit a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.checkpoints import cut
from lodestar.functions import text as T
from lodestar.operators import corpus, graph, memory


def admit(items: Column, cost: Column | str, budget: int, first_always: bool = True) -> Column:
    """Of an ordered array of structs those that fit, one after the other; what is too large is skipped, not the rest.

    A fold, as whether one fits depends on which ones did before. With first_always the first
    one admitted may exceed the budget.
    """
    field = cost if isinstance(cost, str) else "cost"

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x[field] <= budget
        if first_always:
            fits = fits | (F.size(acc["kept"]) == 0)
        return F.struct(F.when(fits, acc["used"] + x[field]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    none = F.filter(items, lambda x: F.lit(False))
    return F.aggregate(items, F.struct(F.lit(0).cast("bigint").alias("used"), none.alias("kept")), step)


def pack(sections: DataFrame, budget: int = 8000) -> DataFrame:
    """(section_ord, title, body, tokens, used): the admitted ones of sections(section_ord, title, body)."""
    rows = sections.where("body IS NOT NULL").withColumn("tokens", T.estimate_tokens("body"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("section_ord", "title", "body", "tokens"))).alias("s"))
    kept = one.select(admit(F.col("s"), "tokens", budget).alias("p"))
    return kept.select(F.col("p.used").alias("used"), F.explode("p.kept").alias("s")).select("s.section_ord", "s.title", "s.body", "s.tokens", "used")


def render(packed: DataFrame, budget: int) -> DataFrame:
    """One row: the whole text with its header."""
    parts = packed.agg(F.max("used").alias("used"), F.array_sort(F.collect_list(F.struct("section_ord", F.concat(F.lit("## "), "title", F.lit("\n\n"), "body").alias("t")))).alias("s"))
    body = F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: x["t"]), "\n\n")).otherwise("_(nothing matches: the index is empty or the query is too narrow)_")
    return parts.select(F.concat(F.lit("context pack · "), F.coalesce("used", F.lit(0)), F.lit(f"/{budget} tokens\n\n"), body).alias("text"))


def snippet(text: Column | str, path: Column | str, start: Column | int, span: int = 8) -> Column:
    """Lines start to start + span (so one more than span) under a header; empty past the end and for unsafe paths."""
    lines = F.split(T.col(text), "\n")
    total = T.line_count(text).cast("int")
    first = F.greatest(F.lit(1), F.lit(start) if isinstance(start, int) else start)
    last = F.least(total, first + span)
    body = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return F.when(T.unsafe_path(path) | (first > total), "").otherwise(F.concat(T.col(path), F.lit("#L"), first.cast("string"), F.lit("\n"), body))


def snippet_block(files: DataFrame, places: DataFrame, max_chars: int = 3000, span: int = 6) -> DataFrame:
    """One row (body): snippets of places(ord, path, line) in order, one a path, as far as they fit."""
    first = places.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where("k = 1")
    rows = first.join(files.select("path", "text"), "path").select("ord", snippet("text", "path", F.greatest(F.col("line") - 1, F.lit(1)), span).alias("t")).where("t <> ''").withColumn("cost", F.length("t"))
    # What is left of the budget never grows: of places with one cost, those that fit are the first ones, and no more than the budget holds.
    rank = F.row_number().over(Window.partitionBy("cost").orderBy("ord", "t"))
    rows = rows.where(F.col("cost") <= max_chars).withColumn("k", rank).where(F.col("k") <= max_chars).where(F.col("k") * F.col("cost") <= max_chars)
    one = rows.agg(F.array_sort(F.collect_list(F.struct("ord", "t", "cost"))).alias("s"))
    kept = one.select(admit(F.col("s"), "cost", max_chars, first_always=False).alias("p"))
    return kept.select(F.array_join(F.transform("p.kept", lambda x: x["t"]), "\n").alias("body")).where("body <> ''")


def interesting(symbols: DataFrame, ranks: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Symbols by name (2, and 1 at its start) and by 1.5 times their rank in the graph."""
    words = list(dict.fromkeys(T.split_words_py(query)))
    low = F.lower("name")
    own = sum((F.when(low.contains(w), 2.0).otherwise(0.0) + F.when(low.startswith(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0))
    rows = symbols.withColumn("own", own)
    rows = rows.where("own > 0") if words else rows
    rows = rows.withColumn("id", graph.symbol_id(F.col("path"), F.col("name"), F.col("line"))).join(ranks, "id", "left")
    rows = rows.withColumn("score", F.round(F.col("own") + 1.5 * F.coalesce("rank", F.lit(0.0)), 6))
    return rows.orderBy(F.desc("score"), "path", "ord").limit(limit).drop("own", "rank")


def build(query: str, as_of: int, *, files: DataFrame, symbols: DataFrame, log: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 8000, max_symbols: int = 25, max_files: int = 15) -> DataFrame:
    """The packed sections on a query: notes, symbols, snippets, dependents, and the largest files if room is left."""

    def section(n: int, title: str, rows: DataFrame, order: Column, line: Column) -> DataFrame:
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
        return rows.agg(F.count("*").alias("n"), body.alias("body")).where("n > 0").select(F.lit(n).alias("section_ord"), F.lit(title).alias("title"), "body")

    place = F.when(F.col("file").isNotNull(), F.concat(F.lit("`"), "file", F.lit("@"), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit("`"))).otherwise("repo")
    tags = F.array_join(F.transform(F.slice("tags", 1, 5), lambda t: F.concat(F.lit("#"), t)), " ")
    notes = memory.recall(log, as_of, query, limit=12)
    note = F.concat(F.lit("- ["), "kind", F.lit("] "), "text", F.lit(" (_via_ "), place, F.lit(", "), T.time_ago("created_at", as_of), F.lit(" · "), tags, F.lit(")"))
    one = section(0, "Relevant memory", notes, F.struct(-F.col("score"), -F.col("created_at"), "log_pos"), note)
    picked = interesting(symbols, graph.page_rank(nodes, edges, iterations=15), query, max_symbols)
    picked = cut(picked)
    sym = F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(") — `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("`"))
    by = F.struct(-F.col("score"), "path", "ord")
    two = section(1, "Symbols", picked, by, sym)
    three = snippet_block(files, picked.select(by.alias("ord"), "path", "line")).select(F.lit(2).alias("section_ord"), F.lit("Definitions (snippets)").alias("title"), "body")
    targets = [r["path"] for r in picked.select("path").distinct().collect()]  # max_symbols at most
    out = one.unionByName(two).unionByName(three)
    if targets:
        out = out.unionByName(section(3, "Impact / dependents", graph.dependents(edges, targets, max_files), F.col("path"), F.concat(F.lit("- `"), "path", F.lit("`"))))
    first = cut(pack(out, budget))
    used = first.agg(F.max("used")).first()[0] or 0
    if used < 0.7 * budget:
        large = corpus.largest(files)
        line = F.concat(F.lit("- `"), "path", F.lit("` ("), F.coalesce("language", F.lit("text")), F.lit(", "), F.col("lines").cast("string"), F.lit(" lines)"))
        return pack(first.select("section_ord", "title", "body").unionByName(section(4, "Largest indexed files", large, F.struct(-F.col("size"), "path"), line)), budget)
    return first
