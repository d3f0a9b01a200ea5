"""Ranked search over files and symbols: content, path, symbol and fuzzy signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import corpus


def filtered(files: DataFrame, language: str | None = None, path_prefix: str | None = None, include_paths: DataFrame | None = None) -> DataFrame:
    """Files by language, folder and a set of paths; the first two reach the scan."""
    if language:
        files = files.where(F.col("language") == language)
    if path_prefix:
        files = files.where((F.col("path") == path_prefix) | F.col("path").startswith(path_prefix.rstrip("/") + "/"))
    if include_paths is not None:
        files = files.join(include_paths.select("path"), "path", "left_semi")
    return files


def content_scores(files: DataFrame, words: list[str]) -> DataFrame:
    """(path, content): the sum of idf * tf over the distinct query words.

    Only texts that hold a query word's letters are split into words, and of these only the
    query words' counts and the number of words are kept; document frequencies count all files,
    filtered or not.
    """
    found, low = T.split_words("text"), F.lower("text")
    maybe = F.lit(False)
    for w in words:
        maybe = maybe | low.contains(w)
    counted = files.where(maybe).select("path", found.alias("w")).select("path", F.size("w").alias("total"), *(F.size(F.filter("w", _equals(w))).alias(f"n{i}") for i, w in enumerate(words)))
    stats = counted.agg(*(F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    joined = counted.crossJoin(F.broadcast(stats.crossJoin(files.agg(F.count("*").alias("n")))))  # one row
    score = sum((F.when(F.col(f"n{i}") > 0, F.log(1.0 + F.col("n") / (1.0 + F.col(f"df{i}"))) * F.col(f"n{i}") / F.col("total")).otherwise(0.0) for i in range(len(words))), F.lit(0.0))
    return joined.select("path", score.alias("content")).where("content > 0")


def stored_scores(posts: DataFrame, stats: DataFrame, words: list[str]) -> DataFrame:
    """content_scores from an index: posts(path, term, tf) and stats(term, idf) of all files. Only the query words' postings are read."""
    wanted = stats.where(F.col("term").isin(*words)).select("term", "idf")  # one row a word
    return posts.where(F.col("term").isin(*words)).join(F.broadcast(wanted), "term").groupBy("path").agg(F.sum(F.col("idf") * F.col("tf")).alias("content"))


def details(results: DataFrame, posts: DataFrame, symbols: DataFrame, query: str, most: int = 12) -> DataFrame:
    """Results with ``matches``, the query's words that each file holds in the query's order, and the names of its first ``most`` symbols."""
    words = list(dict.fromkeys(T.split_words_py(query)))
    few = F.broadcast(results.select("path").distinct())  # limited by the search
    held = posts.where(F.col("term").isin(*words)).join(few, "path").groupBy("path").agg(F.collect_set("term").alias("_held"))
    named = symbols.join(few, "path").withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where(F.col("_k") <= most)
    named = named.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda x: x["name"]).alias("symbols"))
    out = results.join(held, "path", "left").join(named, "path", "left")
    matches = F.filter(T.strings(*words), lambda w: F.array_contains(F.coalesce("_held", T.strings()), w))
    return out.select(*results.columns, matches.alias("matches"), F.coalesce("symbols", T.strings()).alias("symbols"))


def _equals(word: str):
    return lambda x: x == word


def path_score(path: Column, words: list[str]) -> Column:
    """1.2 for each word in the path, 0.6 more where it is a whole segment; repeated words count again."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return sum((F.when(low.contains(w), 1.2).otherwise(0.0) + F.when(F.concat(F.lit("/"), low, F.lit("/")).contains(f"/{w}/"), 0.6).otherwise(0.0) for w in words), F.lit(0.0))


def symbol_scores(symbols: DataFrame, words: list[str]) -> DataFrame:
    """(path, symbol): 2.5 where any declared name holds a word."""
    low = F.lower("name")
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return symbols.where(hit).select("path").distinct().withColumn("symbol", F.lit(2.5))


def grams_of(words: list[str]) -> list[str]:
    """Distinct three-letter grams of each word alone, short words padded."""
    return sorted({w.ljust(3)[i : i + 3] for w in words for i in range(max(1, len(w) - 2))})


def fuzzy_scores(files: DataFrame, words: list[str], max_scan: int | None = None) -> DataFrame:
    """(path, fuzzy): 0.4 for each gram that a file's words share with the query's.

    max_scan limits this signal to the first files in walk order; by default all are scanned.
    """
    if max_scan is not None:
        files = files.orderBy("dir", "name").limit(max_scan)
    grams = grams_of(words)
    text = F.concat(F.lit("\x00"), F.array_join(F.array_distinct(F.transform(T.split_words("text"), lambda w: F.rpad(w, F.greatest(F.length(w), F.lit(3)), F.lit(" ")))), "\x00"))
    rows = files.select("path", text.alias("w"))
    shared = sum((F.when(F.col("w").contains(g), 1).otherwise(0) for g in grams), F.lit(0))
    return rows.select("path", (shared * 0.4).alias("fuzzy")).where("fuzzy > 0")


def search(files: DataFrame, query: str, limit: int = 10, *, symbols: DataFrame | None = None, signals: tuple[str, ...] = ("content", "path", "symbol", "fuzzy"), max_scan: int | None = None, index: tuple[DataFrame, DataFrame] | None = None, **filters) -> DataFrame:
    """(path, score, content, path_score, symbol, fuzzy), best first; the first files in walk order for an empty query.

    index: stored (postings, term statistics), so that texts aren't split anew for their content.
    """
    words = T.split_words_py(query)
    kept = filtered(files, **filters)
    if not words:
        return kept.orderBy("dir", "name").limit(limit).select("path", F.lit(0.0).alias("score"), *(F.lit(0.0).alias(c) for c in ("content", "path_score", "symbol", "fuzzy")))
    distinct = list(dict.fromkeys(words))
    rows = kept.select("path", (path_score(F.col("path"), words) if "path" in signals else F.lit(0.0)).alias("path_score"))
    # Document frequencies are those of all files; the join keeps the filtered ones.
    rows = rows.join(stored_scores(*index, distinct) if index else content_scores(files, distinct), "path", "left") if "content" in signals else rows.withColumn("content", F.lit(0.0))
    rows = rows.join(symbol_scores(symbols, words), "path", "left") if symbols is not None and "symbol" in signals else rows.withColumn("symbol", F.lit(0.0))
    rows = rows.join(fuzzy_scores(kept, words, max_scan), "path", "left") if "fuzzy" in signals else rows.withColumn("fuzzy", F.lit(0.0))
    rows = rows.na.fill(0.0, ["content", "symbol", "fuzzy"])
    rows = rows.withColumn("score", F.round(F.col("content") + F.col("path_score") + F.col("symbol") + F.col("fuzzy"), 6)).where("score > 0")
    return rows.select("path", "score", *(F.round(c, 6).alias(c) for c in ("content", "path_score", "symbol", "fuzzy"))).orderBy(F.desc("score"), "path").limit(limit)


def lookup_symbol(symbols: DataFrame, name: str, *, fuzzy: bool = False, line: int | None = None, cutoff: int = 20, per_name: int = 6, limit: int = 40) -> DataFrame:
    """Declarations by exact name; with fuzzy and no exact hit, names that hold it.

    Names are taken in order of their first declaration until ``cutoff`` declarations are at
    hand; a partial name gives ``per_name`` of its declarations, one equal but for case all.
    """
    exact = symbols.where(F.col("name") == name)
    if line is not None:
        exact = exact.where(F.col("line") == line)
    if not fuzzy or not exact.isEmpty():
        return exact.orderBy("dir", "path", "ord")
    place = F.struct("dir", "path", "ord")
    hits = symbols.where(F.lower("name").contains(name.lower()))
    names = hits.groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    same = F.lower("name") == name.lower()
    names = names.withColumn("take", F.when(same, F.col("n")).otherwise(F.least("n", F.lit(per_name))))
    # Each name adds at least one: the first `cutoff` names always reach the cut-off.
    names = names.orderBy("first").limit(cutoff)
    names = names.withColumn("before", F.coalesce(F.sum("take").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < cutoff)
    rows = hits.join(F.broadcast(names), "name").withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("dir", "path", "ord"))).where(F.col("k") <= F.col("take"))
    return rows.orderBy("first", "k").limit(limit).select(*symbols.columns)


def search_symbols(symbols: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Symbols by name (3, and 1 at its start) and by the paths of a name's first three declarations (0.8)."""
    words = T.split_words_py(query)
    low = F.lower("name")
    own = sum((F.when(low.contains(w), 3.0).otherwise(0.0) + F.when(low.startswith(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0))
    near = sum((F.when(F.lower("path").contains(w), 0.8).otherwise(0.0) for w in words), F.lit(0.0))
    rows = symbols.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("dir", "path", "ord"))).withColumn("near", F.when(F.col("k") <= 3, near).otherwise(0.0))
    rows = rows.withColumn("score", F.round(own + F.sum("near").over(Window.partitionBy("name")), 6)).where("score > 0")
    return rows.orderBy(F.desc("score"), "path", "ord").limit(limit).select("name", "path", "ord", "kind", "line", "score")


def stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files, unique terms, distinct symbol names, and the sum of files' distinct terms."""
    posts = corpus.terms(files).distinct()
    a = posts.agg(F.count_distinct("term").alias("unique_terms"), F.count("*").alias("postings"))
    return files.agg(F.count("*").alias("files")).crossJoin(a).crossJoin(symbols.agg(F.count_distinct("name").alias("symbols")))
