"""Import targets to files, identifiers to declarations: joins over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions tried for a relative import, and those that a language's imports may end in.
RELATIVE = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".rs", ".go", ".java", ".c", ".h", ".cc", ".cpp", ".hpp", ".rb", ".sh", ".mod")
ENDINGS = {
    "javascript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"),
    "rust": (".rs",),
    "c": (".h", ".hpp", ".c", ".cc", ".cpp"),
    "cpp": (".h", ".hpp", ".c", ".cc", ".cpp"),
    "ruby": (".rb",),
    "python": (".py",),
    "go": (".go",),
}


def place_of(path: Column) -> Column:
    """A struct that orders paths as a walk does, a folder's files before its subfolders."""
    parts = F.split(path, "/")
    return F.struct(F.slice(parts, 1, F.size(parts) - 1).alias("dir"), F.element_at(parts, -1).alias("name"))


def walk_rank(files: DataFrame) -> DataFrame:
    """(path, place) of files."""
    return files.select("path", place_of(F.col("path")).alias("place"))


def normal(path):
    """A path without . segments; each .. takes away the segment before it, and none at the root."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def candidates(imports: DataFrame) -> DataFrame:
    """(src, ord, language, target, how, key, rank): paths and stems that an import may mean, the best first.

    imports(path, ord, language, target, source): source is the module or path that the name
    comes from, and target the name itself.
    """
    src = imports.withColumn("t", F.trim(F.regexp_replace(F.coalesce("source", "target"), "[\"']", ""))).where("t <> ''")
    src = src.select(F.col("path").alias("src"), "ord", "language", "target", "t")
    dots = F.length(F.regexp_extract("t", "^(\\.+)", 1))
    folder = F.regexp_replace("src", "/?[^/]*$", "")
    python = F.col("language") == "python"
    # A Python module's leading dots count folders, the first being its own.
    up = F.concat(folder, F.lit("/"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.regexp_replace("t", "^\\.+", ""), F.lit("."), F.lit("/")))
    base = normal(F.when(python, up).otherwise(F.concat(folder, F.lit("/"), F.regexp_replace("t", r"(?<=[^./])\.(js|jsx|ts|tsx|mjs|cjs|rb|sh|h|hpp)$", ""))))
    relative = src.where(F.col("t").startswith("."))
    endings = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(e).alias("end")) for i, e in enumerate((*RELATIVE, "/__init__.py", "/index.ts", "/index.js"))))
    a = relative.withColumn("base", base).select("src", "ord", "language", "target", F.explode(endings).alias("e"), "base").select("src", "ord", "language", "target", F.lit("path").alias("how"), F.lower(F.concat("base", "e.end")).alias("key"), F.col("e.rank").alias("rank"))
    dotted = src.where(~F.col("t").startswith("."))
    as_path = F.replace(F.col("t"), F.lit("."), F.lit("/"))
    b = dotted.where(F.col("language").isin("java", "python")).select(
        "src", "ord", "language", "target", F.lit("path").alias("how"), F.explode(F.when(python, F.array(F.concat(as_path, F.lit(".py")), F.concat(as_path, F.lit("/__init__.py")))).otherwise(F.array(F.concat(as_path, F.lit(".java"))))).alias("key"), F.lit(0).alias("rank")
    )
    b = b.withColumn("key", F.lower("key"))
    last = F.when(F.col("language") == "python", F.element_at(F.split("t", r"\."), -1)).when(F.col("language") == "rust", F.regexp_extract("t", "([A-Za-z0-9_]+)$", 1)).when(F.col("language") == "ruby", F.element_at(F.split("t", "/"), -1))
    last = last.when(F.col("language").isin("c", "cpp"), F.regexp_replace(F.element_at(F.split("t", "/"), -1), r"\.[^.]*$", "")).otherwise(F.element_at(F.split("t", "/"), -1))
    c = dotted.where(F.col("language") != "java").select("src", "ord", "language", "target", F.lit("stem").alias("how"), F.lower(last).alias("key"), F.lit(50).alias("rank"))
    # use a::b::item may name an item of the module b.
    d = dotted.where((F.col("language") == "rust") & F.col("t").contains("::")).select("src", "ord", "language", "target", F.lit("stem").alias("how"), F.lower(F.element_at(F.split("t", "::"), -2)).alias("key"), F.lit(51).alias("rank"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def imports_to_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, ord, target, dst): the best file for each import that has one; a file doesn't import itself."""
    places = walk_rank(files)
    base = F.element_at(F.split("path", "/"), -1)
    keyed = places.select("path", "place", F.explode(F.array(F.struct(F.lit("path").alias("how"), F.lower("path").alias("key")), F.struct(F.lit("stem").alias("how"), F.lower(F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")).alias("key")))).alias("k"))
    keyed = keyed.select("path", "place", "k.how", "k.key")
    pairs = candidates(imports).join(keyed, ["how", "key"])
    fits = F.lit(False)
    for language, ends in ENDINGS.items():
        good = F.lit(False)
        for e in ends:
            good = good | F.col("path").endswith(e)
        fits = fits | ((F.col("language") == language) & good)
    pairs = pairs.where((F.col("how") == "path") | fits)
    best = pairs.groupBy("src", "ord", "target").agg(F.min_by("path", F.struct("rank", "place")).alias("dst"))
    return best.where("src <> dst")


def calls_of(tokens: DataFrame) -> DataFrame:
    """(path, pos, name, line): identifiers before an opening bracket, of the significant tokens(path, pos, kind, value, line)."""
    nxt = F.lead(F.struct("kind", "value")).over(Window.partitionBy("path").orderBy("pos"))
    return tokens.withColumn("next", nxt).where((F.col("kind") == "ident") & (F.col("next.kind") == "punct") & (F.col("next.value") == "(")).select("path", "pos", F.col("value").alias("name"), "line")


def bound(calls: DataFrame, symbols: DataFrame, max_edges: int | None = None) -> DataFrame:
    """references, of calls(path, pos, name, line)."""
    calls = calls.join(symbols.select("path", "name", "line").distinct(), ["path", "name", "line"], "left_anti")
    places = symbols.withColumn("place", place_of(F.col("path")))
    first = places.groupBy("name").agg(F.min_by(F.struct("path", "name", "line"), F.struct("place", "ord")).alias("d"))
    out = calls.join(first, "name").groupBy("path", "name", F.col("d.path").alias("to"), F.col("d.line").alias("to_line")).agg(F.min("pos").alias("pos"))
    out = out.select("path", "name", F.concat(F.lit("s:"), "to", F.lit(":"), "name", F.lit("@"), "to_line").alias("target"), (F.col("path") != F.col("to")).alias("is_cross_file"), "pos")
    if max_edges is not None:
        out = out.orderBy(place_of(F.col("path")), "pos", "name").limit(max_edges)
    return out.select("path", "name", "target", "is_cross_file")


def references(tokens: DataFrame, symbols: DataFrame, max_edges: int | None = None) -> DataFrame:
    """(path, name, target, is_cross_file): calls bound to the first declaration of their name, once for each file and declaration.

    tokens(path, pos, kind, value, line) are the significant ones, symbols(path, ord, name, line).
    A call on its own declaration's line isn't one. All edges stay; on demand only the first
    max_edges in walk order do.
    """
    return bound(calls_of(tokens), symbols, max_edges)
