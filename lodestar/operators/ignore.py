"""Ignore rules of repositories: patterns to regular expressions, and files against all rules at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_regex(glob: str) -> str:
    """A path glob: ** spans folders, * and ? stay within one, [..] is a class."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.+")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[^/{inner[1:]}]" if inner[0] in "!^" else f"[{inner}]")
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def parse(lines: list[str], base: str = "", first: int = 0, anchored: bool = False) -> list[tuple]:
    """Rules (ord, base, negate, dir_only, regex) of one ignore file; the regex is matched against paths below base."""
    rules = []
    for n, raw in enumerate(lines):
        line = raw.rstrip("\n").rstrip("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        negate = line.startswith("!")
        line = line[1:] if negate else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        dir_only = line.endswith("/")
        line = line.rstrip("/")
        rooted = "/" in line or anchored and not negate
        line = line.lstrip("/")
        if line:
            rules.append((first + n, base.strip("/."), negate, dir_only, ("" if rooted else "(?:.*/)?") + to_regex(line)))
    return rules


RULES = "ord int, base string, negate boolean, dir_only boolean, regex string"


def rules_table(spark: SparkSession, files: list[tuple[str, list[str]]], extra: list[str] | None = None) -> DataFrame:
    """All rules of ignore files (folder, lines), deeper ones after shallower ones, then extra patterns."""
    rows: list[tuple] = []
    for base, lines in sorted(files, key=lambda f: (f[0].strip("/.").count("/") + bool(f[0].strip("/.")), f[0])):
        rows += parse(lines, base, len(rows) * 1000)
    rows += parse(extra or [], "", len(rows) * 1000 + 1_000_000, anchored=True)
    return spark.createDataFrame(rows, RULES)


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, is_dir, ignored): whether a path or a folder above it is ignored.

    Each path is put beside its ancestors; of the rules that match one of them, the last
    decides about it, and the first ignored ancestor decides about all below. The rules of a
    repository are few (they come from the driver), so they are broadcast.
    """
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("at"), (F.col("is_dir") | (i < F.size(parts))).alias("dir")))
    rows = paths.select("path", "is_dir", F.explode(levels).alias("l")).select("path", "is_dir", "l.depth", "l.at", "l.dir")
    hit = ((F.col("base") == "") | F.col("at").startswith(F.concat("base", F.lit("/")))) & (~F.col("dir_only") | F.col("dir")) & F.expr("regexp_like(CASE WHEN base = '' THEN at ELSE substr(at, length(base) + 2) END, concat('^', regex, '$'))")
    told = rows.join(F.broadcast(rules), hit, "left").groupBy("path", "is_dir", "depth").agg(F.max_by("negate", "ord").alias("negate"))
    verdict = told.withColumn("out", F.coalesce(~F.col("negate"), F.lit(False))).groupBy("path", "is_dir").agg(F.bool_or("out").alias("ignored"))
    return verdict
