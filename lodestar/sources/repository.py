"""Source repositories as files tables: a distributed scan with the rules of what to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.languages import classify
from lodestar.functions.text import line_count
from lodestar.operators import ignore

VCS = (".git", ".hg", ".svn")


def decode(content: Column) -> Column:
    """Bytes to text: by their byte order mark, else UTF-8 if valid, else Latin-1."""
    mark = F.hex(F.substring(content, 1, 3))
    return (
        F.when(mark == "EFBBBF", F.decode(F.substr(content, F.lit(4)), "UTF-8"))
        .when(F.substring(mark, 1, 4).isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(F.decode(content, "ISO-8859-1")) & F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def is_binary(content: Column) -> Column:
    """Whether the first 4096 bytes hold a NUL, or more than three in ten control characters; empty is text."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    size = F.length(head)
    control = size - F.length(F.regexp_replace(head, "[\\x01-\\x08\\x0B\\x0E-\\x1A\\x1C-\\x1F]", ""))
    return F.when(size == 0, False).otherwise(F.contains(head, F.lit("\x00")) | (control / size > 0.30))


def listed(spark: SparkSession, root: str, max_depth: int) -> list[tuple[str, int]]:
    """(path below root, size) of all files, version control left out. The driver lists, as it does for any Spark scan."""
    fs_of = spark._jvm.org.apache.hadoop.fs
    top = fs_of.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [(top, "")]
    while todo:
        folder, below = todo.pop()
        for s in fs.listStatus(folder):
            name = s.getPath().getName()
            if s.isDirectory():
                if name not in VCS and below.count("/") <= max_depth:
                    todo.append((s.getPath(), f"{below}{name}/"))
            else:
                out.append((below + name, s.getLen()))
    return sorted(out)


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, content) of the given files.

    Spark's file sources pass over names that begin with a dot or an underscore and over
    empty files, so these few are read by the driver and the others by the executors.
    """
    base = root.rstrip("/") + "/"
    odd = F.exists(F.split("path", "/"), lambda p: p.startswith("_") | p.startswith(".")) | (F.col("size") == 0)
    fs_of = spark._jvm.org.apache.hadoop.fs
    fs = fs_of.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for r in paths.where(odd).select("path", "size").collect():
        data = b""
        if r["size"]:
            stream = fs.open(fs_of.Path(base + r["path"]))
            data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            stream.close()
        rows.append((r["path"], bytearray(data)))
    few = spark.createDataFrame(rows, "path string, content binary")
    # The bound on the length reaches the scan: larger files aren't read at all.
    most = paths.where(~odd).agg(F.max("size")).first()[0] or 0
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most)
    rel = F.regexp_replace(F.substring_index("path", base, -1), "^/+", "")
    many = raw.select(rel.alias("path"), "content").join(paths.where(~odd).select("path"), "path", "left_semi")
    return many.unionByName(few)


def scan(spark: SparkSession, root: str, *, max_bytes: int = 1_000_000, max_depth: int = 12, include_hidden: bool = False, languages: list[str] | None = None, extra_ignores: list[str] | None = None, respect_ignores: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): the indexed files, and how many were skipped for each reason.

    files(path, dir, name, language, text, size, lines). All reasons but binary content are
    settled on the listing; contents are read only of what is left.
    """
    rows = spark.createDataFrame(listed(spark, root, max_depth), "path string, size long")
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    reason = F.when(F.size(parts) - 1 > max_depth, "depth")
    if not include_hidden:
        reason = F.coalesce(reason, F.when(hidden, "hidden"))
    rows = rows.withColumn("reason", reason)
    if respect_ignores or extra_ignores:
        own = rows.where(F.element_at(parts, -1) == ".gitignore")
        found = contents(spark, root, own).select("path", F.decode("content", "UTF-8").alias("t")).collect() if respect_ignores else []
        table = ignore.rules_table(spark, [(r["path"].rpartition("/")[0], r["t"].split("\n")) for r in found], extra_ignores)
        out = ignore.ignored(rows.select("path", F.lit(False).alias("is_dir")), table).where("ignored").select("path", "ignored")
        rows = rows.join(out, "path", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("ignored"), "ignored"))).drop("ignored")
    language = F.coalesce(classify(F.col("path")), F.lit("text"))
    later = F.when(F.col("size") > max_bytes, "size")
    if languages:
        later = later.when(~language.isin(*languages), "language")
    rows = rows.withColumn("reason", F.coalesce("reason", later))
    read = contents(spark, root, rows.where("reason IS NULL")).withColumn("binary", is_binary(F.col("content")))
    read = rows.where("reason IS NULL").join(read, "path")
    kept = read.where("NOT binary").select("path", F.slice(parts, 1, F.size(parts) - 1).alias("dir"), F.element_at(parts, -1).alias("name"), language.alias("language"), decode(F.col("content")).alias("text"), "size")
    skipped = rows.where("reason IS NOT NULL").select("reason").unionByName(read.where("binary").select(F.lit("binary").alias("reason"))).groupBy("reason").agg(F.count("*").alias("files"))
    return kept.withColumn("lines", line_count("text")), skipped


def git_files(spark: SparkSession, root: str, count: int = 500) -> DataFrame:
    """(value, ord): the lines of a history with the names of changed files, for commits.parse_files; none without a history."""
    import subprocess

    try:
        out = subprocess.run(["git", "-C", root, "log", f"-{count}", "--name-only", "--pretty=%x01%H%x01%at"], capture_output=True, text=True, timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        out = ""
    return spark.createDataFrame(list(enumerate(out.splitlines())), "ord int, value string")


def git_log(spark: SparkSession, root: str, count: int = 500) -> DataFrame:
    """The lines of a repository's history for commits.parse_log; none where there is no history."""
    import subprocess

    try:
        out = subprocess.run(["git", "-C", root, "log", f"-{count}", "--pretty=%H%x01%s%x01%an%x01%at"], capture_output=True, text=True, timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        out = ""
    return spark.createDataFrame([(x,) for x in out.splitlines()], "value string")
