"""Signals from a commit history: commits(hash, subject, author, ts) and commit_files(hash, path, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_events(events: DataFrame) -> DataFrame:
    """Events as a history: each touches the path type/user."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("bigint")
    return events.select(F.col("event_id").alias("hash"), F.concat_ws("/", "event_type", "user_id").alias("path"), seconds.alias("ts"))


def parse_log(lines: DataFrame) -> DataFrame:
    """commits from lines of four fields parted by U+0001: hash, subject, author, time."""
    f = F.split("value", "\x01")
    return lines.where(F.size(f) >= 4).select(F.substring(f[0], 1, 12).alias("hash"), f[1].alias("subject"), f[2].alias("author"), f[3].try_cast("bigint").alias("ts"))


def parse_files(lines: DataFrame) -> DataFrame:
    """commit_files(hash, path, ts) from the lines of a log with names: each commit's line (U+0001, hash, U+0001, time), then its paths.

    lines(value, ord): a path belongs to the last commit's line before it.
    """
    f = F.split("value", "\x01")
    head = F.when(F.startswith("value", F.lit("\x01")), F.struct(F.substring(f[1], 1, 12).alias("hash"), f[2].try_cast("bigint").alias("ts")))
    # The history of one repository, at most so many commits as were asked for.
    rows = lines.withColumn("head", F.last(head, ignorenulls=True).over(Window.orderBy("ord")))
    return rows.where((F.trim("value") != "") & ~F.startswith("value", F.lit("\x01")) & F.col("head").isNotNull()).select("head.hash", F.col("value").alias("path"), "head.ts")


def recent(commits: DataFrame, count: int = 10) -> DataFrame:
    return commits.orderBy(F.desc("ts"), F.desc("hash")).limit(count)


def touched(files: DataFrame, as_of: int, since_days: int = 14, limit: int = 30) -> DataFrame:
    """(path, last): paths touched of late, newest first."""
    rows = files.where(F.col("ts") >= as_of - since_days * 86400)
    return rows.groupBy("path").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "path").limit(limit)


def hot(files: DataFrame, commits: int = 500, limit: int = 20) -> DataFrame:
    """(path, n): how often the last commits touched a path, the most often first."""
    last = files.select("hash", "ts").distinct().orderBy(F.desc("ts"), F.desc("hash")).limit(commits)
    rows = files.join(last.select("hash"), "hash", "left_semi")
    return rows.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(limit)


def changed_between(files: DataFrame, after: int, until: int) -> DataFrame:
    return files.where((F.col("ts") > after) & (F.col("ts") <= until)).select("path").distinct()
