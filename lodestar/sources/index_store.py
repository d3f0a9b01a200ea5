"""An index as a folder of Parquet tables with a format version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


class IndexCorrupt(Exception):
    pass


def save(tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], path: str) -> None:
    """Every table, then the mark that the index is whole, in a folder beside the old index; then this takes the old one's place.

    A table may be a function of a reader of those saved before it, which aren't computed again for it.
    """
    spark = next(df for df in tables.values() if isinstance(df, DataFrame)).sparkSession
    for name, df in tables.items():
        df = df if isinstance(df, DataFrame) else df(lambda of: spark.read.parquet(f"{path}.new/{of}"))
        df.write.mode("overwrite").parquet(f"{path}.new/{name}")
    meta = spark.range(1).select(F.lit(FORMAT_VERSION).alias("format_version"), F.array(*map(F.lit, sorted(tables))).alias("tables"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}.new/_meta")
    _swap(spark, path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The saved tables; an index of another version, or without its mark, is an error.

    Where a save broke off between setting the old index aside and putting the new one in place, the new one is read.
    """
    system, at = _folder(spark, path)
    found = path if system.exists(at) else f"{path}.new"
    try:
        meta = spark.read.schema("format_version int, tables array<string>").json(f"{found}/_meta").first()
    except Exception as e:
        raise IndexCorrupt(f"no index at {path}") from e
    if meta is None or meta["format_version"] != FORMAT_VERSION:
        raise IndexCorrupt(f"the index at {path} has another format")
    return {name: spark.read.parquet(f"{found}/{name}") for name in meta["tables"]}


def replace(df: DataFrame, path: str) -> None:
    """Write a table over the one that it may be read from, by way of a second folder."""
    df.write.mode("overwrite").parquet(f"{path}.new")
    _swap(df.sparkSession, path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _swap(spark: SparkSession, path: str) -> None:
    """path.new to path. The old folder is set aside first and deleted last, so one of them is whole whenever this breaks off."""
    system, at = _folder(spark, path)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{x}") for x in ("new", "old"))
    system.delete(old, True)
    if system.exists(at) and not system.rename(at, old):
        raise OSError(f"{path} can't be set aside")
    if not system.rename(new, at):
        raise OSError(f"{path}.new can't be put in place")
    system.delete(old, True)
