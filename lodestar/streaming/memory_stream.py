"""The memory log as a stream: ingestion, duplicates, expiry, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.functions import text as T
from lodestar.operators import memory
from lodestar.shipping import ship


def read(spark: SparkSession, path: str, lateness: str = "1 day") -> DataFrame:
    """New entries as their files arrive, with event_ts and a watermark."""
    rows = memory.with_defaults(spark.readStream.schema(memory.SCHEMA).json(path))
    return rows.withColumn("event_ts", F.timestamp_seconds("created_at")).withWatermark("event_ts", lateness)


def without_duplicates(rows: DataFrame) -> DataFrame:
    """Entries whose fingerprint hasn't come within the watermark's time: bounded by time, not by count."""
    return rows.dropDuplicatesWithinWatermark(["fingerprint"])


def without_tail_duplicates(rows: DataFrame, window: int = 200) -> DataFrame:
    """The count-bounded variant: (log, id, fingerprint) of entries not among the last ``window`` kept ones of their log.

    Each log's state is its last kept fingerprints. rows need a column ``log`` and ``log_pos``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = list(state.get[0]) if state.exists else []
        kept = []
        for row in pd.concat(parts).sort_values("log_pos").itertuples():
            if row.fingerprint not in tail:
                tail = [*tail, row.fingerprint][-window:]
                kept.append((key[0], row.id, row.fingerprint))
        state.update((tail,))
        yield pd.DataFrame(kept, columns=["log", "id", "fingerprint"])

    ship(rows.sparkSession)
    return rows.select("log", "log_pos", "id", "fingerprint").groupBy("log").applyInPandasWithState(step, "log string, id string, fingerprint string", "tail array<string>", "append", GroupStateTimeout.NoTimeout)


def live(rows: DataFrame, as_of: int) -> DataFrame:
    """Entries that haven't expired."""
    return rows.where(~memory.expired(as_of))


def kind_counts(rows: DataFrame, window: str = "1 day") -> DataFrame:
    """Entries of each kind in tumbling windows."""
    return rows.groupBy(F.window("event_ts", window), T.valid_kind("kind").alias("kind")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet log; each batch's files are committed together."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
