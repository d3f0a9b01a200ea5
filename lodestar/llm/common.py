"""What several operators share: folds, Arrow helpers, bounded caches, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.checkpoints import cut
from lodestar.shipping import ship

#: Resolution of the hash by which labelled rows are drawn.
DRAW = 1 << 20


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(-1))


def drawn(id_col: str, share: Column | float) -> Column:
    """Whether a row is among a share of all rows, by a hash of its id: the same rows in every run."""
    share = F.lit(share) if isinstance(share, int | float) else share
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(DRAW)) < share * DRAW


#: What a worker keeps between tasks of one operator, by name; other operators' tasks let it go.
KEPT: dict[str, dict] = {}


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow, with the package on the executors, in batches bounded by their bytes.

    Where the session doesn't say how many bytes an Arrow batch may hold, it is set to
    BATCH_BYTES: whole texts in batches of Spark's own size would take much memory. Workers
    outlive their tasks, so what a task has freed is given back to the system as it ends, and
    of KEPT only what goes by the name ``keeps`` survives the start of one.
    """
    spark = df.sparkSession
    ship(spark)
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def let_go(keeps: str | None) -> None:
    for name in [k for k in KEPT if k != keeps]:
        del KEPT[name]


def give_back() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def texts_of(batch: pa.RecordBatch, col: str) -> list[str]:
    """A string column as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(col)).to_pylist()]


#: Spark's setting of how many bytes an Arrow batch may hold, and what it is here unless set.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Links that one task may hold at once.
FOREST = 200_000
#: Bytes up to which a side of a join is broadcast.
SENT_BYTES = 128 << 20


def few(df: DataFrame, rows: int, width: float = 128) -> DataFrame:
    """A side of a join, with the hint to broadcast it if its rows, of ``width`` bytes on average, are few; else left to be shuffled."""
    return F.broadcast(df) if rows * width <= SENT_BYTES else df


def sweep(spark: SparkSession) -> None:
    """Let go of files that finished rounds of a loop have shuffled and checkpointed.

    Spark removes them when the driver's JVM finds that nothing refers to them any more,
    which a driver with memory to spare may not look for in hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Memo(dict):
    """A dict that makes missing values and starts anew when full, so that a worker's memory is bounded."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Forest:
    """Links as few as connect the same nodes: each node with the smallest one it reaches."""

    def __init__(self):
        self.up: dict = {}

    def __len__(self) -> int:
        return len(self.up)

    def top(self, x):
        root, up = x, self.up
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def add(self, u, v) -> None:
        self.up.setdefault(u, u)
        self.up.setdefault(v, v)
        x, y = self.top(u), self.top(v)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def links(self) -> list[tuple]:
        return [(r, x) for x in self.up if (r := self.top(x)) != x]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to as few that connect the same nodes."""
    held, kinds = Forest(), None
    for b in batches:
        kinds = [f.type for f in b.schema]
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.add(u, v)
    if kinds:
        rows = held.links()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in (0, 1)], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (id, component), component being the smallest id reachable.

    Alternating large-star and small-star rounds: each round is two groupings with
    partial aggregation and needs no list of a component in one task. Self-links are
    ignored; nodes without links don't appear. Rounds go on until no link changes;
    each round is cut in the shared checkpoint folder, so a lost executor costs one round.
    """
    def mark(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    edges = cut(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    # Stretches of at most about FOREST links keep only what ties their nodes together.
    edges = cut(arrow_map(edges.coalesce(1 + edges.count() // FOREST), forest, edges.schema.simpleString()[7:-1].replace(":", " ")))
    was = mark(edges)
    while True:
        # Large star: each node tells its larger neighbours of its smallest one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Small star: each node hands its smaller neighbours to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        edges = cut(small.where("u < v").distinct())
        sweep(edges.sparkSession)
        # At the fixed point every link joins a component's smallest id with one other id.
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
