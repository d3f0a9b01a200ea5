"""Cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; where it is unset (tests, one machine), a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="lodestar-checkpoints-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there from now on."""
    ensure_dir(df.sparkSession)
    return df.checkpoint(eager)


#: Spark's setting that has the files an execution has shuffled removed as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """As cut, but as a Parquet table in that folder, which takes less room for many rows of a few numbers.

    Once it is written nothing reads what was shuffled for it, so these files go at once;
    otherwise Spark keeps them until the driver's JVM happens to collect its garbage.
    """
    ensure_dir(df.sparkSession)
    spark, folder = df.sparkSession, f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Remove tables in the shared folder that nothing will read again.

    Only folders below the checkpoint folder are removed, whatever else a table may read.
    """
    for table in tables:
        spark = table.sparkSession
        jvm, conf, top = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), spark.sparkContext.getCheckpointDir()
        of = jvm.org.apache.hadoop.fs.Path
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = of(folder)
            if top and path.toUri().getPath().startswith(of(top).toUri().getPath() + "/"):
                path.getFileSystem(conf).delete(path, True)


def rest(spark: SparkSession) -> None:
    """Have the executors collect their garbage, so that heaps that a heavy stage has blown up are given back before the next one."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()
