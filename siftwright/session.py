"""Session helpers: the shared folder, and cutting lineage through it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where the setting is absent a temporary folder is taken and set, but only
    if the session runs in local mode (tests, a laptop): executors on other
    machines could not read it, so that is an error there.
    """
    path = spark.conf.get(SHARED_KEY, None) or spark.sparkContext.getConf().get(SHARED_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED_KEY} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siftwright-")
        spark.conf.set(SHARED_KEY, path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder under the shared one; it is deleted when the driver ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/siftwright/{sc.applicationId}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path under the run's folder that nothing has used yet."""
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The result survives the loss of any executor and has no lineage. Used
    where a result is read more than once or an iteration would grow a plan.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read any more; others are left alone."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        own = run_dir(spark).split("://", 1)[-1].split(":", 1)[-1].lstrip("/")
        folders = {f.rsplit("/", 1)[0] for f in files}
        if len(folders) == 1 and own in (path := folders.pop()):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def parallel(df: DataFrame, heavy: bool = True) -> DataFrame:
    """Spread a table that came in too few splits over the cores.

    A single small file is one split, and one split is one task. Where the
    work per row is heavy the rows are dealt out once, before the work.
    """
    spark = df.sparkSession
    width = max(spark.sparkContext.defaultParallelism, 2)
    if heavy and df.rdd.getNumPartitions() < width:
        return df.repartition(width)
    return df
