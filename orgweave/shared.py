"""Where intermediate results live, and small helpers that every operator may use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named in spark.checkpoint.dir; only where that is unset, and the session runs on one machine
    (as in tests), a local one. A cluster without the setting is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orgweave-"))
    return sc.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/orgweave/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was made by ``work_path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: computed once, and safe when an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (F.regexp_replace(c, r"(?U)\s+", "") == "")


def width(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a step that makes far more rows than it reads, where the size of its input says too little."""
    return max(least, 2 * spark.sparkContext.defaultParallelism)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application, unless they find it themselves."""
    import os
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_orgweave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="orgweave-code-"), "orgweave")
    shutil.make_archive(target, "zip", os.path.dirname(root), "orgweave")
    sc.addPyFile(f"{target}.zip")
    sc._orgweave_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """For a costly step per row: the rows over all cores. A table of enough parts is left as it lies; only a small one is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
