"""Session factory and the lineage cut that every iterative operator uses."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "strataloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with AQE and Arrow. ``master`` is left to spark-submit when None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a local one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strataloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The files survive the loss of any executor, so an iterative plan neither
    recomputes its history nor depends on cached blocks. The planner's estimate of its size is forgotten too: a
    join is estimated as the product of its sides, so over some rounds of joins with oneself the
    number would have millions of digits and fill the driver.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    written = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def release(spark: SparkSession, wait: float = 0.3) -> None:
    """Let Spark remove the shuffle files of finished steps now.

    They go when the driver's garbage is collected, which a driver that does little may put off for
    half an hour. For use between the large steps of an operator, after a cut; it costs two collections, as
    events of the step that are still to be delivered hold on to it during the first. They may for up to a second: where
    the step before was large, ``wait`` that long.
    """
    for pause in (wait, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores; a table in fewer is dealt anew.

    For costly per-row work on tables of few files; only for plans without a shuffle, which would run to
    count its partitions. A table that already has as many splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
