"""Session-level helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over the cluster only where a scan has fewer splits than the cluster has slots.

    A large table's scan has many more splits than slots and is returned untouched, so the shuffle only happens on
    inputs small enough (a few row groups) for it to be cheaper than idle cores.  Only for scans and what is mapped or
    filtered from them: to ask a plan with a shuffle for its partitions would run it.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > slots:
        return df
    return df.repartition(slots)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where none is named, a local one serves a local master and anything else is an error."""
    sc = spark.sparkContext
    set_to = sc._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "proofmill-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are read back from the shared folder, whichever executors are lost later."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
