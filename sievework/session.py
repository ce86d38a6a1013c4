"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables whose rows are long texts: work on them is by row, not by scan.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data directory.

    A text table that gives fewer tasks than there are cores (a small file of
    one row group is one task) is dealt to all of them; larger ones are left
    as their files are split.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is named, a new folder on this machine is taken in local mode
    (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_dealt(df: DataFrame) -> DataFrame:
    """``cut`` that keeps how ``df`` is dealt and sorted, so that joins over its key shuffle their other side alone.

    An adaptive plan doesn't tell the checkpoint how its rows are dealt, so
    this one is made without.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(df)
    finally:
        spark.conf.set(name, before)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``cut_dealt``, dealt and sorted by ``key``."""
    return cut_dealt(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key))


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for the rounds of a loop: a Parquet table in the shared folder, read again.

    A checkpoint keeps the optimiser's estimate of its size, and a join's is the
    product of its sides: where each round joins the last one's table with
    itself, the number doubles its digits every round until the driver has no
    room for it.  A table's size is that of its files.
    """
    at = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
