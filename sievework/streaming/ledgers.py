"""Incremental state: resume ledgers, last-write-wins upserts, sticky values.

Batch forms are DataFrame operators; ``streamed_upserts`` drives the same rule
with Structured Streaming, a folder of state per batch and the batch id in its
name, so a batch that is run again replaces its own result.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import cut, shared_dir

STATE_PARTS = 64


def last_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """ST2: each key's last row by ``order``: a grouped maximum, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*").select(rows.columns)


def still_open(work: DataFrame, ledger: DataFrame, key: str, resume: bool, force: bool = False) -> DataFrame:
    """ST1: what is left to do: not what succeeded, nor what was quarantined when resuming; ``force`` leaves all."""
    if force:
        return work
    past = ledger.where(F.col("status").isin(*(["done", "quarantined"] if resume else ["done"]))).select(key).distinct()
    return work.join(past, key, "left_anti")


def decision_queue(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """ST3: candidates with their state, ``open`` where nothing was decided."""
    return candidates.join(decisions, key, "left").withColumn("state", F.coalesce("state", F.lit("open")))


def sticky(new: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """ST5: previous values win, new ones fill the rest; previous: (key, previous)."""
    return new.join(previous, key, "left").select(key, F.coalesce("previous", value).alias(value))


def streamed_upserts(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """ST2 as a stream: read ``path`` to its end in batches, merge each into the state, return the last state.

    The state lies in ``STATE_PARTS`` parts by a hash of the keys; a batch rewrites the parts that it touches.
    """
    at = f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex}"
    source = stream_of(spark, path)
    schema = source.schema
    part = F.pmod(F.xxhash64(*keys), F.lit(STATE_PARTS)).alias("_part")
    now: dict[int, str] = {}  # the folder of each part of the state, at most STATE_PARTS

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = cut(last_by_key(batch, keys, order))
        touched = [r._part for r in new.select(part).distinct().collect()]
        old = [f for k, f in now.items() if k in touched]
        rows = new.unionByName(batch.sparkSession.read.schema(schema).parquet(*old)) if old else new
        to = f"{at}/state-{batch_id}"
        last_by_key(rows, keys, order).withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(to)
        now.update({k: f"{to}/_part={k}" for k in touched})

    run = source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(*now.values()) if now else spark.createDataFrame([], schema)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream; streams read folders, and the pattern holds for one file and for a folder of files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path if _is_folder(spark, path) else path + "*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
