"""Review decisions and rotation windows as keyed state of a stream.

Both run to the end of what their source holds and can be run again on the same
folder: the stream's checkpoint keeps how far it has read, and the state store
(RocksDB) keeps a row for each key, of which a batch writes those it touches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Members whose counts a window sums up before it writes them to the state store.
MOST_MEMBERS = 200_000
#: Parts of a window by its members, each with a state of its own.
PARTS = 16


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with RocksDB as its state store, which operators of many state variables need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def rejection(known: Column, actions: Sequence[str]) -> Column:
    """ST2: why a decision is not taken, or null: wildcards, then keys that are no candidate's, unknown actions, rows without a place in time."""
    wild = (F.col("asset") == "*") | (F.col("field") == "*")
    unknown = ~F.coalesce(F.col("action").isin(*actions), F.lit(False))
    return F.when(wild, "wildcard").when(~known, "unknown-key").when(unknown, "unknown-action").when(F.col("at").isNull() | F.col("seq").isNull(), "no-time")


def import_decisions(decisions: DataFrame, candidates: DataFrame, actions: Sequence[str], at: str) -> tuple[DataFrame, DataFrame]:
    """ST2: (accepted, rejected) after all that the stream holds by now.

    ``decisions`` is a stream of (asset, field, action, value, at, seq),
    ``candidates`` a table of the (asset, field) that may be decided.  Of one
    key the last write by (at, seq) counts; it is the greatest of a grouped
    maximum, so a batch is summed up where it is read and the state store is
    asked once for each key in it.  Rejected rows keep their columns and get a
    ``reason``; null keys are unknown ones.  ``at`` holds the checkpoints, the
    rejects and the state, which is read back as the table of accepted
    decisions: no batch rewrites what it does not touch.
    """
    spark = decisions.sparkSession
    known = candidates.select("asset", "field").distinct().withColumn("known", F.lit(True))
    judged = decisions.join(known, ["asset", "field"], "left").withColumn("reason", rejection(F.col("known").isNotNull(), actions)).drop("known")
    with rocks(spark):
        last = F.max(F.struct("at", "seq", "action", "value")).alias("last")
        taken = judged.where("reason is null").groupBy("asset", "field").agg(last).select("asset", "field", "last.action", "last.value", "last.at", "last.seq")
        # a batch that is run again writes its folder again
        changed = taken.writeStream.outputMode("update").foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/changes/batch={k}"))
        runs = [
            changed.option("checkpointLocation", f"{at}/accepted").trigger(availableNow=True).start(),
            judged.where("reason is not null").writeStream.format("parquet").option("checkpointLocation", f"{at}/rejecting").option("path", f"{at}/rejected").trigger(availableNow=True).start(),
        ]
        for r in runs:
            r.awaitTermination()
        state = spark.read.format("statestore").load(f"{at}/accepted")
        accepted = state.select("key.asset", "key.field", "value.*").toDF("asset", "field", "last").select("asset", "field", "last.action", "last.value", "last.at", "last.seq")
    rejected = spark.read.schema(judged.schema).parquet(f"{at}/rejected")
    return accepted, rejected


class WindowCounts(StatefulProcessor):
    """Counts a window's rows and its distinct members until the watermark passes its end, then gives it out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint, starts timestamp, ends timestamp")
        self.members = handle.getMapState("members", "member string", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = self.count.get() if self.count.exists() else None
        n, starts, ends = have if have else (0, None, None)
        counts: dict[str, int] = {}
        new = have is None
        for some in rows:
            if ends is None:
                starts, ends = some["starts"].iloc[0].to_pydatetime(), some["ends"].iloc[0].to_pydatetime()
                self.handle.registerTimer(int(some["ends_ms"].iloc[0]))
            n += len(some)
            for member, k in some["member"].value_counts().items():
                counts[member] = counts.get(member, 0) + int(k)
            if len(counts) > MOST_MEMBERS:
                self.add(counts, new)
                counts, new = {}, False
        self.add(counts, new)
        self.count.update((n, starts, ends))
        yield from ()

    def add(self, counts: dict[str, int], new: bool) -> None:
        """Each member costs calls of the state store, so what rows say of it is summed up first; a new window has none to read."""
        for member, k in counts.items():
            old = None if new else self.members.getValue((member,))
            self.members.updateValue((member,), ((old[0] if old else 0) + k,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, starts, ends = self.count.get()
        members = sum(1 for _ in self.members.iterator())
        self.count.clear()
        self.members.clear()
        yield pd.DataFrame({"window": [key[0]], "starts": [pd.Timestamp(starts)], "ends": [pd.Timestamp(ends)], "n": [n], "members": [members]})

    def close(self) -> None:
        pass


class WindowParts(WindowCounts):
    """A part of a window: its members are a list, written at once and not one by one, that may name a member again until it is read."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint, starts timestamp, ends timestamp")
        self.members = handle.getListState("members", "member string")
        self.sizes = handle.getValueState("sizes", "listed bigint, known bigint")

    def add(self, counts: dict[str, int], new: bool) -> None:
        if not counts:
            return
        listed, known = self.sizes.get() if self.sizes.exists() else (0, 0)
        self.members.appendList([(m,) for m in counts])
        listed += len(counts)
        if listed > 2 * known + MOST_MEMBERS:  # so the list stays in proportion to the members
            held = {m for (m,) in self.members.get()}
            self.members.put([(m,) for m in held])
            listed = known = len(held)
        self.sizes.update((listed, known))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, starts, ends = self.count.get()
        members = len({m for (m,) in self.members.get()}) if self.sizes.exists() else 0
        self.count.clear()
        self.members.clear()
        self.sizes.clear()
        yield pd.DataFrame({"window": [key[0]], "starts": [pd.Timestamp(starts)], "ends": [pd.Timestamp(ends)], "n": [n], "members": [members]})


def three_day_bounds(ts: Column) -> tuple[Column, Column]:
    """N24, ST4: the start and end of the three-day window of a time (UTC); the year's last one ends with it."""
    year = F.year(ts)
    starts = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (F.floor((F.dayofyear(ts) - 1) / 3) * 3).cast("int"))
    ends = F.least(F.date_add(starts, 3), F.make_date(year + 1, F.lit(1), F.lit(1)))
    return starts.cast("timestamp"), ends.cast("timestamp")


def closed_windows(rows: DataFrame, window: Column, delay: str, at: str) -> DataFrame:
    """ST4: (window, starts, ends, n, members) of the three-day windows that have closed by now.

    ``rows`` is a stream of (ts, member); a window closes when the greatest
    time seen, less ``delay``, reaches its end, and is given out once.  Rows
    older than the watermark of the batches before theirs are late and not
    counted: what a closed window counts less than its rows are its late ones.
    Rows without a time have no window.  A window is kept in ``PARTS`` parts by
    its members, which close together and are added up when they are read, so
    that few open windows still make work for many tasks.
    """
    spark = rows.sparkSession
    starts, ends = three_day_bounds(F.col("ts"))
    timed = rows.where("ts is not null").select(F.col("ts").cast("timestamp").alias("ts"), F.col("member").cast("string").alias("member"), window.alias("window"), starts.alias("starts"), ends.alias("ends"), F.unix_millis(ends).alias("ends_ms"))
    timed = timed.withColumn("part", F.pmod(F.xxhash64("member"), F.lit(PARTS)).cast("int"))
    out = "window string, starts timestamp, ends timestamp, n bigint, members bigint"
    with rocks(spark):
        closed = timed.withWatermark("ts", delay).groupBy("window", "part").transformWithStateInPandas(statefulProcessor=WindowParts(), outputStructType=out, outputMode="Append", timeMode="EventTime")
        run = closed.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/closed").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(out).parquet(f"{at}/closed").groupBy("window", "starts", "ends").agg(F.sum("n").alias("n"), F.sum("members").alias("members"))
