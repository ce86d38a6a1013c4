"""Representatives by deferred acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import cut, cut_round


def claims(members: DataFrame, hub: str, item: str, order: Column, turn: Column) -> DataFrame:
    """(hub, item): what each hub gets if hubs in ``turn`` order take the first item (by ``order``) that no earlier one took.

    Taking turns is a matching in which all items prefer the earlier hub, so
    deferred acceptance ends in the same one: each round every hub without an
    item asks for its first that is free or held by a later hub, and each item
    keeps the earliest that asks.  A round is two grouped minima and a join,
    however many hubs there are; rounds go on while a hub that has lost its
    item finds another.  ``order`` and ``turn`` end in unique values.  Rows
    with a null hub or item take no part.
    """
    listed = members.where(F.col(hub).isNotNull() & F.col(item).isNotNull())
    listed = cut(listed.groupBy(F.col(hub).alias("hub"), F.col(item).alias("item")).agg(F.min(order).alias("place"), F.min(turn).alias("turn")))
    held = cut(listed.select("hub", "item", "turn").limit(0))
    while True:
        left = listed.join(held.select("hub"), "hub", "left_anti")
        can = left.join(held.select("item", F.col("turn").alias("by")), "item", "left").where("by is null or turn < by")
        asks = can.groupBy("hub", "turn").agg(F.min_by("item", "place").alias("item"))
        asks = cut_round(asks.select("hub", "item", "turn"))
        if asks.isEmpty():
            return held.select("hub", "item")
        held = cut_round(held.unionByName(asks).groupBy("item").agg(F.min_by(F.struct("hub", "turn"), "turn").alias("x")).select("x.hub", "item", "x.turn"))


def representatives(members: DataFrame, hub: str, item: str, order: Column, rows: DataFrame, flagged: Column, most: int) -> DataFrame:
    """(item, reason, hub): a claimed item of each hub, largest hubs first, then flagged rows, then the others, ``most`` in all.

    ``members`` (hub, item, …) may put an item into several hubs; only items
    among ``rows`` can be taken.
    """
    known = members.join(rows.select(item), item, "left_semi")
    sizes = members.groupBy(hub).agg(F.count_distinct(item).alias("_n"))
    turn = F.struct((-F.col("_n")).alias("n"), F.col(hub).alias("h"))
    taken = claims(known.join(sizes, hub), hub, item, order, turn)
    by_hub = taken.join(sizes.withColumnRenamed(hub, "hub"), "hub").select(F.col("item").alias("_item"), "hub", F.struct((-F.col("_n")).alias("n"), F.col("hub").alias("h")).alias("_turn"))
    met = rows.select(F.col(item), flagged.alias("_flag")).join(by_hub, F.col(item) == F.col("_item"), "left")
    rank = F.when(F.col("hub").isNotNull(), 0).when(F.col("_flag"), 1).otherwise(2)
    top = met.withColumn("_rank", rank).orderBy("_rank", "_turn", item).limit(most)
    return top.select(F.col(item).alias("item"), F.when(F.col("_rank") == 0, "hub").when(F.col("_rank") == 1, "flagged").otherwise("fill").alias("reason"), "hub")
