"""Class-ranked search, related items and sequential list rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut


def _pieces(c: Column, n: int) -> Column:
    """The distinct ``n``-letter pieces of a text."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


def ranked(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, match_class, rank), the best ``k`` items of each query.

    items: (key, title, label, terms, blob) and queries: (query), all
    normalised.  Classes: 1 exact, 2 prefix, 3 all words in the title, 4 title
    words in order with prefixes, 5 label, 6 terms, 7 anywhere.

    Whatever its class, a hit holds every word of the query, so it holds each
    of the words' three-letter pieces (shorter words are pieces themselves).
    Items and queries meet over the query's rarest piece; the rule is tested
    on those pairs alone.
    """
    kinds = [items.select("key", F.explode(_pieces(F.col("blob"), n)).alias("piece")) for n in (1, 2, 3)]
    index = reduce(lambda a, b: a.unionByName(b), kinds)
    asked = queries.select("query").distinct().withColumn("piece", F.explode(F.array_distinct(F.flatten(F.transform(F.split("query", " "), lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(_pieces(w, 3)))))))
    wanted = asked.select("piece").distinct()
    index = cut(index.join(wanted, "piece", "left_semi"))
    df = wanted.join(index.groupBy("piece").agg(F.count("*").alias("n")), "piece", "left").select("piece", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = asked.join(df, "piece").groupBy("query").agg(F.min(F.struct("n", "piece")).alias("p")).select("query", "p.piece")
    met = index.join(rarest, "piece").join(items.select("key", "title", "label", "terms", "blob"), "key").drop("piece")
    met = met.where(F.contains("blob", F.col("query")) | F.forall(F.split("query", " "), lambda w: F.contains(F.col("blob"), w)))
    words, title = F.split("query", " "), F.split("title", " ")
    runs = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(title) - F.size(words) + 1))
    ordered = F.exists(runs, lambda s: F.forall(F.zip_with(words, F.slice(title, s, F.size(words)), lambda a, b: F.coalesce(b.startswith(a), F.lit(False))), lambda x: x))
    cls = (
        F.when(F.col("title") == F.col("query"), 1)
        .when(F.startswith("title", F.concat("query", F.lit(" "))), 2)
        .when(F.size(F.array_except(words, title)) == 0, 3)
        .when(ordered, 4)
        .when(F.col("label") == F.col("query"), 5)
        .when(F.contains(F.concat(F.lit(" "), "terms", F.lit(" ")), F.concat(F.lit(" "), "query", F.lit(" "))), 6)
        .when(F.contains("blob", F.col("query")), 7)
    )
    w = Window.partitionBy("query").orderBy("match_class", F.length("title"), "title", "key")
    hits = met.withColumn("match_class", cls).where("match_class is not null").select("query", "key", "title", "match_class")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "key", "match_class", "rank")


def hub_profiles(membership: DataFrame, tokens: DataFrame) -> DataFrame:
    """(hub, token, kind, members) from (hub, asset) and (asset, token, kind)."""
    return membership.join(tokens, "asset").groupBy("hub", "token", "kind").agg(F.count_distinct("asset").alias("members"))


SALTS = 64


def token_sets(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asset, set) and (set, token, kind): items that hold the same tokens, repeats included, share a set."""
    rows = tokens.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("token", "kind"))).alias("tokens"))
    keyed = cut(rows.select("asset", F.xxhash64(F.to_json("tokens")).alias("set"), "tokens"))
    return keyed.select("asset", "set"), keyed.groupBy("set").agg(F.first("tokens").alias("tokens")).select("set", F.inline("tokens"))


def of_items(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (set, …) for each item of ``keyed`` (asset, set); a set that very many items share is dealt to ``SALTS`` tasks."""
    k = keyed.select("asset", "set", F.pmod(F.xxhash64("asset"), F.lit(SALTS)).alias("_salt"))
    dealt = found.join(k.select("set", "_salt").distinct(), "set")
    return k.join(dealt, ["set", "_salt"]).select("asset", *(c for c in found.columns if c != "set"))


def match_scores(tokens: DataFrame, profiles: DataFrame, sizes: DataFrame, strong: float = 3.0, broad: float = 1.0) -> DataFrame:
    """(asset, hub, score): weight of shared tokens by how much of the hub holds them; hubs meet sets of tokens, not items."""
    keyed, sets = token_sets(tokens)
    met = sets.join(profiles, ["token", "kind"]).join(sizes, "hub")
    share = F.when(F.col("kind") == "strong", strong).otherwise(broad) * F.col("members") / F.col("size")
    return of_items(keyed, met.groupBy("set", "hub").agg(F.round(F.sum(share), 6).alias("score")))


def featured(members: DataFrame, k: int, short: int) -> DataFrame:
    """Per hub (hub, asset, rank): best scores, one per near-title key while there are enough; then the others fill up.

    The sequential rule equals: first of each key by score, and only if those
    are fewer than ``short`` the later ones after them.
    """
    order = [F.desc("score"), F.asc("asset")]
    rows = members.withColumn("again", (F.row_number().over(Window.partitionBy("hub", "key").orderBy(*order)) > 1).cast("int"))
    rows = rows.withColumn("fresh", F.sum(1 - F.col("again")).over(Window.partitionBy("hub")))
    w = Window.partitionBy("hub").orderBy("again", *order)
    rows = rows.withColumn("rank", F.row_number().over(w))
    return rows.where((F.col("rank") <= k) & ((F.col("again") == 0) | (F.col("fresh") < short))).select("hub", "asset", "rank")


def spread(items: DataFrame, page: str, position: str, group: str, most: int = 2) -> DataFrame:
    """Each page's items so that at most ``most`` neighbours share a group where that is possible (pages hold tens of rows)."""

    def arrange(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = pdf.sort_values(position).to_dict("records"), []
        while left:
            tail = [r[group] for r in out[-most:]]
            full = len(tail) == most and len(set(tail)) == 1
            pick = next((i for i, r in enumerate(left) if not full or r[group] != tail[0]), 0)
            out.append(left.pop(pick) | {"shown": len(out) + 1})
        return pd.DataFrame(out)

    from pyspark.sql import types as T

    schema = T.StructType([*items.schema.fields, T.StructField("shown", T.LongType())])
    return items.groupBy(page).applyInPandas(arrange, schema)


def mulberry(seed: int) -> Iterator[float]:
    """The 32-bit generator of rotations: uniform numbers from a seed."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (1 | state)) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def rotation(candidates: DataFrame, hub: str, key: str, seed: Column, k: int) -> DataFrame:
    """(hub, key, shown): each hub's candidates (tens of rows) shuffled by its seed, the first ``k``."""
    rows = candidates.select(F.col(hub).alias("hub"), F.col(key).alias("key"), seed.cast("bigint").alias("seed")).distinct()

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, rng = sorted(pdf["key"].tolist()), mulberry(int(pdf["seed"].min()))
        for i in range(len(ids) - 1, 0, -1):
            j = int(next(rng) * (i + 1))
            ids[i], ids[j] = ids[j], ids[i]
        return pd.DataFrame({"hub": pdf["hub"].iloc[0], "key": ids[:k], "shown": range(1, len(ids[:k]) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("hub").applyInPandas(turn, f"hub {kinds['hub']}, key {kinds['key']}, shown bigint")


def cluster_first(ranked_hubs: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(owner, hub, rank): of hubs in one cluster only the best ranked place stays, taken by the cluster's preferred hub."""
    c = ranked_hubs.join(clusters, "hub", "left").withColumn("slot", F.coalesce(F.col("cluster"), F.concat(F.lit("hub:"), "hub")))
    best = c.groupBy("owner", "slot").agg(F.min("rank").alias("r"), F.min_by("hub", "rank").alias("first"), F.first("preferred", True).alias("preferred"))
    w = Window.partitionBy("owner").orderBy("r", "slot")
    return best.select("owner", F.coalesce("preferred", "first").alias("hub"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
