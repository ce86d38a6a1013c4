"""Related collections and related items by shared tokens, collections and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.search import cluster_first, of_items, token_sets
from sievework.session import cut


def token_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(asset, hub, strong, broad): how many tokens of each kind an item and a collection share; items' sets of tokens and (hub, token, kind) meet over the token alone."""
    keyed, sets = token_sets(left)
    return of_items(keyed, _overlap(sets, "set", right))


def _overlap(left: DataFrame, key: str, right: DataFrame) -> DataFrame:
    met = left.join(right, ["token", "kind"])
    return met.groupBy(key, "hub").agg(F.count_if(F.col("kind") == "strong").alias("strong"), F.count_if(F.col("kind") == "broad").alias("broad"))


def inventory_match(tokens: DataFrame, profiles: DataFrame) -> DataFrame:
    """(asset, hub, s_members, s_tokens, b_members): members of a collection that hold an item's tokens; profiles: (hub, token, kind, members)."""
    keyed, sets = token_sets(tokens)
    return of_items(keyed, _inventory(sets, "set", profiles))


def _inventory(tokens: DataFrame, key: str, profiles: DataFrame) -> DataFrame:
    met, strong = tokens.join(profiles, ["token", "kind"]), F.col("kind") == "strong"
    count = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    return met.groupBy(key, "hub").agg(count(strong, F.col("members")).alias("s_members"), F.count_if(strong).alias("s_tokens"), count(~strong, F.col("members")).alias("b_members"))


def related_hubs(items: DataFrame, own: DataFrame, tokens: DataFrame, sizes: DataFrame, titles: DataFrame, profiles: DataFrame, relations: DataFrame, shared: DataFrame, clusters: DataFrame, thin: int, thin_most: int, k: int) -> DataFrame:
    """(asset, hub, score, rank) of the ``k`` collections most related to each item beside its primary one.

    Candidates are an item's own collections, those that its primary one names
    (``related``, ``target``) or belongs with (``family``), and those whose
    title or members share its strong tokens.  Eight terms make the score
    (their points are fixed values);
    small collections (``thin`` members or fewer) count only for their own
    items and take ``thin_most`` places; of one cluster one place stays.

    items: (asset, primary), own: (asset, hub), tokens: (asset, token, kind),
    sizes: (hub, size), titles: (hub, token, kind), profiles: as for
    ``inventory_match``, relations: (primary, hub, relation), shared: (primary,
    hub, common), clusters: (hub, cluster, preferred).

    Items of one primary collection, the same own ones and the same tokens are
    worked out once.
    """
    held = own.groupBy("asset").agg(F.array_sort(F.collect_set("hub")).alias("own"))
    said = tokens.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("token", "kind"))).alias("tokens"))
    features = ("primary", "own", "tokens")
    rows = items.where("asset is not null").select("asset", "primary").join(held, "asset", "left").join(said, "asset", "left")
    keyed = cut(rows.select("asset", F.xxhash64(F.to_json(F.struct(*features))).alias("set"), *features))
    sets = cut(keyed.groupBy("set").agg(*(F.first(c).alias(c) for c in features)).withColumnRenamed("set", "asset"))
    found = _related_sets(
        sets.select("asset", "primary"), sets.select("asset", F.explode("own").alias("hub")), sets.select("asset", F.inline("tokens")),
        sizes, titles, profiles, relations, shared, clusters, thin, thin_most, k)
    return of_items(keyed, found.withColumnRenamed("asset", "set"))


def _related_sets(items: DataFrame, own: DataFrame, tokens: DataFrame, sizes: DataFrame, titles: DataFrame, profiles: DataFrame, relations: DataFrame, shared: DataFrame, clusters: DataFrame, thin: int, thin_most: int, k: int) -> DataFrame:
    """``related_hubs``, item by item."""
    n = tokens.groupBy("asset").agg(F.least(F.lit(2), F.count_if(F.col("kind") == "strong")).alias("need"))
    balanced = (F.col("need") > 0) & (F.col("s_members") >= 2) & (F.col("s_tokens") >= F.col("need"))
    # evidence takes strong tokens, so broad ones make no pairs; they count for pairs that are there
    strong = lambda df: df.where(F.col("kind") == "strong")
    title = _overlap(strong(tokens), "asset", strong(titles)).select("asset", "hub")
    stock = _inventory(strong(tokens), "asset", strong(profiles)).join(n, "asset").where(balanced).select("asset", "hub")
    evident = title.unionByName(stock).distinct()

    def flagged(df: DataFrame, flag: str) -> DataFrame:
        return df.select("asset", "hub", *(F.lit(f == flag).alias(f) for f in ("direct", "related", "target", "family", "found")))

    named = items.join(relations, "primary")
    cands = flagged(own, "direct").unionByName(flagged(evident, "found"))
    for flag in ("related", "target", "family"):
        cands = cands.unionByName(flagged(named.where(F.col("relation") == flag), flag))
    cands = cut(cands.groupBy("asset", "hub").agg(*(F.bool_or(f).alias(f) for f in ("direct", "related", "target", "family"))))
    held = cands.select("asset", "hub").join(tokens, "asset")
    held = held.join(titles.withColumn("named", F.lit(True)), ["hub", "token", "kind"], "left").join(profiles, ["hub", "token", "kind"], "left")
    is_strong, count = F.col("kind") == "strong", lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    met = held.groupBy("asset", "hub").agg(
        F.count_if(F.col("named") & is_strong).alias("strong"), F.count_if(F.col("named") & ~is_strong).alias("broad"), count(is_strong, F.col("members")).alias("s_members"),
        F.count_if(is_strong & F.col("members").isNotNull()).alias("s_tokens"), count(~is_strong, F.col("members")).alias("b_members"))
    met = met.join(n, "asset").withColumn("evidence", (F.col("strong") > 0) | balanced).withColumn("balanced", balanced)
    c = cands.join(items, "asset").where("hub <> primary").join(met, ["asset", "hub"], "left").join(sizes, "hub").join(shared, ["primary", "hub"], "left")
    c = c.na.fill(0, ["strong", "broad", "s_members", "b_members", "common"]).na.fill(False, ["evidence", "balanced"])
    kin = F.col("family") & (F.col("common") > 0)
    inventory = F.when(F.col("balanced"), 200_000).otherwise(0) + F.least(F.col("s_members"), F.lit(12)) * 5_000 + F.floor(F.least(F.lit(1.0), F.col("s_members") / F.col("size")) * 5_000_000 + 0.5) + F.least(F.col("b_members"), F.lit(12)) * 1_000
    points = lambda flag, p: F.when(flag, p).otherwise(0)
    score = points(F.col("direct"), 10_000_000) + F.col("strong") * 1_200_000 + inventory + points(F.col("related"), 100_000) + points(F.col("target"), 50_000) + points(kin, 25_000) + F.col("broad") * 5_000 + F.least(F.col("common"), F.lit(100)) * 100
    c = c.where(F.col("direct") | F.col("related") | F.col("target") | kin | F.col("evidence")).where((F.col("size") > thin) | F.col("direct"))
    c = c.select("asset", "hub", score.cast("bigint").alias("score"))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("score"), "hub")))
    places = cluster_first(ranked.select(F.col("asset").alias("owner"), "hub", "rank"), clusters, 1 << 30)
    p = places.select(F.col("owner").alias("asset"), "hub", F.col("rank").alias("place")).join(c, ["asset", "hub"], "left").join(sizes, "hub", "left")
    small = F.coalesce(F.col("size") <= thin, F.lit(False)).cast("int")
    w = Window.partitionBy("asset").orderBy("place")
    p = p.withColumn("small", small).withColumn("before", F.sum("small").over(w)).where((F.col("small") == 0) | (F.col("before") <= thin_most))
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("asset", "hub", F.coalesce("score", F.lit(0)).alias("score"), "rank")


def ordered_members(members: DataFrame, width: int) -> DataFrame:
    """(class, bucket, asset, pos): members numbered inside their class by id, bucket by bucket, so that a class of any size is dealt."""
    m = members.withColumn("bucket", F.floor(F.col("asset") / F.lit(width)))
    n = m.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    base = n.withColumn("base", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).drop("n")
    inside = m.withColumn("i", F.row_number().over(Window.partitionBy("class", "bucket").orderBy("asset")))
    return inside.join(base, ["class", "bucket"]).select("class", "bucket", "asset", (F.col("base") + F.col("i")).alias("pos"))


def nearest_members(wanted: DataFrame, members: DataFrame, reach: int, width: int = 1 << 16) -> DataFrame:
    """``wanted`` (asset, class, …) with ``other``: the ``reach`` members of the class on either side of the item's id, itself left out."""
    numbered = cut(ordered_members(members, width))
    q = wanted.select("asset", "class").distinct().withColumn("bucket", F.floor(F.col("asset") / F.lit(width)))
    every = numbered.groupBy("class", "bucket").agg(F.count("*").alias("n")).unionByName(q.select("class", "bucket", F.lit(0).cast("bigint").alias("n")).distinct())
    per = every.groupBy("class", "bucket").agg(F.sum("n").alias("n"))
    base = per.withColumn("base", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).drop("n")
    both = numbered.select("class", "bucket", "asset", F.lit(1).alias("own"), F.lit(0).alias("asks")).unionByName(q.select("class", "bucket", "asset", F.lit(0).alias("own"), F.lit(1).alias("asks")))
    seen = both.groupBy("class", "bucket", "asset").agg(F.max("own").alias("own"), F.max("asks").alias("asks"))
    before = F.sum("own").over(Window.partitionBy("class", "bucket").orderBy("asset"))
    at = seen.withColumn("before", before).where("asks = 1").join(base, ["class", "bucket"]).select("class", "asset", (F.col("base") + F.col("before")).alias("p"))
    around = at.select("class", "asset", F.explode(F.sequence(F.col("p") - reach, F.col("p") + reach)).alias("pos"))
    found = around.join(numbered.select("class", "pos", F.col("asset").alias("other")), ["class", "pos"]).where("asset <> other").drop("pos")
    return wanted.join(found, ["asset", "class"])


SALTS = 16
LOOK = ("strong", "broad", "subjects", "styles", "pattern")
PLACE = ("primary", "hubs", "related", "seasons", "orientation")


def _points(c: Column, p: int) -> Column:
    return F.when(c, p).otherwise(0)


def look_score(a: str, b: str) -> Column:
    """The six terms of R8 over titles and subjects; ``a`` is the one that asks.  Its points are fixed values."""
    common = lambda c: F.size(F.array_intersect(f"{a}.{c}", f"{b}.{c}"))
    strong, need = common("strong"), F.least(F.lit(2), F.size(f"{a}.strong"))
    compound = (need > 0) & (strong >= need)
    words = common("subjects") * 2_500_000 + strong * F.when(compound, 900_000).otherwise(700_000) + _points(compound, 250_000) + common("styles") * 350_000 + common("broad") * 10_000
    return (words + _points(F.col(f"{a}.pattern") & F.col(f"{b}.pattern"), 200_000)).cast("bigint")


def place_score(a: str, b: str) -> Column:
    """The five terms of R8 over collections, seasons and orientation.  Its points are fixed values."""
    f = lambda side, c: F.col(f"{side}.{c}")
    more = F.size(F.array_intersect(F.array_remove(f(a, "hubs"), f(a, "primary")), f(b, "hubs")))
    n = F.size(f(a, "related"))
    near = F.aggregate(F.transform(f(a, "related"), lambda h, i: F.when(F.array_contains(f(b, "hubs"), h), (n - i) * 10_000).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    seasons = F.size(F.array_intersect(f(a, "seasons"), f(b, "seasons")))
    return (more * 300_000 + near + seasons * 300_000 + _points(F.array_contains(f(b, "hubs"), f(a, "primary")), 75_000) + _points(f(a, "orientation") == f(b, "orientation"), 500)).cast("bigint")


def related_items(items: DataFrame, k: int) -> DataFrame:
    """(asset, other, score, rank): the ``k`` items most related to each, among those of its own and its related collections.

    By score, then by distance of ids; one item of each title first, others
    fill up.  items: (asset bigint), title, ``LOOK`` and ``PLACE``.

    Titles go by their hashes, as classes do.
    Items of equal features are a class; a class has a title, a look (words,
    subjects) and a place (collections, seasons), and the score of two classes
    is that of their looks plus that of their places.  So places that meet are
    scored once and, for each place that asks, only the best place of each
    (title, look) goes on; classes meet these instead of each other.  The
    titles that can stand among the first ``k`` follow, then the classes that
    reach a title's best score, then the members of these nearest to the item's
    id: no collection makes pairs of its members, nor of its classes unless all
    have places of their own.
    """
    name = lambda cols: F.xxhash64(F.to_json(F.struct(*cols)))
    keyed = cut(items.select("asset", name(["title", *LOOK, *PLACE]).alias("class"), name(LOOK).alias("look"), name(PLACE).alias("place"), F.xxhash64("title").alias("title"), *LOOK, *PLACE))
    members = keyed.select("asset", "class")
    classes = cut(keyed.groupBy("class").agg(*(F.first(c).alias(c) for c in ("look", "place", "title")), F.count("*").alias("size")))

    def table_of(kind: str, cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        own = cut(keyed.groupBy(kind).agg(F.struct(*(F.first(c).alias(c) for c in cols)).alias("x")))
        return tuple(own.select(F.col(kind).alias(f"{side}_{kind}"), F.col("x").alias(side)) for side in ("a", "b"))

    # a collection's places are dealt to several tasks: who asks is in one of them, who is asked in each
    a, b = table_of("place", PLACE)
    asks = a.select("a_place", F.pmod("a_place", F.lit(SALTS)).alias("salt"), F.explode(F.array_distinct(F.concat("a.hubs", "a.related"))).alias("hub"))
    gives = b.select("b_place", F.explode(F.array_distinct("b.hubs")).alias("hub")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = asks.join(gives, ["hub", "salt"]).select("a_place", "b_place").distinct()
    places = cut(met.join(a, "a_place").join(b, "b_place").select("a_place", "b_place", place_score("a", "b").alias("place_score")))
    asked = classes.select(F.col("class").alias("d"), F.col("size").alias("d_size"), "title", F.col("look").alias("b_look"), F.col("place").alias("b_place"))
    reach = cut(places.join(asked, "b_place"))
    # a class that holds one item has no partner in itself, and it is the one of its look at its own place
    other = F.when(F.col("a_place") != F.col("b_place"), F.col("place_score"))
    tops = cut(reach.groupBy("a_place", "title", "b_look").agg(F.max("place_score").alias("best"), F.max(other).alias("others")))
    s = classes.select(F.col("class").alias("s"), "size", F.col("title").alias("own"), F.col("look").alias("a_look"), F.col("place").alias("a_place"), F.pmod("class", F.lit(SALTS)).alias("salt"))
    dealt = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = (F.col("size") == 1) & (F.col("own") == F.col("title")) & (F.col("a_look") == F.col("b_look"))
    meet = cut(s.join(dealt, ["a_place", "salt"]).select("s", "a_place", "a_look", "title", "b_look", F.when(alone, F.col("others")).otherwise(F.col("best")).alias("place_score")).where("place_score is not null"))
    x, y = table_of("look", LOOK)
    looks = cut(meet.select("a_look", "b_look").distinct().join(x, "a_look").join(y, "b_look").select("a_look", "b_look", look_score("a", "b").alias("look_score")))
    scored = cut(meet.join(looks, ["a_look", "b_look"]).withColumn("score", F.col("look_score") + F.col("place_score")).select("s", "a_place", "title", "b_look", "place_score", "score"))
    title = scored.groupBy("s", "title").agg(F.max("score").alias("score"))
    ranked = cut(title.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("score"), "title"))))
    limits = ranked.groupBy("s").agg(F.count("*").alias("titles"), F.min(F.when(F.col("rn") == k, F.col("score"))).alias("least"))
    kept = ranked.join(limits, "s").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).select("s", "title", "score")
    best_of = scored.join(kept, ["s", "title", "score"]).select("s", "a_place", "title", "b_look", "place_score", "score")
    first = best_of.join(reach, ["a_place", "title", "b_look", "place_score"]).where("s <> d or d_size > 1").select("s", "d", "title", "score").distinct()
    own = members.select("asset", F.col("class").alias("s"))
    distance = F.abs(F.col("asset") - F.col("other"))
    met = nearest_members(own.join(first, "s").select("asset", F.col("d").alias("class"), "title", "score"), members, 1)
    # the nearest on either side as plain numbers, which a hash aggregate holds; a least struct would have all rows sorted
    sides = met.groupBy("asset", "title", "score").agg(F.max(F.when(F.col("other") < F.col("asset"), F.col("other"))).alias("below"), F.min(F.when(F.col("other") > F.col("asset"), F.col("other"))).alias("above"))
    nearest = F.when(F.col("above").isNull() | (F.col("asset") - F.col("below") <= F.col("above") - F.col("asset")), F.col("below")).otherwise(F.col("above"))
    best = sides.select("asset", "score", nearest.alias("other")).select("asset", "score", distance.alias("distance"), "other", F.lit(0).alias("again"))
    rank = F.row_number().over(Window.partitionBy("asset").orderBy("again", F.desc("score"), "distance", "other"))
    # items of classes with fewer than k titles to choose from take further members of any title
    few = cut(limits.where(F.col("titles") < k).select("s"))
    if not few.isEmpty():
        best = cut(best)
        every = s.join(few, "s").join(reach.drop("title"), "a_place").where("s <> d or d_size > 1").join(looks, ["a_look", "b_look"])
        every = every.select("s", "d", (F.col("look_score") + F.col("place_score")).alias("score")).distinct()
        wide = own.join(every, "s").select("asset", F.col("d").alias("class"), "score")
        fill = nearest_members(wide, members, k).select("asset", "score", distance.alias("distance"), "other", F.lit(1).alias("again"))
        best = best.unionByName(fill.join(best.select("asset", "other"), ["asset", "other"], "left_anti"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("asset", "other", "score", "rank")
