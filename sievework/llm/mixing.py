"""Mixing sources to target weights by pivotal dependent rounding.

DataFrame functions only.  A source's target divided by its size is the rate
at which each of its documents is wanted; its whole part is taken for sure and
the fraction is rounded dependently: two documents' fractions meet, and one
passes mass to the other at random until one is 0 or 1, which keeps every
document's expectation and the sum of fractions.

The meetings form a reduction tree.  Leaves hold about ``FAN`` documents of one
source and one size class (a quarter power of two), largest first, so mass
moves between documents of nearly equal length and the words taken stay near
the target.  Each node passes one unsettled document on; nodes of a class
merge by ``FAN``, then the classes of a source, and the last document of a
source is drawn by its fraction.  No node sees more than its few inputs, so a
source with a third of all rows is spread over as many tasks as any other.
Random numbers are hashes of the seed and the documents, so reruns agree.

Sources are ordered by code point, null last, and weigh ``weights`` in turn;
together they get ``share`` of all sizes.  A target stops at ``most`` times its
source's size and the excess is reshared by weight among the others.

Defined results: null text has size 0 and is never taken in words; a null
source is a source; rows that agree in id, source and text are one unit of
the rounding and all get the same number of copies; an empty table gives an
empty one; ids of any type that can be compared will do, and columns of the
user's table stay whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm._names import free
from sievework.session import cut

FAN = 64
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20
UNIT = "struct<size:bigint,h:bigint,id:{kind},content:bigint,n:bigint,p:double>"


def size_of(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def _numbered(sizes: DataFrame) -> DataFrame:
    """(source, source_size, ordinal): sources by code point, null last, numbered part by part so that no task sees them all."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = sizes.select("source", "source_size").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    inside = cut(parts.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*order))))  # range borders are drawn once
    counts = inside.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return inside.join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("i") - 1).alias("ordinal"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source in, one out.

    The excess of capped sources is reshared round by round until none is above
    its cap; a round is one sum over the sources, and the driver gets a row for
    each of the ``weights``.
    """
    k = (F.col("ordinal") % len(weights)).cast("int")
    w = cut(_numbered(sizes).withColumn("k", k).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1)))
    cap = F.col("source_size") * F.lit(most)
    level, held = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap + 1e-9
        rows = w.groupBy("k").agg(F.count_if(~over).alias("free"), F.count_if(over).alias("capped"), F.sum("source_size").alias("size"), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("held")).collect()
        free, now = sum(weights[r.k] * r.free for r in rows), sum(r.capped for r in rows)
        if now == held:
            break
        held = now
        # all of these are sums of whole numbers, so reruns agree to the last bit
        level = (share * sum(r["size"] for r in rows) - most * sum(r["held"] for r in rows)) / free if free else float("inf")
    target = F.when(F.col("weight") * F.lit(level) > cap + 1e-9, cap).otherwise(F.col("weight") * F.lit(level))
    return w.select("source", "source_size", target.alias("target"))


def _uniform(*cols: Column) -> Column:
    return (F.xxhash64(*cols, F.lit(SEED)).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / F.lit(float(1 << 53))


def _fold(units: Column, kind: str) -> Column:
    """Pivotal rounding along an array of units: (carry, done) with done an array of (unit, taken)."""
    unit = UNIT.format(kind=kind)
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(f"array<struct<unit:{unit},taken:int>>").alias("done"))

    def at(u: Column, p: Column) -> Column:
        return F.struct(u["size"].alias("size"), u["h"].alias("h"), u["id"].alias("id"), u["content"].alias("content"), u["n"].alias("n"), p.alias("p"))

    def settled(u: Column, taken: int) -> Column:
        return F.array(F.struct(u.alias("unit"), F.lit(taken).alias("taken")))

    def step(acc: Column, u: Column) -> Column:
        c = acc["carry"]
        s, draw = c["p"] + u["p"], _uniform(c["h"], u["h"])
        stays = draw * s < c["p"]  # the carried one keeps the mass
        first = draw * (F.lit(2.0) - s) < F.lit(1.0) - u["p"]  # the carried one is taken
        carry = F.when(c.isNull(), u).when(s < 1, F.when(stays, at(c, s)).otherwise(at(u, s))).otherwise(F.when(first, at(u, s - 1)).otherwise(at(c, s - 1)))
        more = F.when(s < 1, F.when(stays, settled(u, 0)).otherwise(settled(c, 0))).otherwise(F.when(first, settled(c, 1)).otherwise(settled(u, 1)))
        return F.struct(carry.alias("carry"), F.when(c.isNull(), acc["done"]).otherwise(F.concat(acc["done"], more)).alias("done"))

    return F.aggregate(units, start, step)


def decide(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, source, content, size, n, source_size, target, copies): one row per distinct document, ``n`` rows of it each."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("content"), size_of(text_col).alias("size"))
    slim = cut(slim.groupBy("id", "source", "content").agg(F.first("size").alias("size"), F.count("*").alias("n")))
    rates = targets(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "_source")
    rated = slim.join(rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
    rated = cut(rated.withColumn("class", F.when((F.col("size") > 0) & (F.col("p") > 0), F.floor(F.log2(F.col("size") * F.col("n")) * 4).cast("int"))))
    open_ = rated.where("class is not null")
    nodes = open_.groupBy("source", "class").agg(F.ceil(F.count("*") / F.lit(FAN)).cast("int").alias("nodes"))
    nodes = nodes.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "nodes")
    mass = F.struct((F.col("size") * F.col("n")).alias("size"), F.xxhash64("id", "content", F.lit(SEED)).alias("h"), "id", "content", "n", "p")
    level = open_.join(nodes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))).select(
        "source", "class", F.pmod(F.xxhash64("id", "content"), F.col("nodes")).cast("int").alias("node"), mass.alias("unit")
    )
    width = nodes.agg(F.max("nodes")).first()[0] or 0
    done = []
    while width:
        key = ["source", "class", "node"] if width > 1 or not done else ["source"]
        folded = _fold(F.array_sort(F.collect_list("unit"), _larger), kind)
        level = cut(level.groupBy(*key).agg(folded.alias("f")).select(*key, "f"))
        done.append(level.select("source", F.explode("f.done").alias("d")).select("source", "d.unit.id", "d.unit.content", "d.taken"))
        level = level.select("source", *(c for c in key[1:2]), *([F.floor(F.col("node") / FAN).cast("int").alias("node")] if len(key) > 1 else []), F.col("f.carry").alias("unit"))
        if key == ["source"]:
            break
        if width == 1:
            # one node is left in each class: the classes of a source meet next
            level = level.select("source", "unit")
            folded = level.groupBy("source").agg(_fold(F.array_sort(F.collect_list("unit"), _larger), kind).alias("f"))
            level = cut(folded)
            done.append(level.select("source", F.explode("f.done").alias("d")).select("source", "d.unit.id", "d.unit.content", "d.taken"))
            level = level.select("source", F.col("f.carry").alias("unit"))
            break
        width = -(-width // FAN)
    rounded = None
    if done:
        last = level.where("unit is not null").select("source", "unit.id", "unit.content", (_uniform(F.col("unit.h"), F.lit("last")) < F.col("unit.p")).cast("int").alias("taken"))
        rounded = reduce(lambda a, b: a.unionByName(b), [*done, last])
        rounded = rounded.select(F.col("source").alias("_s"), F.col("id").alias("_i"), F.col("content").alias("_t"), "taken")
        same = F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("content") == F.col("_t"))
        rated = rated.join(rounded, same, "left")
    else:
        rated = rated.withColumn("taken", F.lit(0))
    copies = (F.col("whole") + F.coalesce("taken", F.lit(0))).cast("bigint")
    return rated.select("id", "source", "content", "size", "n", "source_size", "target", copies.alias("copies"))


def _larger(a: Column, b: Column) -> Column:
    """Larger units first, then by hash, so that an array's order doesn't depend on how it was gathered."""
    def order(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(rest)

    return order(b["size"], a["size"], order(a["h"], b["h"], order(a["content"], b["content"], F.lit(0))))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """``docs`` rows that the mix takes at least once, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Where ``docs`` has a column of one of these names, it stays and the mix's own one is called ``mix_`` and that name
    (with underscores after it until it is new).
    """
    found = decide(docs, id_col, source_col, text_col, **how).where("copies > 0").withColumn("taken", F.col("size") * F.col("copies"))
    have = {c.lower() for c in docs.columns}
    own = [F.col(c).alias(free(docs, f"mix_{c}") if c in have else c) for c in ("size", "source_size", "target", "copies", "taken")]
    key, source, content = (free(docs, x) for x in ("_id", "_source", "_content"))
    found = found.select(F.col("id").alias(key), F.col("source").alias(source), F.col("content").alias(content), *own)
    same = F.col(id_col).eqNullSafe(F.col(key)) & F.col(source_col).eqNullSafe(F.col(source)) & (F.xxhash64(text_col) == F.col(content))
    return docs.join(found, same).drop(key, source, content)
