"""Filter interaction audit: what each filter removes in every order in which the filters can run.

1. Each document gets a mask with one bit for each filter that it fails.  The
   texts themselves are not shuffled: the duplicate filter meets digests, each
   with its smallest id (combined before the shuffle), and then ids again, so a
   text with very many copies makes no hot key.
2. Masks are counted by part: a cell is (part, mask) with its documents and how
   many of them are labelled good or toxic.  Of n filters a part has at most
   2**n cells, kept as one array.
3. A recursive query extends prefixes of filters with each letter not in them,
   meets the part's cells at each level and emits the step's counts; n filters
   make the sum of n!/k! prefixes (325 rows of a part for five).
4. Full orders take their prefixes' rows; a filter's ``shapley`` is what it
   removes, over all orders.

Defined results: a null text is empty; a null part is the empty string; a row
with a null id neither is a copy nor makes one; repeated rows of one id are not
copies of each other, as neither id is smaller; a document is good (toxic) if
any of its label rows says so.  Without documents there are no rows.  Ids of any
type with an order will do.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut

#: A word of the filters ends at one of these characters.
SPACE = r"[\x20\x09-\x0D]+"
ROWS = "spark.sql.cteRecursionRowLimit"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone: letter -> does the text fail."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], duplicate: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of each document; bit i of the mask is the i-th letter of ``filters`` and then ``duplicate``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask")))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = rows.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return met.select("part", (F.col("mask") + F.when(copy, 1 << len(filters)).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(masked: DataFrame) -> DataFrame:
    """(part, cells): the part's documents by mask, an array of (mask, n, good, toxic)."""
    by = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return by.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # at most 2**filters of them


def _sum(which: str, what: str) -> str:
    return f"aggregate(filter(cells, c -> {which}), 0L, (s, c) -> s + c.{what})"


def prefixes(table: DataFrame, letters: str) -> DataFrame:
    """(part, prefix, kept, removed, redundant, unique_fails, good_lost, toxic_lost) for each prefix of filters; the last letter is the step's filter."""
    spark = table.sparkSession
    unused = "filter(array({}), x -> (applied & x.bit) = 0)".format(", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters)))
    alive, here = "(c.mask & applied) = 0", "(c.mask & applied) = 0 AND (c.mask & bit) <> 0"
    query = f"""
    WITH RECURSIVE steps (part, prefix, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
      SELECT part, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
      UNION ALL
      SELECT part, prefix || letter, applied | bit,
        {_sum(alive + " AND (c.mask & bit) = 0", "n")}, {_sum(here, "n")},
        {_sum("(c.mask & applied) <> 0 AND (c.mask & bit) <> 0", "n")}, {_sum("c.mask = bit", "n")},
        {_sum(here, "good")}, {_sum(here, "toxic")}
      FROM (SELECT part, prefix, applied, cells, inline({unused}) AS (letter, bit) FROM steps JOIN {{cells}} USING (part))
    )
    SELECT * EXCEPT (applied) FROM steps WHERE prefix <> ''
    """
    return spark.sql(query, cells=table)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order of the five filters and step."""
    found = text_filters(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    letters = "".join(found) + "E"
    table = cut(cells(masks(docs, labels, found, "E", id_col, text_col, part_col)))
    conf, limit = docs.sparkSession.conf, docs.sparkSession.conf.get(ROWS)
    conf.set(ROWS, "-1")  # the rows are 326 to a part, however many parts there are
    try:
        steps = cut(prefixes(table, letters))
    finally:
        conf.set(ROWS, limit)
    orders = steps.where(F.length("prefix") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    each = orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    rows = each.withColumn("prefix", F.expr("substring(filter_order, 1, step)")).join(steps, ["part", "prefix"])
    own = Window.partitionBy("part", F.substring("prefix", -1, 1))  # n! rows, one of each order
    return rows.withColumn("shapley", F.sum("removed").over(own)).drop("prefix")
