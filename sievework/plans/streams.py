"""Queries that run streams to their end over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import keys
from sievework.operators import search
from sievework.plans.exchange import fresh
from sievework.plans.registry import query
from sievework.session import table
from sievework.streaming import decisions, ledgers

ACTIONS = ("approve", "reject", "correct", "skip")
_DECISIONS = """c AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS asset, event_type AS field FROM events WHERE user_id % 10 <> 3),
d AS (SELECT CASE WHEN event_id % 41 = 0 THEN '*' ELSE CAST(user_id AS VARCHAR) END AS asset, CASE WHEN event_id % 37 = 0 THEN '*' ELSE event_type END AS field,
  ['approve', 'reject', 'correct', 'skip', 'publish', NULL][event_id % 6 + 1] AS action, CASE WHEN event_id % 6 = 2 THEN 'v' || event_id END AS value, ts, event_id FROM events),
j AS (SELECT d.*, CASE WHEN d.asset = '*' OR d.field = '*' THEN 'wildcard' WHEN c.asset IS NULL THEN 'unknown-key' WHEN action IS NULL OR action = 'publish' THEN 'unknown-action' END AS reason FROM d LEFT JOIN c ON d.asset = c.asset AND d.field = c.field)"""


def _imported(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as decisions: each 41st names all assets, each 37th all fields, a tenth of the users is no candidate, two of six actions are unknown."""
    user, k = F.col("user_id").cast("string"), F.col("event_id")
    action = F.get(F.array(*(F.lit(a) for a in (*ACTIONS, "publish", None))), (k % 6).cast("int"))
    rows = ledgers.stream_of(spark, f"{sf}/events.parquet").select(
        F.when(k % 41 == 0, "*").otherwise(user).alias("asset"), F.when(k % 37 == 0, "*").otherwise(F.col("event_type")).alias("field"), action.alias("action"),
        F.when(k % 6 == 2, F.concat(F.lit("v"), k.cast("string"))).alias("value"), F.col("ts").alias("at"), k.cast("bigint").alias("seq"))
    candidates = table(spark, sf, "events").where("user_id % 10 <> 3").select(user.alias("asset"), F.col("event_type").alias("field"))
    return decisions.import_decisions(rows, candidates, ACTIONS, fresh(spark, "decisions"))


@query(f"WITH {_DECISIONS} SELECT asset, field, action, value, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY asset, field ORDER BY ts DESC, event_id DESC) AS rn FROM j WHERE reason IS NULL) WHERE rn = 1")
def st02_accepted_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _imported(spark, sf)[0].select("asset", "field", "action", "value", "seq")


@query(f"WITH {_DECISIONS} SELECT asset, field, action, event_id AS seq, reason FROM j WHERE reason IS NOT NULL")
def st02_rejected_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _imported(spark, sf)[1].select("asset", "field", "action", "seq", "reason")


BLOCKS = 3
_WINDOWS = f"""e AS (SELECT *, CAST(least({BLOCKS - 1}, (dayofyear(ts) - 1 + event_id % 7) // 12) AS INT) AS block, year(ts) || '-' || lpad(CAST((dayofyear(ts) - 1) // 3 AS VARCHAR), 3, '0') AS w,
  CAST(make_date(year(ts), 1, 1) + CAST((dayofyear(ts) - 1) // 3 * 3 AS INT) AS TIMESTAMP) AS starts FROM events WHERE ts IS NOT NULL),
m AS (SELECT block, max(max(ts)) OVER (ORDER BY block ROWS UNBOUNDED PRECEDING) - INTERVAL 1 DAY AS mark FROM e GROUP BY block),
x AS (SELECT e.*, coalesce(ts <= (SELECT max(mark) FROM m WHERE m.block < e.block), false) AS late FROM e),
g AS (SELECT w, starts, least(starts + INTERVAL 3 DAY, CAST(make_date(year(starts) + 1, 1, 1) AS TIMESTAMP)) AS ends, count(*) FILTER (NOT late) AS n, count(DISTINCT user_id) FILTER (NOT late) AS members, count(*) FILTER (late) AS late FROM x GROUP BY w, starts)"""


def _closed(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive up to six days late, in three lots, each of which the stream reads in a run of its own that goes on from the last one's state."""
    at = fresh(spark, "windows")
    e = table(spark, sf, "events").where("ts is not null").select("ts", F.col("user_id").alias("member"), F.least(F.lit(BLOCKS - 1), F.floor((F.dayofyear("ts") - 1 + F.col("event_id") % 7) / 12)).alias("block"))
    closed = None
    for block in range(BLOCKS):
        e.where(F.col("block") == block).select("ts", "member").write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(e.select("ts", "member").schema).parquet(f"{at}/in")
        closed = decisions.closed_windows(rows, keys.three_day_key(F.col("ts")), "1 day", at)
    return closed


@query(f"WITH {_WINDOWS} SELECT w AS \"window\", strftime(starts, '%Y-%m-%d') AS starts, n, members, late FROM g WHERE ends <= (SELECT max(mark) FROM m)")
def st04_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Closed windows with what they count and how many rows came too late for them."""
    total = table(spark, sf, "events").groupBy(keys.three_day_key(F.col("ts")).alias("window")).agg(F.count("*").alias("total"))
    return _closed(spark, sf).join(total, "window").select("window", F.date_format("starts", "yyyy-MM-dd").alias("starts"), "n", "members", (F.col("total") - F.col("n")).alias("late"))


@query()
def st04_window_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """The featured pool of each brand, turned by each closed window."""
    m = table(spark, sf, "part").select(F.col("p_brand").alias("hub"), F.col("p_partkey").alias("asset"), F.col("p_name").alias("key"), F.col("p_size").alias("score"))
    pools = search.featured(m, 40, 45).withColumn("on", F.lit(1))
    met = pools.join(_closed(spark, sf).select("window", F.lit(1).alias("on")), "on").withColumn("hub", F.concat_ws("@", "hub", "window"))
    turned = search.rotation(met.drop("on", "window"), "hub", "asset", keys.fnv1a(F.col("hub")), 12)
    return turned.withColumn("window", F.substring_index("hub", "@", -1)).withColumn("hub", F.substring_index("hub", "@", 1))
