"""Relations derived from the driver's tables: command log, keyspaces, subscriptions.

Each is a DataFrame here and a common table expression for the oracle in SQL below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 883612800000  # 1998-01-01T00:00:00Z
DAY = 86400000
DAYS = {"1-URGENT": 1, "2-HIGH": 7, "3-MEDIUM": 30, "4-NOT SPECIFIED": 365}
COMMANDS = {"signup": "SET", "view": "INCRBY", "click": "APPEND", "purchase": "PSETEX", "error": "DEL"}
SUFFIX = {"signup": "profile", "view": "views", "click": "trail", "purchase": "cart", "error": "profile"}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def millis(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}) div 1000")


def _case(values: dict, c: str):
    out = F
    for k, v in values.items():
        out = out.when(F.col(c) == k, v)
    return out


def kvlog(spark, d) -> DataFrame:
    """seq, at_ms, conn, user_id, cmd, key, value (text), ttl_ms: one command per event."""
    e = read(spark, d, "events").filter(F.col("event_type").isin(*COMMANDS))
    cents = F.round(F.col("value") * 100).cast("bigint")
    value = F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).when(F.col("event_type") == "view", "1").when(F.col("event_type") == "click", (F.col("event_id") % 10).cast("string")).when(F.col("event_type") == "purchase", cents.cast("string"))
    return e.select(F.col("event_id").alias("seq"), millis("ts").alias("at_ms"), (F.col("user_id") % 8).alias("conn"), "user_id", _case(COMMANDS, "event_type").alias("cmd"),
                    F.concat(F.lit("{u"), F.col("user_id").cast("string"), F.lit("}:"), _case(SUFFIX, "event_type")).alias("key"), value.alias("value"),
                    F.when(F.col("event_type") == "purchase", cents * 10000).alias("ttl_ms"))


def kv_orders(spark, d) -> DataFrame:
    """key, value, at_ms, expire_at_ms."""
    at = millis("o_orderdate")
    return read(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("value"), at.alias("at_ms"), (at + _case({k: F.lit(v * DAY).cast("bigint") for k, v in DAYS.items()}, "o_orderpriority")).alias("expire_at_ms"))


def kv_customer(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(F.concat(F.lit("cust:{"), (k % 50).cast("string"), F.lit("}:"), k.cast("string")).alias("key"), F.col("c_mktsegment").alias("value"), (F.col("c_nationkey") % 16).cast("int").alias("db"))


def kv_part(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_brand"), F.lit(":"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"))


def requests(spark, d) -> DataFrame:
    """req_id, pos, key: for each customer its orders and, after each, a key that may be missing."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("req_id"), F.explode(F.array(F.struct((F.col("o_orderkey") * 2).alias("pos"), F.col("o_orderkey").alias("k")), F.struct((F.col("o_orderkey") * 2 + 1).alias("pos"), (F.col("o_orderkey") * 3 + 7).alias("k")))).alias("x"))
    return o.select("req_id", "x.pos", F.concat(F.lit("order:"), F.col("x.k").cast("string")).alias("key"))


def access(spark, d) -> DataFrame:
    """seq, key, bytes: lineitem rows as reads of their order, in shipping order."""
    li = read(spark, d, "lineitem")
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(seq.alias("seq"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key"), F.round("l_extendedprice").cast("bigint").alias("bytes"), millis("l_shipdate").alias("at_ms"))


def subs(spark, d) -> DataFrame:
    """conn, kind, name, from_seq, to_seq: subscription intervals opened by signups, closed by errors."""
    from pyspark.sql import Window

    e = read(spark, d, "events").filter(F.col("event_type").isin("signup", "error")).select("user_id", F.col("event_id").alias("seq"), "event_type")
    close = F.min(F.when(F.col("event_type") == "error", F.col("seq"))).over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
    opened = e.withColumn("to_seq", close).filter("event_type = 'signup'").groupBy("user_id", "to_seq").agg(F.min("seq").alias("from_seq"))
    pattern = F.col("user_id") % 15 == 0
    return opened.select(F.col("user_id").alias("conn"), F.when(pattern, "pattern").otherwise("channel").alias("kind"), F.when(pattern, "chan:[0-4]*").otherwise(F.concat(F.lit("chan:"), (F.col("user_id") % 10).cast("string"))).alias("name"), "from_seq", "to_seq")


def msgs(spark, d) -> DataFrame:
    e = read(spark, d, "events").filter("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("chan:"), (F.col("user_id") % 10).cast("string")).alias("channel"), F.round(F.col("value") * 100).cast("bigint").cast("string").alias("payload"), millis("ts").alias("at_ms"))


_cmd = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMANDS.items())
_suffix = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIX.items())
_days = " ".join(f"WHEN '{k}' THEN {v * DAY}" for k, v in DAYS.items())
KVLOG = f"""kvlog AS (SELECT event_id AS seq, epoch_us(ts)//1000 AS at_ms, user_id % 8 AS conn, user_id, CASE event_type {_cmd} END AS cmd,
  '{{u' || user_id || '}}:' || CASE event_type {_suffix} END AS key,
  CASE event_type WHEN 'signup' THEN CAST(event_id AS VARCHAR) WHEN 'view' THEN '1' WHEN 'click' THEN CAST(event_id % 10 AS VARCHAR) WHEN 'purchase' THEN CAST(CAST(round(value*100) AS BIGINT) AS VARCHAR) END AS value,
  CASE event_type WHEN 'purchase' THEN CAST(round(value*100) AS BIGINT) * 10000 END AS ttl_ms FROM events WHERE event_type IN ('signup','view','click','purchase','error'))"""
KV_ORDERS = f"""kv_orders AS (SELECT 'order:' || o_orderkey AS key, CAST(CAST(round(o_totalprice*100) AS BIGINT) AS VARCHAR) AS value, epoch_us(o_orderdate)//1000 AS at_ms,
  epoch_us(o_orderdate)//1000 + CASE o_orderpriority {_days} END AS expire_at_ms FROM orders)"""
KV_CUSTOMER = "kv_customer AS (SELECT 'cust:{' || (c_custkey % 50) || '}:' || c_custkey AS key, c_mktsegment AS value, CAST(c_nationkey % 16 AS INTEGER) AS db FROM customer)"
KV_PART = "kv_part AS (SELECT 'part:' || p_brand || ':' || p_partkey AS key, p_name AS value FROM part)"
REQUESTS = "requests AS (SELECT o_custkey AS req_id, o_orderkey*2 AS pos, 'order:' || o_orderkey AS key FROM orders UNION ALL SELECT o_custkey, o_orderkey*2+1, 'order:' || (o_orderkey*3+7) FROM orders)"
ACCESS = "access AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, 'order:' || l_orderkey AS key, CAST(round(l_extendedprice) AS BIGINT) AS bytes, epoch_us(l_shipdate)//1000 AS at_ms FROM lineitem)"
SUBS = """subs AS (SELECT user_id AS conn, CASE WHEN user_id % 15 = 0 THEN 'pattern' ELSE 'channel' END AS kind, CASE WHEN user_id % 15 = 0 THEN 'chan:[0-4]*' ELSE 'chan:' || (user_id % 10) END AS name, min(seq) AS from_seq, to_seq FROM
  (SELECT user_id, event_id AS seq, event_type, min(CASE WHEN event_type='error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS to_seq FROM events WHERE event_type IN ('signup','error')) WHERE event_type='signup' GROUP BY user_id, to_seq)"""
MSGS = "msgs AS (SELECT event_id AS seq, 'chan:' || (user_id % 10) AS channel, CAST(CAST(round(value*100) AS BIGINT) AS VARCHAR) AS payload, epoch_us(ts)//1000 AS at_ms FROM events WHERE event_type='purchase')"
