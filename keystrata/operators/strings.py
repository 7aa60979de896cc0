"""String and integer commands as plans over keyspace relations and command logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def live(keyspace: DataFrame, now_ms) -> DataFrame:
    """Rows whose deadline is later than `now_ms` (a deadline that is reached is dead)."""
    return keyspace.filter(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))


def last_write(log: DataFrame, deletes=("DEL",)) -> DataFrame:
    """key, value, seq of the keys whose last write is no delete.  One aggregate with
    map-side combine; no sort and no window."""
    last = log.groupBy("key").agg(F.max_by(F.struct("cmd", "value"), "seq").alias("w"), F.max("seq").alias("seq"))
    return last.filter(~F.col("w.cmd").isin(*deletes)).select("key", F.col("w.value").alias("value"), "seq")


def mget(requests: DataFrame, keyspace: DataFrame) -> DataFrame:
    """req_id, pos, key, value in the order asked, null where missing, repeats kept."""
    return requests.join(keyspace.select("key", "value"), "key", "left").select("req_id", "pos", "key", "value")


def gather(replies: DataFrame, missing: str = "(nil)") -> DataFrame:
    """One row per request: its values in order."""
    xs = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", F.lit(missing)).alias("v"))))
    return replies.groupBy("req_id").agg(F.array_join(F.transform(xs, lambda x: x["v"]), ",").alias("reply"))


def exists(requests: DataFrame, keyspace: DataFrame) -> DataFrame:
    """req_id, present: repeats count each time."""
    hit = requests.join(keyspace.select("key", F.lit(1).alias("hit")), "key", "left")
    return hit.groupBy("req_id").agg(F.count("hit").alias("present"))


def removed(requests: DataFrame, keyspace: DataFrame) -> DataFrame:
    """req_id, removed: repeats count once."""
    hit = requests.select("req_id", "key").distinct().join(keyspace.select("key", F.lit(1).alias("hit")), "key", "left")
    return hit.groupBy("req_id").agg(F.count("hit").alias("removed"))


def epochs(log: DataFrame, ends) -> DataFrame:
    """Adds `epoch`: how many rows before this one end an incarnation of the key."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("epoch", F.coalesce(F.sum(ends.cast("bigint")).over(w), F.lit(0).cast("bigint")))


def counters(log: DataFrame) -> DataFrame:
    """seq, key, reply of every INCRBY: the running sum within the key's incarnation."""
    w = Window.partitionBy("key", "epoch").orderBy("seq")
    e = epochs(log, F.col("cmd") == "DEL").filter("cmd = 'INCRBY'")
    return e.select("seq", "key", F.sum(F.col("value").cast("bigint")).over(w).alias("reply"))


def appended(log: DataFrame) -> DataFrame:
    """key, value, length after all APPENDs of the last incarnation."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return log.filter("cmd = 'APPEND'").groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("value")).withColumn("length", X.octets("value"))


def set_if_absent(log: DataFrame) -> DataFrame:
    """Winner of SET NX per incarnation: the first SET after a delete."""
    e = epochs(log, F.col("cmd") == "DEL").filter("cmd = 'SET'")
    return e.groupBy("key", "epoch").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))


def set_if_present(log: DataFrame) -> DataFrame:
    """seq, key, applied of XX writes that compete with the log's own writes: applied if the
    key exists just before."""
    w = Window.partitionBy("key").orderBy("seq")
    return log.select("seq", "key", F.coalesce(F.lag("cmd").over(w) == "SET", F.lit(False)).alias("applied"), "cmd").filter("cmd = 'SET'").drop("cmd")


def old_values(log: DataFrame) -> DataFrame:
    """seq, key, old value seen by GETSET (SET ... GET)."""
    w = Window.partitionBy("key", "epoch").orderBy("seq")
    return epochs(log, F.col("cmd") == "DEL").filter("cmd = 'SET'").select("seq", "key", F.lag("value").over(w).alias("old"))


def taken(log: DataFrame) -> DataFrame:
    """seq, key, value taken by GETDEL: what stands just before each delete."""
    w = Window.partitionBy("key").orderBy("seq")
    prev = F.lag(F.struct("cmd", "value")).over(w)
    return log.withColumn("p", prev).filter("cmd = 'DEL'").select("seq", "key", F.when(F.col("p.cmd") == "SET", F.col("p.value")).alias("value"))


def multi_set(pairs: DataFrame) -> DataFrame:
    """Last pair of each key wins over (call, pos)."""
    return pairs.groupBy("key").agg(F.max_by("value", F.struct("call", "pos")).alias("value"))


def multi_set_if_none(pairs: DataFrame, keyspace: DataFrame) -> DataFrame:
    """call, reply: 1 if none of its keys existed, else 0 and nothing is written."""
    hit = pairs.join(keyspace.select("key", F.lit(True).alias("hit")), "key", "left")
    return hit.groupBy("call").agg(F.when(F.bool_or(F.coalesce("hit", F.lit(False))), 0).otherwise(1).cast("bigint").alias("reply"))
