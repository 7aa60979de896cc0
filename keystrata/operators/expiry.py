"""Deadlines: conditions, remaining time, as-of expiry of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEVER = 9223372036854775807


def applies(condition, current, new):
    """Whether EXPIRE with NX, XX, GT, LT or none takes effect (no deadline counts as never)."""
    cur = F.coalesce(current, F.lit(NEVER))
    return (F.when(condition == "NX", current.isNull()).when(condition == "XX", current.isNotNull())
            .when(condition == "GT", new > cur).when(condition == "LT", new < cur).otherwise(True))


def expire(keyspace: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """key, cond, reply (1 applied, 0 not), expire_at_ms after, deleted (deadline not after now)."""
    k = requests.join(keyspace.select("key", "expire_at_ms"), "key")
    ok = applies(F.col("cond"), F.col("expire_at_ms"), F.col("new_at"))
    return k.select("key", "cond", ok.cast("int").cast("bigint").alias("reply"), F.when(ok, F.col("new_at")).otherwise(F.col("expire_at_ms")).alias("expire_at_ms"), (ok & (F.col("new_at") <= now_ms)).alias("deleted"))


def times(requests: DataFrame, keyspace: DataFrame, now_ms: int) -> DataFrame:
    """key, ttl (rounded), pttl, expiretime (truncated), pexpiretime: -2 missing, -1 none."""
    k = requests.join(keyspace.select("key", "value", "expire_at_ms"), "key", "left")
    dead = F.col("value").isNull() | (F.col("expire_at_ms") <= now_ms)
    pick = lambda x: F.when(dead, -2).when(F.col("expire_at_ms").isNull(), -1).otherwise(x).cast("bigint")
    left = F.col("expire_at_ms") - now_ms
    return k.select("key", pick(F.floor((left + 500) / 1000)).alias("ttl"), pick(left).alias("pttl"), pick(F.floor(F.col("expire_at_ms") / 1000)).alias("expiretime"), pick(F.col("expire_at_ms")).alias("pexpiretime"))


def persist(keyspace: DataFrame) -> DataFrame:
    return keyspace.select("key", F.col("expire_at_ms").isNotNull().cast("int").cast("bigint").alias("reply"))


def get_and_extend(keyspace: DataFrame, option: str, at: int | None) -> DataFrame:
    """GETEX: value read first, then PERSIST or a new deadline."""
    new = F.lit(None).cast("bigint") if option == "PERSIST" else F.lit(at).cast("bigint") if option in ("EXAT", "PXAT") else F.col("expire_at_ms")
    return keyspace.select("key", "value", new.alias("expire_at_ms"))


def previous_alive(log: DataFrame) -> DataFrame:
    """For every timed write: state of the key just before it (none, expired or live)."""
    w = Window.partitionBy("key").orderBy("seq")
    before = F.lag(F.col("at_ms") + F.col("ttl_ms")).over(w)
    return log.select("seq", "key", F.when(before.isNull(), "none").when(before <= F.col("at_ms"), "expired").otherwise("live").alias("before"))


def departures(log: DataFrame, tick_ms: int) -> DataFrame:
    """key, seq, how, gone_ms of each write with a deadline in log(seq, at_ms, key, deadline):
    replaced (touched before the deadline), lazy (found dead by the next command on its key)
    or active (swept at the first tick that is not before the deadline)."""
    after = F.lead("at_ms").over(Window.partitionBy("key").orderBy("seq"))
    x = log.withColumn("after", after).filter(F.col("deadline").isNotNull()).withColumn("tick", F.ceil(F.col("deadline") / tick_ms) * tick_ms)
    how = F.when(F.col("after") < F.col("deadline"), "replaced").when(F.col("after") < F.col("tick"), "lazy").otherwise("active")
    gone = F.when(F.col("how") == "lazy", F.col("after")).when(F.col("how") == "active", F.col("tick"))
    return x.withColumn("how", how).select("key", "seq", "how", gone.alias("gone_ms"))
