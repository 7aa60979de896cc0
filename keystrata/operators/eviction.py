"""The eight eviction policies as exact rankings per cell, and the memory gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.commands import DENY_OOM

RANGES = 4096
POLICIES = ("noeviction", "allkeys-lru", "volatile-lru", "allkeys-lfu", "volatile-lfu", "volatile-ttl", "allkeys-random", "volatile-random")


def victims(keys: DataFrame, policy: str, limit_bytes: int, seed: int = 0) -> DataFrame:
    """cell, key, bytes of the keys to go so that each cell fits `limit_bytes`.

    keys: cell, key, bytes, expire_at_ms, last_seq, freq.  Candidates of the policy go in the
    order of (score, key) within their cell until it fits.  Scores are cut into RANGES; the
    sums of the ranges decide all but the one in which a cell comes to fit, and only the rows
    of that one are ranked.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if policy == "noeviction":
        return keys.select("cell", "key", "bytes").limit(0)
    score = {"lru": F.col("last_seq"), "lfu": F.col("freq"), "ttl": F.col("expire_at_ms"), "random": F.md5(F.concat(F.col("key"), F.lit(f"#{seed}")).cast("binary"))}[policy.split("-")[1]]
    excess = keys.groupBy("cell").agg((F.sum("bytes") - limit_bytes).alias("excess")).filter("excess > 0")
    k = keys.filter(F.col("expire_at_ms").isNotNull()) if policy.startswith("volatile") else keys
    k = k.select("cell", "key", "bytes", score.alias("score"))
    if policy.endswith("random"):
        part = F.conv(F.substring("score", 1, 3), 16, 10).cast("long")
    else:  # equal widths between the extremes
        low, high = (k.agg(f("score")).scalar() for f in (F.min, F.max))
        part = F.floor((F.col("score") - low) / (high - low + 1) * RANGES)
    k = k.withColumn("part", F.coalesce(part, F.lit(-1)))  # no score goes first
    sums = k.groupBy("cell", "part").agg(F.sum("bytes").alias("size")).join(excess, "cell")
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a cell
    sums = sums.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0))).filter("base < excess")
    k = k.join(sums.select("cell", "part", "base", "excess", (F.col("base") + F.col("size") < F.col("excess")).alias("whole")), ["cell", "part"])
    before = Window.partitionBy("cell", "part").orderBy("score", "key").rowsBetween(Window.unboundedPreceding, -1)
    last = k.filter(~F.col("whole")).withColumn("before", F.col("base") + F.coalesce(F.sum("bytes").over(before), F.lit(0))).filter("before < excess")
    return k.filter("whole").select("cell", "key", "bytes").unionByName(last.select("cell", "key", "bytes"))


def admission(log: DataFrame, limit_bytes: int) -> DataFrame:
    """seq, conn, admitted: a command that may grow memory passes while the growth so far on its
    connection's shard stays within the limit; all others pass and cost nothing."""
    w = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    grows = F.lower("cmd").isin(*DENY_OOM)
    size = F.when(grows, F.octet_length("key") + F.octet_length(F.coalesce("value", F.lit(""))) + 8).otherwise(0)
    used = F.coalesce(F.sum("size").over(w), F.lit(0))
    return log.withColumn("size", size.cast("bigint")).withColumn("used", used).select("seq", "conn", (~grows | (F.col("used") <= limit_bytes)).alias("admitted"))


def lfu_hit_rate(access: DataFrame, warm: int, slots: int) -> DataFrame:
    """accesses, hits, hit_rate of the reads access(seq, key) from `warm` on, against a cache that
    holds the `slots` keys read most before (ties to the smaller key)."""
    held = access.filter(F.col("seq") < warm).groupBy("key").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "key").limit(slots).select("key", F.lit(1).alias("hit"))
    x = access.filter(F.col("seq") >= warm).join(held, "key", "left")
    return x.agg(F.count("*").alias("accesses"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("hit_rate"))
