"""What a server tells of itself, as relations: INFO, object and debug replies, take and peek,
report figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import keys, strings

# Sections of INFO in order, and the fields that never vary
SECTIONS = ("server", "clients", "memory", "persistence", "stats", "replication", "cpu", "tripwires", "keyspace")
CONSTANT = (
    ("server", "redis_mode", "standalone"), ("server", "arch_bits", "64"), ("server", "config_file", ""),
    ("clients", "cluster_connections", "0"), ("clients", "blocked_clients", "0"), ("clients", "tracking_clients", "0"),
    ("persistence", "loading", "0"), ("persistence", "rdb_changes_since_last_save", "0"), ("persistence", "rdb_bgsave_in_progress", "0"), ("persistence", "aof_enabled", "0"), ("persistence", "aof_rewrite_in_progress", "0"),
    ("stats", "instantaneous_ops_per_sec", "0"), ("stats", "rejected_connections", "0"), ("stats", "latest_fork_usec", "0"),
    ("replication", "role", "master"), ("replication", "connected_slaves", "0"), ("replication", "master_failover_state", "no-failover"), ("replication", "master_repl_offset", "0"),
)
READS = ("GET", "MGET", "GETRANGE", "SUBSTR", "GETEX")


def wanted(*names: str) -> list[str]:
    """Sections that INFO's arguments select: all, default and everything forget those before
    them, unknown ones select nothing, and no selection at all means every section."""
    out: list[str] = []
    for n in map(str.lower, names):
        if n in ("all", "default", "everything"):
            out = []
        elif n in SECTIONS and n not in out:
            out.append(n)
    return out or list(SECTIONS)


def since_reset(log: DataFrame, reset) -> DataFrame:
    """Rows of log(seq, ...) after the last one that `reset` (CONFIG RESETSTAT) marks."""
    at = log.filter(reset).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("at")).scalar()
    return log.filter(F.col("seq") > at)


def info(keyspace: DataFrame, conf: DataFrame, log: DataFrame, now_ms: int, *sections: str, reset=None) -> DataFrame:
    """section, field, value.  keyspace: db, key, value, expire_at_ms; conf: name, value;
    log: seq, conn, cmd, hit (boolean, null where not a read).  Facts of the machine (process,
    CPU, resident memory, rings) are left out."""
    spark, chosen = keyspace.sparkSession, wanted(*sections)

    def fields(section, one_row):
        cols = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in one_row.columns]
        return one_row.select(F.lit(section).alias("section"), F.inline(F.array(*cols)))

    conns = log.agg(F.countDistinct("conn").alias("total_connections_received"))
    counted = log if reset is None else since_reset(log, reset)
    read = F.upper("cmd").isin(*READS)
    stats = counted.agg(F.count("*").alias("total_commands_processed"), F.count_if(read & F.col("hit")).alias("keyspace_hits"), F.count_if(read & ~F.col("hit")).alias("keyspace_misses"))
    live = strings.live(keyspace, now_ms)
    by_db = live.groupBy("db").agg(F.count("*").alias("n"), F.count("expire_at_ms").alias("e"))
    db_text = F.concat(F.lit("keys="), F.col("n").cast("string"), F.lit(",expires="), F.col("e").cast("string"), F.lit(",avg_ttl=0"))
    setting = lambda section, *names: conf.filter(F.col("name").isin(*names)).select(F.lit(section).alias("section"), F.translate("name", "-", "_").alias("field"), "value")
    out = spark.createDataFrame(CONSTANT, "section string, field string, value string")
    for part in (fields("clients", conns), setting("clients", "maxclients"), fields("memory", keys.used_memory(keyspace).select("used_memory")), setting("memory", "maxmemory", "maxmemory-policy"), fields("stats", stats),
                 by_db.select(F.lit("keyspace").alias("section"), F.concat(F.lit("db"), F.col("db").cast("string")).alias("field"), db_text.alias("value"))):
        out = out.unionByName(part)
    return out.filter(F.col("section").isin(*chosen))


def debug_object(keyspace: DataFrame, requests: DataFrame) -> DataFrame:
    """key, reply, error of DEBUG OBJECT for requests(key)."""
    x = requests.select("key").join(keyspace.select("key", "value"), "key", "left")
    there = F.col("value").isNotNull()
    text = F.concat(F.lit("Value at:0x0 refcount:1 encoding:"), X.encoding("value"), F.lit(" serializedlength:"), F.octet_length("value").cast("string"), F.lit(" lru:0 lru_seconds_idle:0"))
    return x.select("key", F.when(there, text).alias("reply"), F.when(~there, "NO_SUCH_KEY").alias("error"))


def object_replies(keyspace: DataFrame, requests: DataFrame, policy: str, frequency: DataFrame) -> DataFrame:
    """key, idletime, freq, error of OBJECT IDLETIME and FREQ: no idle time is kept, and a
    frequency only under an LFU policy; missing keys answer nulls."""
    x = requests.select("key").join(keyspace.select("key", F.lit(True).alias("there")), "key", "left").join(frequency.select("key", "score"), "key", "left")
    lfu = "lfu" in policy
    freq = F.when(F.col("there"), F.least(F.floor(F.coalesce("score", F.lit(0.0))), F.lit(255)).cast("bigint")) if lfu else F.lit(None).cast("bigint")
    return x.select("key", F.when(F.col("there"), F.lit(0).cast("bigint")).alias("idletime"), freq.alias("freq"), (F.lit(None).cast("string") if lfu else F.when(F.col("there"), "NO_LFU_POLICY")).alias("error"))


def peek(keyspace: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """key, value, pttl for requests(key): -1 without a deadline, nulls where there is no key."""
    x = requests.select("key").join(strings.live(keyspace, now_ms).select("key", "value", "expire_at_ms"), "key", "left")
    return x.select("key", "value", F.when(F.col("value").isNotNull(), F.coalesce(F.col("expire_at_ms") - now_ms, F.lit(-1))).alias("pttl"))


def take(keyspace: DataFrame, requests: DataFrame) -> DataFrame:
    """The keyspace that stands after its keys in `requests` were taken (their replies are peek's)."""
    return keyspace.join(requests.select("key"), "key", "left_anti")


def replicates(runs: DataFrame) -> DataFrame:
    """metric, median, ratio of runs(metric, value, numerator, denominator): the upper median of
    the values, and the counters summed before they are divided."""
    return runs.groupBy("metric").agg(F.expr("percentile_disc(0.5) within group (order by value desc)").alias("median"), (F.sum("numerator") / F.sum("denominator")).alias("ratio"))
