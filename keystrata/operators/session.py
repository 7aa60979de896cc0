"""Connection state as windows over the log: database, protocol, name, end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def _last(value, w):
    return F.last(value, ignorenulls=True).over(w)


def with_session(log: DataFrame) -> DataFrame:
    """Adds db, proto and name in force at each row of log(seq, conn, cmd, args array<string>),
    and drops what follows a QUIT.  SELECT takes 0..15, HELLO 2 or 3; others change nothing."""
    before = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    arg = F.get("args", F.lit(0))
    n = X.strict_int(arg)
    log = log.withColumn("cmd", F.upper("cmd"))
    out = log.withColumn("ended", F.coalesce(F.max((F.col("cmd") == "QUIT").cast("int")).over(before), F.lit(0)))
    out = out.filter("ended = 0").drop("ended")
    set_name = (F.col("cmd") == "CLIENT") & (F.upper(arg) == "SETNAME") & (F.size("args") == 2) & F.get("args", F.lit(1)).rlike("^[!-~]*$")
    return (out.withColumn("db", F.coalesce(_last(F.when((F.col("cmd") == "SELECT") & n.between(0, 15), n), before), F.lit(0)))
            .withColumn("proto", F.coalesce(_last(F.when((F.col("cmd") == "HELLO") & (F.size("args") == 1) & n.isin(2, 3), n), before), F.lit(2)))
            .withColumn("name", _last(F.when(set_name, F.get("args", F.lit(1))), before)))


def stats(replies: DataFrame) -> DataFrame:
    """Counters over (cmd, hit boolean or null, expired, evicted): only reads count hits."""
    reads = F.col("cmd").isin("GET", "MGET", "GETRANGE", "SUBSTR", "GETEX")
    return replies.agg(F.count("*").alias("total_commands_processed"), F.count_if(reads & F.col("hit")).alias("keyspace_hits"), F.count_if(reads & ~F.col("hit")).alias("keyspace_misses"),
                       F.sum("expired").cast("bigint").alias("expired_keys"), F.sum("evicted").cast("bigint").alias("evicted_keys"))


def decayed_frequency(access: DataFrame, now_ms: int, half_ms: int = 60_000) -> DataFrame:
    """key, score: accesses halved for every whole period since."""
    return access.groupBy("key").agg(F.sum(F.pow(F.lit(0.5), F.floor((F.lit(now_ms) - F.col("at_ms")) / half_ms))).alias("score"))


def until_killed(log: DataFrame, kills: DataFrame) -> DataFrame:
    """log(seq, conn, ...) without what a connection sends after the first of kills(seq, id)
    that names it; the kill itself, if it is its own, still runs."""
    first = kills.groupBy(F.col("id").alias("conn")).agg(F.min("seq").alias("killed_seq"))
    return log.join(first, "conn", "left").filter(F.col("killed_seq").isNull() | (F.col("seq") <= F.col("killed_seq"))).drop("killed_seq")


ROWS, COLUMNS, BITS = 4, 2048, 11


def _cells(key):
    """(row, col) pairs of a key: eleven bits of its md5 for each row."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, ROWS * BITS // 4), 16, 10).cast("bigint")
    return F.array(*(F.struct(F.lit(r).alias("row"), F.shiftright(h, BITS * r).bitwiseAND(COLUMNS - 1).alias("col")) for r in range(ROWS)))


def frequency_sketch(scores: DataFrame) -> DataFrame:
    """row, col, weight: a count-min sketch of scores(key, score), at most ROWS * COLUMNS rows.
    Sums take the place of counters updated one by one, so sketches of parts can be added."""
    return scores.select("score", F.explode(_cells("key")).alias("c")).groupBy("c.row", "c.col").agg(F.sum("score").alias("weight"))


def estimates(keys: DataFrame, sketch: DataFrame) -> DataFrame:
    """key, estimate: the least of a key's cells, never below its score."""
    x = keys.select("key").distinct().select("key", F.explode(_cells("key")).alias("c")).select("key", "c.row", "c.col")
    x = x.join(F.broadcast(sketch), ["row", "col"], "left")  # 8192 rows at most
    return x.groupBy("key").agg(F.min(F.coalesce("weight", F.lit(0.0))).alias("estimate"))
