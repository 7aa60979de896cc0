"""Key management: moves, flushes, scans, slots, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def rename(keyspace: DataFrame, moves: DataFrame) -> DataFrame:
    """Keyspace after moves(src, dst), all at once: sources go, destinations are replaced."""
    moved = keyspace.join(moves, keyspace["key"] == moves["src"]).select(F.col("dst").alias("key"), *[c for c in keyspace.columns if c != "key"])
    gone = moves.join(keyspace.select(F.col("key").alias("src")), "src", "left_semi").select(F.explode(F.array("src", "dst")).alias("key"))
    return keyspace.join(gone, "key", "left_anti").unionByName(moved)


def rename_if_free(keyspace: DataFrame, moves: DataFrame) -> DataFrame:
    """src, dst, reply: NO_SUCH_KEY (null), 0 where the destination exists, else 1; a key
    moved onto itself answers 1."""
    has = keyspace.select("key", F.lit(True).alias("has"))
    m = moves.join(has.withColumnRenamed("key", "src").withColumnRenamed("has", "s"), "src", "left").join(has.withColumnRenamed("key", "dst").withColumnRenamed("has", "d"), "dst", "left")
    return m.select("src", "dst", F.when(F.col("s").isNull(), None).when(F.col("src") == F.col("dst"), 1).when(F.col("d"), 0).otherwise(1).cast("bigint").alias("reply"))


def copy(keyspace: DataFrame, moves: DataFrame, replace: bool = False) -> DataFrame:
    """Keyspace (db, key, ...) after copies(src, dst, to_db); without `replace` an existing
    destination stays."""
    rest = [c for c in keyspace.columns if c not in ("db", "key")]
    new = keyspace.join(moves, keyspace["key"] == moves["src"]).select(F.col("to_db").alias("db"), F.col("dst").alias("key"), *rest)
    if replace:
        return keyspace.join(new.select("db", "key"), ["db", "key"], "left_anti").unionByName(new)
    return keyspace.unionByName(new.join(keyspace.select("db", "key"), ["db", "key"], "left_anti"))


def matching(keyspace: DataFrame, pattern: str) -> DataFrame:
    return keyspace.filter(F.col("key").rlike(X.glob_regex(pattern)))


def cursor(text):
    """decimal(20,0) of a cursor's text: up to 20 digits that fit 64 bits; else null (invalid)."""
    n = F.when(text.rlike("^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(n <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), n)


def scan_page(keyspace: DataFrame, after: tuple[int, str] | None, count: int, pattern: str = "*", type_: str = "string") -> DataFrame:
    """One cursor page in (slot, key) order: `count` keys are taken before the pattern and the
    type filter; every key is a string."""
    if count < 1:
        raise ValueError("COUNT must be positive")
    if type_.lower() != "string":
        return scan_page(keyspace, after, count, pattern).limit(0)
    s = keyspace.select("key").withColumn("slot", X.slot("key").cast("bigint"))
    if after is not None:
        s = s.filter(F.struct("slot", "key") > F.struct(F.lit(after[0]).cast("bigint"), F.lit(after[1])))
    return s.orderBy("slot", "key").limit(count).filter(F.col("key").rlike(X.glob_regex(pattern)))


def scan_all(keyspace: DataFrame, pattern: str = "*") -> DataFrame:
    """What a whole cursor walk returns: every key once.  Order is a matter of pages only, so
    nothing is sorted or shuffled."""
    return matching(keyspace.select("key"), pattern)


def random_key(keyspace: DataFrame, seed: int) -> DataFrame:
    return keyspace.select("key").orderBy(F.md5(F.concat(F.col("key"), F.lit(f"#{seed}")).cast("binary")), "key").limit(1)


def slots(keyspace: DataFrame, cells: int) -> DataFrame:
    s = keyspace.select("key").withColumn("slot", X.slot("key").cast("bigint"))
    return s.withColumn("cell", X.cell(F.col("slot"), cells))


def used_memory(keyspace: DataFrame) -> DataFrame:
    """Encoded bytes: 8 of header, 5 with a deadline, key and value."""
    size = 8 + F.when(F.col("expire_at_ms").isNotNull(), 5).otherwise(0) + X.octets("key") + X.octets("value")
    return keyspace.agg(F.sum(size).alias("used_memory"), F.count("*").alias("keys"), F.count("expire_at_ms").alias("expires"))
