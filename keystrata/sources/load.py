"""Generated load: seeded read/write mixes, fills, and keys under a Zipf law.

Numbers come from md5 over the row's id, a stream's name and the seed, so any row can be
made again by any task, and by any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 1 << 32  # weight of the first rank
RANKS = 4096  # ranks that share a prefix sum


def draw(stream: str, seed: int, row="id") -> Column:
    """A number of 60 bits."""
    return F.conv(F.substring(F.md5(F.concat(F.col(row).cast("string"), F.lit(f"#{stream}#{seed}")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def key_of(index, prefix: str = "key:", size: int = 16) -> Column:
    """`prefix` and the index, padded with zeros to `size`; a longer index is kept whole."""
    text, digits = index.cast("string"), max(size - len(prefix), 1)
    return F.concat(F.lit(prefix), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))


def mix(spark: SparkSession, rows: int, keys: int = 1_000_000, sets: int = 1, gets: int = 10, value_size: int = 64, seed: int = 0xC0FFEE, ttl_ms: tuple[int, int] | None = None) -> DataFrame:
    """seq, cmd, key, value_size, px: SET and GET in the given weights over uniform keys; each SET
    has a uniform time to live in [low, high) where `ttl_ms` is given."""
    is_set = draw("op", seed) % (sets + gets) < sets
    px = F.lit(None).cast("bigint") if ttl_ms is None else F.when(F.col("cmd") == "SET", ttl_ms[0] + draw("ttl", seed) % max(ttl_ms[1] - ttl_ms[0], 1))
    out = spark.range(rows).withColumn("cmd", F.when(is_set, "SET").otherwise("GET"))
    return out.select(F.col("id").alias("seq"), "cmd", key_of(draw("key", seed) % keys).alias("key"), F.when(F.col("cmd") == "SET", value_size).alias("value_size"), px.alias("px"))


def fill(spark: SparkSession, keys: int, value_size: int = 64, pxat: int | None = None) -> DataFrame:
    """key, value_size, expire_at_ms: every key once, all with the same deadline if one is given."""
    return spark.range(keys).select(key_of(F.col("id")).alias("key"), F.lit(value_size).alias("value_size"), F.lit(pxat).cast("bigint").alias("expire_at_ms"))


def zipf_law(spark: SparkSession, keys: int, theta: float) -> DataFrame:
    """rank (from 1), lo, hi: whole-numbered cumulative weights, 1/rank^theta in units of 1/SCALE.
    Prefix sums are made per RANKS ranks and then over those sums, so no task sees all ranks."""
    w = spark.range(1, keys + 1).select(F.col("id").alias("rank"), F.expr(f"(id - 1) div {RANKS}").alias("part"), F.greatest(F.round(F.pow(F.col("id"), F.lit(-theta)) * SCALE).cast("bigint"), F.lit(1)).alias("w"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per RANKS ranks
    parts = w.groupBy("part").agg(F.sum("w").alias("w")).select("part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    own = w.withColumn("hi", F.sum("w").over(Window.partitionBy("part").orderBy("rank")))
    return own.join(parts, "part").select("rank", (F.col("base") + F.col("hi") - F.col("w")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))


def zipf(spark: SparkSession, keys: int, draws: int, theta: float = 0.99, seed: int = 0xC0FFEE, cells: int = 4096) -> DataFrame:
    """seq, rank: the rank whose weights [lo, hi) hold a uniform number.  The range join is an
    equi-join on equal cells of the weights: a rank lies in each cell it touches, together at
    most keys + cells rows, and every cell draws the same share, so none is hot."""
    law = zipf_law(spark, keys, theta)
    total = int(law.agg(F.max("hi")).first()[0] or 0)
    if not total:
        return law.select(F.col("rank").alias("seq"), "rank").limit(0)
    width = -(-total // cells)
    law = law.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    u = spark.range(draws).select(F.col("id").alias("seq"), (draw("zipf", seed) % total).alias("u")).withColumn("cell", F.expr(f"u div {width}"))
    return u.join(law, "cell").filter("lo <= u and u < hi").select("seq", "rank")
