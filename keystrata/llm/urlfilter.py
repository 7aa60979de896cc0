"""URL filters, with DataFrame functions only.

A list holds rules (host/path prefix, verdict), which fit hosts and paths as they stand, and
blocked sites, which fit canonical URLs: without user information, port and trailing dots,
escapes decoded once, dot segments resolved.  Each url asks for its host suffixes joined with
its path prefixes, in both forms.  A split-block Bloom filter over the list (eight 64-bit words
a block, one bit in each) lets possible hits pass; an exact hash join with the list then
removes the false ones, and the longest rule wins.  A url without a rule is allowed unless
its canonical host or a parent of it is on the list of blocked sites, which go through the
same filter and join.

The filter has as many blocks as the list needs for false positives of RATE a key, at most
MAX_BLOCKS (16 MiB, some 8 million entries): a list beyond that raises its false positives,
never its size, and the join stays exact.  Only urls with a possible hit are exploded and
shuffled, a few short rows each.  A list of at most BROADCAST_ROWS entries is broadcast to
them; a longer one is joined by key and salt, so that no host's urls meet in one task.
Repeated urls are counted within their input partition and dealt out again at the end.

Edge cases: a null url or one without "://" has empty host and path and is allowed; an
empty list allows everything; repeated rows are judged one by one; ties between equal
rules go to block; a null page_id is kept; escapes that cannot be decoded stay as they are;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WORDS = 8
RATE, MAX_BLOCKS = 0.001, 1 << 18
BROADCAST_ROWS, SALTS = 100_000, 16
#: Rules of the production list.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Sites blocked as a whole where no rule says otherwise.
SITES = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.org", "ads-track.example.org", "free-bets.example.com")


def host_path(url):
    """Host (A-Z lower-cased) and path columns of a url column."""
    host = F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _decoded(c):
    """Escapes decoded once; a plus stays a plus."""
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def canonical(host, path):
    """Canonical forms of host and path columns."""
    h = ascii_lower(_decoded(F.regexp_replace(host, "^(?s:.*)@", "")))
    h = F.regexp_replace(F.regexp_replace(h, ":[0-9]*$", ""), "[.]+$", "")
    parts = F.split(_decoded(path), "/")

    def step(done, part):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))  # the leading slash stays
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1).isin(".", "..")
    p = F.concat(F.array_join(kept, "/"), F.when(last, "/").otherwise(""))
    return h, F.when(F.contains(path, F.lit("%")) | F.contains(path, F.lit("/.")), p).otherwise(path)


def rules_frame(spark, rules=RULES, sites=SITES) -> DataFrame:
    """The list: rules as they stand and sites as canonical URLs."""
    rows = [(h, p, v, True) for h, p, v in rules] + [(s, "", "block", False) for s in sites]
    given = spark.createDataFrame(rows, "r_host string, r_path string, r_verdict string, is_rule boolean")
    h, p = canonical(F.col("r_host"), F.col("r_path"))
    return given.withColumns({"r_host": F.when(F.col("is_rule"), F.col("r_host")).otherwise(h), "r_path": F.when(F.col("is_rule"), F.col("r_path")).otherwise(p)})


def _key(is_rule, host, path):
    return F.concat(F.when(is_rule, "R").otherwise("C"), host, F.lit("\0"), path)


def _bits(key):
    """Block hash and, for each word, the bit that `key` sets in it."""
    h = F.xxhash64(key)
    return h, [F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(h2, {7 * w}), 64) as int))") for w in range(WORDS)]


def blocks_for(entries: int, rate: float = RATE) -> int:
    """Blocks so that a key that is not listed passes with probability `rate`: with c keys a block
    each word has a given bit with 1 - (63/64)^c; 0.85 makes up for uneven blocks."""
    per_block = -64 * math.log(1 - rate ** (1 / WORDS)) * 0.85
    return min(max(1, math.ceil(entries / per_block)), MAX_BLOCKS)


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """One row: array<long> of blocks * 8 words."""
    h, bits = _bits(F.col("k"))
    names = [f"w{w}" for w in range(WORDS)]
    of = rules.select(_key(F.col("is_rule"), F.col("r_host"), F.col("r_path")).alias("k")).withColumn("b", F.pmod(h, F.lit(blocks))).withColumn("h2", F.xxhash64("k", F.lit(7)))
    every = rules.sparkSession.range(blocks).select(F.col("id").alias("b"), *(F.lit(0).cast("long").alias(n) for n in names))
    by = of.select("b", *(x.alias(n) for x, n in zip(bits, names))).unionByName(every).groupBy("b").agg(*(F.bit_or(n).alias(n) for n in names))
    ordered = F.sort_array(F.collect_list(F.struct("b", F.array(*names).alias("w"))))
    return by.agg(F.flatten(F.transform(ordered, lambda x: x["w"])).alias("words"))


def judge(pages: DataFrame, rules: DataFrame, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed."""
    host, path = host_path(F.col("url"))
    # The longest host and the lengths of the paths listed bound what a url asks for.
    shape = {x["is_rule"]: x for x in rules.groupBy("is_rule").agg(F.count("*").alias("n"), F.max(F.size(F.split("r_host", "\\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).collect()}
    entries = sum(x["n"] for x in shape.values())
    blocks = blocks_for(entries) if blocks is None else blocks
    words = bloom(rules, blocks).scalar()

    def asked(is_rule, host, path):
        if is_rule not in shape:
            return F.array().cast("array<string>")
        parts, kind = F.split(host, "\\."), "R" if is_rule else "C"
        n = F.size(parts)
        suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(shape[is_rule]["labels"]))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
        prefixes = F.array_distinct(F.array(*(F.substring(path, 1, m) for m in sorted(shape[is_rule]["lengths"]))))
        return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit(kind), s, F.lit("\0"), p))))

    def passes(k):
        h2 = F.xxhash64(k, F.lit(7))
        base = F.pmod(F.xxhash64(k), F.lit(blocks)) * WORDS + 1

        def every(block):
            ok = None
            for w in range(WORDS):
                x = F.getbit(F.get(block, F.lit(w)), F.pmod(F.shiftrightunsigned(h2, 7 * w), F.lit(64)).cast("int")) == 1
                ok = x if ok is None else ok & x
            return ok

        return F.exists(F.array(F.slice("words", base.cast("int"), WORDS)), every)

    keys = F.concat(asked(True, F.col("host"), F.col("path")), asked(False, *canonical(F.col("host"), F.col("path"))))
    # A url is told apart from its repeats by its input partition and counted there.
    url = pages.select("page_id", host.alias("host"), path.alias("path"), F.spark_partition_id().alias("part"))
    url = url.withColumn("words", words).withColumn("keys", F.filter(keys, passes)).drop("words")
    own = ["page_id", "host", "path", "part", "keys"]  # with the keys, so that both aggregates share one exchange
    hits = url.filter(F.size("keys") > 0).groupBy(*own).agg(F.count("*").alias("copies")).select(*own, "copies", F.explode("keys").alias("k"))
    listed = rules.withColumn("k", _key(F.col("is_rule"), F.col("r_host"), F.col("r_path")))
    if entries <= BROADCAST_ROWS:
        exact = hits.join(F.broadcast(listed), "k", "left")
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        exact = hits.withColumn("salt", F.pmod(F.xxhash64(*own), F.lit(SALTS))).join(salted, ["k", "salt"], "left")
    rule = F.concat("r_host", "r_path")
    order = F.struct(F.length(rule), F.length("r_host"), (F.col("r_verdict") == "block"))
    judged = exact.groupBy(*own, "copies").agg(
        F.max_by(F.when(F.col("is_rule"), F.struct(rule.alias("rule"), F.col("r_verdict").alias("verdict"))), F.when(F.col("is_rule"), order)).alias("r"),
        F.coalesce(F.bool_or(~F.col("is_rule")), F.lit(False)).alias("listed"))
    judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    judged = judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
    rest = url.filter(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    return judged.unionByName(rest)


_RULE = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " END"
ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(translate(url_decode(regexp_replace(host, '^.*@', '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':[0-9]*$', ''), '[.]+$', '') AS site FROM u),
r AS (SELECT *, {_RULE} AS rule, {' OR '.join(f"site = '{s}' OR ends_with(site, '.{s}')" for s in SITES)} AS listed FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({', '.join(f"'{h}{p}'" for h, p, v in RULES if v == 'block')}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r"""
