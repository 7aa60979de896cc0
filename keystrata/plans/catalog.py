"""All registered queries of the key/value engine and their oracle statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import admin, eviction, expiry, keys, pubsub, strings
from ..sources import fixtures as fx

NOW = fx.NOW_MS
_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return put


def queries():
    from . import programs, service  # noqa: F401  (register more queries)

    return dict(_QUERIES)


def oracle_sql():
    from . import programs, service  # noqa: F401

    return dict(_ORACLES)


LAST = f"WITH {fx.KVLOG}, lastw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kvlog WHERE cmd IN ('SET','DEL')) WHERE rn = 1 AND cmd = 'SET')"
PROFILE = "cmd in ('SET', 'DEL')"


@query(f"{LAST} SELECT key, value, seq FROM lastw")
def kv_lww_get(spark, d):
    return strings.last_write(fx.kvlog(spark, d).filter(PROFILE))


@query(f"WITH {fx.KV_ORDERS}, {fx.REQUESTS} SELECT r.req_id, string_agg(coalesce(k.value, '(nil)'), ',' ORDER BY pos) AS reply FROM requests r LEFT JOIN kv_orders k USING (key) GROUP BY r.req_id")
def kv_mget_gather(spark, d):
    return strings.gather(strings.mget(fx.requests(spark, d), fx.kv_orders(spark, d)))


@query(f"WITH {fx.KV_ORDERS} SELECT l_partkey AS req_id, count(k.key) AS present FROM lineitem l LEFT JOIN kv_orders k ON k.key = 'order:' || l.l_orderkey AND (k.expire_at_ms IS NULL OR k.expire_at_ms > {NOW}) GROUP BY l_partkey")
def kv_exists_dups(spark, d):
    req = fx.read(spark, d, "lineitem").select(F.col("l_partkey").alias("req_id"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key"))
    return strings.exists(req, strings.live(fx.kv_orders(spark, d), NOW))


@query(f"WITH {fx.KV_ORDERS} SELECT l_suppkey AS req_id, count(DISTINCT k.key) AS removed FROM lineitem l LEFT JOIN kv_orders k ON k.key = 'order:' || l.l_orderkey AND (k.expire_at_ms IS NULL OR k.expire_at_ms > {NOW}) GROUP BY l_suppkey")
def kv_del_count(spark, d):
    req = fx.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("req_id"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key"))
    return strings.removed(req, strings.live(fx.kv_orders(spark, d), NOW))


@query(f"WITH {fx.ACCESS} SELECT key, count(*) AS touches, max(seq) IS NOT NULL AS seen FROM access GROUP BY key")
def kv_touch_access(spark, d):
    return fx.access(spark, d).groupBy("key").agg(F.count("*").alias("touches"), F.max("seq").isNotNull().alias("seen"))


EPOCH = f"WITH {fx.KVLOG}, e AS (SELECT *, coalesce(sum(CASE WHEN cmd='DEL' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM kvlog WHERE cmd IN ('SET','DEL'))"


@query(f"{EPOCH} SELECT key, CAST(epoch AS BIGINT) AS epoch, arg_min(value, seq) AS value, min(seq) AS seq FROM e WHERE cmd='SET' GROUP BY key, epoch")
def kv_setnx_first(spark, d):
    return strings.set_if_absent(fx.kvlog(spark, d).filter(PROFILE))


@query(f"WITH {fx.KVLOG} SELECT seq, key, applied FROM (SELECT seq, key, cmd, coalesce(lag(cmd) OVER (PARTITION BY key ORDER BY seq) = 'SET', false) AS applied FROM kvlog WHERE cmd IN ('SET','DEL')) WHERE cmd='SET'")
def kv_set_xx(spark, d):
    return strings.set_if_present(fx.kvlog(spark, d).filter(PROFILE))


@query(f"{EPOCH} SELECT seq, key, lag(value) OVER (PARTITION BY key, epoch ORDER BY seq) AS old FROM e WHERE cmd='SET'")
def kv_getset_old(spark, d):
    return strings.old_values(fx.kvlog(spark, d).filter(PROFILE))


@query(f"WITH {fx.KVLOG} SELECT seq, key, CASE WHEN pc='SET' THEN pv END AS value FROM (SELECT *, lag(cmd) OVER w AS pc, lag(value) OVER w AS pv FROM kvlog WHERE cmd IN ('SET','DEL') WINDOW w AS (PARTITION BY key ORDER BY seq)) WHERE cmd='DEL'")
def kv_getdel(spark, d):
    return strings.taken(fx.kvlog(spark, d).filter(PROFILE))


def _pairs(spark, d):
    return fx.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("call"), "l_linenumber", (F.col("l_partkey") % 500).alias("k")).agg(F.max("l_suppkey").alias("v")).select("call", (F.col("l_linenumber") * 1000 + F.col("k")).alias("pos"), F.concat(F.lit("p:"), F.col("k").cast("string")).alias("key"), F.col("v").cast("string").alias("value"))


PAIRS = "pairs AS (SELECT l_orderkey AS call, l_linenumber*1000 + l_partkey % 500 AS pos, 'p:' || (l_partkey % 500) AS key, CAST(max(l_suppkey) AS VARCHAR) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey % 500)"


@query(f"WITH {PAIRS} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY call DESC, pos DESC) AS rn FROM pairs) WHERE rn = 1")
def kv_mset_dup_last(spark, d):
    return strings.multi_set(_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT call, CAST(CASE WHEN bool_or(x.key IS NOT NULL) THEN 0 ELSE 1 END AS BIGINT) AS reply FROM pairs p LEFT JOIN (SELECT 'p:' || p_partkey AS key FROM part WHERE p_partkey < 100) x USING (key) GROUP BY call")
def kv_msetnx_gate(spark, d):
    have = fx.read(spark, d, "part").filter("p_partkey < 100").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"))
    return strings.multi_set_if_none(_pairs(spark, d), have)


@query(f"WITH {fx.KVLOG} SELECT seq, key, CAST(sum(CAST(value AS BIGINT)) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS reply FROM kvlog WHERE cmd='INCRBY'")
def kv_incr(spark, d):
    return strings.counters(fx.kvlog(spark, d).filter("cmd in ('INCRBY', 'DEL')"))


@query("SELECT p_partkey, try_cast(CASE WHEN regexp_matches(t, '^(0|-?[1-9][0-9]*)$') THEN t END AS BIGINT) AS parsed FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '00' || p_partkey WHEN 1 THEN '-' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR) WHEN 3 THEN ' ' || p_partkey WHEN 4 THEN '922337203685477580' || (p_partkey % 10) ELSE p_name END AS t FROM part)")
def kv_incr_strict(spark, d):
    k = F.col("p_partkey")
    s = k.cast("string")
    t = F.when(k % 6 == 0, F.concat(F.lit("00"), s)).when(k % 6 == 1, F.concat(F.lit("-"), s)).when(k % 6 == 2, s).when(k % 6 == 3, F.concat(F.lit(" "), s)).when(k % 6 == 4, F.concat(F.lit("922337203685477580"), (k % 10).cast("string"))).otherwise(F.col("p_name"))
    return fx.read(spark, d, "part").select("p_partkey", X.strict_int(t).alias("parsed"))


@query("SELECT n_nationkey, CASE WHEN 9223372036854775800 + CAST(n_nationkey AS HUGEINT) <= 9223372036854775807 THEN CAST(9223372036854775800 + CAST(n_nationkey AS HUGEINT) AS BIGINT) END AS reply FROM nation")
def kv_incr_overflow(spark, d):
    return fx.read(spark, d, "nation").select("n_nationkey", X.checked_add(F.lit(9223372036854775800), F.col("n_nationkey").cast("bigint")).alias("reply"))


@query(f"WITH {fx.KVLOG} SELECT key, string_agg(value, '' ORDER BY seq) AS value, CAST(sum(octet_length(encode(value))) AS BIGINT) AS length FROM kvlog WHERE cmd='APPEND' GROUP BY key")
def kv_append_strlen(spark, d):
    return strings.appended(fx.kvlog(spark, d))


@query("""SELECT p_partkey, CASE WHEN hi >= lo THEN substr(v, CAST(lo+1 AS BIGINT), CAST(hi-lo+1 AS BIGINT)) ELSE '' END AS reply FROM (SELECT p_partkey, v,
  greatest(CASE WHEN s < 0 THEN n+s ELSE s END, 0) AS lo, least(CASE WHEN e < 0 THEN n+e ELSE e END, n-1) AS hi FROM (SELECT p_partkey, p_name AS v, length(p_name) AS n, p_partkey % 13 - 6 AS s, p_partkey % 17 - 8 AS e FROM part))""")
def kv_getrange(spark, d):
    v = F.col("p_name").cast("binary")
    return fx.read(spark, d, "part").select("p_partkey", X.byte_range(v, F.col("p_partkey") % 13 - 6, F.col("p_partkey") % 17 - 8).cast("string").alias("reply"))


@query("""SELECT p_partkey, replace(CASE WHEN off > n THEN v || repeat('~', CAST(off-n AS BIGINT)) || 'XYZ' ELSE substr(v, 1, CAST(off AS BIGINT)) || 'XYZ' || substr(v, CAST(off+4 AS BIGINT)) END, chr(0), '~') AS value,
  CAST(greatest(n, off+3) AS BIGINT) AS length FROM (SELECT p_partkey, p_name AS v, length(p_name) AS n, p_partkey % 40 AS off FROM part)""")
def kv_setrange(spark, d):
    v = X.overwrite(F.col("p_name").cast("binary"), F.col("p_partkey") % 40, F.lit("XYZ").cast("binary"))
    return fx.read(spark, d, "part").select("p_partkey", F.translate(v.cast("string"), "\0", "~").alias("value"), X.octets(v).alias("length"))


@query(f"WITH {fx.KV_ORDERS} SELECT r.key, CASE WHEN k.key IS NULL THEN 'none' ELSE 'string' END AS type, CASE WHEN k.key IS NULL THEN NULL WHEN regexp_matches(k.value, '^(0|-?[1-9][0-9]*)$') AND try_cast(k.value AS BIGINT) IS NOT NULL THEN 'int' WHEN strlen(k.value) > 44 THEN 'raw' ELSE 'embstr' END AS encoding, CASE WHEN k.key IS NOT NULL THEN CAST(CASE WHEN CAST(k.value AS BIGINT) BETWEEN 0 AND 9999 THEN 2147483647 ELSE 1 END AS BIGINT) END AS refcount FROM (SELECT 'order:' || (o_orderkey*2) AS key FROM orders) r LEFT JOIN kv_orders k USING (key)")
def kv_type_encoding(spark, d):
    r = fx.read(spark, d, "orders").select(F.concat(F.lit("order:"), (F.col("o_orderkey") * 2).cast("string")).alias("key"))
    x = r.join(fx.kv_orders(spark, d).select("key", "value"), "key", "left")
    there = F.col("value").isNotNull()
    return x.select("key", F.when(there, "string").otherwise("none").alias("type"), F.when(there, X.encoding("value")).alias("encoding"), F.when(there, X.refcount("value")).alias("refcount"))


@query(f"""WITH {fx.KV_ORDERS} SELECT key, cond, CAST(ok AS BIGINT) AS reply, CASE WHEN ok THEN new_at ELSE expire_at_ms END AS expire_at_ms, ok AND new_at <= {NOW} AS deleted FROM (SELECT *, CASE cond WHEN 'NX' THEN expire_at_ms IS NULL WHEN 'XX' THEN expire_at_ms IS NOT NULL
  WHEN 'GT' THEN new_at > coalesce(expire_at_ms, 9223372036854775807) WHEN 'LT' THEN new_at < coalesce(expire_at_ms, 9223372036854775807) ELSE true END AS ok FROM (SELECT key, expire_at_ms, at_ms + {20 * fx.DAY} AS new_at FROM kv_orders), (SELECT unnest(['-','NX','XX','GT','LT']) AS cond))""")
def kv_expire_cond(spark, d):
    k = fx.kv_orders(spark, d)
    req = k.select("key", (F.col("at_ms") + 20 * fx.DAY).alias("new_at"), F.explode(F.array(*map(F.lit, ("-", "NX", "XX", "GT", "LT")))).alias("cond"))
    return expiry.expire(k, req, NOW)


@query(f"""WITH {fx.KV_ORDERS} SELECT r.key, {', '.join(f"CAST(CASE WHEN k.key IS NULL OR expire_at_ms <= {NOW} THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE {x} END AS BIGINT) AS {n}" for n, x in (('ttl', f'(expire_at_ms - {NOW} + 500)//1000'), ('pttl', f'expire_at_ms - {NOW}'), ('expiretime', 'expire_at_ms//1000'), ('pexpiretime', 'expire_at_ms')))}
  FROM (SELECT 'order:' || (o_orderkey+o_orderkey%3) AS key FROM orders) r LEFT JOIN kv_orders k USING (key)""")
def kv_ttl(spark, d):
    req = fx.read(spark, d, "orders").select(F.concat(F.lit("order:"), (F.col("o_orderkey") + F.col("o_orderkey") % 3).cast("string")).alias("key"))
    return expiry.times(req, fx.kv_orders(spark, d), NOW)


@query(f"WITH {fx.KV_ORDERS} SELECT key, CAST(expire_at_ms IS NOT NULL AS BIGINT) AS reply FROM kv_orders WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW}")
def kv_persist(spark, d):
    return expiry.persist(strings.live(fx.kv_orders(spark, d), NOW))


@query(f"WITH {fx.KVLOG} SELECT seq, key, CASE WHEN b IS NULL THEN 'none' WHEN b <= at_ms THEN 'expired' ELSE 'live' END AS before FROM (SELECT *, lag(at_ms + ttl_ms) OVER (PARTITION BY key ORDER BY seq) AS b FROM kvlog WHERE cmd='PSETEX')")
def kv_setex_expired(spark, d):
    return expiry.previous_alive(fx.kvlog(spark, d).filter("cmd = 'PSETEX'"))


@query(f"WITH {fx.KV_ORDERS} SELECT key, value, CAST({NOW + fx.DAY} AS BIGINT) AS expire_at_ms FROM kv_orders WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW}")
def kv_getex(spark, d):
    return expiry.get_and_extend(strings.live(fx.kv_orders(spark, d), NOW), "PXAT", NOW + fx.DAY)


def _moves(spark, d):
    k = F.col("c_custkey")
    key = lambda x: F.concat(F.lit("cust:{"), (x % 50).cast("string"), F.lit("}:"), x.cast("string"))
    return fx.read(spark, d, "customer").filter(k % 4 == 0).select(key(k).alias("src"), key(k + 1_000_000 * (k % 8 == 0).cast("int") + (k % 8 != 0).cast("int")).alias("dst"), (k % 16).cast("int").alias("to_db"))


MOVES = "moves AS (SELECT 'cust:{' || (c_custkey % 50) || '}:' || c_custkey AS src, 'cust:{' || (d % 50) || '}:' || d AS dst, CAST(c_custkey % 16 AS INTEGER) AS to_db FROM (SELECT c_custkey, c_custkey + CASE WHEN c_custkey % 8 = 0 THEN 1000000 ELSE 1 END AS d FROM customer WHERE c_custkey % 4 = 0))"


@query(f"WITH {fx.KV_CUSTOMER}, {MOVES} SELECT key, value, db FROM kv_customer WHERE key NOT IN (SELECT src FROM moves) AND key NOT IN (SELECT dst FROM moves) UNION ALL SELECT dst, value, db FROM kv_customer JOIN moves ON key = src")
def kv_rename(spark, d):
    return keys.rename(fx.kv_customer(spark, d), _moves(spark, d).select("src", "dst"))


@query(f"WITH {fx.KV_CUSTOMER}, {MOVES} SELECT src, dst, CAST(CASE WHEN dst IN (SELECT key FROM kv_customer) THEN 0 ELSE 1 END AS BIGINT) AS reply FROM moves")
def kv_renamenx(spark, d):
    return keys.rename_if_free(fx.kv_customer(spark, d), _moves(spark, d))


@query(f"WITH {fx.KV_CUSTOMER}, {MOVES}, n AS (SELECT to_db AS db, dst AS key, value FROM kv_customer JOIN moves ON key = src) SELECT db, key, value FROM kv_customer UNION ALL SELECT db, key, value FROM n WHERE NOT EXISTS (SELECT 1 FROM kv_customer k WHERE k.db = n.db AND k.key = n.key)")
def kv_copy_db(spark, d):
    return keys.copy(fx.kv_customer(spark, d), _moves(spark, d))


@query(f"WITH {fx.KV_CUSTOMER}, {MOVES}, n AS (SELECT to_db AS db, dst AS key, value FROM kv_customer JOIN moves ON key = src) SELECT db, key, value FROM kv_customer k WHERE NOT EXISTS (SELECT 1 FROM n WHERE k.db = n.db AND k.key = n.key) UNION ALL SELECT db, key, value FROM n")
def kv_copy_replace(spark, d):
    return keys.copy(fx.kv_customer(spark, d), _moves(spark, d), replace=True)


@query(f"WITH {fx.KVLOG}, s AS (SELECT *, last_value(CASE WHEN cmd='SET' THEN seq % 16 END IGNORE NULLS) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sel FROM kvlog) SELECT CAST(coalesce(sel, 0) AS INTEGER) AS db, count(*) AS commands, count(DISTINCT key) AS keys FROM s GROUP BY 1")
def kv_select_isolation(spark, d):
    w = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sel = F.last(F.when(F.col("cmd") == "SET", F.col("seq") % 16), ignorenulls=True).over(w)
    return fx.kvlog(spark, d).withColumn("db", F.coalesce(sel, F.lit(0)).cast("int")).groupBy("db").agg(F.count("*").alias("commands"), F.countDistinct("key").alias("keys"))


@query(f"{LAST}, f AS (SELECT user_id % 4 AS db, max(seq) AS at FROM kvlog WHERE cmd='DEL' AND seq % 97 = 0 GROUP BY 1) SELECT key, value FROM lastw l LEFT JOIN f ON l.user_id % 4 = f.db WHERE f.at IS NULL OR l.seq > f.at")
def kv_flushdb(spark, d):
    log = fx.kvlog(spark, d)
    flush = log.filter("cmd = 'DEL' and seq % 97 = 0").groupBy((F.col("user_id") % 4).alias("db")).agg(F.max("seq").alias("at"))
    last = strings.last_write(log.filter(PROFILE)).withColumn("db", F.regexp_extract("key", "[0-9]+", 0).cast("bigint") % 4)
    return last.join(F.broadcast(flush), "db", "left").filter("at is null or seq > at").select("key", "value")  # at most one row per database


@query(f"{LAST}, f AS (SELECT max(seq) AS due FROM kvlog WHERE cmd='DEL' AND seq % 997 = 0) SELECT key, value FROM lastw WHERE seq > coalesce((SELECT due FROM f), -1)")
def kv_flushall(spark, d):
    log = fx.kvlog(spark, d)
    at = log.filter("cmd = 'DEL' and seq % 997 = 0").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("at")).scalar()
    return strings.last_write(log.filter(PROFILE)).filter(F.col("seq") > at).select("key", "value")


@query(f"WITH {fx.KV_CUSTOMER} SELECT db, count(*) AS keys FROM kv_customer GROUP BY ROLLUP (db)")
def kv_dbsize(spark, d):
    return fx.kv_customer(spark, d).rollup("db").agg(F.count("*").alias("keys"))


@query(f"WITH {fx.KV_ORDERS} SELECT CAST(strlen(key) % 16 AS INTEGER) AS db, count(*) AS keys, count(expire_at_ms) AS expires, CAST(0 AS BIGINT) AS avg_ttl FROM kv_orders WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW} GROUP BY 1")
def kv_info_keyspace(spark, d):
    return strings.live(fx.kv_orders(spark, d), NOW).groupBy((F.octet_length("key") % 16).cast("int").alias("db")).agg(F.count("*").alias("keys"), F.count("expire_at_ms").alias("expires"), F.lit(0).cast("bigint").alias("avg_ttl"))


@query(f"WITH {fx.KV_PART} SELECT key FROM kv_part WHERE regexp_matches(key, '^part:Brand#[1-3][^5]:.*7$')")
def kv_keys_glob(spark, d):
    return keys.matching(fx.kv_part(spark, d).select("key"), "part:Brand#[1-3][^5]:*7")


@query(f"WITH {fx.KV_CUSTOMER} SELECT count(DISTINCT split_part(split_part(key, '{{', 2), '}}', 1)) AS tags, count(*) AS keys FROM kv_customer")
def kv_cell_balance(spark, d):
    s = keys.slots(fx.kv_customer(spark, d), 8)
    return s.agg(F.countDistinct("slot").alias("tags"), F.count("*").alias("keys"))


@query(f"WITH {fx.KV_CUSTOMER} SELECT key FROM kv_customer")
def kv_scan_full(spark, d):
    return keys.scan_all(fx.kv_customer(spark, d))


@query(f"WITH {fx.KV_ORDERS} SELECT key FROM kv_orders ORDER BY md5(key || '#42'), key LIMIT 1")
def kv_randomkey(spark, d):
    return keys.random_key(fx.kv_orders(spark, d), 42)


@query(f"WITH {fx.KV_ORDERS} SELECT CAST(sum(8 + CASE WHEN expire_at_ms IS NULL THEN 0 ELSE 5 END + strlen(key) + strlen(value)) AS BIGINT) AS used_memory, count(*) AS keys, count(expire_at_ms) AS expires FROM kv_orders")
def kv_used_memory(spark, d):
    return keys.used_memory(fx.kv_orders(spark, d))


@query(f"WITH {fx.KV_ORDERS}, {fx.REQUESTS} SELECT count(k.key) AS hits, count(*) - count(k.key) AS misses FROM requests r LEFT JOIN (SELECT key FROM kv_orders WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW}) k USING (key)")
def kv_hit_stats(spark, d):
    x = fx.requests(spark, d).join(strings.live(fx.kv_orders(spark, d), NOW).select("key", F.lit(1).alias("hit")), "key", "left")
    return x.agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def _evict_keys(spark, d):
    o = fx.read(spark, d, "orders")
    li = fx.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.count("*").alias("freq"))
    x = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    at = fx.millis("o_orderdate")
    days = fx._case({k: F.lit(v * fx.DAY).cast("bigint") for k, v in fx.DAYS.items()}, "o_orderpriority")
    return x.select((F.col("o_custkey") % 8).cast("int").alias("cell"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), F.round("o_totalprice").cast("bigint").alias("bytes"), (at + days).alias("expire_at_ms"), F.coalesce(fx.millis("last"), F.lit(0)).alias("last_seq"), F.coalesce("freq", F.lit(0)).alias("freq"))


EVICT = f"""WITH k AS (SELECT CAST(o_custkey %% 8 AS INTEGER) AS cell, 'order:' || o_orderkey AS key, CAST(round(o_totalprice) AS BIGINT) AS bytes, epoch_us(o_orderdate)//1000 + CASE o_orderpriority {fx._days} END AS expire_at_ms,
  coalesce(epoch_us(last)//1000, 0) AS last_seq, coalesce(freq, 0) AS freq FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last, count(*) AS freq FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
u AS (SELECT *, sum(bytes) OVER (PARTITION BY cell) AS used FROM k), r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY cell ORDER BY %s, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u WHERE %s) SELECT cell, key, bytes FROM r WHERE used - before > 100000000"""


def _evict(policy):
    def run(spark, d):
        return eviction.victims(_evict_keys(spark, d), policy, 100_000_000)

    run.__name__ = "kv_evict_" + policy.replace("-", "_")
    return run


for _policy in eviction.POLICIES[1:]:
    _score = {"lru": "last_seq", "lfu": "freq", "ttl": "expire_at_ms", "random": "md5(key || '#0')"}[_policy.split("-")[1]]
    query(EVICT % (_score, "expire_at_ms IS NOT NULL" if _policy.startswith("volatile") else "true"))(_evict(_policy))


@query(f"WITH {fx.KVLOG} SELECT seq, conn, cmd = 'DEL' OR coalesce(sum(CASE WHEN cmd = 'DEL' THEN 0 ELSE strlen(key) + coalesce(strlen(value), 0) + 8 END) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 20000 AS admitted FROM kvlog")
def kv_oom_gate(spark, d):
    return eviction.admission(fx.kvlog(spark, d), 20000)


MATCH = "(s.kind = 'channel' AND s.name = m.channel OR s.kind = 'pattern' AND regexp_matches(m.channel, '^chan:[0-4].*$')) AND s.from_seq < m.seq AND (s.to_seq IS NULL OR m.seq < s.to_seq)"
PS = f"WITH {fx.SUBS}, {fx.MSGS}"


@query(f"{PS} SELECT m.seq, s.conn, s.kind, s.name, m.channel, m.payload FROM msgs m JOIN subs s ON {MATCH}")
def ps_delivery(spark, d):
    return pubsub.deliveries(fx.subs(spark, d), fx.msgs(spark, d))


@query(f"{PS} SELECT m.seq, count(s.conn) AS receivers FROM msgs m LEFT JOIN subs s ON {MATCH} GROUP BY m.seq")
def ps_receivers(spark, d):
    return pubsub.receivers(fx.subs(spark, d), fx.msgs(spark, d))


@query(f"WITH {fx.SUBS} SELECT c.channel, count(DISTINCT s.conn) AS subscribers FROM (SELECT 'chan:' || range AS channel FROM range(12)) c LEFT JOIN subs s ON s.kind='channel' AND s.to_seq IS NULL AND s.name = c.channel GROUP BY 1")
def ps_numsub(spark, d):
    return pubsub.numsub(fx.subs(spark, d), spark.range(12).select(F.concat(F.lit("chan:"), F.col("id").cast("string")).alias("channel")))


@query(f"WITH {fx.SUBS} SELECT count(DISTINCT name) AS patterns FROM subs WHERE kind='pattern' AND to_seq IS NULL")
def ps_numpat(spark, d):
    return pubsub.numpat(fx.subs(spark, d))


@query(f"WITH {fx.SUBS} SELECT DISTINCT name AS channel FROM subs WHERE kind='channel' AND to_seq IS NULL AND regexp_matches(name, '^chan:[2-8]$')")
def ps_channels(spark, d):
    return pubsub.channels(fx.subs(spark, d), "chan:[2-8]")


@query(f"WITH {fx.SUBS}, ev AS (SELECT conn, from_seq AS seq, 'subscribe' AS verb, 1 AS d FROM subs UNION ALL SELECT conn, to_seq, 'unsubscribe', -1 FROM subs WHERE to_seq IS NOT NULL) SELECT conn, seq, verb, CAST(sum(d) OVER (PARTITION BY conn ORDER BY seq) AS BIGINT) AS count FROM ev")
def ps_confirm_counts(spark, d):
    return pubsub.confirmations(fx.subs(spark, d))


@query(f"WITH {fx.KVLOG}, {fx.SUBS} SELECT seq, user_id FROM kvlog l WHERE EXISTS (SELECT 1 FROM subs s WHERE s.conn = l.user_id AND s.from_seq < l.seq AND (s.to_seq IS NULL OR l.seq < s.to_seq))")
def ps_restricted(spark, d):
    return pubsub.restricted(fx.kvlog(spark, d), fx.subs(spark, d))


BACKLOG = "b AS (SELECT user_id AS conn, event_id AS seq, epoch_us(ts)//1000 AS at_ms, CAST(round(value*100) AS BIGINT) AS backlog FROM events)"


@query(f"WITH {BACKLOG}, i AS (SELECT *, sum(CASE WHEN backlog <= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY conn ORDER BY seq) AS island FROM b), s AS (SELECT *, min(at_ms) OVER (PARTITION BY conn, island) AS since FROM i WHERE backlog > 1000) SELECT conn, min(seq) AS killed_seq FROM s WHERE backlog > 20000 OR at_ms - since >= 36000000 GROUP BY conn")
def ps_output_cap(spark, d):
    b = fx.read(spark, d, "events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), fx.millis("ts").alias("at_ms"), F.round(F.col("value") * 100).cast("bigint").alias("backlog"))
    return pubsub.output_cap(b, 20000, 1000, 36_000_000)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {f}, {l}, {s})" for n, a, f, l, s in admin.registry()) + ") t(name, arity, first, last, step)")
def adm_command_table(spark, d):
    return admin.command_table(spark)


@query("SELECT l_orderkey AS seq, CAST(pos AS INTEGER) AS pos, 'k' || pos AS key FROM (SELECT DISTINCT l_orderkey FROM lineitem), (SELECT unnest([0, 2, 4]) AS pos)")
def adm_getkeys(spark, d):
    log = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq")).distinct().select("seq", F.lit("mset").alias("cmd"), F.array(*(F.lit(f"k{i}") for i in range(6))).alias("args"))
    return admin.keys_of(log, admin.command_table(spark))


_conf = "conf AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}')" for n, _, _, v in admin.CONFIG) + ") t(name, value))"


@query(f"WITH {_conf} SELECT name, value FROM conf WHERE regexp_matches(name, '^maxmemory.*$') OR name = 'timeout'")
def adm_config_get(spark, d):
    return admin.config_get(admin.config(spark), "MAXMEMORY*", "timeout")


CHANGES = [(1, "maxmemory", "100mb"), (2, "databases", "4"), (2, "timeout", "9"), (3, "Timeout", "+5"), (4, "maxmemory", "lots"), (5, "maxmemory-policy", "bogus"), (6, "maxmemory-policy", "AllKeys-LFU"),
           (7, "client-output-buffer-limit", "replica 1mb 0 5"), (8, "client-output-buffer-limit", "pubsub 1k 2k 3 normal 4 5 6"), (9, "client-output-buffer-limit", "pubsub 1 2"), (10, "nope", "1"), (11, "save", ""), (12, "tcp-keepalive", "007")]


def _changes(spark):
    return spark.createDataFrame(CHANGES, "seq int, name string, value string")


@query(f"WITH {_conf} SELECT name, CASE name WHEN 'maxmemory' THEN '104857600' WHEN 'timeout' THEN '5' WHEN 'maxmemory-policy' THEN 'allkeys-lfu' WHEN 'client-output-buffer-limit' THEN 'normal 4 5 6 slave 1048576 0 5 pubsub 1000 2000 3' WHEN 'save' THEN '' WHEN 'tcp-keepalive' THEN '7' ELSE value END AS value FROM conf")
def adm_config_set(spark, d):
    return admin.config_set(admin.config(spark), _changes(spark))


@query("SELECT CAST(range AS INTEGER) AS seq, CASE WHEN range = 2 THEN 'CONFIG_BOOT' WHEN range IN (4, 5, 9) THEN 'CONFIG_INVALID' WHEN range = 10 THEN 'CONFIG_UNKNOWN' END AS error FROM range(1, 13)")
def adm_config_replies(spark, d):
    return admin.config_replies(admin.config(spark), _changes(spark))


@query(f"WITH {fx.KVLOG} SELECT conn, count(*) AS commands, min(at_ms) AS created_ms, max(at_ms) AS last_ms, arg_max(cmd, seq) AS last_cmd FROM kvlog GROUP BY conn")
def adm_client_list(spark, d):
    return admin.clients(fx.kvlog(spark, d))


NS = """e AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'DROP' ELSE 'CREATE' END AS op, CASE WHEN c_custkey % 7 = 0 THEN 'bad name' WHEN c_custkey % 11 = 0 THEN 'db03' WHEN c_custkey % 13 = 0 THEN 'DB3' WHEN c_custkey % 17 = 0 THEN 'db16' ELSE 'ns.' || (c_custkey * 7 % 40) END AS name, c_custkey * 10 AS maxmemory FROM customer)"""


def _ns_events(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, "bad name").when(k % 11 == 0, "db03").when(k % 13 == 0, "DB3").when(k % 17 == 0, "db16").otherwise(F.concat(F.lit("ns."), (k * 7 % 40).cast("string")))
    return fx.read(spark, d, "customer").select(k.alias("seq"), F.when(k % 3 == 0, "DROP").otherwise("CREATE").alias("op"), name.alias("name"), (k * 10).alias("maxmemory"))


@query(f"WITH {NS} SELECT name, maxmemory FROM e a WHERE op = 'CREATE' AND name NOT IN ('bad name', 'db03') AND NOT EXISTS (SELECT 1 FROM e b WHERE b.name = a.name AND b.op = 'DROP' AND b.seq > a.seq) AND coalesce((SELECT arg_max(b.op, b.seq) FROM e b WHERE b.name = a.name AND b.seq < a.seq), 'DROP') = 'DROP'")
def adm_namespace(spark, d):
    return admin.namespaces(_ns_events(spark, d))


@query(f"WITH {NS}, p AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY name ORDER BY seq), 'DROP') AS prev FROM e) SELECT seq, name, CASE WHEN name = 'bad name' AND op = 'CREATE' THEN 'INVALID_NAME' WHEN name = 'db03' THEN 'RESERVED' WHEN op = 'CREATE' AND prev = 'CREATE' THEN 'EXISTS' WHEN op = 'DROP' AND prev = 'DROP' THEN 'UNKNOWN' END AS error FROM p")
def adm_namespace_replies(spark, d):
    return admin.namespace_replies(_ns_events(spark, d))


@query("SELECT user_id, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, max(value) AS worst FROM events GROUP BY user_id")
def st_latency_pct(spark, d):
    return fx.read(spark, d, "events").groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.99)).alias("p99"), F.max("value").alias("worst"))
