"""Generated load, session, introspection, deadlines that pass, and the closing of subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admin, eviction, expiry, fold, introspect, keys, pubsub, session
from ..sources import fixtures as fx
from ..sources import load, wire
from ..streaming import live
from .catalog import NOW, query

SEED = 0xC0FFEE
YEAR = 31_536_000_000


def _draw(stream, row="range"):
    return f"CAST('0x' || substr(md5({row} || '#{stream}#{SEED}'), 1, 15) AS BIGINT)"


@query(f"SELECT seq, cmd, 'key:' || lpad(CAST(k AS VARCHAR), 12, '0') AS key, CAST(CASE cmd WHEN 'SET' THEN 64 END AS INTEGER) AS value_size, CASE cmd WHEN 'SET' THEN 1000 + t % 59000 END AS px FROM (SELECT range AS seq, CASE WHEN {_draw('op')} % 11 < 1 THEN 'SET' ELSE 'GET' END AS cmd, {_draw('key')} % 1000000 AS k, {_draw('ttl')} AS t FROM range(200000))")
def src_load_mix(spark, d):
    return load.mix(spark, 200_000, ttl_ms=(1000, 60_000))


@query(f"SELECT 'key:' || lpad(CAST(range AS VARCHAR), 12, '0') AS key, CAST(64 AS INTEGER) AS value_size, CAST({NOW} AS BIGINT) AS expire_at_ms FROM range(100000)")
def src_load_fill(spark, d):
    return load.fill(spark, 100_000, pxat=NOW)


def _zipf(n, draws):
    return f"""w AS (SELECT range AS rank, greatest(CAST(round(pow(range, -0.99) * 4294967296) AS BIGINT), 1) AS w FROM range(1, {n + 1})), c AS (SELECT rank, CAST(sum(w) OVER (ORDER BY rank) AS BIGINT) - 1 AS last FROM w),
u AS (SELECT range AS seq, {_draw('zipf')} % (SELECT CAST(sum(w) AS BIGINT) FROM w) AS u FROM range({draws})), z AS (SELECT seq, rank FROM u ASOF JOIN c ON u.u <= c.last)"""


@query(f"WITH {_zipf(2000, 100000)} SELECT rank, count(*) AS draws FROM z GROUP BY rank")
def src_zipf(spark, d):
    return load.zipf(spark, 2000, 100_000).groupBy("rank").agg(F.count("*").alias("draws"))


SLOTS = 8 * 2**20 // (8 + 16 + 64)  # records of a 16-byte key and a 64-byte value in 8 MiB


@query(f"WITH {_zipf(200000, 2000000)}, h AS (SELECT rank FROM (SELECT rank, count(*) AS n FROM z WHERE seq < 1000000 GROUP BY rank) ORDER BY n DESC, rank LIMIT {SLOTS}) SELECT count(*) AS accesses, count(h.rank) AS hits, count(h.rank) / count(*) AS hit_rate FROM z LEFT JOIN h USING (rank) WHERE seq >= 1000000")
def st_zipf_hitrate(spark, d):
    """The reference workload: 200,000 keys, a million reads to warm up and a million measured."""
    z = load.zipf(spark, 200_000, 2_000_000)
    return eviction.lfu_hit_rate(z.withColumnRenamed("rank", "key"), 1_000_000, SLOTS)


SCORES = f"s AS (SELECT key, sum(pow(0.5, floor(({NOW} - at_ms) / {YEAR}.0))) AS score FROM access GROUP BY key), h AS (SELECT key, score, CAST('0x' || substr(md5(key), 1, 11) AS BIGINT) AS h FROM s), c AS (SELECT key, score, r, (h >> CAST(11 * r AS INTEGER)) & 2047 AS c FROM h, range(4) t(r))"


@query(f"WITH {fx.ACCESS}, {SCORES} SELECT c.key, min(w) AS estimate FROM c JOIN (SELECT r, c, sum(score) AS w FROM c GROUP BY r, c) k USING (r, c) GROUP BY c.key")
def st_frequency_sketch(spark, d):
    scores = session.decayed_frequency(fx.access(spark, d), NOW, YEAR)
    return session.estimates(scores.select("key"), session.frequency_sketch(scores))


@query(f"WITH {fx.KV_ORDERS}, {fx.ACCESS}, s AS (SELECT key, sum(pow(0.5, floor(({NOW} - at_ms) / {YEAR}.0))) AS score FROM access GROUP BY key) SELECT r.key, CASE WHEN k.key IS NOT NULL THEN CAST(0 AS BIGINT) END AS idletime, CASE WHEN k.key IS NOT NULL THEN CAST(least(floor(coalesce(score, 0)), 255) AS BIGINT) END AS freq, CAST(NULL AS VARCHAR) AS error FROM (SELECT 'order:' || (o_orderkey * 2) AS key FROM orders) r LEFT JOIN kv_orders k USING (key) LEFT JOIN s USING (key)")
def kv_object_freq(spark, d):
    r = fx.read(spark, d, "orders").select(F.concat(F.lit("order:"), (F.col("o_orderkey") * 2).cast("string")).alias("key"))
    return introspect.object_replies(fx.kv_orders(spark, d), r, "allkeys-lfu", session.decayed_frequency(fx.access(spark, d), NOW, YEAR))


@query(f"WITH {fx.KV_ORDERS} SELECT r.key, CASE WHEN k.key IS NOT NULL THEN 'Value at:0x0 refcount:1 encoding:int serializedlength:' || strlen(k.value) || ' lru:0 lru_seconds_idle:0' END AS reply, CASE WHEN k.key IS NULL THEN 'NO_SUCH_KEY' END AS error FROM (SELECT 'order:' || (o_orderkey * 2) AS key FROM orders) r LEFT JOIN kv_orders k USING (key)")
def adm_debug_object(spark, d):
    r = fx.read(spark, d, "orders").select(F.concat(F.lit("order:"), (F.col("o_orderkey") * 2).cast("string")).alias("key"))
    return introspect.debug_object(fx.kv_orders(spark, d), r)


TAKEN = "r AS (SELECT DISTINCT 'order:' || l_orderkey * 3 AS key FROM lineitem)"


def _taken(spark, d):
    return fx.read(spark, d, "lineitem").select(F.concat(F.lit("order:"), (F.col("l_orderkey") * 3).cast("string")).alias("key")).distinct()


@query(f"WITH {fx.KV_ORDERS}, {TAKEN} SELECT r.key, k.value, CASE WHEN k.key IS NOT NULL THEN coalesce(k.expire_at_ms - {NOW}, -1) END AS pttl FROM r LEFT JOIN (SELECT * FROM kv_orders WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW}) k USING (key)")
def kv_peek(spark, d):
    return introspect.peek(fx.kv_orders(spark, d), _taken(spark, d), NOW)


@query(f"WITH {fx.KV_ORDERS}, {TAKEN} SELECT k.* FROM kv_orders k WHERE key NOT IN (SELECT key FROM r)")
def kv_take(spark, d):
    return introspect.take(fx.kv_orders(spark, d), _taken(spark, d))


@query("SELECT l_returnflag || l_linestatus AS metric, list_extract(list_sort(list(l_extendedprice)), CAST(count(*) // 2 + 1 AS BIGINT)) AS median, sum(l_linenumber) / sum(l_suppkey) AS ratio FROM lineitem GROUP BY 1")
def st_replicates(spark, d):
    return introspect.replicates(fx.read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("metric"), F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("numerator"), F.col("l_suppkey").alias("denominator")))


_const = ", ".join(f"('{s}', '{f}', '{v}')" for s, f, v in introspect.CONSTANT if s in ("clients", "stats", "replication"))
_conf = dict((n, v) for n, _, _, v in admin.CONFIG)


@query(f"""WITH {fx.KVLOG}, {fx.KV_ORDERS}, l AS (SELECT * FROM kvlog WHERE seq > coalesce((SELECT max(seq) FROM kvlog WHERE cmd = 'DEL' AND seq % 97 = 0), -1)), k AS (SELECT 'db' || strlen(key) % 16 AS db, count(*) AS n, count(expire_at_ms) AS e FROM kv_orders WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW} GROUP BY 1)
SELECT * FROM (VALUES {_const}, ('clients', 'maxclients', '{_conf["maxclients"]}'), ('memory', 'maxmemory', '{_conf["maxmemory"]}'), ('memory', 'maxmemory_policy', '{_conf["maxmemory-policy"]}')) t(section, field, value)
UNION ALL SELECT 'clients', 'total_connections_received', CAST(count(DISTINCT conn) AS VARCHAR) FROM kvlog
UNION ALL SELECT 'memory', 'used_memory', CAST(sum(8 + CASE WHEN expire_at_ms IS NULL THEN 0 ELSE 5 END + strlen(key) + strlen(value)) AS VARCHAR) FROM kv_orders
UNION ALL SELECT 'stats', 'total_commands_processed', CAST(count(*) AS VARCHAR) FROM l
UNION ALL SELECT 'stats', 'keyspace_hits', CAST(count(CASE WHEN cmd = 'INCRBY' AND seq % 3 = 0 THEN 1 END) AS VARCHAR) FROM l
UNION ALL SELECT 'stats', 'keyspace_misses', CAST(count(CASE WHEN cmd = 'INCRBY' AND seq % 3 <> 0 THEN 1 END) AS VARCHAR) FROM l
UNION ALL SELECT 'keyspace', db, 'keys=' || n || ',expires=' || e || ',avg_ttl=0' FROM k""")
def adm_info(spark, d):
    """INFO clients memory stats replication keyspace, counters since the last CONFIG RESETSTAT."""
    log = fx.kvlog(spark, d).select("seq", "conn", F.when(F.col("cmd") == "INCRBY", "GET").otherwise(F.col("cmd")).alias("cmd"), F.when(F.col("cmd") == "INCRBY", F.col("seq") % 3 == 0).alias("hit"))
    ks = fx.kv_orders(spark, d).withColumn("db", F.octet_length("key") % 16)
    return introspect.info(ks, admin.config(spark), log, NOW, "clients", "memory", "STATS", "nope", "replication", "keyspace", reset=(F.col("cmd") == "DEL") & (F.col("seq") % 97 == 0))


@query(f"WITH {fx.KVLOG}, l AS (SELECT *, min(CASE WHEN cmd = 'DEL' AND seq % 7 = 0 THEN seq END) OVER (PARTITION BY conn) AS quit FROM kvlog), s AS (SELECT *, last_value(CASE WHEN cmd = 'SET' AND seq % 4 IN (2, 3) AND seq % 5 <> 0 THEN seq % 4 END IGNORE NULLS) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l WHERE quit IS NULL OR seq <= quit) SELECT seq, CAST(coalesce(p, 2) AS BIGINT) AS proto FROM s")
def ses_hello_quit(spark, d):
    """SET as HELLO seq % 4 (with an option, thus refused, where 5 divides seq), some DEL as QUIT."""
    version = (F.col("seq") % 4).cast("string")
    args = F.when(F.col("seq") % 5 == 0, F.array(version, F.lit("AUTH"))).otherwise(F.array(version))
    cmd = F.when(F.col("cmd") == "SET", "HELLO").when((F.col("cmd") == "DEL") & (F.col("seq") % 7 == 0), "QUIT").otherwise(F.col("cmd"))
    return session.with_session(fx.kvlog(spark, d).select("seq", "conn", cmd.alias("cmd"), args.alias("args"))).select("seq", F.col("proto").cast("bigint").alias("proto"))


@query(f"WITH {fx.KVLOG}, k AS (SELECT user_id % 8 AS id, min(seq) AS at_seq FROM kvlog WHERE cmd = 'DEL' AND seq % 41 = 0 GROUP BY 1) SELECT l.seq, l.conn FROM kvlog l LEFT JOIN k ON k.id = (l.conn + 1) % 8 WHERE at_seq IS NULL OR l.seq <= at_seq")
def ses_client_kill(spark, d):
    """Some DEL as CLIENT KILL ID of the connection before the sender's."""
    log = fx.kvlog(spark, d)
    kills = log.filter("cmd = 'DEL' and seq % 41 = 0").select("seq", ((F.col("user_id") % 8 + 7) % 8).alias("id"))
    return session.until_killed(log, kills).select("seq", "conn")


@query(f"WITH {fx.KVLOG}, n AS (SELECT seq, conn, CASE WHEN cmd = 'SET' AND seq % 3 <> 0 THEN 'c' || value END AS name FROM kvlog) SELECT seq, last_value(name IGNORE NULLS) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS name FROM n")
def ses_client_name(spark, d):
    """SET as CLIENT SETNAME; a name with a blank is refused and the one before stays."""
    blank = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("c "), F.col("value"))).otherwise(F.concat(F.lit("c"), F.col("value")))
    log = fx.kvlog(spark, d).select("seq", "conn", F.when(F.col("cmd") == "SET", "client").otherwise(F.col("cmd")).alias("cmd"), F.array(F.lit("setname"), blank).alias("args"))
    return session.with_session(log).select("seq", "name")


@query("SELECT p_partkey AS seq, CASE p_partkey % 6 WHEN 1 THEN 'ARITY' WHEN 2 THEN 'UNKNOWN_COMMAND' WHEN 4 THEN 'ARITY' END AS error FROM part")
def adm_accepted(spark, d):
    forms = (("get", 1), ("get", 2), ("zap", 1), ("mset", 2), ("mget", 0), ("ping", 0))
    k = F.col("p_partkey") % 6
    cmd, n = F, F
    for i, (name, count) in enumerate(forms):
        cmd, n = cmd.when(k == i, name), n.when(k == i, count)
    args = F.array_repeat(F.lit("x"), n)
    return admin.accepted(fx.read(spark, d, "part").select(F.col("p_partkey").alias("seq"), cmd.alias("cmd"), args.alias("args")), admin.command_table(spark)).select("seq", "error")


@query("SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_partkey WHEN 1 THEN 18446744073709551615 WHEN 4 THEN 7 END AS DECIMAL(20, 0)) AS cursor FROM part")
def kv_scan_cursor(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, "18446744073709551615").when(k % 5 == 2, "18446744073709551616").when(k % 5 == 3, F.concat(F.lit("-"), k.cast("string"))).otherwise("00000000000000000007")
    return fx.read(spark, d, "part").select("p_partkey", keys.cursor(text).alias("cursor"))


TICK = 60_000


@query(f"WITH {fx.KVLOG}, x AS (SELECT key, seq, at_ms + ttl_ms AS due, lead(at_ms) OVER (PARTITION BY key ORDER BY seq) AS nxt, CAST(ceil((at_ms + ttl_ms) / {TICK}.0) AS BIGINT) * {TICK} AS tick FROM kvlog WHERE cmd = 'PSETEX'), h AS (SELECT *, CASE WHEN nxt < due THEN 'replaced' WHEN nxt < tick THEN 'lazy' ELSE 'active' END AS how FROM x) SELECT key, seq, how, CASE how WHEN 'lazy' THEN nxt WHEN 'active' THEN tick END AS gone_ms FROM h")
def kv_active_expiry(spark, d):
    log = fx.kvlog(spark, d).filter("cmd = 'PSETEX'").select("seq", "at_ms", "key", (F.col("at_ms") + F.col("ttl_ms")).alias("deadline"))
    return expiry.departures(log, TICK)


@query(f"WITH {fx.KVLOG}, w AS (SELECT key, max(seq) AS seq, arg_max(at_ms + ttl_ms, seq) AS deadline FROM kvlog WHERE cmd = 'PSETEX' GROUP BY key) SELECT * FROM w WHERE deadline <= (SELECT max(at_ms) FROM kvlog WHERE cmd = 'PSETEX')")
def stream_expiry(spark, d):
    """Keys that timers expire by the end of a stream that comes in one batch."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    key = F.concat(F.lit("{u"), F.col("user_id").cast("string"), F.lit("}:cart"))
    s = live.table_stream(spark, d, "events").filter("event_type = 'purchase'")
    w = s.select(key.alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), (fx.millis("ts") + cents * 10000).alias("deadline"))
    name, provider = live.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        return live.run_to_end(live.expiring(w), "append").drop("batch")
    finally:
        spark.conf.set(name, before)


CLOSING = "ev AS (SELECT user_id AS conn, event_id AS seq, CASE WHEN event_type IN ('signup', 'click') THEN 'sub' WHEN event_type = 'purchase' THEN 'close' ELSE 'unsub' END AS verb, CASE WHEN event_type <> 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'pattern' ELSE 'channel' END END AS kind, CASE WHEN event_type IN ('signup', 'click') OR event_type = 'view' THEN 'c' || event_id % 3 END AS name FROM events WHERE event_type IN ('signup', 'click', 'error', 'view') OR event_type = 'purchase' AND event_id % 4 = 0)"


def _closing(spark, d):
    t, n = F.col("event_type"), F.col("event_id")
    e = fx.read(spark, d, "events").filter(t.isin("signup", "click", "error", "view") | ((t == "purchase") & (n % 4 == 0)))
    verb = F.when(t.isin("signup", "click"), "sub").when(t == "purchase", "close").otherwise("unsub")
    kind = F.when(t != "purchase", F.when(n % 5 == 0, "pattern").otherwise("channel"))
    name = F.when(t.isin("signup", "click", "view"), F.concat(F.lit("c"), (n % 3).cast("string")))
    return e.select(F.col("user_id").alias("conn"), n.alias("seq"), verb.alias("verb"), kind.alias("kind"), name.alias("name"))


_iv = f"{CLOSING}, iv AS (SELECT s.conn, s.kind, s.name, s.seq AS from_seq, (SELECT min(u.seq) FROM ev u WHERE u.conn = s.conn AND u.seq > s.seq AND (u.verb = 'close' OR u.verb = 'unsub' AND u.kind = s.kind AND (u.name IS NULL OR u.name = s.name))) AS to_seq, coalesce((SELECT arg_max(u.verb, u.seq) FROM ev u WHERE u.conn = s.conn AND u.seq < s.seq AND (u.verb = 'close' OR u.kind = s.kind AND (u.name = s.name OR u.verb = 'unsub' AND u.name IS NULL))), '') = 'sub' AS again FROM ev s WHERE s.verb = 'sub'), open AS (SELECT conn, kind, name, from_seq, to_seq FROM iv WHERE NOT again)"


@query(f"WITH {_iv} SELECT * FROM open")
def ps_intervals(spark, d):
    return pubsub.intervals(_closing(spark, d))


@query(f"""WITH {_iv}, b AS (SELECT conn, seq, kind, (SELECT count(*) FROM open o WHERE o.conn = e.conn AND o.from_seq < e.seq AND (o.to_seq IS NULL OR o.to_seq >= e.seq)) AS held FROM ev e WHERE verb = 'unsub' AND name IS NULL),
f AS (SELECT b.conn, b.seq, b.kind, o.name, b.held, row_number() OVER (PARTITION BY b.conn, b.seq ORDER BY o.from_seq) AS pos FROM b LEFT JOIN open o ON o.conn = b.conn AND o.kind = b.kind AND o.to_seq = b.seq) SELECT conn, seq, CAST(pos AS INTEGER) AS pos, kind, name, CASE WHEN name IS NULL THEN held ELSE held - pos END AS count FROM f""")
def ps_unsubscribe_bare(spark, d):
    return pubsub.bare_unsubscribe(_closing(spark, d))


@query("SELECT p_partkey AS conn, CASE p_partkey % 3 WHEN 0 THEN 'EXPECTED_BULK' ELSE 'MISSING_CRLF' END AS error FROM part WHERE p_partkey % 3 < 2")
def src_protocol_error(spark, d):
    """Broken frames after a good one: the good one is read, the error ends the connection."""
    k = F.col("p_partkey") % 3
    bad = F.when(k == 0, "*1\r\n+x\r\n").when(k == 1, "*1\r\n$1\r\nabc").otherwise("PING\r\n")
    chunks = fx.read(spark, d, "part").select(F.col("p_partkey").alias("conn"), F.lit(0).alias("pos"), F.concat(F.lit("*1\r\n$4\r\nPING\r\n"), bad, F.lit("PING\r\n")).cast("binary").alias("data"))
    return wire.commands(chunks).filter("error is not null").select("conn", "error")


@query(f"WITH {fx.KVLOG}, p AS (SELECT seq, cmd, lag(cmd) OVER (PARTITION BY key ORDER BY seq) AS prev FROM kvlog WHERE cmd IN ('SET', 'DEL')) SELECT seq, 'simple' AS kind, CAST(NULL AS BIGINT) AS int_val, 'OK' AS error FROM p WHERE cmd = 'SET' UNION ALL SELECT seq, 'int', CASE WHEN prev = 'SET' THEN 1 ELSE 0 END, NULL FROM p WHERE cmd = 'DEL' UNION ALL SELECT seq, 'simple', NULL, 'PONG' FROM kvlog WHERE cmd = 'INCRBY' UNION ALL SELECT seq, 'error', NULL, 'UNKNOWN_COMMAND' FROM kvlog WHERE cmd = 'APPEND'")
def kv_fold_keyless(spark, d):
    """A log in which PING and an unknown command stand between SET and DEL: all are answered."""
    log = fx.kvlog(spark, d).filter("cmd <> 'PSETEX'")
    cmd = F.when(F.col("cmd") == "INCRBY", "ping").when(F.col("cmd") == "APPEND", "zap").otherwise(F.col("cmd"))
    args = F.when(F.col("cmd") == "SET", F.array("key", "value")).when(F.col("cmd") == "DEL", F.array("key")).otherwise(F.array().cast("array<string>"))
    done = fold.replies(log.select("seq", "at_ms", F.lit(0).alias("db"), cmd.alias("cmd"), args.cast("array<binary>").alias("args")))
    return done.select("seq", "kind", "int_val", "error")


FAR = 86_400_000  # seconds


@query(f"""WITH {fx.KVLOG}, c AS (SELECT *, CASE WHEN seq % 2 = 0 THEN NULL WHEN seq % 4 = 1 THEN (at_ms // 1000 + {FAR}) * 1000 ELSE at_ms + {FAR}000 END AS due, min(CASE WHEN seq % 2 = 0 THEN seq END) OVER (PARTITION BY key) AS born FROM kvlog WHERE cmd = 'PSETEX')
SELECT key, count(*) AS version, arg_max_null(due, seq) AS expire_at_ms FROM c WHERE seq >= born GROUP BY key""")
def kv_fold_versions(spark, d):
    """SET, EXPIREAT and PEXPIREAT through the fold: each that takes effect raises a record's version."""
    k = F.col("seq") % 4
    cmd = F.when(k % 2 == 0, "SET").when(k == 1, "EXPIREAT").otherwise("PEXPIREAT")
    arg = F.when(k % 2 == 0, F.col("value")).when(k == 1, (F.floor(F.col("at_ms") / 1000) + FAR).cast("string")).otherwise((F.col("at_ms") + FAR * 1000).cast("string"))
    log = fx.kvlog(spark, d).filter("cmd = 'PSETEX'").select("seq", "at_ms", F.lit(0).alias("db"), cmd.alias("cmd"), F.array("key", arg).cast("array<binary>").alias("args"))
    return fold.keyspace(log).select(F.col("key").cast("string").alias("key"), "version", "expire_at_ms")
