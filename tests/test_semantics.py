import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions import exprs as X
from keystrata.operators import admin, eviction, fold
from keystrata.operators.engine import Keyspace

LOG = "seq long, at_ms long, db int, cmd string, args array<binary>"


def run(*steps):
    ks = Keyspace()
    return [ks.run(c, [a.encode() if isinstance(a, str) else a for a in args], at) for at, c, *args in steps]


def test_strict_integers_and_overflow():
    assert run((0, "SET", "k", "007"), (0, "INCR", "k"))[1] == ("error", "NOT_INT")
    assert run((0, "SET", "k", str(2**63 - 1)), (0, "INCR", "k"), (0, "GET", "k"))[1:] == [("error", "OVERFLOW"), ("bulk", str(2**63 - 1).encode())]
    assert run((0, "DECRBY", "k", str(-(2**63))))[0] == ("error", "OVERFLOW")
    assert run((0, "INCRBYFLOAT", "k", "10.5"), (0, "INCRBYFLOAT", "k", "0.1"), (0, "INCRBYFLOAT", "k", "5.0e3"))[-1] == ("bulk", b"5010.6")


def test_set_options():
    assert run((0, "SET", "k", "a", "NX"), (0, "SET", "k", "b", "NX", "GET"), (0, "SET", "k", "c", "NX", "XX"))[1:] == [("bulk", b"a"), ("error", "SYNTAX")]
    assert run((0, "SET", "k", "a", "PX", "10"), (5, "SET", "k", "b", "KEEPTTL"), (9, "PTTL", "k"), (10, "GET", "k"))[2:] == [("int", 1), ("null", None)]
    assert run((0, "SET", "k", "a", "EX", "0"))[0] == ("error", "INVALID_EXPIRE")
    assert run((5, "SET", "k", "a", "PXAT", "1"), (5, "EXISTS", "k"))[1] == ("int", 0)


def test_expire_conditions():
    t = run((0, "SET", "k", "v"), (0, "EXPIRE", "k", "10", "GT"), (0, "EXPIRE", "k", "10", "LT"), (0, "EXPIRE", "k", "5", "NX"), (0, "EXPIRE", "k", "20", "GT"), (0, "TTL", "k"), (0, "PERSIST", "k"), (0, "TTL", "k"), (0, "EXPIRE", "k", "1", "NX", "GT"), (0, "EXPIRE", "k", "-1"), (0, "TTL", "k"))
    assert [x[1] for x in t[1:]] == [0, 1, 0, 1, 20, 1, -1, "NX_CONFLICT", 1, -2]


def test_ranges_moves_and_encodings():
    assert run((0, "SETRANGE", "k", "3", "ab"), (0, "GET", "k"), (0, "GETRANGE", "k", "-2", "-1"), (0, "OBJECT", "ENCODING", "k"))[1:] == [("bulk", b"\0\0\0ab"), ("bulk", b"ab"), ("bulk", b"raw")]
    assert run((0, "MSETNX", "a", "1", "a", "2"), (0, "GET", "a"), (0, "RENAME", "x", "y"), (0, "COPY", "a", "a"), (0, "COPY", "a", "b"), (0, "RENAMENX", "a", "b"))[1:] == [("bulk", b"2"), ("error", "NO_SUCH_KEY"), ("error", "SAME_OBJECT"), ("int", 1), ("int", 0)]
    assert run((0, "NOPE"), (0, "GET"))[:] == [("error", "UNKNOWN_COMMAND"), ("error", "ARITY")]


def test_orders_of_checks():
    far = str(2**63 - 1)
    assert run((0, "SET", "k", "v"), (0, "EXPIRE", "k", far, "XX"), (0, "EXPIRE", "k", far), (0, "EXPIRE", "nope", far, "XX"), (0, "EXPIRE", "k", "1", "ZZ"), (0, "EXPIRE", "k", "1", "GT", "LT"))[1:] == [("int", 0), ("error", "INVALID_EXPIRE"), ("int", 0), ("error", "UNSUPPORTED_OPTION"), ("error", "GT_LT_CONFLICT")]
    assert run((0, "SET", "k", "v"), (0, "FLUSHDB", "NOPE"), (0, "EXISTS", "k"), (0, "FLUSHALL", "async"), (0, "EXISTS", "k"))[1:] == [("error", "SYNTAX"), ("int", 1), ("simple", "OK"), ("int", 0)]
    assert run((0, "PING"), (0, "PING", "x"), (0, "PING", "x", "y"), (0, "ECHO", "hi"), (0, "OBJECT", "IDLETIME", "k"), (0, "OBJECT", "NOPE", "k"), (0, "ECHO")) == [("simple", "PONG"), ("bulk", b"x"), ("error", "ARITY"), ("bulk", b"hi"), ("null", None), ("error", "SUBCOMMAND"), ("error", "ARITY")]


def test_many_patterns(spark):
    from keystrata.operators import pubsub

    r = random.Random(6)
    chans = sorted({"".join(r.choice("ab[-") for _ in range(r.randrange(5))) for _ in range(40)})
    pats = sorted({"".join(r.choice("ab*?[]\\") for _ in range(r.randrange(6))) for _ in range(60)})
    got = pubsub.matched(spark.createDataFrame([(c,) for c in chans], "channel string"), spark.createDataFrame([(p,) for p in pats], "name string")).collect()
    assert sorted((x.channel, x.name) for x in got) == sorted((c, p) for c in chans for p in pats if glob(p, c))


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_one_sequential_run(spark, seed):
    r, log = random.Random(seed), []
    for seq in range(400):
        k = lambda: f"k{r.randrange(12)}".encode()
        cmd, args = r.choice([("SET", [k(), b"%d" % r.randrange(9)]), ("SET", [k(), b"x", b"PX", b"%d" % r.randrange(1, 200)]), ("INCR", [k()]), ("APPEND", [k(), b"+"]), ("DEL", [k(), k()]), ("GET", [k()]), ("RENAME", [k(), k()]), ("PEXPIRE", [k(), b"%d" % r.randrange(-5, 99)]), ("MGET", [k(), k()]), ("GETDEL", [k()]), ("PING", []), ("zap", [k()]), ("DEBUG", [b"OBJECT", k()])] + ([("FLUSHDB", [])] if r.random() < 0.02 else []))
        log.append((seq, seq * 7, 0, cmd, [bytearray(a) for a in args]))
    ks, want = Keyspace(), []
    for seq, at, db, cmd, args in log:
        kind, v = ks.run(cmd, [bytes(a) for a in args], at, db)
        if cmd != "FLUSHDB":
            for pos, one in enumerate(v if kind == "array" else [v]):
                want.append((seq, pos, one if not isinstance(one, bytes) else one.decode()))
    got = []
    for x in fold.replies(spark.createDataFrame(log, LOG)).collect():
        v = x.int_val if x.kind == "int" else bytes(x.bulk_val).decode() if x.kind == "bulk" else x.error
        got.append((x.seq, x.pos, v))
    assert sorted(got, key=str) == sorted(want, key=str)


def glob(p, t):
    """Recursive matcher, written from the description of the syntax."""
    if not p:
        return not t
    if p[0] == "*":
        return any(glob(p[1:], t[i:]) for i in range(len(t) + 1))
    if p[0] == "[":
        i, neg, hit = 1, False, False
        if i < len(p) and p[i] == "^":
            neg, i = True, 2
        while i < len(p) and p[i] != "]":
            if p[i] == "\\" and i + 1 < len(p):
                hit |= bool(t) and p[i + 1] == t[0]
                i += 2
            elif i + 2 < len(p) and p[i + 1] == "-":
                a, b = sorted((p[i], p[i + 2]))
                hit |= bool(t) and a <= t[0] <= b
                i += 3
            else:
                hit |= bool(t) and p[i] == t[0]
                i += 1
        return bool(t) and hit != neg and glob(p[i + 1:], t[1:])
    if p[0] == "\\" and len(p) > 1:
        return bool(t) and t[0] == p[1] and glob(p[2:], t[1:])
    return bool(t) and (p[0] == "?" or p[0] == t[0]) and glob(p[1:], t[1:])


def test_globs(spark):
    r = random.Random(3)
    texts = sorted({"".join(r.choice("abc]-") for _ in range(r.randrange(6))) for _ in range(60)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = sorted({"".join(r.choice("ab*?[]^-\\c") for _ in range(r.randrange(8))) for _ in range(120)})
    row = df.agg(*(F.collect_list(F.when(F.col("t").rlike(X.glob_regex(p)), F.col("t"))).alias(f"p{i}") for i, p in enumerate(patterns))).first()
    for i, p in enumerate(patterns):
        assert sorted(row[f"p{i}"]) == [t for t in texts if glob(p, t)], p


def test_slots_and_sizes(spark):
    rows = [("foo", 12182), ("bar", 5061), ("hello", 866), ("123456789", 12739), ("", 0), ("{foo}x", 12182)]
    df = spark.createDataFrame(rows, "k string, want int").withColumn("got", X.slot("k"))
    assert df.filter("got <> want").count() == 0
    sizes = spark.createDataFrame([("1k",), ("1kb",), ("2MB",), ("7",), ("x",), ("1tb",)], "t string").select(X.memory_bytes(F.col("t")).alias("n"))
    assert [x.n for x in sizes.collect()] == [1000, 1024, 2097152, 7, None, None]


def test_eviction_keeps_the_limit_and_persistent_keys(spark):
    r = random.Random(5)
    rows = [(i % 3, f"k{i}", r.randrange(1, 100), i * 10 if i % 2 else None, r.randrange(1000), r.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "cell int, key string, bytes long, expire_at_ms long, last_seq long, freq long")
    for p in eviction.POLICIES:
        gone = {x.key for x in eviction.victims(df, p, 3000).collect()}
        if p == "noeviction":
            assert not gone
            continue
        for c in range(3):
            left = sum(b for cell, k, b, *_ in rows if cell == c and k not in gone)
            assert left <= 3000
        if p.startswith("volatile"):
            assert all(int(k[1:]) % 2 for k in gone)


def test_gates(spark):
    log = spark.createDataFrame([(1, "get", [b"a"]), (2, "get", []), (3, "zap", []), (4, "MSET", [b"a", b"1", b"b", b"2"])], "seq long, cmd string, args array<binary>")
    t = admin.command_table(spark)
    assert {x.seq: x.error for x in admin.accepted(log, t).collect()} == {1: None, 2: "ARITY", 3: "UNKNOWN_COMMAND", 4: None}
    assert sorted((x.seq, bytes(x.key)) for x in admin.keys_of(log, t).collect()) == [(1, b"a"), (4, b"a"), (4, b"b")]


def test_frames_do_not_depend_on_chunks():
    from keystrata.sources.wire import Reader

    data = b"*2\r\n$3\r\nGET\r\n$4\r\na\r\nb\r\n\r\n  ping  x\r\n*0\r\n*1\r\n$0\r\n\r\n"
    want = Reader().feed(data)
    assert want == [[b"GET", b"a\r\nb"], [b"ping", b"x"], [b""]]
    r = random.Random(1)
    for _ in range(50):
        reader, got, at = Reader(), [], 0
        while at < len(data):
            n = r.randrange(1, 7)
            got += reader.feed(data[at:at + n])
            at += n
        assert got == want
    bad = Reader()
    assert bad.feed(b"*1\r\n+x\r\n") == [] and bad.error == "EXPECTED_BULK" and bad.feed(b"PING\r\n") == []


def test_load_is_seeded_and_zipf_keeps_every_draw(spark):
    from keystrata.sources import load

    a, b = (sorted(map(tuple, load.mix(spark, 500, keys=50, seed=9, ttl_ms=(10, 20)).collect()), key=str) for _ in range(2))
    assert a == b and all((c == "SET") == (px is not None) and (px is None or 10 <= px < 20) for _, c, _, _, px in a)
    for n in (1, 7, 5000):
        z = load.zipf(spark, n, 2000, seed=3)
        assert z.count() == 2000 and z.select("seq").distinct().count() == 2000 and z.filter(f"rank < 1 or rank > {n}").count() == 0
    assert load.zipf(spark, 0, 10).count() == 0
    assert load.key_of(F.lit(7)) is not None and spark.range(1).select(load.key_of(F.lit(10**14))).first()[0] == "key:100000000000000"


def test_info_sections():
    from keystrata.operators.introspect import SECTIONS, wanted

    assert wanted() == list(SECTIONS) == wanted("nope") == wanted("cpu", "ALL")
    assert wanted("all", "Stats", "stats") == ["stats"]


def test_debug_and_lolwut():
    far = "9" * 400
    assert run((0, "SET", "k", "abc"), (0, "DEBUG", "OBJECT", "k"), (0, "DEBUG", "OBJECT", "x"), (0, "DEBUG", "SLEEP", "-1"), (0, "DEBUG", "SLEEP", far), (0, "DEBUG", "JMAP"), (0, "DEBUG", "NOPE"))[1:] == [
        ("simple", "Value at:0x0 refcount:1 encoding:embstr serializedlength:3 lru:0 lru_seconds_idle:0"), ("error", "NO_SUCH_KEY"), ("error", "NOT_FLOAT"), ("error", "NOT_FLOAT"), ("simple", "OK"), ("error", "SUBCOMMAND")]
    assert run((0, "LOLWUT"))[0][0] == "bulk"


def test_sketch_never_underestimates(spark):
    from keystrata.operators import session

    scores = spark.createDataFrame([(f"k{i}", float(i % 7)) for i in range(3000)], "key string, score double")
    x = scores.join(session.estimates(scores.select("key"), session.frequency_sketch(scores)), "key")
    assert x.count() == 3000 and x.filter("estimate < score").count() == 0
