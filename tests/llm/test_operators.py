"""Each operator against brute force, a round trip or held-out accuracy, and on edge rows."""

import hashlib
import html
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from keystrata.llm import jaccard, media, packing, pieces, queries, secrets, toolcalls, topk, toxicity, urlfilter, wrappers
from oracle import connect, same

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
EDGE = [(1, None, "a"), (2, "", None), (3, "a", "a"), (4, "é\0 ▁ <|endoftext|> \t\n x", "b"), (5, "w " * 9000, "b"), (5, "w " * 9000, "b"), (None, "no id here at all", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumn("start", F.lit(1)).withColumn("score", F.lit("clash")).withColumn("n", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.mark.parametrize("name", ["op1_topk", "op2_urls"])
def test_sql(spark, name):
    same(queries.queries()[name](spark, DATA), connect(DATA), queries.oracle_sql()[name])


def test_topk_against_all_scores(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=12)], "x") for i in range(700)]
    rows += [(i, rows[3][1], "copy") for i in range(700, 760)] + [(900, None, ""), (901, [1.0, float("nan")], ""), (902, [1.0, None], ""), (903, [2.0], ""), (904, [], ""), (None, [1.0], ""), (1000, [3.0e38, -1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for x in topk.search(df, F.col("vec_id") % 100 == 0, k=10, block=64).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    ok = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    twice = {x.query_id: (x.vec_id, x.score) for x in topk.search(spark.createDataFrame([(1, [2.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (200, [1.0, 0.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=1).collect()}
    assert twice == {200: (1, 2 * 2**20)}
    both = topk.search(spark.createDataFrame([(1, [2.0, 0.0]), (1, [1.0, 0.0]), (200, [1.0, 0.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert [(x["rank"], x.vec_id, x.score) for x in sorted(both)] == [(1, 1, 2 * 2**20), (2, 1, 2**20)]
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    lim = 2**63 - 1
    for q in (i for i in ok if i % 100 == 0):
        want = sorted((-max(-lim, min(lim, sum(a * b for a, b in zip(ok[q], v)))), i) for i, v in ok.items() if i != q)[:10]
        assert [(-s, i) for s, i in want] == [(s, i) for _, i, s in sorted(got[q])], q


def test_topk_stops_on_proof():
    x = np.floor(np.random.default_rng(2).normal(size=(500, 8)) * 1024)
    for q, m in zip(x[:20], topk.ImpactIndex(x).members(x[:20], 5, 20)):
        assert set(np.argsort(-(x @ q), kind="stable")[:5]) <= set(m)
    assert topk.search.__defaults__[0] == 10


def test_urls_edge(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://NET/"), (4, "http://net"), (5, "https://a.Example.net/en/x?q#f"), (5, "https://a.Example.net/en/x?q#f"), (6, "http://xnet/"), (7, "http://m.free-bets.example.com/en/"), (8, "http://a://net/"), (9, "http://é.org/fr/"), (10, ""), (11, "http://b.example.com/de/" + "x/" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("words", F.lit(1))
    got = sorted(tuple(str(v) for v in (x.page_id, x.host, x.rule, x.verdict)) for x in urlfilter.judge(df, urlfilter.rules_frame(spark), blocks=1).collect())
    assert len(got) == len(rows)
    by = {x[0]: x[1:] for x in got}
    assert by["1"] == ("", "None", "allow") and by["3"] == ("net", "net/", "block") and by["4"] == ("net", "None", "allow")
    assert by["5"] == ("a.example.net", "example.net/en/", "allow") and by["6"][2] == "allow" and by["7"] == ("m.free-bets.example.com", "None", "block")
    assert by["9"][1] == "org/fr/" and by["11"][1] == "example.com/de/"
    assert urlfilter.judge(df, urlfilter.rules_frame(spark, (), ()), blocks=4).filter("verdict <> 'allow'").count() == 0
    assert urlfilter.judge(df.limit(0), urlfilter.rules_frame(spark)).count() == 0


def test_urls_canonical_sites(spark):
    site = "casino-win.example.org"
    rows = [(1, f"http://u:p@{site.upper()}:8080/x"), (2, f"http://www.{site}./a"), (3, "http://%63asino-win.example.org/"), (4, f"http://x{site}/"), (5, f"http://{site}%zz/"), (6, f"http://{site}.net/"), (7, f"http://{site}")]
    rows += [(None, f"http://{site}/q")] * 3
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(((x.page_id or 0, x.listed, x.verdict) for x in urlfilter.judge(df, urlfilter.rules_frame(spark)).collect()))
    assert got == sorted([(0, True, "block")] * 3 + [(1, True, "block"), (2, True, "block"), (3, True, "block"), (4, False, "allow"), (5, False, "allow"), (6, False, "block"), (7, True, "block")])
    paths = [("/a/./b/../c", "/a/c"), ("/..", "/"), ("", ""), ("/a/..", "/"), ("/%2E%2e/x", "/x"), ("/a+b%20c", "/a+b c"), ("/a//b/.", "/a//b/"), ("/.hidden", "/.hidden")]
    p = spark.createDataFrame([("h", x, y) for x, y in paths], "h string, p string, want string")
    bad = [(x.p, x.want, x.got) for x in p.withColumn("got", urlfilter.canonical(F.col("h"), F.col("p"))[1]).collect() if x.want != x.got]
    assert not bad


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_long_list(spark, broadcast, monkeypatch):
    """A list of 100,000 sites: the filter's false positives stay near RATE, verdicts are exact."""
    n = 100_000
    if not broadcast:
        monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 10)
    sites = spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string"), F.lit(".example.org")).alias("r_host"), F.lit("").alias("r_path"), F.lit("block").alias("r_verdict"), F.lit(False).alias("is_rule"))
    pages = spark.range(0, 4 * n, 2).select(F.col("id").alias("page_id"), F.concat(F.lit("http://s"), F.col("id").cast("string"), F.lit(".example.org/p")).alias("url"))
    x = urlfilter.judge(pages, sites).agg(F.count("*"), F.count_if(F.col("listed")), F.count_if(F.col("listed") != (F.col("page_id") < n))).first()
    assert tuple(x) == (2 * n, n // 2, 0)
    words = urlfilter.bloom(sites, urlfilter.blocks_for(n)).first().words
    assert len(words) == 8 * urlfilter.blocks_for(n) and urlfilter.blocks_for(10**9) == urlfilter.MAX_BLOCKS
    blocks = urlfilter.blocks_for(n)
    probe = spark.range(n, 3 * n).select(F.concat(F.lit("Cs"), F.col("id").cast("string"), F.lit(".example.org\0")).alias("k")).select(F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("b"), F.xxhash64("k", F.lit(7)).alias("h2")).collect()
    false = sum(all(words[r.b * 8 + w] >> (((r.h2 & (2**64 - 1)) >> (7 * w)) % 64) & 1 for w in range(8)) for r in probe)
    assert 0 < false <= 2 * urlfilter.RATE * len(probe)


def test_tool_calls(spark):
    call = lambda i, n, a: f'<tool_call>{json.dumps({"name": n, "id": i, "arguments": a})}</tool_call>'
    rows = [(1, 0, "user", "hi é"), (1, 1, "assistant", "ok " + call("a", "search", {"query": "x"}) + call("b", "search", {"query": "$a", "limit": 2})), (1, 2, "tool", '{"id": "a", "content": [2, 1]}'), (1, 3, "assistant", call("c", "search", {"limit": "no"}) + call("d", "search", {"query": "$e"}) + call("e", "search", {"query": "$d"})), (1, 4, "tool", '{"id": "zz"}'), (2, 0, None, None), (2, 0, None, None), (None, None, "user", "<tool_call>{broken</tool_call>")]
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))).collect()
    by = {(x.kind, x.call_id): (x.level, x.linked, x.valid) for x in got if x.kind != "message"}
    assert by == {("call", "a"): (0, True, True), ("call", "b"): (1, False, True), ("result", "a"): (1, True, True), ("call", "c"): (0, False, False), ("call", "d"): (None, False, False), ("call", "e"): (None, False, False), ("result", "zz"): (None, False, True)}
    assert sum(x.kind == "message" for x in got) == 6
    assert next(x.json for x in got if x.call_id == "b") == '{"arguments":{"limit":2,"query":"$a"},"id":"b","name":"search"}'


def test_tool_calls_on_odd_json(spark):
    t = "<tool_call>%s</tool_call>"
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    texts = [t % '{"id":"\\ud800","name":"x","arguments":{}}', t % deep, t % '{"id":"n","x":NaN}', t % '{"id":"h","x":1e999}', t % ('{"id":"l","x":' + "9" * 5000 + "}"), t % '{"name":"search","arguments":{"query":"q"}}', t % '{"id":null,"name":"u","arguments":"s"}',
             t % '{"id":7,"name":"u","arguments":3}', t % '{"id":"7","name":"u","arguments":"$7"}', "<tool_result>{\"id\":7}</tool_result><tool_result>{\"id\":7}</tool_result>"]
    rows = [(None, i, "assistant", x) for i, x in enumerate(texts)]
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"u": {"type": "wat"}, "search": toolcalls.SCHEMAS["search"]}).collect()
    by = sorted(((x.turn, x.kind, x.call_id, x.level, x.linked, x.valid) for x in got if x.kind != "message"), key=str)
    assert by == [(0, "call", "\ufffd", 0, False, False), (5, "call", None, 0, False, True), (6, "call", None, 0, False, False), (7, "call", "7", 0, True, False), (8, "call", "7", None, False, False), (9, "result", "7", 1, True, True), (9, "result", "7", None, False, True)]
    assert {x.turn for x in got if x.kind == "message" and "<tool_call>" in x.json} == {1, 2, 3, 4}
    assert toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").limit(0)).count() == 0


def link_plainly(rows, schemas):
    """Linking by dictionaries and a recursive level, for small tables."""
    items, first = [], {}
    for c, t, r, x in rows:
        for place, kind, cid, deps, ok, js in toolcalls.items_of(r or "", x or "", schemas):
            if kind != "message":
                items.append((c, t, kind, cid, deps, ok, js))
                if cid is not None and (c, kind, cid) not in first:
                    first[c, kind, cid] = len(items) - 1

    def level(c, cid, seen):
        i = first.get((c, "call", cid))
        if i is None or cid in seen:
            return None
        below = [level(c, d, seen | {cid}) for d in items[i][4]]
        return None if None in below else 1 + max(below, default=-1)

    out = []
    for i, (c, t, kind, cid, deps, ok, js) in enumerate(items):
        lead = first.get((c, kind, cid)) == i
        at = level(c, cid, frozenset()) if lead else 0 if kind == "call" and cid is None and not deps else None
        at = at + 1 if kind == "result" and at is not None else at
        out.append((str(c), t, kind, str(cid), str(at), lead and (c, "result" if kind == "call" else "call", cid) in first, ok and (kind == "result" or at is not None), js))
    return sorted(out)


def test_tool_calls_against_plain_linking(spark):
    r, rows = random.Random(12), []
    for c in [*range(25), None]:
        for t in range(r.randrange(1, 9)):
            text = "say " * r.randrange(3)
            for _ in range(r.randrange(4)):
                i = r.choice(["a", "b", "c", "d", "e", 1, None])
                if r.random() < 0.6:
                    text += "<tool_call>" + json.dumps({"id": i, "name": r.choice(["search", "other"]), "arguments": {"query": r.choice(["$a", "$b", "$c", "$1", "x", "y"])} | ({"limit": r.choice([1, "1"])} if r.random() < 0.4 else {})}) + "</tool_call>"
                else:
                    text += "<tool_result>" + json.dumps({"tool_call_id": i, "content": r.randrange(3)}) + "</tool_result>"
            rows.append((c, t, "assistant", text))
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("kind <> 'message'").collect()
    assert sorted((str(x.conv_id), x.turn, x.kind, str(x.call_id), str(x.level), x.linked, x.valid, x.json) for x in got) == link_plainly(rows, toolcalls.SCHEMAS)


def test_pieces_equal_the_library(spark, edge, empty):
    path = P.path("piece_bpe_32k.model")
    c = pieces.codec(path)
    rows = EDGE + [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").limit(60).collect()]
    got = pieces.encode(spark.createDataFrame(rows, DOCS).coalesce(1), path).collect()
    for (_, text, _), x in zip(rows, got):
        ids = [1, *c.sp.encode(text or ""), 2]
        assert x.ids == ids and x.n_tokens == len(ids) and x.text == c.sp.decode(ids)
        data, at = (text or "").encode(), 0
        for b, e in zip(x.begins, x.ends):
            assert at == b or (b, e) == (0, 0) or b >= at - 1
            at = e
        assert b"".join(data[b:e] for b, e in zip(x.begins, x.ends)) == data
    assert pieces.encode(edge, path, digest=True).count() == len(EDGE) and pieces.encode(empty, path, digest=True).count() == 0


def test_compiled_character_map():
    # a trie that holds "ab" -> "X": units by the double-array rules
    units, text = [0] * 512, b"X\0"
    units[0] = 1 << 10
    a = 1 ^ ord("a")
    units[a] = (256 ^ a) << 10 | ord("a")
    b = 256 ^ ord("b")
    leaf = 300
    units[b] = (leaf ^ b) << 10 | 1 << 8 | ord("b")
    units[leaf] = 1 << 31
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + text
    m = pieces.CharMap(blob)
    assert m.longest(b"abc", 0) == (b"X", 2) and m.longest(b"ac", 0) == (b"a", 1) and m.longest("é".encode(), 0) == ("é".encode(), 2)


def base_of(t):
    o = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[1]) >= 6]
    o += [(m.start(), k, m.end()) for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)) for m in re.finditer(p, t) if len(m[0]) >= n]
    return sorted(o)


def test_secrets(spark, edge, empty):
    r = random.Random(4)
    parts = ["é ", "secret", "=", "token:", " ", "abcdefgh", "AKIA", "A1" * 8, "0a" * 12, "f", '"', "api_key", "\n", "PASSWORD = 'x", "ſecret=abcdefg"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(30))), "s") for i in range(400)]
    rows += [(1000, "key " + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) + " end", "s"), (1001, "id " + "a1" * 30 + " plain lowercaseproseofmorethantwentyletters", "s")]
    got = {x.doc_id: x for x in secrets.digest(secrets.scan(spark.createDataFrame(rows, DOCS))).collect()}
    for i, t, _ in rows:
        want = base_of(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest(), t
    assert got[1000].spans == "random:4:44" and "random" not in got[1001].spans
    assert secrets.scan(edge).count() == len(EDGE) and secrets.scan(empty).count() == 0
    masked = {x.doc_id: x for x in secrets.redact(spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.char_length("text"))).collect()}
    for i, t, _ in rows:
        at, out = 0, ""
        for kind, a, b in (x.split(":") for x in got[i].spans.split(",") if x):
            if int(a) >= at:
                out += t[at:int(a)] + f"[{kind}]"
            at = max(at, int(b))
        assert (masked[i].text, masked[i].n_chars) == (out + t[at:], len(out + t[at:])), t
    assert masked[1000].text == "key [random] end" and masked[1001].text == "id [hex] plain lowercaseproseofmorethantwentyletters"


def test_media_round_trip(spark, edge, empty):
    for n in (0, 1, 575, 576, 577, 5000, 100_000):
        p = media.payload_of("ÿ" * (n // 2))
        m = media.store(p)
        x = media.parse(m)
        assert x["payload"] == p and x["intact"] and not x["bad"] and not x["skipped"] and len(p) % 576 == 0 and p
        assert x["table"][0] == len(x["offsets"]) and all(m[o] == 255 for o in x["offsets"])
    damaged = bytearray(media.store(media.payload_of("x" * 9000)))
    damaged[media.parse(bytes(damaged))["offsets"][2] + 7] ^= 1
    x = media.parse(b"noise" + bytes(damaged))
    assert x["bad"] == 1 and len(x["offsets"]) >= 3 and media.parse(b"")["offsets"] == []
    got = media.read_media(media.to_media(edge)).collect()
    for (_, t, _), y in zip(EDGE, sorted(got, key=lambda y: 0)):
        p = media.payload_of(t or "")
        assert y.payload_sha256 == hashlib.sha256(p).hexdigest() and y.tail_crc32 == zlib.crc32(p[-32:])
    assert media.read_media(media.to_media(empty)).count() == 0


def stream(version: int, mode: int, protected: bool, sizes=(3, 5, 3), body=b"", first=b"") -> bytes:
    """Layer III frames written from the format's description, the first one with `first`."""
    out = b""
    for k, kbit in enumerate(sizes):
        h = bytes([0xFF, 0xE2 | version << 3 | (not protected), kbit << 4, mode << 6])
        side = bytes(((17, 32) if version == 3 else (9, 17))[mode != 3])
        rate = 44100 / {3: 1, 2: 2, 0: 4}[version]
        kb = (media.KBITS if version == 3 else media.KBITS2)[kbit]
        size = int((144 if version == 3 else 72) * kb * 1000 // rate)
        crc = media.crc16(h[2:] + side).to_bytes(2, "big") if protected else b""
        out += (h + crc + side + (first if k == 0 else body)).ljust(size, b"\0")
    return out


def test_media_of_other_writers():
    for version, samples, rate in ((3, 1152, 44100), (2, 576, 22050), (0, 576, 11025)):
        for mode in (0, 1, 3):
            for protected in (True, False):
                x = media.parse(stream(version, mode, protected))
                assert (len(x["offsets"]), x["bad"], x["skipped"], x["samples"], x["rate"]) == (3, 0, 0, 3 * samples, rate), (version, mode, protected)
    for mode in (1, 3):
        xing = b"Xing" + (1 | 4).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes(range(100))
        x = media.parse(stream(3, mode, False, (9, 5, 5), first=xing))
        assert x["table"] == (2, None, bytes(range(100))) and len(x["offsets"]) == 2
    vbri = bytes(32 - 17) + b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (2).to_bytes(4, "big") + (2).to_bytes(2, "big") + (10).to_bytes(2, "big") + (1).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"\x05\x07"
    assert media.parse(stream(3, 3, False, (9, 5, 5), first=vbri))["table"] == (2, 999, [50, 70])
    plain = stream(3, 1, True)
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1 << 29 | 1 << 31).to_bytes(4, "little") + bytes(8) + bytes(40)
    foreign = b"ID3\3\0\0" + media.synchsafe(30) + b"TXXX" + (20).to_bytes(4, "big") + b"\0\0" + b"\0payload\0not numbers"
    x = media.parse(foreign + plain + ape + b"TAG".ljust(128, b"x"))
    assert (len(x["offsets"]), x["bad"], x["skipped"]) == (3, 0, 0) and "intact" not in x


def test_jaccard_components(spark, edge, empty):
    r = random.Random(9)
    base = [f"w{i % 40}x{i}" for i in range(70)]
    rows = [(i, " ".join(w if r.random() > 0.02 else f"e{r.randrange(999)}" for w in base), "s") for i in range(150)]
    rows += [(200 + i, " ".join(base[:30] + [f"u{i}v{k}" for k in range(60)]), "s") for i in range(40)] + [(300 + i, " ".join(base), "s") for i in range(20)] + [(400, None, ""), (401, "", ""), (402, "A b", ""), (403, "a  B", ""), (404, " \x0b", "")]
    want = jaccard.brute_force([(i, t) for i, t, _ in rows])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want
    assert sorted((x.doc_id or 0, x.component_id) for x in jaccard.join(edge).collect())[0] == (0, None)
    assert jaccard.join(empty).count() == 0


def test_jaccard_of_hot_shingles_and_shared_names(spark, monkeypatch):
    """Hot shingles dealt to several tasks, near copies beside other components, and classes
    whose first names collide."""
    monkeypatch.setattr(jaccard, "HOT", -1e9)
    monkeypatch.setattr(jaccard, "HUB", 5)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if r.random() > 0.02 else f"e{r.randrange(999)}" for w in base), "s") for i in range(120)]
    rows += [(200 + i, " ".join(base[:20 + 4 * i]), "s") for i in range(9)] + [(300 + i, " ".join(base[:30] + [f"z{i % 5}{k}" for k in range(30)]), "s") for i in range(15)]
    want = jaccard.brute_force([(i, t) for i, t, _ in rows])
    df = spark.createDataFrame(rows, DOCS)
    for bits in (64, 3):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, bits=bits).collect()} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_segments_are_maximal():
    r = random.Random(1)
    for _ in range(200):
        xs = [r.choice([-2, -1, 1, 2]) for _ in range(r.randrange(1, 14))]
        got = toxicity.segments([(i, float(x)) for i, x in enumerate(xs)], -0.5)

        def best(lo, hi):  # repeatedly the highest-scoring, then left and right of it
            c = [(sum(xs[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            s, _, _, a, b = max(c, default=(0, 0, 0, 0, 0))
            return [] if s <= 0 else best(lo, a) + [float(s)] + best(b, hi)

        assert sorted(s for *_, s in got) == sorted(best(0, len(xs)))


def test_toxicity_held_out(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    x = toxicity.score(docs, model).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    rank = x["score"].rank()
    n1, n0 = (x.toxic == 1).sum(), (x.toxic == 0).sum()
    assert (rank[x.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert ((x.predicted == 1) & (x.toxic == 0)).sum() <= 0.01 * n0
    # 9 of the 144 toxic rows hold none of the words that mark the others
    assert ((x.predicted == 1) & (x.toxic == 1)).sum() >= 0.89 * n1
    assert toxicity.is_held_out(5) == bool(spark.range(5, 6).select(toxicity.held_out(F.col("id"))).first()[0])
    assert toxicity.score(edge, model).count() == len(EDGE) and toxicity.score(edge, model, keep=False).filter("score < 0 or score > 1").count() == 0
    got = toxicity.score(edge, model, keep=True, names=("s", "p", "h", "y")).collect()
    assert len(got) == len(EDGE) and all(r.score == "clash" and 0 <= r.s <= 1 for r in got)
    with pytest.raises(ValueError):
        toxicity.score(edge, model, keep=True)
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(empty, none).count() == 0
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(edge, one).filter("score <> 0").count() == 0


def test_toxicity_against_plain_odds(spark):
    """Scores of words and the background, computed from the texts with plain loops."""
    import math

    rows = [(i, ("bad%s awful " % (i % 3) if i % 2 else "fine ") + " ".join(f"w{(i * 7 + k) % 50}x" for k in range(12)), i % 2) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    c = [{}, {}]
    for i, t, y in rows:
        if not toxicity.is_held_out(i):
            for w in set(toxicity.WORD.findall(t)):
                c[y][w] = c[y].get(w, 0) + 1
    n0, n1 = (sum(d.values()) for d in c)
    p = 0.5 + 0.035 * n1 / (n0 + n1) * c[1]["awful"]
    assert abs(m.words["awful"] - (math.log((c[1]["awful"] + p) / (n1 - c[1]["awful"] + p)) - math.log(p / (n0 + p)))) < 1e-9
    assert "fine" not in m.words and m.background < 0
    found, n = toxicity.passages("w1x awful bad w2x w3x awful awful", m)
    assert n == 4 and found and found[0][0] == 2


def test_wrappers(spark):
    page = "<html><body><div><span>Site name</span></div><div class=c><p>{}</p></div><div class=z>All rights</div></body></html>"
    t = wrappers.template([page.format(x) for x in ("one", "two", "three")])
    assert wrappers.extract(page.format("a &amp; b"), t) == "a & b"
    assert wrappers.extract('<body><nav>x</nav><article><h1>T</h1><p><b>one  two<br><p>three<div class="ad">no</div><form>f</form></article><footer>f') == "T\none two\nthree"
    assert wrappers.extract("<p>" * 5000 + "deep" + "<div>" * 3000) == "deep" and wrappers.extract("") == ""
    rows = [(x.page_id, x.url, x.html) for x in spark.read.parquet(f"{DATA}/pages.parquet").collect()] + [(None, None, None), (-1, "http://x/", ""), (-2, "http://x/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("clash"))
    got = {x.page_id: x for x in wrappers.main_text(df).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        if h:
            art = re.search(r"<article>(.*?)(?:</article>|$)", h, re.S)[1]
            want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", art)]
            assert got[i].text == "\n".join(b for b in want if b) and got[i].n_chars == len(got[i].text)


def test_wrapper_of_unmatched_subtrees(spark):
    page = "<html><body><div class=m><p>Menu</p></div><div class=c><p>{}</p></div>{}</body></html>"
    more = page.format("two", "<div class=x><div><p>extra section</p></div></div>")
    t = wrappers.template([page.format("one", ""), more])
    assert wrappers.extract(more, t) == "two\nextra section" and wrappers.extract(page.format("one", ""), t) == "one"
    rows = [(1, "http://a/", ""), (2, "http://a/", None)] + [(i, "http://a/", more) for i in range(3, 6)]
    got = {x.page_id: x.text for x in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "" and got[3] == got[5] == "Menu\ntwo\nextra section"


def test_wrapper_counts_all_pages(spark):
    page = "<html><body><div class=m><p>{}</p></div><div class=c><p>text {}</p></div>{}</body></html>"
    note = "<div class=x><p>Your account is new</p></div>"
    rows = [(i, "http://a/", page.format("Menu" if i % 10 else "Menü", i, note if i % 10 != 1 else "")) for i in range(200)]
    got = {x.page_id: x.text for x in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}" if i % 10 else got[i] == f"Menü\ntext {i}" for i in range(200))
    assert wrappers.extract(rows[7][2], wrappers.template([r[2] for r in rows])) == "text 7"
    assert wrappers.template([rows[1][2]] * 3) is None


def test_wrapper_decides_in_articles():
    page = ('<html><body><nav>n{0}</nav><div class=by>by {0}</div><div class=m>Menu</div><article><div class=x>Read our rules</div><h1>t{0}</h1><p>see <a>here</a> {0}</p>'
            '<h2 id="related-work">Related {0}</h2><div class="ad">ad {0}</div></article></body></html>')
    pages = [page.format(i) for i in range(5)]
    t = wrappers.template(pages)
    assert wrappers.extract(pages[3], t) == "by 3\nt3\nsee here 3\nRelated 3"
    assert wrappers.extract(pages[3]) == "Read our rules\nt3\nsee here 3"
    pair = wrappers.template(pages[:2])  # near copies: two pages prove nothing inside the article
    assert wrappers.extract(pages[1], pair) == "by 1\nRead our rules\nt1\nsee here 1\nRelated 1"


def test_simple_tree_matching_against_all_matches():
    """Sizes against every order-keeping matching of children, and partners that reach them."""
    import itertools

    r = random.Random(7)

    def grow(level):
        t = wrappers.Tree(r.choice("ab"))
        t.kids = [grow(level - 1) for _ in range(r.randrange(4))] if level else []
        return t

    def best(a, b):
        if a.label != b.label:
            return 0
        most = 0
        for k in range(min(len(a.kids), len(b.kids)) + 1):
            for xs in itertools.combinations(a.kids, k):
                for ys in itertools.combinations(b.kids, k):
                    sizes = [best(x, y) for x, y in zip(xs, ys)]
                    most = max(most, sum(sizes) if all(sizes) else 0)
        return 1 + most

    for _ in range(150):
        a, b = grow(3), grow(3)
        a.label = b.label = "r"
        m = wrappers.Matching()
        assert m.size(a, b) == best(a, b)
        met = m.partners(a, b)
        assert 1 + sum(m.size(a.kids[i], b.kids[j]) for i, j in met) == best(a, b) and met == sorted(met)


def test_wrapper_aligns_unnamed_nodes(spark):
    """Constant and varying nodes of one label path: only their place among siblings tells them apart."""
    page = "<html><body><div><b>Site</b></div><div><p>{0}</p><p>{1}</p></div>{2}<div><i>All rights</i></div></body></html>"
    pages = [page.format(f"one {i}", "Site", "<div><u>x%d</u></div>" % i if i % 3 else "") for i in range(9)]
    t = wrappers.template(pages)
    names = [wrappers.extract(p, t) for p in pages]
    assert names == [f"one {i}" + (f"\nx{i}" if i % 3 else "") for i in range(9)]
    changed = sum(wrappers.extract(p, t) != wrappers.extract(p) for p in pages)
    assert changed == len(pages)
    got = wrappers.main_text(spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert [x.text for x in sorted(got)] == names
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_reads_odd_markup_in_linear_time():
    import time

    start = time.monotonic()
    assert wrappers.extract("<a " * 350_000) == "" and wrappers.extract("<p" + " '" * 100_001) == ""
    assert wrappers.extract("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep" and wrappers.extract("</b>" * 50_000 + "x") == "x"
    assert wrappers.extract("a < b <c>d") == "a < b d" and wrappers.extract("x<!-- y") == "x"
    assert time.monotonic() - start < 20
    deep = "<div>" * 130 + "<nav>menu</nav><p>a</p><p>b</p>" + "</div>" * 130
    assert wrappers.extract(deep) == "a\nb"
    kept = '<article><div class="article-header"><h1>T</h1></div><p class="side">s</p><p id="search-results">r</p></article>'
    assert wrappers.extract(kept) == "T\ns\nr"


def test_packing(spark, edge, empty):
    r = random.Random(2)
    for _ in range(100):
        counts = {r.randrange(1, 60): r.randrange(1, 4) for _ in range(r.randrange(6))}
        cap = r.randrange(1, 90)
        got = packing.best_fill(counts, cap)
        sums = {0}
        for s, k in counts.items():
            sums |= {x + s * j for x in sums for j in range(1, k + 1)}
        assert all(got[s] <= counts[s] for s in got) and sum(s * k for s, k in got.items()) == max(x for x in sums if x <= cap)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = EDGE[:4] + EDGE[5:6] + [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").filter("doc_id > 5").collect()]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), P.path("byte_bpe_50k.json")).collect()
    seqs, ids = {}, {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, _ in rows}
    covered = {i: [] for i in ids}
    for x in got:
        part = ids[x.doc_id][x.start:x.start + x.length]
        assert len(part) == x.length and x.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and x.doc_tokens == len(ids[x.doc_id])
        covered[x.doc_id].append((x.start, x.length))
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for i, c in covered.items():
        at = 0
        for s, n in sorted(c):
            assert s == at
            at += n
        assert at == len(ids[i])
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    same = packing.tokenise(spark.createDataFrame([(None, "a b c", "s")] * 3000, DOCS).coalesce(1), P.path("byte_bpe_50k.json"))
    assert max(x["count"] for x in packing.pack(same, 3000, group_docs=100).groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()) < 400
    assert packing.pack_documents(edge, P.path("byte_bpe_50k.json")).count() >= len(EDGE) and packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, DATA)
        assert out.columns == docs.columns
        assert {x[0] for x in out.select("doc_id").collect()} <= {x[0] for x in d.select("doc_id").collect()}
        if name == "near_duplicates":
            want = jaccard.brute_force([(x.doc_id, x.text) for x in d.collect()])
            assert sorted(x.doc_id for x in out.collect()) == sorted({c for _, c in want.values()})
        d = spark.createDataFrame(out.collect(), out.schema)
    n = corpus_pipeline.run(spark, DATA)
    assert n.select("doc_id").distinct().count() == d.count()


def test_near_duplicates_of_odd_ids(spark):
    import corpus_pipeline

    t = [" ".join(f"{k}{i}" for i in range(60)) for k in "abcd"]
    rows = [(None, t[0]), (None, t[0]), (7, t[1]), (7, t[1]), (7, t[1] + " x"), (3, t[2]), (9, t[2]), (9, t[3]), (None, t[3] + " x"), (None, ""), (5, None)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted((x.doc_id or 0, (x.text or "")[:2]) for x in got) == [(0, ""), (0, "a0"), (3, "c0"), (5, ""), (7, "b0"), (9, "d0")]


def test_jaccard_of_int_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text + " x" * (i % 2)) for i in range(1, 5)] + [(9, "other words")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {x.doc_id: x.component_id for x in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_secrets_around_base_spans(spark):
    r = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    a, b, c = ("".join(r.choice(chars + more) for _ in range(n)) for n, more in ((60, ""), (60, ""), (64, "+/-_")))
    run = "".join(r.choice("0123456789abcdef") for _ in range(24))
    rows = [(1, f"x {a}{run}{b} y", "s"), (2, f"x {c} y", "s"), (3, f"token={a} y", "s")]
    masked = {x.doc_id: x.text for x in secrets.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert masked == {1: "x [random] y", 2: "x [random] y", 3: "[assign] y"}


def test_false_discovery_cuts_equal_the_plain_procedure(spark):
    """Binned Benjamini-Hochberg against the one on sorted p-values, small ones included; and
    the battery's p-values on uniform tokens."""
    r = random.Random(8)
    for low, m in ((1, 400), (1e-9, 5000), (1e-25, 3000)):
        ps = [r.random() for _ in range(m)] + [r.random() * low for _ in range(m // 10)]
        df = spark.createDataFrame([(0, p) for p in ps], "c int, p double").select("c", "p", secrets.p_bin(F.col("p")).alias("bin"))
        cut = secrets.cutoffs(df.groupBy("c", "bin").agg(F.count("*").alias("k"))).first()["cut"]
        got = sorted(x.p for x in df.filter(F.col("bin") >= cut).collect())
        last = max((k for k, p in enumerate(sorted(ps), 1) if p <= secrets.FDR * k / len(ps)), default=0)
        want = sorted(ps)[:last]
        assert got == want[:len(got)] and all(p > secrets.FDR * len(want) / len(ps) * 2 ** (-2 / secrets.OCTAVE) for p in want[len(got):])
    for name, _, alphabet in secrets.ENCODINGS[:8]:
        rows = [("".join(r.choice(alphabet) for _ in range(48)),) for _ in range(600)]
        x = spark.createDataFrame(rows, "s string").select(F.explode(secrets.tested(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(3).alias("kind"), F.lit(48).cast("long").alias("end"), "s")))).alias("x")).select("x.r.p")
        assert x.filter("p <= 0.05").count() <= 0.1 * x.count() and x.filter("p <= 0.001").count() <= 0.01 * x.count(), name


CLASH = ("score", "predicted", "held_out", "passages", "base", "found", "tokens", "cand", "cuts", "row", "r", "component_id", "class_id", "toxic", "g", "Row_", "n")


@pytest.mark.parametrize("kind", ["clash", "empty"])
def test_pipeline_stages_on_odd_tables(spark, kind):
    """Null, empty and repeated rows, clashing columns and an empty table through every stage."""
    import corpus_pipeline

    rows = [*EDGE, (8, "password: hunter2hunter2 and more words here", "a")]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(None).cast("int").alias("n_chars"), *(F.lit("keep").alias(c) for c in CLASH))
    d = docs if kind == "clash" else docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, DATA)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.collect()
        assert all(x[c] == "keep" for x in got for c in CLASH)
        d = spark.createDataFrame(got, docs.schema)
        if kind == "clash":
            assert len(got) == (8 if name == "toxicity" else 7)
    if kind == "clash":
        assert next(x for x in got if x.doc_id == 8).text == "[assign] and more words here" and next(x for x in got if x.doc_id == 8).n_chars == 28
    assert corpus_pipeline.pack(spark, d, DATA).count() >= d.count()
