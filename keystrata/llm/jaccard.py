"""Exact n-gram Jaccard join with adaptive multi-match prefixes, and its components.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Documents
with equal sets (128-bit fingerprint) form one class, so copies are never expanded; all
further work is on classes, named by 64 bits that are dealt anew wherever two fingerprints
share them.

1. Every partition counts its shingles in hash buckets; the sums make a sketch of fixed
   size, the only thing sent to all executors.  Shingles are ordered by (bucket count,
   hash): passages that many documents share come last.
2. A set of n needs ceil(t*n) common shingles, so two linked sets share at least L
   shingles among their first n - ceil(t*n) + L ones.  Each class takes the L of least
   estimated candidate cost; a pair must then share min(L, L') prefix shingles.
3. Shingles with few classes emit all their pairs.  Shingles with many first emit stars
   (every class with one pivot), are linked and labelled.  Only then do they emit the pairs
   that still lie in different components, and only these: the classes outside a shingle's
   largest component meet all its classes, so a group of thousands of near copies beside a
   few others costs about its size, not its square, and no link between components is lost.
4. Candidates are verified exactly on the whole sets.

Shingles whose bucket count stands out (`HOT`) are dealt to several tasks by class, more of
them (with the square root) the more rows there are.

Edge cases: null, empty or wordless texts have an empty set, are linked with nothing and
are their own component; a text of 1 to 4 words is one shingle; rows without an id are
kept with a null component; repeated ids share their component; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, saved, small_batches, texts

MULT = np.uint64(0x9E3779B97F4A7C15)
#: Sketch of 2**BITS buckets in RANGES rows; at most 2 bytes a bucket are broadcast.
BITS, RANGES = 22, 64
MATCHES, FEW, STARS = (1, 2, 3, 4), 8, 1
POSTING = 64.0  # cost of one posting, in candidates met
FILTER_WORDS = 1 << 17
HOT = 1000
#: A star has about HUB points, so that no class meets thousands of others by itself.
HUB = 256
#: Classes of more than 1/HEAVY of all rows (so fewer than HEAVY of them) meet their rows by broadcast.
HEAVY = 1000


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode().lower().split()


def shingles(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; one for a text of fewer words."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words(text)), np.uint64)
    if not len(w):
        return w
    m = min(k, len(w))
    h = w[:len(w) - m + 1].copy()
    for i in range(1, m):
        h = h * MULT + w[i:len(w) - m + 1 + i]
    h ^= np.uint64(m)  # a short sequence is no shingle of k words
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def need(n, num: int, den: int):
    """Least overlap of a set of n with any set it is linked to."""
    return (n * num + den - 1) // den


def sketch(docs: DataFrame) -> np.ndarray:
    """Saturated counts of shingles by the top BITS bits of their hash."""
    size = 1 << (BITS - 6)

    def count(batches):
        total = np.zeros(1 << BITS, np.uint32)
        for b in batches:
            got = [shingles(s) for s in texts(b)[1]]
            if got:
                np.add.at(total, np.concatenate(got) >> np.uint64(64 - BITS), 1)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(RANGES, size)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["r", "c"])

    def add(batches):
        total = {}
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(c), np.uint16).astype(np.uint32)
                total[r] = total[r] + x if r in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(x, 65535).astype(np.uint16).tobytes(), 1) for x in total.values()], pa.binary())], ["r", "c"])

    schema = "r int, c binary"
    rows = small_batches(docs).select("doc_id", "text").mapInArrow(count, schema).repartition(RANGES, "r").mapInArrow(add, schema).collect()
    out = np.zeros((RANGES, size), np.uint16)
    for r, c in rows:
        x = np.frombuffer(zlib.decompress(c), np.uint16)
        out[r] = np.minimum(out[r].astype(np.uint32) + x, 65535)
    return out.reshape(-1)


def prefix(h: np.ndarray, counts: np.ndarray, floor: float, num: int, den: int) -> tuple[np.ndarray, int, int]:
    """The prefix of least estimated cost, the number of matches it asks for, and how many of
    its shingles, which come first, are not hot."""
    c = counts[h >> np.uint64(64 - BITS)]
    order = np.lexsort((h, c))
    least = need(len(h), num, den)
    met = np.cumsum(np.maximum(c[order].astype(np.float64) - 3 * floor, 0))  # without chance hits of a bucket
    best, match = None, 1
    for m in MATCHES:
        if m > least:
            break
        size = len(h) - least + m
        # postings and classes met by them, and classes met at least m times, each verified on its whole set
        price = POSTING * size + met[size - 1] * (1 + len(h) / (4 * m))
        if best is None or price < best:
            best, match = price, m
    chosen = order[:len(h) - least + match]
    return h[chosen], match, int(np.searchsorted(c[chosen], HOT + 3 * floor, "right"))


def fingerprint(h: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two signed 64-bit halves of a set's fingerprint, `bits` of the first one."""
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return tuple((x ^ 1 << 63) - (1 << 63) for x in (d & (1 << bits) - 1, d >> 64))


def signatures(docs: DataFrame, counts, num: int, den: int, bits: int = 64) -> DataFrame:
    """doc_id, n, cid, cid2, m (matches), cold (shingles before the hot ones), prefix."""
    kinds = {"n": pa.int64(), "cid": pa.int64(), "cid2": pa.int64(), "m": pa.int32(), "cold": pa.int32(), "prefix": pa.list_(pa.int64())}

    def run(batches):
        table = counts.value
        floor = float(table.mean())
        for b in batches:
            keys, it = texts(b)
            rows = []
            for s in it:
                h = shingles(s)
                p, m, cold = prefix(h, table, floor, num, den) if len(h) else (h, 0, 0)
                rows.append((len(h), *fingerprint(h, bits), m, cold, p.view(np.int64)))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds.values()))], ["doc_id", *kinds])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cid long, cid2 long, m int, cold int, prefix array<long>")


class Classes:
    """Makes cid name one set: where several fingerprints share it, all but the least are
    renamed, until no two share one."""

    def __init__(self, rows: DataFrame):
        self.renames: list[DataFrame] = []
        while True:
            by = self.named(rows).groupBy("cid").agg(F.min("cid2").alias("keeps"), F.max("cid2").alias("most"))
            shared = checkpoint(by.filter("keeps <> most").select("cid", "keeps"))
            if shared.isEmpty():
                break
            self.renames.append(shared)

    def named(self, rows: DataFrame) -> DataFrame:
        """The rows (cid, cid2, ...) with their final cid."""
        for k, shared in enumerate(self.renames):
            new = F.when(F.col("keeps") < F.col("cid2"), F.xxhash64("cid", "cid2", F.lit(k))).otherwise(F.col("cid"))
            rows = rows.join(shared, "cid", "left").withColumn("cid", F.when(F.col("keeps").isNull(), F.col("cid")).otherwise(new)).drop("keeps")
        return rows


def sets_of(docs: DataFrame, wanted: DataFrame, bits: int = 64) -> DataFrame:
    """(cid, cid2, shs) of the documents whose id may be in `wanted`(doc_id): a bitmap of fixed
    size spares the others, the joins that follow are exact."""
    sc = docs.sparkSession.sparkContext
    h = F.xxhash64("doc_id")
    marked = wanted.select(F.pmod(h, F.lit(FILTER_WORDS)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(doc_id), 40), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(FILTER_WORDS, np.int64)
    for w, b in marked.collect():  # at most FILTER_WORDS rows
        table[w] = b
    held = sc.broadcast(table)

    def run(batches):
        t = held.value
        for b in batches:
            hs = b.column(2).to_numpy()
            ok = (t[hs % FILTER_WORDS] >> (hs.view(np.uint64) >> np.uint64(40)).astype(np.int64) % 64) & 1
            b = b.filter(pa.array(ok.astype(bool)))
            sets = [shingles(s) for s in texts(b)[1]]
            names = list(zip(*(fingerprint(x, bits) for x in sets))) or [(), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(list(n), pa.int64()) for n in names), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["cid", "cid2", "shs"])

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", h.alias("h")).mapInArrow(run, "cid long, cid2 long, shs array<long>")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets reach the similarity."""
    x = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shs").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shs").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return x.withColumn("both", both).filter(F.col("both") * den >= (F.size("sa") + F.size("sb") - F.col("both")) * num).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): large-star and small-star until all
    that is left are stars: each node has one parent, and no parent has one."""
    e = checkpoint(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).filter("u <> v").distinct()  # large star
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(low, "u")
        e = checkpoint(j.filter("v <> m").select(F.col("m").alias("v"), F.col("v").alias("u")).unionByName(low.select(F.col("m").alias("v"), "u")).distinct())  # small star
        n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def join(docs: DataFrame, num: int = 75, den: int = 100, bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that links reach) and
    class_id (equal sets).  `bits` of the fingerprint name a class at first (fewer in tests)."""
    sc = docs.sparkSession.sparkContext
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))  # equal ids of other types have other hashes
    counts = sc.broadcast(sketch(docs))
    sig = saved(signatures(docs, counts, num, den, bits))
    salts = max(8, min(256, int(sig.count() ** 0.5 / 32)))
    classes = Classes(sig.select("cid", "cid2"))
    sig = classes.named(sig)
    members = sig.select("doc_id", "n", "cid")
    reps = members.filter("n > 0 and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    posts = sig.filter("n > 0 and doc_id is not null").select("cid", "cold", (F.col("n") * 64 + F.col("m")).alias("nm"), F.posexplode("prefix").alias("pos", "t"))
    # a hot shingle's classes are dealt by their own hash: salt -1 is a shingle in one task
    posts = posts.withColumn("salt", F.when(F.col("pos") < F.col("cold"), -1).otherwise(F.pmod(F.xxhash64("cid"), F.lit(salts))).cast("int"))
    # one exchange by shingle serves all of this: those of a single class go, copies fall together
    w = Window.partitionBy("t", "salt")
    posts = posts.withColumn("other", F.min("cid").over(w) != F.max("cid").over(w)).filter("other or salt >= 0").groupBy("t", "salt", "cid").agg(F.first("nm").alias("nm"), F.first("pos").alias("pos")).withColumn("df", F.count("*").over(w))
    # a common shingle before this one is in both prefixes: at most `seen` of them, those of
    # other classes too; `rest` counts this one and all after it, also beyond the prefix
    posts = posts.withColumn("seen", F.row_number().over(Window.partitionBy("cid").orderBy("pos")) - 1)
    posts = saved(posts.select("t", "salt", "cid", F.expr("nm div 64").alias("n"), F.expr("cast(nm % 64 as int)").alias("m"), "df", "seen", F.expr("nm div 64 - pos").alias("rest")))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links among `pairs`; the sets of the classes in them are made anew."""
        pairs = saved(pairs)
        nodes = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        wanted = nodes.join(reps, "cid").select(F.col("rep").alias("doc_id"))
        sets = classes.named(sets_of(docs, wanted, bits)).select("cid", "shs").dropDuplicates(["cid"])
        return saved(verify(pairs, sets, num, den))

    few, many = posts.filter((F.col("salt") < 0) & (F.col("df") <= FEW)), posts.filter((F.col("salt") >= 0) | (F.col("df") > FEW))
    heavy = many.groupBy("cid").agg(F.count("*").alias("heavy"))

    def fits(a: dict, b: dict, first: bool = False):
        """Sizes allow the similarity, and so does this common shingle's place: at most the
        seen ones before it (none if it is the pair's first one), itself and what follows it
        are common."""
        both = F.floor(((a["n"] + b["n"]) * num + (num + den - 1)) / F.lit(num + den))
        before = F.lit(0) if first else F.least(a["seen"], b["seen"])
        place = before + F.least(a["rest"], b["rest"]) >= both
        return (F.least(a["n"], b["n"]) * den >= F.greatest(a["n"], b["n"]) * num) & place

    def sides(left: DataFrame, right: DataFrame, on: list[str], cols: tuple[str, ...]) -> DataFrame:
        """`left` with columns ending in a, joined to `right` with columns ending in b."""
        side = lambda df, q: df.select(*on, F.col("cid").alias(q), *(F.col(c).alias(c + q) for c in cols))
        return side(left, "a").join(side(right, "b"), on)

    place = [{c: F.col(c + q) for c in ("n", "seen", "rest")} for q in "ab"]

    def may_link(p: DataFrame, grant) -> DataFrame:
        """Keeps pairs that may reach the similarity, having k + `grant` common prefix shingles
        at most: the shorter prefix in shingle order misses only what lies beyond it."""
        k = F.col("k") + grant
        least = [F.expr(f"(n{x} * {num} + {den - 1}) div {den} - m{x}") for x in "ab"]
        both = F.expr(f"((na + nb) * {num} + {num + den - 1}) div {num + den}")
        return p.filter((k >= F.least("ma", "mb")) & (k + F.greatest(*least) >= both)).select("a", "b")

    p = sides(few, few, ["t"], ("n", "m", "seen", "rest")).filter("a < b").filter(fits(*place))
    p = p.groupBy("a", "b", "na", "nb", "ma", "mb").agg(F.count("*").alias("k"))
    # shared heavy shingles are not counted here, so as many as both have are granted
    p = p.join(heavy.select(F.col("cid").alias("a"), F.col("heavy").alias("ha")), "a", "left").join(heavy.select(F.col("cid").alias("b"), F.col("heavy").alias("hb")), "b", "left")
    p = may_link(p, F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))))

    def stars(x: DataFrame, turn: int) -> DataFrame:
        """Of each shingle, every class with the first and the next one in an order: on even
        turns those of least own matter before it come first, on odd ones a hash decides.  A
        shingle of more than HUB classes has several stars, dealt by a hash of the class alike
        for all shingles of its size; their firsts are linked likewise."""
        order = [*([F.desc("rest")] if turn % 2 == 0 else []), "h", "cid"]
        labelled = "comp" in x.columns
        x = x.withColumn("h", F.xxhash64("cid", F.lit(turn))).withColumn("me", F.struct("cid", "n", "seen", "rest", *(["comp"] if labelled else [])))

        def near(x: DataFrame, *by: str) -> DataFrame:
            w = Window.partitionBy(*by).orderBy(*order)
            return x.withColumn("near", F.array(F.first("me").over(w), F.lag("me").over(w)))

        several = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("df") / HUB)), F.lit(0))).cast("long")
        own = near(x.withColumn("star", F.pmod(F.xxhash64("cid", F.lit(-1)), several)), "t", "salt", "star")
        firsts = own.filter(((F.col("salt") >= 0) | (F.col("df") > HUB)) & (F.col("near")[0]["cid"] == F.col("cid"))).drop("near")
        cols = ["cid", "n", "seen", "rest", *(["comp"] if labelled else []), F.explode("near").alias("p")]
        x = own.select(*cols).unionByName(near(firsts, "t").select(*cols))
        x = x.filter(F.col("p.cid") != F.col("cid")).filter(fits(*({c: F.col(q + c) for c in ("n", "seen", "rest")} for q in ("", "p."))))
        if labelled:
            x = x.filter(F.col("p.comp") != F.col("comp"))
        return x.select(F.least("cid", "p.cid").alias("a"), F.greatest("cid", "p.cid").alias("b")).distinct()

    edges = confirm(p.union(stars(many, 0)).distinct())
    labels = checkpoint(components(edges))
    if not many.isEmpty():
        def labelled() -> DataFrame:
            """The postings of shingles in several components, with comp and main, the component
            of most classes there."""
            x = many.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
            by = x.groupBy("t", "salt", "comp").agg(F.count("*").alias("k"))
            mains = by.groupBy("t", "comp").agg(F.sum("k").alias("k")).groupBy("t").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"))
            tasks = by.select("t", "salt").distinct().join(mains.filter("comps > 1").drop("comps"), "t")
            return x.join(tasks, ["t", "salt"])

        def across(x: DataFrame) -> DataFrame:
            """The pairs of different components whose first common shingle this may be: classes
            outside the main component meet all others, in every task of a hot shingle."""
            every = F.when(F.col("salt") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
            minor = x.filter("comp <> main").withColumn("salt", F.explode(every))
            p = sides(x, minor, ["t", "salt"], ("n", "seen", "rest", "comp", "main"))
            p = p.filter("compa <> compb and (compa = maina or a < b)").filter(fits(*place, first=True))
            return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

        for turn in range(1, STARS + 1):
            found = confirm(stars(labelled().drop("main"), turn))
            if not found.isEmpty():
                labels = checkpoint(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)))
        found = confirm(across(saved(labelled())))
        if not found.isEmpty():
            labels = checkpoint(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)))

    reps = saved(reps.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    roots = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = reps.join(roots, "root").select("cid", "component_id", "size")
    # copies of one class may be a large part of all rows: such classes come to their rows
    total = reps.agg(F.sum("size")).first()[0] or 0
    large = F.broadcast(checkpoint(of.filter(F.col("size") * HEAVY > total).drop("size")))  # fewer than HEAVY rows
    rest = members.join(large.select("cid"), "cid", "left_anti").join(of.drop("size"), "cid", "left")
    out = members.join(large, "cid").unionByName(rest)
    comp = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("cid").alias("class_id"))


def brute_force(rows: list[tuple[int, str]], num: int = 75, den: int = 100) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) by comparing all pairs of word sets; for tests."""
    sets = {}
    for i, t in rows:
        w = words(t or "")
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
