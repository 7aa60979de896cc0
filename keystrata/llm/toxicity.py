"""Toxic passages by maximum-scoring segments.

Training counts, per word, the labelled training documents of each class that hold it; a
text is the sequence of its distinct words, each at its first place and, with half its score,
at its second one, so that a word said a hundred times is little more evidence than once.  A word's score is its log-odds between the
classes under an informative Dirichlet prior (the pooled counts).
Words that stand out of all words tested (log-likelihood ratio above ln tests) and score more
than `least` are listed, and by the same rule beginnings of three to six letters, unless one
word makes up half of their toxic ones.  Every word that is not listed scores the log-odds of not being
listed, slightly below zero.  A linear-time scan (all maximal scoring segments) finds the
passages of each text.  Under the null model of clean training texts the best segment
follows an extreme-value law, so a segment's score S in a text of n distinct words has the
E-value K n exp(-lambda S); the passages with E below `E_MAX` are significant.  Their summed
evidence, -log E, goes through an isotonic calibration fitted on the training texts.

Bounds: the model is fitted on at most `max_train` labelled documents (the smallest hashes
of doc_id, one row each); labels, lang, source and doc_id are no inputs of a score.  Only
the listed tokens, sums and a histogram of fixed size reach the driver.

Edge cases: null and empty texts have no passage and the score of a clean text; with no
labelled row, or rows of one class only, there are no tokens and all scores are the prior
0.0; rows without an id are scored (held out: false); conflicting labels of an id count as
toxic, and of texts that share an id the greatest counts; repeated rows get equal scores; an
empty table gives no rows.  Further columns are ignored; with `keep` they stay, and those
named like a result are told apart by the caller's choice of `names`.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, texts

WORD = re.compile(r"[^\W\d_]+")
STEMS, CACHE = (6, 5, 4, 3), 200_000
E_MAX, THRESHOLD = 0.05, 0.7
#: Histogram of evidence for the calibration: from LOW to HIGH in steps of STEP.
LOW, HIGH, STEP = -10.0, 12.0, 0.25
#: Segment scores above TOP count as TOP in the null law, whose highest share SPARE is left out.
TOP, SPARE = 60.0, 0.02


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    background: float = -0.5
    lam: float = 1.0
    k: float = 0.1
    at: list[float] = field(default_factory=lambda: [0.0])  # calibration: evidence, probability
    share: list[float] = field(default_factory=lambda: [0.0])
    cache: dict[str, float] = field(default_factory=dict, repr=False, compare=False)


def held_out(doc_id):
    """Column: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def segments(scores: list[tuple[int, float]], background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence whose listed positions
    have the given scores and all others `background` (negative); linear time."""
    found: list[list] = []  # begin, end, sum before, sum after, index of the nearest lower left
    total, last = 0.0, -1
    for at, s in scores:
        total += background * (at - last - 1)
        last = at
        left, total = total, total + s
        if s <= 0:
            continue
        cur = [at, at + 1, left, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j = found[j][4]
            cur[4] = j
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                break
            cur[0], cur[2] = found[j][0], found[j][2]
            del found[j:]
    return [(b, e, after - before) for b, e, before, after, _ in found]


def token_score(w: str, m: Model) -> float:
    """Of a word: its own, else that of its longest listed beginning, else 0; known answers
    are kept for up to CACHE words."""
    s = m.words.get(w)
    if s is None:
        s = next((v for k in STEMS if len(w) > k and (v := m.words.get(w[:k] + "*")) is not None), 0.0)
    if len(m.cache) >= CACHE:
        m.cache.clear()
    m.cache[w] = s
    return s


def passages(text: str, m: Model) -> tuple[list[tuple[int, int, float, float]], int]:
    """(begin word, end word, score, E-value) of each maximal segment, and the number of
    distinct words."""
    words = WORD.findall(text.lower())
    own, known = dict.fromkeys(words), m.cache
    marks = {w: s for w in own if (s := known[w] if w in known else token_score(w, m))}
    if not marks:
        return [], len(own)
    order, scored, seen = [], [], {}
    for i, w in enumerate(words):
        seen[w] = times = seen.get(w, 0) + 1
        if times == 1 or (times == 2 and w in marks):
            if w in marks:
                scored.append((len(order), marks[w] / times))
            order.append(i)
    n = len(own)
    return [(order[b], order[e - 1] + 1, s, m.k * n * math.exp(-m.lam * s)) for b, e, s in segments(scored, m.background)], n


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    """Aggregate of all significant passages: each adds what its E-value stays below E_MAX;
    without one, the best passage's distance to it."""
    if not found:
        return LOW
    xs = [-math.log(max(e, 1e-300)) + math.log(E_MAX) for *_, e in found]
    good = [x for x in xs if x > 0]
    return min(sum(good), HIGH) if good else max(max(xs), LOW)


def probability(found, m: Model) -> float:
    return float(np.interp(evidence(found), m.at, m.share))


def listed(counts: DataFrame, n0: float, n1: float, tests: int, least: float) -> DataFrame:
    """t, c0, c1, score of the tokens of counts(t, c0, c1) that stand out as toxic; n0 and n1
    are the words of each class."""
    # Dirichlet prior: half a word of each kind, and pseudo-words spread as the pooled counts are
    share = n1 / (n0 + n1)
    prior = 0.5 + 0.035 * share * (F.col("c0") + F.col("c1"))
    odds = [F.log((F.col(c) + prior) / (size - F.col(c) + prior)) for c, size in (("c1", n1), ("c0", n0))]
    both = F.col("c0") + F.col("c1")

    def part(c, q):
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * q))).otherwise(0.0)

    stands = part("c1", share) + part("c0", 1 - share) > math.log(max(tests, 2))
    x = counts.withColumn("score", odds[0] - odds[1])
    return x.filter(stands & (F.col("c1") > both * share) & (F.col("score") > least)).select("t", "c0", "c1", "score")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, least: float = 0.5) -> Model:
    m = Model()
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    marks = saved(marks.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    train = small_batches(docs).select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # at most max_train rows of 12 bytes
    train = saved(train.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")))  # one row an id

    def count(batches):
        total: dict[str, list[int]] = {}
        for b in batches:
            for y, s in zip(b.column(b.schema.get_field_index("toxic")).to_pylist(), texts(b)[1]):
                for w in set(WORD.findall(s.lower())):
                    total.setdefault(w, [0, 0])[y] += 1
            if len(total) > 100_000:
                yield table(total)
                total = {}
        yield table(total)

    def table(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], ["t", "c0", "c1"])

    words = saved(train.mapInArrow(count, "t string, c0 long, c1 long").groupBy("t").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    n0, n1, tests = words.agg(F.sum("c0"), F.sum("c1"), F.count("*")).first()
    if not n0 or not n1:
        return m
    whole = listed(words, n0, n1, tests, least).collect()
    stems = F.array(*(F.when(F.length("t") > k, F.concat(F.substring("t", 1, k), F.lit("*"))) for k in STEMS))
    pooled = words.select(F.explode(stems).alias("t"), "c0", "c1").filter("t is not null").groupBy("t").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.max("c1").alias("most"))
    begin = listed(pooled.filter("2 * most <= c1"), n0, n1, tests, least).collect()
    m.words = {x.t: x.score for x in [*whole, *begin]}
    # what is listed: the outermost beginnings (the others lie within these) and words of none
    parts = [x for x in [*whole, *begin] if not any(x.t[:k] + "*" in m.words for k in STEMS if k < len(x.t.rstrip("*")))]
    p0, p1 = (sum(x[c] for x in parts) / n for c, n in (("c0", n0), ("c1", n1)))
    m.background = min(math.log((1 - min(p1, 0.999)) / (1 - min(p0, 0.999))), -1e-3)

    # null law: the maxima of clean texts but the highest SPARE (labels err) give lambda by
    # moments of the Gumbel law, then K
    def maxima(batches):
        total: dict[int, list[float]] = {}
        for b in batches:
            for y, s in zip(b.column(b.schema.get_field_index("toxic")).to_pylist(), texts(b)[1]):
                if not y:
                    found, n = passages(s, m)
                    at = total.setdefault(round(min(max((f[2] for f in found), default=0.0), TOP) / STEP), [0, 0.0])
                    at[0] += 1
                    at[1] += math.log(max(1, n))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.float64())], ["bin", "n", "ln"])

    bins = train.mapInArrow(maxima, "bin int, n long, ln double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ln").alias("ln")).orderBy("bin").collect()  # at most TOP / STEP rows
    left, sums = (1 - SPARE) * sum(x.n for x in bins), np.zeros(4)
    for x in bins:
        part = min(1.0, max(0.0, left) / x.n)
        left -= x.n
        sums += part * np.array([x.n, x.n * x.bin * STEP, x.n * (x.bin * STEP) ** 2, x.ln])
    n, s, ss, ln = sums
    spread = math.sqrt(max(ss / n - (s / n) ** 2, 1e-12))
    # scores are log-odds, whose lambda is 1 in theory; a scatter wider than that lowers it
    m.lam = min(1.0, math.pi / (math.sqrt(6) * spread))
    m.k = math.exp(m.lam * s / n - ln / n - 0.5772)

    def histogram(batches):
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            for y, s in zip(b.column(b.schema.get_field_index("toxic")).to_pylist(), texts(b)[1]):
                at = round((evidence(passages(s, m)[0]) - LOW) / STEP), y
                total[at] = total.get(at, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)] + [pa.array(list(total.values()), pa.int64())], ["bin", "y", "n"])

    bins = train.mapInArrow(histogram, "bin int, y int, n long").groupBy("bin").agg(F.sum(F.col("n") * F.col("y")).alias("toxic"), F.sum("n").alias("n")).orderBy("bin").collect()  # at most 89 rows
    m.at, m.share = isotonic([LOW + x.bin * STEP for x in bins], [x.toxic for x in bins], [x.n for x in bins])
    return m


def isotonic(x, toxic, n) -> tuple[list[float], list[float]]:
    """Places and heights of the curve of the toxic share over ascending x that fits best and
    never falls (pool adjacent violators), each pool's share drawn to the base rate by one row."""
    pools: list[list[float]] = []  # rows, toxic rows, sum of x
    for v, t, k in zip(x, toxic, n):
        pools.append([k, t, v * k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    base = sum(toxic) / sum(n)
    heights = np.maximum.accumulate([(t + base) / (k + 1) for k, t, _ in pools])
    return [float(v / k) for k, _, v in pools], [float(h) for h in heights]


RESULT = ("score", "passages", "held_out", "predicted")


def score(docs: DataFrame, model: Model, keep: bool = False, names: tuple[str, ...] = RESULT) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (significant ones: word spans, score,
    E-value); with `keep` all columns of `docs` stay, and `names` are those of the result."""
    sc = small_batches(docs).sparkSession.sparkContext
    held = sc.broadcast(model)  # the listed tokens of at most max_train documents
    s_name, p_name, h_name, y_name = names
    cols = docs.columns if keep else ["doc_id"]
    if set(cols) & set(names):
        raise ValueError(f"columns {sorted(set(cols) & set(names))} clash with the result's names")

    def run(batches):
        m = held.value
        for b in batches:
            s, out = [], []
            for t in texts(b)[1]:
                found, _ = passages(t, m)
                s.append(probability(found, m))
                out.append([{"begin": f[0], "end": f[1], "score": f[2], "e_value": f[3]} for f in found if f[3] <= E_MAX])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), pa.array(s, pa.float64()), pa.array(out, kind)], [*cols, s_name, p_name])

    src = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in cols)
    out = src.mapInArrow(run, f"{base}, `{s_name}` double, `{p_name}` array<struct<begin:long,end:long,score:double,e_value:double>>")
    return out.withColumn(h_name, held_out(F.col("doc_id"))).withColumn(y_name, (F.col(s_name) >= THRESHOLD).cast("int"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
