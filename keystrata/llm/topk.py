"""Exact top-k inner products over an impact-ordered score-at-a-time index.

Vectors are floored to integers.  Candidates are dealt by a hash of their row into blocks;
each block indexes its postings in segments of equal quantised impact (the magnitude of a
component), one posting list per dimension, and keeps for every vector the norm of what
each level has not explained yet.  A block's queries are scored segment by segment in
descending impact.  After each level, Cauchy-Schwarz bounds each score from both sides; a
query stops only when the vectors that may still belong to its k best are few, because all
others are then proven out.  Those left are rescored exactly, and the blocks' winners meet
in a window per query.

Queries (a stated set, a fixed share of all rows) meet all rows in blocks: candidates are
repeated once per query block of `query_block` rows, never per query.

Edge cases: vectors that are null or hold null, NaN or infinite components, and rows
without an id, take no part; missing trailing components count as 0; every row that repeats
an id is a candidate, and a query with results of its own (its copies are candidates of it);
further columns are ignored; fewer than k candidates give as many rows; ties go to
the smaller id; scores saturate at the range of long; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEVELS, SCALE = 12, 1024


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, saturated to long."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[-1])
    if top < 2**52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    lim = 2**63 - 1
    qs = [int(v) for v in q]
    return np.array([max(-lim, min(lim, sum(a * int(b) for a, b in zip(qs, row)))) for row in x], np.int64)


class ImpactIndex:
    """Segments of one block in descending quantised impact."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x = x
        mag = np.abs(x)
        self.step = max(1.0, float(mag.max(initial=0)) / levels)
        level = np.minimum(np.ceil(mag / self.step), levels).astype(np.int16)
        approx, self.segments = np.zeros_like(x), []
        for lv in range(levels, 0, -1):
            posts, at = [], level == lv
            value = (lv - 0.5) * self.step  # the impact that stands for this level
            approx = np.where(at, np.sign(x) * value, approx)
            for d in np.flatnonzero(at.any(0)):
                rows = np.flatnonzero(at[:, d])
                posts.append((d, rows, np.sign(x[rows, d]) * value))
            self.segments.append((posts, np.sqrt(((x - approx) ** 2).sum(1)) * (1 + 1e-9) + 1e-6))

    def members(self, q: np.ndarray, k: int, few: int) -> list[np.ndarray]:
        """For each query row, the vectors that may be among its k best: a proven superset."""
        n, live, found = len(self.x), np.arange(len(q)), [None] * len(q)
        if float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, q.shape[1]) >= 2**50:
            return [np.arange(n)] * len(q)  # bounds in floating point prove nothing here
        acc, norm = np.zeros((len(q), n)), np.sqrt((q**2).sum(1)) * (1 + 1e-9)
        for i, (posts, left) in enumerate(self.segments):
            part = acc[live]
            for d, rows, impact in posts:
                part[:, rows] += q[live, d][:, None] * impact
            acc[live] = part
            slack = norm[live][:, None] * left
            low = part - slack
            kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else low.min(1)
            may = part + slack >= kth[:, None] - 1e-6
            last = i == len(self.segments) - 1
            done = (may.sum(1) <= few) | last
            for r in np.flatnonzero(done):
                found[live[r]] = np.flatnonzero(may[r])
            live = live[~done]
            if not len(live):
                break
        return [f if f is not None else np.arange(n) for f in found]


def valid(df: DataFrame, vec_id: str, vec: str) -> DataFrame:
    ok = F.col(vec_id).isNotNull() & F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # floor() gives a long; what does not fit is kept as a double, scores saturate
    big = F.transform(vec, lambda x: F.when(F.abs(x.cast("double")) < 2.0**50, F.floor(F.when(F.abs(x.cast("double")) < 2.0**50, x.cast("double")).otherwise(0.0) * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), big.alias("v"))


def search(df: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding", block: int = 2048, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where `is_query` (a Column on vec_id) holds."""
    rows = valid(df, vec_id, vec)
    # written once, so that a row keeps its number: rows that repeat an id are told apart by it
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    n, nq = rows.count(), rows.filter(is_query).count()
    blocks, qblocks = max(1, -(-n // block), min(96, -(-n // 128))), max(1, -(-nq // query_block))
    cand = rows.withColumn("cb", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    cand = cand.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1)))) if qblocks > 1 else cand.withColumn("qb", F.lit(0))
    q = rows.filter(is_query).withColumn("qb", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(qblocks)).cast("int"))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def dense(pdf):
        pdf = pdf.assign(v=[tuple(v) for v in pdf["v"]]).sort_values(["vec_id", "v"], kind="stable")
        return pdf["vec_id"].to_numpy(np.int64), list(pdf["v"]), pdf["row"].to_numpy(np.int64)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [], [], [], []
        if len(a) and len(b):
            (ci, cv, cr), (qi, qv, qr) = dense(a), dense(b)
            dim = max(max(map(len, cv)), max(map(len, qv)), 1)
            x, y = (np.array([(*v, *[0.0] * (dim - len(v))) for v in m]) for m in (cv, qv))
            index = ImpactIndex(x)
            members = index.members(y, min(k + 1, len(ci)), max(4 * k, len(ci) // 16))
            for i, m in enumerate(members):
                m = m[cr[m] != qr[i]]
                s = exact_scores(y[i], x[m])
                top = np.lexsort((ci[m], -s))[:k] if len(m) else np.array([], int)
                out[0].extend([qi[i]] * len(top))
                out[1].extend(ci[m][top])
                out[2].extend(s[top])
                out[3].extend([qr[i]] * len(top))
        return pd.DataFrame({n: np.array(v, np.int64) for n, v in zip(("query_id", "vec_id", "score", "row"), out)})

    part = cand.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInPandas(run, "query_id long, vec_id long, score long, row long")
    w = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rn AS qn, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.rn <> c.rn WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""
