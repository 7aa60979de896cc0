"""Whole command logs: keys that commands tie together form components, each component is
folded in log order by one task, components run in parallel.

log: seq, at_ms, db, cmd, args array<binary>.  Result rows: replies (seq, pos, kind,
int_val, bulk_val, error) or the keyspace that stands after the log.

Only commands that name several keys go through the search for components; any other key is
a component of its own.  Rows are dealt and sorted by component, so a task streams through
them and holds the entries of one component at a time, never a component's commands.
Commands without a key (PING, unknown ones) are spread over SALTS components of their own.

Flushes reach every key: the flush commands, far fewer than the keys, are joined to each
component by an equi-join; the log is never gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commands import COMMANDS
from .engine import Keyspace

FLUSH, SALTS = ("FLUSHDB", "FLUSHALL"), 64
REPLY = "seq long, pos int, kind string, int_val long, bulk_val binary, error string"
STATE = "db int, key binary, value binary, version long, expire_at_ms long, raw boolean"
REPLY_ARROW = pa.schema([("seq", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("int_val", pa.int64()), ("bulk_val", pa.binary()), ("error", pa.string())])
STATE_ARROW = pa.schema([("db", pa.int32()), ("key", pa.binary()), ("value", pa.binary()), ("version", pa.int64()), ("expire_at_ms", pa.int64()), ("raw", pa.bool_())])
ROWS = 4096


def key_components(pairs: DataFrame) -> DataFrame:
    """(key, comp) for pairs(seq, key): keys of one command share a component; minimum
    labels spread until nothing changes (one round where commands name one key each)."""
    label = pairs.select("key", F.col("key").alias("comp")).distinct()
    while True:
        low = pairs.join(label, "key").groupBy("seq").agg(F.min("comp").alias("low"))
        new = pairs.join(low, "seq").groupBy("key").agg(F.min("low").alias("comp"))
        new = new.checkpoint() if new.sparkSession.sparkContext.getCheckpointDir() else new.cache()
        if new.join(label, ["key", "comp"], "left_anti").isEmpty():
            return new
        label = new


def named_keys(cmd: Column, args: Column) -> Column:
    """Distinct keys a command names, by the key specifications of the table; DEBUG OBJECT
    names its second argument."""
    specs: dict[tuple[int, int, int], list[str]] = {}
    for name, _, first, last, step in COMMANDS:
        if first:
            specs.setdefault((first, last, step), []).append(name.upper())
    out = F.when((cmd == "DEBUG") & (F.upper(F.get(args, F.lit(0)).cast("string")) == "OBJECT"), F.slice(args, 2, 1))

    def at(first, last, step):
        return lambda _, i: (i + 1 >= first) & ((i + 1 - first) % step == 0) & (F.lit(last < 0) | (i + 1 <= last))

    for spec, names in specs.items():
        out = out.when(cmd.isin(*names), F.filter(args, at(*spec)))
    return F.array_distinct(F.coalesce(out, F.array().cast("array<binary>")))


def with_components(log: DataFrame) -> DataFrame:
    """log with comp, the component its keys are in; no row is shuffled where every command
    names one key at most."""
    log = log.withColumn("named", named_keys(F.upper("cmd"), F.col("args")))
    spread = F.concat(F.lit("\0").cast("binary"), F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("string").cast("binary"))
    own = F.coalesce(F.get("named", F.lit(0)), spread)
    tied = log.filter(F.size("named") > 1).select("seq", F.explode("named").alias("key"))
    if tied.isEmpty():
        return log.withColumn("comp", own)
    comp = key_components(tied)
    return log.withColumn("key", own).join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key")).drop("key")


def _replay(log: DataFrame, emit: str) -> DataFrame:
    log = log.select("seq", "at_ms", "db", "cmd", "args")
    flushes = F.upper("cmd").isin(*FLUSH)
    work = with_components(log.filter(~flushes)).select("comp", "seq", "at_ms", "db", "cmd", "args")
    flush = log.filter(flushes)
    if not flush.isEmpty():
        # salted on both sides, so that no single key carries all of them
        every = work.select("comp").distinct().withColumn("salt", F.pmod(F.xxhash64("comp"), F.lit(SALTS)).cast("int"))
        dealt = flush.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        work = work.unionByName(every.join(dealt, "salt").select(*work.columns))
    schema = REPLY_ARROW if emit == "replies" else STATE_ARROW

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def answer(seq, kind, v):
        for pos, one in enumerate(v if kind == "array" else [v]):
            k = kind if kind != "array" else "null" if one is None else "int" if isinstance(one, int) else "bulk"
            yield (seq, pos, k, one if k == "int" else None, one if k == "bulk" else None, one if k in ("error", "simple") else None)

    def run(batches):
        ks, at, rows = Keyspace(), None, []
        standing = lambda: ((db, k, e.value, e.version, e.expire_at, e.raw) for (db, k), e in ks.data.items())
        for b in batches:
            for comp, seq, at_ms, db, cmd, args in zip(*(c.to_pylist() for c in b.columns)):
                if comp != at:
                    if emit == "state":
                        rows.extend(standing())
                    ks, at = Keyspace(), comp
                kind, v = ks.run(cmd, args, at_ms, db)
                if emit == "replies" and cmd.upper() not in FLUSH:
                    rows.extend(answer(seq, kind, v))
                if len(rows) >= ROWS:
                    yield table(rows)
                    rows = []
        if emit == "state":
            rows.extend(standing())
        if rows:
            yield table(rows)

    return work.repartition("comp").sortWithinPartitions("comp", "seq").mapInArrow(run, REPLY if emit == "replies" else STATE)


def replies(log: DataFrame) -> DataFrame:
    return _replay(log, "replies")


def keyspace(log: DataFrame, now_ms: int | None = None) -> DataFrame:
    state = _replay(log, "state")
    return state if now_ms is None else state.filter(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))
