"""Chat formatting with tool-call linking.

A call is the JSON object between <tool_call> and </tool_call> in a message: id, name,
arguments.  A result is the one between <tool_result> and </tool_result>, or the text of a
message of role tool that is such an object: id (or tool_call_id), content.  Calls and
results of a conversation meet in a hash join on (conv_id, id).  A call depends on each
call whose result it names as "$id" in its arguments; calls are ordered topologically,
round by round (as many rounds as the longest chain), so a conversation of any length is
never gathered in one task.  Arguments are validated against JSON schemas, and every item
is serialised as canonical JSON: sorted keys, no white space, UTF-8.

Result, one row per item: conv_id, turn, kind (message, call, result), call_id, level
(topological, null on a cycle or an unknown reference), linked, valid, json.

Edge cases: null texts are empty; what is not a JSON object as RFC 8259 has it (NaN and
Infinity, numbers of more than MAX_DIGITS digits, nesting beyond MAX_NESTING levels) stays
part of its message; lone surrogates become U+FFFD; a call without a result is unlinked, a
result without a call is a row of its own; items without an id (absent, null or not a string
or number) have a null call_id and link with nothing; of calls or results that share an id in
one conversation only the first (by turn, place, then json) links and has a level, the others
are unlinked; a null conv_id is a conversation like any other; without a schema for its name,
or with one of unknown types, a call is not valid; an empty table gives no rows; repeated
rows give repeated messages, and their items count as repeated ids; further columns are
ignored.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

ITEM = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
REF = re.compile(r"^\$(.+)$", re.S)
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Tools of the production query.
SCHEMAS = {"search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False}}


MAX_DIGITS, MAX_NESTING = 1000, 200


def canonical(x) -> str:
    s = json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _refuse(text: str):
    raise ValueError(text)


def _integer(text: str) -> int:
    return int(text) if len(text) <= MAX_DIGITS else _refuse(text)


def _real(text: str) -> float:
    x = float(text)
    return x if abs(x) < float("inf") else _refuse(text)


def deep(text: str) -> bool:
    """Whether brackets outside strings nest beyond MAX_NESTING."""
    level = 0
    for m in re.finditer(r'"(?:[^"\\\\]|\\\\.)*"|[\[{]|[\]}]', text, re.S):
        c = m[0][0]
        level += (c in "[{") - (c in "]}")
        if level > MAX_NESTING:
            return True
    return False


def parse(text: str) -> dict | None:
    """The JSON object that `text` is, else None."""
    try:
        x = None if deep(text) else json.loads(text, parse_constant=_refuse, parse_int=_integer, parse_float=_real)
    except ValueError:
        return None
    return x if isinstance(x, dict) else None


def name_of(x: dict, *keys: str) -> str | None:
    """The id under the first of `keys` that is there."""
    v = next((x[k] for k in keys if k in x), None)
    return canonical(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else canonical(v)[1:-1] if isinstance(v, str) else None


def validates(x, schema: dict) -> bool:
    """Types, enum, properties, required, additionalProperties and items of JSON Schema."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(isinstance(x, TYPES.get(k, ())) and not (isinstance(x, bool) and k in ("integer", "number")) for k in kinds):
            return False
    if "enum" in schema and x not in schema["enum"]:
        return False
    if isinstance(x, dict):
        own = schema.get("properties", {})
        if any(k not in x for k in schema.get("required", ())):
            return False
        if any(k not in own and schema.get("additionalProperties") is False for k in x):
            return False
        return all(validates(v, own[k]) for k, v in x.items() if k in own)
    if isinstance(x, list) and "items" in schema:
        return all(validates(v, schema["items"]) for v in x)
    return True


def references(x) -> set[str]:
    if isinstance(x, str):
        m = REF.match(x)
        return {canonical(m[1])[1:-1]} if m else set()
    if isinstance(x, dict):
        x = list(x.values())
    return set().union(*map(references, x)) if isinstance(x, list) and x else set()


def items_of(role: str, text: str, schemas: dict) -> list[tuple]:
    """(place, kind, call_id, deps, valid, json) of a message and what it holds."""
    found, plain, last = [], [], 0
    for n, m in enumerate(ITEM.finditer(text), 1):
        x = parse(m[2])
        if x is None:
            continue
        plain.append(text[last:m.start()])
        last = m.end()
        if m[1] == "call":
            args = x.get("arguments", {})
            ok = isinstance(x.get("name"), str) and x["name"] in schemas and validates(args, schemas[x["name"]])
            found.append((n, "call", name_of(x, "id"), sorted(references(args)), ok, canonical(x)))
        else:
            found.append((n, "result", name_of(x, "id", "tool_call_id"), [], True, canonical(x)))
    plain.append(text[last:])
    rest = "".join(plain)
    if role == "tool" and not found:
        x = parse(rest)
        if x is not None:
            return [(0, "result", name_of(x, "id", "tool_call_id"), [], True, canonical(x))]
    return [(0, "message", None, [], True, canonical({"content": rest, "role": role})), *found]


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    schemas = SCHEMAS if schemas is None else schemas

    def run(pdfs):
        for pdf in pdfs:
            rows = [(c, t, *i) for c, t, r, x in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"]) for i in items_of(r or "", x or "", schemas)]
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "place", "kind", "call_id", "deps", "valid", "json"])
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    schema = "conv_id long, turn long, place int, kind string, call_id string, deps array<string>, valid boolean, json string"
    items = saved(messages.select("conv_id", "turn", "role", "text").mapInPandas(run, schema))  # texts are parsed once
    plain = items.filter("kind = 'message'").select("conv_id", "turn", "kind", "call_id", F.lit(0).alias("level"), F.lit(False).alias("linked"), "valid", "json")
    # null conversations are one too; of items that share an id the first one stands for it, so
    # that whatever is joined by id has each id once, however often it repeats
    tools = items.filter("kind <> 'message'").withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))
    tools = saved(tools.withColumn("n", F.monotonically_increasing_id()))
    firsts = tools.filter("call_id is not null").groupBy("c", "kind", "call_id").agg(F.min(F.struct("turn", "place", "json", "n")).alias("x")).select("x.n", F.lit(True).alias("first"))
    tools = saved(tools.join(firsts, "n", "left").withColumn("first", F.coalesce("first", F.lit(False))))
    calls = tools.filter("first and kind = 'call'").select("c", "call_id", "deps")
    edges = saved(calls.select("c", "call_id", F.explode(F.array_distinct("deps")).alias("dep")))
    level = saved(calls.filter(F.size("deps") == 0).select("c", "call_id", F.lit(0).alias("level")))
    if not edges.isEmpty():
        level = levels(edges, level)
    results = tools.filter("first and kind = 'result'").select("c", "call_id", F.lit(True).alias("has"))
    call = F.col("kind") == "call"
    known = tools.filter("first").join(level, ["c", "call_id"], "left").join(results, ["c", "call_id"], "left").join(calls.select("c", "call_id", F.lit(True).alias("called")), ["c", "call_id"], "left")
    known = known.withColumn("rank", F.when(call, F.col("level")).otherwise(F.col("level") + 1)).withColumn("linked", F.coalesce(F.when(call, F.col("has")).otherwise(F.col("called")), F.lit(False)))
    # without an id nothing can name a call: it has its place if it waits for nothing
    other = tools.filter("not first").withColumn("rank", F.when(call & F.col("call_id").isNull() & (F.size("deps") == 0), 0)).withColumn("linked", F.lit(False))
    own = ["conv_id", "turn", "kind", "call_id", F.col("rank").alias("level"), "linked", F.when(call, F.col("valid") & F.col("rank").isNotNull()).otherwise(F.col("valid")).alias("valid"), "json"]
    return plain.unionByName(known.select(*own)).unionByName(other.select(*own))


def levels(edges: DataFrame, level: DataFrame) -> DataFrame:
    """c, call_id, level by Kahn's rounds: a call is placed once all it names are.  One round a
    level of the longest chain; each touches only the edges of calls not placed yet."""
    wait, done = edges, level
    while True:
        got = wait.join(done.withColumnRenamed("call_id", "dep").withColumnRenamed("level", "at"), ["c", "dep"], "left").groupBy("c", "call_id").agg(F.max("at").alias("top"), F.count_if(F.col("at").isNull()).alias("open"))
        more = saved(got.filter("open = 0").select("c", "call_id", (F.col("top") + 1).alias("level")))
        if more.isEmpty():
            return done
        done = saved(done.unionByName(more))
        wait = saved(wait.join(more.select("c", "call_id"), ["c", "call_id"], "left_anti"))
