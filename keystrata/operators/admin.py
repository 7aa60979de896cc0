"""Command table, configuration, clients and namespaces as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.commands import COMMANDS

# Key, kind, class, default
CONFIG = (
    ("appendonly", "enum", "boot", "no"), ("client-output-buffer-limit", "class", "hot-per-cell", "normal 0 0 0 slave 268435456 67108864 60 pubsub 33554432 8388608 60"),
    ("databases", "int", "boot", "16"), ("maxclients", "int", "boot", "10000"), ("maxmemory", "memory", "hot-per-cell", "0"), ("maxmemory-policy", "enum", "hot-per-cell", "noeviction"),
    ("maxmemory-samples", "int", "hot-per-cell", "5"), ("proto-max-bulk-len", "memory", "hot", "536870912"), ("save", "string", "hot", "3600 1 300 100 60 10000"), ("tcp-keepalive", "int", "hot", "300"), ("timeout", "int", "hot", "0"),
)
# What enum settings take, and the classes of client-output-buffer-limit in order
ENUMS = {"appendonly": ("no", "yes"), "maxmemory-policy": ("noeviction", "allkeys-lru", "volatile-lru", "allkeys-random", "volatile-random", "volatile-ttl", "allkeys-lfu", "volatile-lfu")}
CLASSES = ("normal", "slave", "pubsub")
NAMESPACE, RESERVED = "^[a-zA-Z0-9_.-]{1,128}$", "^db(0?[0-9]|1[0-5])$"


def registry() -> list[tuple[str, int, int, int, int]]:
    return list(COMMANDS)


def command_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry(), "name string, arity int, first int, last int, step int")


def accepted(log: DataFrame, table: DataFrame) -> DataFrame:
    """Adds error: UNKNOWN_COMMAND, ARITY or null, from the table's arity (name included)."""
    t = table.select(F.upper("name").alias("cmd"), "arity")
    n = F.size("args") + 1
    bad = F.when(F.col("arity").isNull(), "UNKNOWN_COMMAND").when((F.col("arity") >= 0) & (n != F.col("arity")), "ARITY").when((F.col("arity") < 0) & (n < -F.col("arity")), "ARITY")
    return log.withColumn("cmd", F.upper("cmd")).join(F.broadcast(t), "cmd", "left").withColumn("error", bad).drop("arity")


def keys_of(log: DataFrame, table: DataFrame) -> DataFrame:
    """seq, pos, key: the arguments that the key specification names."""
    t = table.select(F.upper("name").alias("cmd"), "first", "last", "step").filter("first > 0")
    x = log.withColumn("cmd", F.upper("cmd")).join(F.broadcast(t), "cmd").select("seq", "first", "last", "step", F.posexplode("args").alias("i", "key"))
    end = F.col("first").isNotNull() & ((F.col("last") < 0) | (F.col("i") + 1 <= F.col("last")))
    return x.filter((F.col("i") + 1 >= F.col("first")) & end & ((F.col("i") + 1 - F.col("first")) % F.col("step") == 0)).select("seq", F.col("i").alias("pos"), "key")


def config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIG, "name string, kind string, class string, value string")


def config_get(conf: DataFrame, *patterns: str) -> DataFrame:
    on = F.lit(False)
    for p in patterns:
        on = on | F.col("name").rlike(X.glob_regex(p, nocase=True))
    return conf.filter(on).select("name", "value")


def _groups(text):
    """array of struct(class, hard, soft, secs) of a client-output-buffer-limit text, null if it
    is none; `replica` is the class `slave`."""
    t = F.split(F.trim(text), r"\s+")
    n = F.size(t)

    def group(i):
        at = lambda k: F.get(t, (i * 4 + k).cast("int"))
        name = F.lower(at(0))
        return F.struct(F.when(name == "replica", "slave").otherwise(name).alias("name"), X.memory_bytes(at(1)).alias("hard"), X.memory_bytes(at(2)).alias("soft"), F.when(at(3).rlike("^[+]?[0-9]+$"), at(3).try_cast("bigint")).alias("secs"))

    out = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 4) - 1, F.lit(0)).cast("int")), group)
    good = F.forall(out, lambda g: g["name"].isin(*CLASSES) & g["hard"].isNotNull() & g["soft"].isNotNull() & g["secs"].isNotNull())
    return F.when((n % 4 == 0) & good, out)


def _judged(conf: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(seq, name, value) with new (the value to store, or the groups to merge) and error."""
    c = changes.withColumn("name", F.lower("name")).join(conf.withColumnRenamed("value", "old"), "name", "left")
    value = F.col("value")
    enums = F.lit(False)
    for name, tokens in ENUMS.items():
        enums = enums | ((F.col("name") == name) & F.lower(value).isin(*tokens))
    whole = F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("bigint")).cast("string")
    new = (F.when(F.col("kind") == "memory", X.memory_bytes(value).cast("string")).when(F.col("kind") == "int", whole).when(F.col("kind") == "enum", F.when(enums, F.lower(value)))
           .when(F.col("kind") == "class", F.when(_groups(value).isNotNull(), value)).otherwise(value))
    bad = F.when(F.col("kind").isNull(), "CONFIG_UNKNOWN").when(F.col("class") == "boot", "CONFIG_BOOT").when(F.col("new").isNull(), "CONFIG_INVALID")
    return c.withColumn("new", new).withColumn("error", bad)


def config_replies(conf: DataFrame, changes: DataFrame) -> DataFrame:
    """seq, error of each CONFIG SET: that of its first bad setting by name, null where it took effect."""
    return _judged(conf, changes).groupBy("seq").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("name"))).alias("error"))


def config_set(conf: DataFrame, changes: DataFrame) -> DataFrame:
    """name, value after changes(seq, name, value): all or nothing per seq, the last wins; of the
    output-buffer limits only the classes named change."""
    c = _judged(conf, changes)
    ok = c.join(config_replies(conf, changes).filter("error is null").select("seq"), "seq", "left_semi")
    last = ok.groupBy("name").agg(F.max_by("new", "seq").alias("new"))
    limits = ok.filter("kind = 'class'").select("seq", F.posexplode(_groups(F.col("value"))).alias("pos", "g"))
    old = conf.filter("kind = 'class'").select(F.lit(-1).alias("seq"), F.posexplode(_groups(F.col("value"))).alias("pos", "g"))
    by = old.unionByName(limits.select(F.col("seq"), "pos", "g"), allowMissingColumns=False).groupBy("g.name").agg(F.max_by("g", F.struct("seq", "pos")).alias("g"))
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("name"))
    text = F.concat_ws(" ", F.col("g.name"), F.col("g.hard").cast("string"), F.col("g.soft").cast("string"), F.col("g.secs").cast("string"))
    merged = by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), text.alias("t")))), lambda x: x["t"]), " ").alias("merged"))  # three rows
    out = conf.join(last, "name", "left").join(F.broadcast(merged))
    return out.select("name", F.when((F.col("kind") == "class") & F.col("new").isNotNull(), F.col("merged")).otherwise(F.coalesce("new", "value")).alias("value"))


def clients(log: DataFrame) -> DataFrame:
    return log.groupBy("conn").agg(F.count("*").alias("commands"), F.min("at_ms").alias("created_ms"), F.max("at_ms").alias("last_ms"), F.max_by("cmd", "seq").alias("last_cmd"))


def namespace_replies(events: DataFrame) -> DataFrame:
    """seq, name, error of events(seq, op, name, ...): a name is created once and dropped once;
    db0 to db15 are always there and can be neither."""
    w = Window.partitionBy("name").orderBy("seq")
    create, before = F.col("op") == "CREATE", F.lag("op").over(w)  # whatever it answered, it stands after a CREATE
    bad = (F.when(create & ~F.col("name").rlike(NAMESPACE), "INVALID_NAME").when(F.col("name").rlike(RESERVED), "RESERVED")
           .when(create & (before == "CREATE"), "EXISTS").when(~create & (F.coalesce(before, F.lit("DROP")) == "DROP"), "UNKNOWN"))
    return events.select("seq", "name", bad.alias("error"))


def namespaces(events: DataFrame) -> DataFrame:
    """name, maxmemory of those that stand after events(seq, op, name, maxmemory): a CREATE of a
    name that stands fails and leaves it as it is."""
    ok = events.filter(F.col("name").rlike(NAMESPACE) & ~F.col("name").rlike(RESERVED))
    dropped = F.coalesce(F.max(F.when(F.col("op") == "DROP", F.col("seq"))).over(Window.partitionBy("name")), F.lit(-1))
    own = ok.withColumn("dropped", dropped).filter("op = 'CREATE' and seq > dropped")
    return own.groupBy("name").agg(F.min_by("maxmemory", "seq").alias("maxmemory"))
