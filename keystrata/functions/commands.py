"""The command table: plain values, no Spark."""

# Name, arity (negative: at least, the name included), first key, last key, key step
COMMANDS = (
    ("get", 2, 1, 1, 1),
    ("set", -3, 1, 1, 1),
    ("setnx", 3, 1, 1, 1),
    ("setex", 4, 1, 1, 1),
    ("psetex", 4, 1, 1, 1),
    ("getset", 3, 1, 1, 1),
    ("getdel", 2, 1, 1, 1),
    ("del", -2, 1, -1, 1),
    ("exists", -2, 1, -1, 1),
    ("type", 2, 1, 1, 1),
    ("incr", 2, 1, 1, 1),
    ("decr", 2, 1, 1, 1),
    ("incrby", 3, 1, 1, 1),
    ("decrby", 3, 1, 1, 1),
    ("append", 3, 1, 1, 1),
    ("strlen", 2, 1, 1, 1),
    ("expire", -3, 1, 1, 1),
    ("pexpire", -3, 1, 1, 1),
    ("ttl", 2, 1, 1, 1),
    ("pttl", 2, 1, 1, 1),
    ("persist", 2, 1, 1, 1),
    ("mget", -2, 1, -1, 1),
    ("mset", -3, 1, -1, 2),
    ("msetnx", -3, 1, -1, 2),
    ("getrange", 4, 1, 1, 1),
    ("setrange", 4, 1, 1, 1),
    ("getex", -2, 1, 1, 1),
    ("incrbyfloat", 3, 1, 1, 1),
    ("substr", 4, 1, 1, 1),
    ("rename", 3, 1, 2, 1),
    ("renamenx", 3, 1, 2, 1),
    ("copy", -3, 1, 2, 1),
    ("touch", -2, 1, -1, 1),
    ("unlink", -2, 1, -1, 1),
    ("dbsize", 1, 0, 0, 0),
    ("keys", 2, 0, 0, 0),
    ("randomkey", 1, 0, 0, 0),
    ("scan", -2, 0, 0, 0),
    ("flushdb", -1, 0, 0, 0),
    ("flushall", -1, 0, 0, 0),
    ("object", -2, 2, 2, 1),
    ("select", 2, 0, 0, 0),
    ("ping", -1, 0, 0, 0),
    ("echo", 2, 0, 0, 0),
    ("hello", -1, 0, 0, 0),
    ("quit", -1, 0, 0, 0),
    ("info", -1, 0, 0, 0),
    ("command", -1, 0, 0, 0),
    ("debug", -2, 0, 0, 0),
    ("config", -2, 0, 0, 0),
    ("client", -2, 0, 0, 0),
    ("lolwut", -1, 0, 0, 0),
    ("expireat", -3, 1, 1, 1),
    ("pexpireat", -3, 1, 1, 1),
    ("expiretime", 2, 1, 1, 1),
    ("pexpiretime", 2, 1, 1, 1),
    ("subscribe", -2, 0, 0, 0),
    ("unsubscribe", -1, 0, 0, 0),
    ("psubscribe", -2, 0, 0, 0),
    ("punsubscribe", -1, 0, 0, 0),
    ("publish", 3, 0, 0, 0),
    ("pubsub", -2, 0, 0, 0),
)
# Commands refused while memory is short
DENY_OOM = ("set", "setnx", "setex", "psetex", "getset", "incr", "decr", "incrby", "decrby", "append", "mset", "msetnx", "setrange", "incrbyfloat", "copy")
