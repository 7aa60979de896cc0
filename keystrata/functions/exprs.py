"""Column expressions with the key/value semantics: strict numbers, byte ranges, slots, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384
INT = "^(0|-?[1-9][0-9]*)$"


def strict_int(c) -> Column:
    """bigint of canonical decimal text (no sign plus, leading zero, space or -0); else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(INT), c.try_cast("bigint"))


def checked_add(a, b) -> Column:
    """Sum, null on overflow of bigint."""
    return F.try_add(a, b)


def octets(c) -> Column:
    return F.octet_length(c).cast("bigint")


def byte_range(c, start, end) -> Column:
    """Bytes start..end inclusive; negatives count from the end; empty when inverted."""
    n = F.octet_length(c)
    lo = F.greatest(F.when(start < 0, n + start).otherwise(start), F.lit(0))
    hi = F.least(F.when(end < 0, n + end).otherwise(end), n - 1)
    return F.when((hi >= lo) & (n > 0), F.substring(c, (lo + 1).cast("int"), (hi - lo + 1).cast("int"))).otherwise(F.substring(c, 1, 0))


def overwrite(c, offset: Column, patch) -> Column:
    """Binary value with `patch` written at a byte offset, zero padded; an empty patch changes nothing."""
    padded = F.rpad(c, F.greatest(offset, F.octet_length(c)).cast("int"), F.unhex(F.lit("00")))
    done = F.concat(F.substring(padded, F.lit(1), offset.cast("int")), patch, F.substring(padded, (offset + F.octet_length(patch) + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.octet_length(patch) == 0, c).otherwise(done)


def encoding(value, raw=None) -> Column:
    """int, embstr (up to 44 bytes) or raw."""
    value = F.col(value) if isinstance(value, str) else value
    raw = F.lit(False) if raw is None else raw
    return F.when(raw, "raw").when(strict_int(value).isNotNull(), "int").when(F.octet_length(value) > 44, "raw").otherwise("embstr")


def refcount(value, raw=None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    shared = (encoding(value, raw) == "int") & strict_int(value).between(0, 9999)
    return F.when(shared, F.lit(2147483647).cast("bigint")).otherwise(F.lit(1).cast("bigint"))


def hash_tag(key) -> Column:
    """What is hashed: the text in the first braces if it is not empty, else the key."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def crc16(c) -> Column:
    """CRC-16/XMODEM of a string's bytes."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(c.cast("binary"), i, F.lit(1))), 16, 10).cast("int"))

    # x^16 + x^12 + x^5 + 1, a byte at a time without a table
    def quick(acc, x):
        t = F.shiftright(acc, 8).bitwiseXOR(x)
        t = t.bitwiseXOR(F.shiftright(t, 4))
        return F.shiftleft(acc, 8).bitwiseXOR(F.shiftleft(t, 12)).bitwiseXOR(F.shiftleft(t, 5)).bitwiseXOR(t).bitwiseAND(0xFFFF)

    return F.when(F.octet_length(c) == 0, F.lit(0)).otherwise(F.aggregate(bytes_, F.lit(0), quick))


def slot(key) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return crc16(hash_tag(key)) % SLOTS


def cell(slot_col, cells: int) -> Column:
    """Owner of a slot: contiguous ranges over `cells` shards."""
    return F.floor(slot_col * cells / SLOTS).cast("int")


def glob_regex(pattern: str, nocase: bool = False) -> str:
    """Java regex of a glob: * ? [..] [^..] ranges and backslash; an unterminated class runs
    to the end, a range may swallow the closing bracket, a trailing backslash is literal."""
    out, i, n = [], 0, len(pattern)
    lit = lambda ch: "\\x{%x}" % ord(ch)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "\\" and i < n:
            out.append(lit(pattern[i]))
            i += 1
        elif ch == "[":
            negated = i < n and pattern[i] == "^"
            i += negated
            parts = []
            while i < n and pattern[i] != "]":
                if pattern[i] == "\\" and i + 1 < n:
                    parts.append(lit(pattern[i + 1]))
                    i += 2
                elif i + 2 < n and pattern[i + 1] == "-":
                    a, b = sorted((pattern[i], pattern[i + 2]))
                    parts.append(f"{lit(a)}-{lit(b)}")
                    i += 3
                else:
                    parts.append(lit(pattern[i]))
                    i += 1
            i += 1
            body = "".join(parts)
            out.append(f"[{'^' if negated else ''}{body}]" if body else ("." if negated else "(?!)"))
        else:
            out.append(lit(ch))
    return f"(?s{'i' if nocase else ''})\\A{''.join(out)}\\z"


def memory_bytes(text) -> Column:
    """Bytes of a size like 64mb, 1k or 100; null if it is none (k is 1000, kb is 1024)."""
    t = F.lower(text)
    unit = F.regexp_extract(t, "^[+]?[0-9]+(b|k|kb|m|mb|g|gb)?$", 1)
    scale = F.lit(1).cast("bigint")
    for name, n in (("k", 10**3), ("kb", 1 << 10), ("m", 10**6), ("mb", 1 << 20), ("g", 10**9), ("gb", 1 << 30)):
        scale = F.when(unit == name, F.lit(n).cast("bigint")).otherwise(scale)
    return F.when(t.rlike("^[+]?[0-9]+(b|k|kb|m|mb|g|gb)?$"), F.try_multiply(F.regexp_extract(t, "[0-9]+", 0).try_cast("bigint"), scale))


def float_text(x) -> Column:
    """Shortest decimal text without exponent or trailing .0, for magnitudes below 1e20."""
    s = F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    return F.when(s == "-0", "0").otherwise(s)
