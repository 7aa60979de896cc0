"""Wire format of commands and replies: source of framed or inline commands, reply rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FRAME, MAX_ARGS = 1 << 20, 1024
PARSED = "conn long, n long, args array<binary>, error string"


def frames(args) -> object:
    """Column: the framed form (array of bulk strings) of an array<binary> column."""
    head = lambda mark, n: F.concat(F.lit(mark), n.cast("string"), F.lit("\r\n")).cast("binary")
    bulk = F.transform(args, lambda a: F.concat(head("$", F.octet_length(a)), a, F.lit("\r\n").cast("binary")))
    return F.aggregate(bulk, head("*", F.size(args)), lambda out, b: F.concat(out, b))


class Reader:
    """Commands of one connection, fed in chunks of any size; an error ends it."""

    def __init__(self):
        self.buf, self.error = b"", None

    def feed(self, data: bytes) -> list[list[bytes]]:
        self.buf += data
        out = []
        while self.error is None and self.buf:
            got = self._framed() if self.buf[:1] == b"*" else self._inline()
            if got is None:
                break
            if got:
                out.append(got)
        return out

    def _number(self, at: int, mark: bytes, most: int, code: str):
        """(value, end) of a length line at `at`, None if it is not whole yet."""
        end = self.buf.find(b"\r\n", at)
        if end < 0:
            if len(self.buf) - at > 32:
                self.error = code
            return None
        text = self.buf[at + 1:end]
        if self.buf[at:at + 1] != mark:
            self.error = "EXPECTED_BULK"
        elif not text.lstrip(b"-").isdigit() or int(text) > most:
            self.error = code
        return None if self.error else (int(text), end + 2)

    def _framed(self):
        head = self._number(0, b"*", MAX_ARGS, "BAD_MULTIBULK_LENGTH")
        if head is None:
            return None
        n, at, args = *head, []
        for _ in range(max(n, 0)):
            if at >= len(self.buf):
                return None
            size = self._number(at, b"$", MAX_FRAME, "BAD_BULK_LENGTH")
            if size is None:
                return None
            if size[0] < 0:
                self.error = "BAD_BULK_LENGTH"
                return None
            stop = size[1] + size[0]
            if len(self.buf) < stop + 2:
                return None
            if self.buf[stop:stop + 2] != b"\r\n":
                self.error = "MISSING_CRLF"
                return None
            args.append(self.buf[size[1]:stop])
            at = stop + 2
            if at > MAX_FRAME:
                self.error = "FRAME_TOO_LARGE"
                return None
        self.buf = self.buf[at:]
        return args

    def _inline(self):
        end = self.buf.find(b"\n")
        if end < 0:
            if len(self.buf) > MAX_FRAME:
                self.error = "FRAME_TOO_LARGE"
            return None
        line, self.buf = self.buf[:end], self.buf[end + 1:]
        return line.split()


def commands(chunks: DataFrame) -> DataFrame:
    """conn, n, args, error of chunks(conn, pos, data): each connection is read in order; a
    protocol error is its last row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, rows = Reader(), []
        conn = int(pdf["conn"].iloc[0])
        for data in pdf.sort_values("pos")["data"]:
            for args in r.feed(bytes(data)):
                rows.append((conn, len(rows), args, None))
            if r.error:
                rows.append((conn, len(rows), None, r.error))
                break
        return pd.DataFrame(rows, columns=["conn", "n", "args", "error"])

    return chunks.groupBy("conn").applyInPandas(run, PARSED)


def inline(lines: DataFrame) -> DataFrame:
    """seq, cmd, args (text) of lines(seq, line); blank lines give nothing."""
    parts = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    x = lines.select("seq", parts.alias("p")).filter(F.size("p") > 0)
    return x.select("seq", F.upper(F.get("p", F.lit(0))).alias("cmd"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("args"))


def render(kind, int_val, bulk_val, text, resp: int = 2):
    """Reply bytes as text in protocol 2 or 3."""
    null = "$-1\r\n" if resp == 2 else "_\r\n"
    return (F.when(kind == "int", F.concat(F.lit(":"), int_val.cast("string"), F.lit("\r\n"))).when(kind == "null", null)
            .when(kind == "bulk", F.concat(F.lit("$"), F.octet_length(bulk_val).cast("string"), F.lit("\r\n"), bulk_val.cast("string"), F.lit("\r\n")))
            .when(kind == "simple", F.concat(F.lit("+"), text, F.lit("\r\n"))).otherwise(F.concat(F.lit("-ERR "), text, F.lit("\r\n"))))
