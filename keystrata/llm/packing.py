"""Packing of token documents into fixed windows by minimum bin slack.

Every document becomes its token ids plus one separator id.  Its full windows stand
alone; the rests are packed per hash group.  For each window the largest rest is placed,
then a bitset subset-sum dynamic program over the *remaining-length multiset* picks the
counts that come closest to the capacity, which are read off by backtracking.  A window
that no multiset fills exactly takes the head of the next largest rest (documents may be
cut), so only a group's last window is short; it is cut into power-of-two sequences,
which need no padding.

Groups are dealt by a hash of the row and its place in its Arrow batch (files are read again
in the same order), about `group_docs` documents each, so neither rows that repeat, with or
without an id, nor a hot source, nor a very long document loads one task: a long document
travels as one row holding a checksum per full window and the ids of its rest only.

Edge cases: a null or empty text is the separator alone (one piece of length 1); an empty
table gives no rows; repeated rows are packed one by one; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

WINDOW = 1024
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


@lru_cache(maxsize=2)
def encoder(vocab: str):
    """text -> ids as the tokenizers library gives for `vocab` (a tokenizer.json of a
    byte-level BPE).  The rank table beside it runs the same merges several times faster;
    texts that hold a special token's own string go through the library itself."""
    import base64
    import os

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocab)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks = vocab.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda s: slow.encode(s, add_special_tokens=False).ids
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def run(s: str):
        if any(t in s for t in special):
            return slow.encode(s, add_special_tokens=False).ids
        return fast.encode_ordinary(s)

    return run


def tokenise(docs: DataFrame, vocab: str, separator: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, doc_tokens, crcs of the full windows, rest (uint32 ids),
    place (row of the Arrow batch)."""

    def run(batches):
        encode = encoder(vocab)
        for b in batches:
            keys, it = texts(b)
            out = [], [], []
            for s in it:
                ids = np.array([*encode(s), separator], dtype="<u4")
                full = len(ids) // window
                out[0].append(len(ids))
                out[1].append([zlib.crc32(ids[k * window:(k + 1) * window].tobytes()) for k in range(full)])
                out[2].append(ids[full * window:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary()), pa.array(range(b.num_rows), pa.int32())],
                ["doc_id", "doc_tokens", "crcs", "rest", "place"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, rest binary, place int")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how many of each whose sum comes closest to `capacity` without passing it.

    Bit s of `reach` says that sum s can be made from the lengths seen so far.  Counts are
    split in powers of two, so each step is one shift; the states before each step allow
    the choice to be traced back.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for size in sorted((s for s in counts if s <= capacity), reverse=True):
        left, k = min(counts[size], capacity // size), 1
        while left:
            k = min(k, left)
            steps.append((size, k, reach))
            reach |= (reach << size * k) & mask
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            at -= size * k
            chosen[size] = chosen.get(size, 0) + k
    return chosen


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece of items of 1..window tokens."""
    by, out, seq = {}, [], 0
    for i in sorted(range(len(lengths)), reverse=True):
        by.setdefault(lengths[i], []).append((i, 0))

    def take(size: int) -> tuple[int, int]:
        got = by[size].pop()
        if not by[size]:
            del by[size]
        return got

    while by:
        size = max(by)
        pieces = [(*take(size), size)]
        room = window - size
        if room:
            for s, k in sorted(best_fill({s: len(v) for s, v in by.items()}, room).items(), reverse=True):
                for _ in range(k):
                    pieces.append((*take(s), s))
                    room -= s
        if room and by:  # every rest is longer than the room or no multiset fits: cut the largest
            size = max(by)
            i, start = take(size)
            cut = min(room, size)
            pieces.append((i, start, cut))
            room -= cut
            if cut < size:
                by.setdefault(size - cut, []).append((i, start + cut))
        total, limits = window - room, []
        if room:
            limits = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        else:
            limits = [window]
        offset = 0
        for i, start, n in pieces:
            while n:
                cut = min(n, limits[0] - offset)
                out.append((i, start, cut, seq, offset))
                start, n, offset = start + cut, n - cut, offset + cut
                if offset == limits[0]:
                    limits.pop(0)
                    seq, offset = seq + 1, 0
    return out


def pack(tokens: DataFrame, n_docs: int, window: int = WINDOW, group_docs: int = 1000) -> DataFrame:
    """Pieces of tokenised documents (see `tokenise`)."""
    groups = max(1, -(-n_docs // group_docs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "doc_tokens", "rest"], kind="stable", na_position="first")
        base, rows, rest = int(pdf["g"].iloc[0]) << 32, [], []
        for doc, n, crcs, ids in zip(pdf["doc_id"], pdf["doc_tokens"], pdf["crcs"], pdf["rest"]):
            for k, crc in enumerate(crcs):
                rows.append((doc, k * window, window, crc, n, base, 0))
                base += 1
            if len(ids):
                rest.append((doc, n, len(crcs) * window, np.frombuffer(ids, "<u4")))
        for i, start, size, seq, offset in pack_lengths([len(x[3]) for x in rest], window):
            doc, n, first, ids = rest[i]
            rows.append((doc, first + start, size, zlib.crc32(ids[start:start + size].tobytes()), n, base + seq, offset))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({c: "int64" for c in out.columns if c != "doc_id"}).astype({"doc_id": "Int64"})

    g = F.pmod(F.xxhash64("doc_id", "doc_tokens", "rest", "crcs", "place"), F.lit(groups))
    return tokens.withColumn("g", g).drop("place").groupBy("g").applyInPandas(run, PIECES)


def pack_documents(docs: DataFrame, vocab: str, window: int = WINDOW) -> DataFrame:
    return pack(tokenise(docs, vocab, window=window), docs.count(), window)
