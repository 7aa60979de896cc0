"""Media columns: MPEG audio with lossless payloads.

`store` writes a payload as an MPEG-1 Layer III stream: an ID3v2 tag with the payload's
length and CRC-32, a frame with a Xing table (frames, bytes, 100 seek points), then
CRC-protected frames.  Their side information says that no audio data follows (silence),
so the rest of each frame is ancillary data, which carries the payload unchanged.

`parse` knows nothing of the writer: it reads ID3v2 tags, passes ID3v1 and APE tags between
frames or at the end, resynchronises on Layer III frame headers of MPEG-1, 2 and 2.5 (a sync
counts only if the next frame's header or a tag follows it or the stream ends), parses Xing,
Info and VBRI tables, verifies the CRC-16 of each frame over the side information that its
version and channel mode have, and gives exact duration (samples over rate) and the frames'
byte offsets.  Layers I and II are no frames here.

Edge cases: a null or empty text is a payload of 576 bytes 255; bytes that hold no frame
give no frames and an empty payload; a damaged frame is counted in `bad` and skipped; where
the rate changes, the duration is that of each frame's own rate; rows without an id and
repeated rows are kept one by one; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts

# Fixed values of the format: kbit/s of MPEG-1 Layer III, and sampling rates
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
# kbit/s of MPEG-2 and 2.5 Layer III, whose rates are a half and a quarter of the above
KBITS2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
SIDE, UNIT = 32, 576
HEAD = 4 + 2 + SIDE  # header, CRC-16, side information of two channels


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005, start 0xFFFF, as protects header and side information."""
    c = 0xFFFF
    for x in data:
        c ^= x << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
    return c


def frame_size(rate_index: int, kbit_index: int) -> int:
    return 144 * KBITS[kbit_index] * 1000 // RATES[rate_index]


def head(rate_index: int, kbit_index: int) -> bytes:
    """A CRC-protected stereo header without padding, its CRC and empty side information."""
    h = bytes([0xFF, 0xFA, kbit_index << 4 | rate_index << 2, 0])
    side = bytes(SIDE)
    return h + crc16(h[2:] + side).to_bytes(2, "big") + side


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + b"\xff" * ((-len(data)) % UNIT or (0 if data else UNIT))


def store(payload: bytes) -> bytes:
    """The stream that carries `payload`; the last frame takes the smallest sufficient bitrate."""
    r, big = 1, 14
    room = frame_size(r, big) - HEAD
    full, rest = divmod(len(payload), room)
    body = np.empty((full, room + HEAD), np.uint8)
    body[:, :HEAD] = np.frombuffer(head(r, big), np.uint8)
    body[:, HEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    frames = body.tobytes()
    if rest:
        k = next(k for k in range(1, 15) if frame_size(r, k) - HEAD >= rest)
        frames += (head(r, k) + payload[full * room:]).ljust(frame_size(r, k), b"\0")
    n, k = full + bool(rest), 7
    size = frame_size(r, k) + len(frames)
    seek = bytes(min(255, (frame_size(r, k) + min(n * p // 100, full) * (room + HEAD)) * 256 // size) for p in range(100))
    xing = (head(r, k) + b"Xing" + struct.pack(">III", 7, n, size) + seek).ljust(frame_size(r, k), b"\0")
    text = b"\0payload\0%d:%d" % (len(payload), zlib.crc32(payload))
    tag = b"TXXX" + synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + synchsafe(len(tag)) + tag + xing + frames


@dataclass(frozen=True)
class Header:
    size: int
    rate: int
    samples: int
    side: int
    protected: bool


@lru_cache(maxsize=4096)
def header_of(four: bytes) -> Header | None:
    version, kbit, rate = four[1] >> 3 & 3, four[2] >> 4, four[2] >> 2 & 3
    if four[0] != 0xFF or four[1] & 0xE6 != 0xE2 or version == 1 or kbit in (0, 15) or rate == 3:
        return None
    one, mono = version == 3, four[3] >> 6 == 3
    hz = RATES[rate] >> (0 if one else 1 if version == 2 else 2)
    samples = 1152 if one else 576
    size = samples // 8 * (KBITS if one else KBITS2)[kbit] * 1000 // hz + (four[2] >> 1 & 1)
    return Header(size, hz, samples, (17 if mono else 32) if one else (9 if mono else 17), not four[1] & 1)


def header(data: bytes, at: int) -> Header | None:
    """The Layer III header that starts at `at`."""
    return header_of(data[at:at + 4]) if at + 4 <= len(data) else None


def trailer(data: bytes, at: int) -> int:
    """Bytes of the ID3v1 or APE tag that starts at `at`, 0 if none does."""
    if data[at:at + 3] == b"TAG" and at + 128 == len(data):
        return 128
    if data[at:at + 8] == b"APETAGEX" and at + 32 <= len(data):
        size, flags = struct.unpack_from("<I4xI", data, at + 12)
        size += 32 if flags >> 29 & 1 else 0  # a header comes besides what the size counts
        return size if 32 <= size <= len(data) - at else 0
    return 0


def sync7(b: bytes) -> int:
    return sum((x & 127) << s for x, s in zip(b, (21, 14, 7, 0)))


def payload_mark(body: bytes, version: int) -> tuple[int, int] | None:
    """Length and CRC-32 from a tag's own text frame `payload`, if it has one."""
    at = 0
    while at + 10 <= len(body) and body[at]:
        size = sync7(body[at + 4:at + 8]) if version >= 4 else int.from_bytes(body[at + 4:at + 8], "big")
        value = body[at + 10:at + 10 + size].split(b"\0")
        if body[at:at + 4] == b"TXXX" and len(value) == 3 and value[1] == b"payload":
            m = re.fullmatch(rb"([0-9]{1,15}):([0-9]{1,10})", value[2])
            if m:
                return int(m[1]), int(m[2])
        at += 10 + size
    return None


def seek_table(frame: bytes, start: int) -> tuple | None:
    """(frames, bytes, seek points) of a first frame's Xing, Info or VBRI table; fields it does
    not have are null."""
    if frame[start:start + 4] in (b"Xing", b"Info") and len(frame) >= start + 8:
        flags, at, out = int.from_bytes(frame[start + 4:start + 8], "big"), start + 8, []
        for bit, size in ((1, 4), (2, 4), (4, 100)):
            part = frame[at:at + size] if flags & bit and at + size <= len(frame) else None
            at += size if flags & bit else 0
            out.append(part if part is None or size == 100 else int.from_bytes(part, "big"))
        return tuple(out)
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, n, entries, scale, width, per = struct.unpack_from(">IIHHHH", frame, 46)
        points = [int.from_bytes(frame[62 + k * width:62 + (k + 1) * width], "big") * scale for k in range(min(entries, (len(frame) - 62) // width if width else 0))]
        return n, size, points
    return None


def parse(data: bytes) -> dict:
    """frames (offsets), bad, samples, rate, seconds, tag and table values, payload."""
    at, mark, out = 0, None, {"offsets": [], "bad": 0, "skipped": 0, "rate": 0, "samples": 0, "seconds": Fraction(0), "table": None, "payload": b""}
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sync7(data[6:10])
        mark, at = payload_mark(data[10:10 + size], data[3]), 10 + size
    parts, synced, rates = [], False, Counter()
    while at < len(data):
        h = header(data, at)
        ok = h and at + h.size <= len(data)
        if ok and not synced:  # a sync word inside data is no header: ask for what follows
            nxt = at + h.size
            ok = nxt == len(data) or header(data, nxt) is not None or trailer(data, nxt) > 0
        if not ok:
            tag = trailer(data, at) if synced else 0
            if tag:
                at += tag
                continue
            synced, nxt = False, data.find(b"\xff", at + 1)
            nxt = len(data) if nxt < 0 else nxt
            out["skipped"] += nxt - at
            at = nxt
            continue
        synced, start = True, at + 4
        if h.protected:
            start = at + 6
            if crc16(data[at + 2:at + 4] + data[start:start + h.side]) != int.from_bytes(data[at + 4:at + 6], "big"):
                out["bad"] += 1
                at += h.size
                continue
        start += h.side
        out["rate"] = out["rate"] or h.rate
        table = seek_table(data[at:at + h.size], start - at) if not out["offsets"] and out["table"] is None else None
        if table:
            out["table"] = table
        else:
            out["offsets"].append(at)
            out["samples"] += h.samples
            rates[h.rate] += h.samples
            parts.append(data[start:at + h.size])
        at += h.size
    out["seconds"] = sum((Fraction(n, r) for r, n in rates.items()), Fraction(0))
    payload = b"".join(parts)
    if mark:
        payload = payload[:mark[0]]
        out["intact"] = len(payload) == mark[0] and zlib.crc32(payload) == mark[1]
    out["payload"] = payload
    return out


def feature(x: dict) -> str:
    """Frames, exact duration, table agreement, seek offsets (first, median, last) and checks."""
    o = x["offsets"]
    table = x["table"] is not None and x["table"][0] == len(o)
    seek = f"{o[0]}/{o[len(o) // 2]}/{o[-1]}" if o else "-"
    return f"frames={len(o)};duration={x['samples']}/{x['rate']};vbr={int(table)};seek={seek};bad={x['bad']};skipped={x['skipped']};intact={int(x.get('intact', False))}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the stored stream of every text."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                keys, it = texts(b.slice(k, 256))
                rows = [(len(s.encode()), store(payload_of(s))) for s in it]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, digest: bool = True) -> DataFrame:
    """Parses the stored bytes: payload (or its digests), duration, frame offsets, features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_s double" + ("" if digest else ", offsets array<long>, payload binary")

    def run(batches):
        for b in batches:
            keys, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for k, n, m in zip(keys, sizes, b.column(2)):
                m = m.as_py() or b""
                x = parse(m)
                p = x["payload"]
                rows.append((k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(x), len(x["offsets"]), float(x["seconds"]), *(() if digest else (x["offsets"], p))))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()] + ([] if digest else [pa.list_(pa.int64()), pa.binary()])
            names = [f.strip().split(" ")[0] for f in schema.split(",")]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
