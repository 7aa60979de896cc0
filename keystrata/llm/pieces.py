"""SentencePiece encoding and decoding with byte spans of the source text.

Normalisation walks the text with the longest prefix found in the model's compiled
character map (a double-array trie followed by NUL-ended replacements) and records, for
each normalised byte, the byte of the source it came from; white space becomes U+2581 and
a dummy prefix is put in front where the model says so.  The library picks the pieces;
the running sum of their byte lengths in the normalised text is projected through the
recorded alignment to [begin, end) byte spans of the source.

Edge cases: a null or empty text has the begin and end ids alone; control ids have empty
spans; repeated rows are encoded one by one; very long texts are handled one at a time.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts

SPACE = "▁".encode()


class CharMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.text = blob[4 + size:] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest listed prefix of data[at:] and its length, or
        (the next character, its length) if none is listed."""
        found, n, units = None, 0, self.units
        if units:
            offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
            node = offset(units[0])
            for k in range(at, len(data)):
                node ^= data[k]
                if node >= len(units):
                    break
                u = units[node]
                if u & 0x800000FF != data[k]:
                    break
                node ^= offset(u)
                if u >> 8 & 1:
                    found, n = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is not None:
            return self.text[found:self.text.index(b"\0", found)], n
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at:at + n], n


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map, self.prefix = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        # a byte piece stands for one byte, a control or unknown piece for none of its own
        self.sizes = np.array([{6: 1, 3: 0, 2: 0}.get(p.type, len(p.piece.encode())) for p in model.pieces])

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each boundary between them, the source byte offset."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.trim:  # identity map: only spaces change length
            raw = np.frombuffer(data, np.uint8)
            wide = np.where(raw == 32, 3, 1)
            starts = np.repeat(np.arange(len(raw)), wide)
            out, at = data.replace(b" ", SPACE), [starts]
            if self.prefix:
                out, at = SPACE + out, [np.zeros(3, np.int64), starts]
            return out, np.concatenate([*at, [len(data)]]).astype(np.int64)
        out, at, k = bytearray(), [], 0
        if self.prefix:
            out += SPACE
            at += [0] * 3
        while k < len(data):
            new, n = self.map.longest(data, k)
            if self.trim and new == b" " and (not out or out.endswith(SPACE)):
                k += n
                continue
            new = new.replace(b" ", SPACE)
            out += new
            at += [k] * len(new)
            k += n
        while self.trim and out.endswith(SPACE):
            del out[-3:], at[-3:]
        return bytes(out), np.array([*at, len(data)], np.int64)

    def encode(self, text: str) -> list[int]:
        return [self.sp.bos_id(), *self.sp.encode(text), self.sp.eos_id()]

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(begin, end) source bytes of each id."""
        normal, align = self.normalise(text)
        ends = np.cumsum(self.sizes[ids])
        if ends[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        begins = ends - self.sizes[ids]
        return np.stack([align[begins], align[ends]], 1)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends (byte spans), text (decoded); with `digest` the
    ids and the decoded text travel as SHA-256 only, and spans as the bytes they cover."""

    def run(batches):
        c = codec(model)
        for b in batches:
            keys, it = texts(b)
            rows = []
            for s in it:
                ids = c.encode(s)
                spans = c.spans(s, ids)
                back = c.sp.decode(ids)
                raw = np.array(ids, "<u4").tobytes()
                if digest:
                    rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest()))
                else:
                    rows.append((len(ids), ids, spans[:, 0].tolist(), spans[:, 1].tolist(), back))
            cols = list(zip(*rows)) or [()] * (4 if digest else 5)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()] if digest else [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"] if digest else ["n_tokens", "ids", "begins", "ends", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(list(x), k) for x, k in zip(cols, kinds))], ["doc_id", *names])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" if digest else "doc_id long, n_tokens long, ids array<int>, begins array<long>, ends array<long>, text string"
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
