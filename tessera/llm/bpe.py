"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

``model_bytes`` writes a sentencepiece BPE model straight from a rank file:
every byte string becomes a piece of one printable character per byte, scored
by its negative rank, with identity normalisation and no white-space rules.
The piece's id is its rank, so encoding gives the ids of the rank file.  Texts
are cut into pre-tokens by the given pattern and each is encoded by itself;
decoding maps ids back to pieces and pieces back to bytes.

Defined results: null text reads as empty and has no ids.  Repeated rows are
encoded alike, an empty table gives an empty result, and only the two named
columns are read, so other columns may have any name.  Texts are encoded
whole; a worker keeps at most ``CACHE`` encoded pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, prepare, whole_text

#: First character used for bytes: byte b is written as chr(FIRST + b).
FIRST = 0x100
CACHE = 200_000
_NORMAL, _UNKNOWN = 1, 2
_BPE = 2


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in order of rank (0, 1, 2, ...)."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_PIECE)


def as_bytes(piece: str) -> bytes:
    return piece.translate(_TO_BYTE).encode("latin-1")


_TO_PIECE = {b: FIRST + b for b in range(256)}
_TO_BYTE = {FIRST + b: b for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece model (protocol buffer) with one piece per token."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = _message(1, as_piece(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank)
        out += _message(1, piece + _number(3, _NORMAL))
    unknown = _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0)
    out += _message(1, unknown + _number(3, _UNKNOWN))
    n = len(tokens) + 1
    # trainer: model type, vocabulary size, <unk> after the tokens, no <s>, </s>, padding
    minus_one = (1 << 64) - 1
    out += _message(2, _number(3, _BPE) + _number(4, n) + _number(40, n - 1)
                    + _number(41, minus_one) + _number(42, minus_one) + _number(43, minus_one))
    # normaliser: identity, no dummy prefix, spaces neither removed nor escaped
    out += _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.sp.unk_id()
        self.find = regex.compile(pattern).findall
        self.tokens = [as_bytes(self.sp.id_to_piece(i)) for i in range(self.unknown)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.seen: dict[str, bytes] = {}

    def _encode(self, pre: str) -> bytes:
        raw = pre.encode()
        at = self.whole.get(raw)
        ids = [at] if at is not None else self.sp.encode(as_piece(raw))
        if len(self.seen) >= CACHE:
            self.seen.clear()
        packed = self.seen[pre] = np.asarray(ids, "<u4").tobytes()
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        get, new = self.seen.get, self._encode
        return b"".join([get(x) or new(x) for x in self.find(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _codec(spark: SparkSession, path: str, pattern: str):
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(path)))
    return lambda: Codec(model.value, pattern)


def _texts(b, col: str) -> list[str]:
    return [x or "" for x in b.column(col).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text",
           ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array of int) in place of any of that name."""
    codec = _codec(prepare(docs.sparkSession), path, pattern)
    keep = [c for c in docs.columns if c.lower() != ids.lower()]

    def make():
        encode_one = codec().encode

        def run(b):
            packed = [np.frombuffer(encode_one(x), "<i4") for x in _texts(b, text)]
            ends = np.cumsum([0, *map(len, packed)], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(packed)))]

        return run

    return map_arrow(docs, make, [(ids, "array<int>")], keep)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids",
           out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids (null ids: none) in column ``out``."""
    codec = _codec(prepare(rows.sparkSession), path, pattern)
    keep = [c for c in rows.columns if c.lower() != out.lower()]

    def make():
        decode_one = codec().decode
        return lambda b: [pa.array([decode_one(np.asarray(x or [], "<u4").tobytes())
                                    for x in b.column(ids).to_pylist()], pa.binary())]

    return map_arrow(rows, make, [(out, "binary")], keep)


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the
    bytes that they decode to."""
    codec = _codec(prepare(docs.sparkSession), path, pattern)

    def make():
        c = codec()

        def run(b):
            packed = [c.encode(x) for x in _texts(b, "text")]
            return [pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in packed])]

        return run

    src = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    return map_arrow(src, make, [("n_tokens", "long"), ("ids_sha256", "string"),
                                 ("decoded_sha256", "string")], ["doc_id"])
