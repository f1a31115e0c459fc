"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every token of the rank file becomes a piece: its bytes mapped to printable characters, scored by its
negative rank, so that sentencepiece merges pairs in rank order. The model has identity normalisation and
no white-space handling. Texts are cut by the pre-token pattern, each pre-token is encoded alone, and ids
are decoded by the inverse of the byte mapping.

A null text counts as empty (no ids, empty digest); texts of any length are handled whole; repeated rows
give repeated results; an empty table gives no rows. Only ``doc_id`` and the text column are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

CACHE = 300_000  # entries a Python worker keeps; more are computed anew


def byte_characters() -> list[str]:
    """A printable character per byte: itself where printable in Latin-1, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in lines if x.strip())}
    return [ranked[i] for i in range(len(ranked))]


def _varint(value: int) -> bytes:
    out = b""
    while value > 0x7F:
        out += bytes([value & 0x7F | 0x80])
        value >>= 7
    return out + bytes([value])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model: piece 0 is the unknown piece, piece i + 1 the token of rank i."""
    chars = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    for rank, token in enumerate(tokens):
        pieces.append(_field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)))
    trainer = _field(3, 2) + _field(4, len(pieces))  # model type BPE, vocabulary size
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to packed little-endian ids and decodes ids to bytes."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.chars = byte_characters()
        self.units = _Bounded(self._unit)
        self.pretokens = _Bounded(self._pretoken)

    def _pretoken(self, text: str) -> bytes:
        mapped = "".join([self.chars[b] for b in text.encode()])
        return np.asarray(self.processor.encode(mapped), np.uint32).__sub__(1).astype("<u4").tobytes()

    def _unit(self, text: str) -> bytes:
        return b"".join([self.pretokens[p] for p in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of the text. A pre-token can only begin where a single space follows a non-space, so single-spaced
        texts are looked up piece by piece; others go through the pattern whole."""
        first, *rest = text.split(" ")
        if not rest or any(not u or u[0].isspace() or u[-1].isspace() for u in rest) or not first or first[-1].isspace():
            return self._unit(text)
        return self.units[first] + b"".join([self.units[" " + u] for u in rest])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


class _Bounded(dict):
    """A lookup that computes what it lacks and forgets everything when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        value = self.make(key)
        if len(key) <= 64:  # long pre-tokens hardly repeat
            self[key] = value
        return value


_codecs: dict[str, Codec] = {}  # one codec per worker and model, kept between tasks


def _codec(key: str, model: bytes, tokens: list[bytes], pattern: str) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, tokens, pattern)
    return _codecs[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id",
                  text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; ``ids`` (array of int) with ``keep_ids``.

    ``vocabulary`` is read on the driver; its size is fixed, so the model is broadcast.
    """
    spark = docs.sparkSession
    tokens = read_ranks(vocabulary)
    model = sentencepiece_model(tokens)
    key = hashlib.sha256(model).hexdigest()
    shared = spark.sparkContext.broadcast((model, tokens))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, *shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [(ids := codec.encode(text or ""), codec.decode(ids)) for text in part.column(1).to_pylist()]
                columns = [
                    part.column(0),
                    pa.array([len(ids) // 4 for ids, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(back).hexdigest() for _, back in rows], pa.string()),
                ]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(id_column, text_column).mapInArrow(encode, schema)
