"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's last piece goes to the open window that it fits
best; when none fits and no more may be opened, the fullest is completed with the head of the piece and emitted, so
that emitted windows have no padding. What is left open when a partition ends is merged in rounds (64
partitions' leftovers per task, a bounded number of windows each) by the same rule; the last round cuts its rest into sequences
whose lengths are powers of two, so that nothing is padded there either.

Token ids come from the tokenizer itself, word by word: white space only separates words there, and a word's ids are
looked up in a bounded table before they are computed. A null text is an empty document: its end id alone. Texts of
any length are cut into full windows and a rest. Repeated rows are packed once each. An empty table gives
no rows. Only id and text are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carecheck.llm.byte_bpe import byte_characters
from carecheck.llm.common import stored

WORDS = 300_000  # words whose ids a Python worker keeps
MERGE = 64  # partitions whose leftovers one task merges
# Printable ASCII and Latin letters up to U+017F, all of them composed, with a lower case of one character (not U+0130).
PLAIN_WORD = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
PLAIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u017f]+")
BYTE_CHARACTERS = dict(enumerate(byte_characters()))


class WordTokenizer(dict):
    """Packed little-endian ids of texts, equal to the tokenizer's own ids of the whole text."""

    def __init__(self, definition: str):
        super().__init__()
        tokenizer = Tokenizer.from_str(definition)
        self.normaliser, self.splitter, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if PLAIN_WORD.fullmatch(word):
            pieces = PLAIN_PIECE.findall(word.lower())
            if not word.isascii():
                pieces = [p.encode().decode("latin-1").translate(BYTE_CHARACTERS) for p in pieces]
        else:
            pieces = [p for p, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(word))]
        ids = [t.id for p in pieces for t in self.model.tokenize(p)]
        value = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


_tokenizers: dict[int, WordTokenizer] = {}  # kept by a worker between tasks


def _tokenizer(definition: str) -> WordTokenizer:
    key = zlib.crc32(definition.encode())
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(definition)
    return _tokenizers[key]


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens); ``emit`` gets full windows."""

    def __init__(self, size: int, windows: int, emit):
        self.size, self.most, self.emit = size, windows, emit
        self.open: list[list] = []  # [room, pieces]

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        while len(ids) >= 4 * self.size:
            self.emit([(doc_id, start, ids[:4 * self.size], doc_tokens)])
            start, ids = start + self.size, ids[4 * self.size:]
        while ids:
            n = len(ids) // 4
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                self.open.append(best := [self.size, []])
            if best is None:
                best = min(self.open, key=lambda w: w[0])  # the fullest: completed by the head of the piece
                n = best[0]
            best[1].append((doc_id, start, ids[:4 * n], doc_tokens))
            best[0] -= n
            start, ids = start + n, ids[4 * n:]
            if not best[0]:
                self.open.remove(best)
                self.emit(best[1])

    def close(self) -> None:
        """Emits the rest without padding: full windows, then sequences with lengths of powers of two."""
        pieces = [p for w in self.open for p in w[1]]
        self.open = []
        total = sum(len(p[2]) for p in pieces) // 4
        sizes = [self.size] * (total // self.size) + [1 << k for k in range(self.size.bit_length(), -1, -1) if total % self.size >> k & 1]
        pieces.reverse()
        for size in sizes:
            window = []
            while size:
                doc_id, start, ids, doc_tokens = pieces.pop()
                n = min(size, len(ids) // 4)
                window.append((doc_id, start, ids[:4 * n], doc_tokens))
                if 4 * n < len(ids):
                    pieces.append((doc_id, start + n, ids[4 * n:], doc_tokens))
                size -= n
            self.emit(window)


class _Rows:
    """Rows of emitted windows, and of open ones with their ids."""

    def __init__(self, part: int, level: int):
        self.part, self.next, self.rows = part, (level << 60) | (part << 32), []

    def window(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next, offset, self.part, None))
            offset += n
        self.next += 1

    def batch(self, types: list, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(types)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def leftover(self, packer: Packer) -> None:
        for _, pieces in packer.open:
            for doc_id, start, ids, doc_tokens in pieces:
                self.rows.append((doc_id, start, len(ids) // 4, None, doc_tokens, None, None, self.part, ids))


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
TYPES = [pa.int64()] * 7 + [pa.binary()]


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, windows: int = 16,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a tokenizer file, read on the driver (a fixed size) and broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(TaskContext.get().partitionId(), 0)
        packer, encode = Packer(size, windows, rows.window), _tokenizer(shared.value).encode
        types = None
        for batch in batches:
            types = [batch.column(0).type, *TYPES]
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(rows.rows) > 5000:
                    yield rows.batch(types, [id_column, *COLUMNS])
        rows.leftover(packer)
        if rows.rows:
            yield rows.batch(types, [id_column, *COLUMNS])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, part bigint, ids binary"

    def merger(level: int, last: bool):
        def merge(group: pa.Table) -> pa.Table:
            group = group.sort_by([(id_column, "ascending"), ("start", "ascending"), ("part", "ascending")])
            rows = _Rows(group.column("part")[0].as_py() // MERGE, level)
            packer = Packer(size, windows, rows.window)
            for piece in zip(*[group.column(c).to_pylist() for c in (id_column, "start", "ids", "doc_tokens")], strict=True):
                packer.add(*piece)
            if last:
                packer.close()
            else:
                rows.leftover(packer)
            return pa.Table.from_batches([rows.batch([group.schema.field(id_column).type, *TYPES], [id_column, *COLUMNS])])

        return merge

    placed = stored(docs.select(id_column, text_column).mapInArrow(place, schema))
    done, level = [placed.filter("ids IS NULL")], 1
    left = placed.filter("ids IS NOT NULL")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        last = parts <= MERGE
        merged = left.groupBy(F.floor(F.col("part") / MERGE)).applyInArrow(merger(level, last), schema)
        if last:
            done.append(merged)
            break
        merged = stored(merged)
        done.append(merged.filter("ids IS NULL"))
        left, parts, level = merged.filter("ids IS NOT NULL"), -(-parts // MERGE), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "ids")
