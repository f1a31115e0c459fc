"""Helpers the operators of this subpackage share: tables in the shared folder, texts as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecheck.session import shared_dir

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
GOLDEN = 0x9E3779B97F4A7C15  # 2**64 / golden ratio, the step of splitmix64


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the cluster's shared folder: lineage ends there, executors may be lost."""
    target = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def crc_of_id(doc_id: str = "doc_id"):
    """crc32 of the id as text, as the folds are defined."""
    return F.crc32(F.col(doc_id).cast("string"))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut at rows so that a slice holds about ``size`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and the rows' offsets in it; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(offsets) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
_BASE = 0xD1342543DE82EF95 | 1
KEPT_POWERS = 1 << 20  # workers serve one task after the other and live on, so longer arrays are made anew and given back
_powers: list[np.ndarray] = []


def _powers_of(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    have = 1
    while have < size:
        more = min(have, size - have)
        np.multiply(out[:more], np.uint64(pow(base, have, 1 << 64)), out=out[have:have + more])
        have += more
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    bases = _BASE, pow(_BASE, -1, 1 << 64)
    if n > KEPT_POWERS:
        return _powers_of(bases[0], n), _powers_of(bases[1], n)
    if not _powers or len(_powers[0]) < n:
        size = min(KEPT_POWERS, max(1 << 16, 2 * n))
        _powers[:] = [_powers_of(base, size) for base in bases]
    return _powers[0], _powers[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of an array of 64-bit values; equal spans hash alike anywhere."""
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(values * up[:len(values)], dtype=np.uint64)]
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each row's first word index (rows + 1 values)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACES[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # words end where their row ends
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.r_[inside[1:], False]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte planes apart, compressed."""
    return pack_planes(np.diff(values, prepend=np.uint64(0)).astype("<u8"))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob, "<u8"), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """An array with its bytes sorted by place, compressed."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_planes(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]
