"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are runs of letters and digits and runs of other characters between white space; features are hashed tokens,
pairs of neighbours, and for pairs whether both tokens are the same word, in counts scaled by the text's length.
Training takes at most ``sample`` labelled rows, chosen by a hash of the id: shards of them train side by side for
some epochs from the same weights, and their weights are averaged after each round. The weights (2**BITS numbers) are broadcast, and
every whole text is scored as a sparse dot product.

Null and empty texts have no features: their score is that of the bias alone. Labels that are null, or whose row has no document,
are not used; of several labels of one id the largest counts. Repeated rows get equal scores. Without any label
the score is 0.5. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import BYTE_VALUES, SPACES, crc_of_id, mix, slices, span_hashes, stored, utf8

BITS = 18  # weights: 2**BITS
SAMPLE = 12_000  # labelled rows used for training, at most
SHARDS, ROUNDS = 8, 2
TRAINED_AT_ONCE = 1 << 18  # bytes of a shard's texts whose features are held at a time
ALPHA, BETA, L1, L2 = 10.0, 1.0, 0.002, 0.1
THRESHOLD = 0.3

WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CLASS = np.where(SPACES, 0, np.where(WORDLIKE, 1, 2)).astype(np.int8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all rows' features; the bias is not among them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.r_[True, kind[1:] != kind[:-1]] | edge[:n]
    cuts = np.flatnonzero(change)
    ends = np.r_[cuts[1:], n]
    token = kind[cuts] != 0
    starts, ends = cuts[token], ends[token]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    one = span_hashes(BYTE_VALUES[data], starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    pair = row[1:] == row[:-1]
    with np.errstate(over="ignore"):
        two = mix(one[:-1] * np.uint64(3) + one[1:])[pair]
        word = kind[starts] == 1
        last = np.full(len(one), -1)  # the word before each token, over symbols
        np.maximum.accumulate(np.where(word, np.arange(len(one)), -1), out=last)
        before = np.r_[-1, last[:-1]]
    again = word & (before >= 0) & (row[before] == row) & (one[before] == one)
    same = np.where(again, 1, 2).astype(np.uint64)[word]
    rows = np.r_[row, row[1:][pair], row[word]]
    hashed = np.r_[one, two, mix(same)] & np.uint64((1 << BITS) - 1)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    return rows, hashed.astype(np.int64), 1.0 / np.sqrt(count[rows])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(weights: np.ndarray, texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """One pass of FTRL-proximal over the rows in their order, from given weights (the last one is the bias).

    Features are made for a slice of the texts at a time, as they take many times the space of the texts.
    """
    n = np.full(len(weights), 1.0)
    z = -weights * ((BETA + np.sqrt(n)) / ALPHA + L2) - np.sign(weights) * L1
    at = 0
    for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", TRAINED_AT_ONCE):
        rows, hashed, values = features(*utf8(part.column(0)))
        order = np.argsort(rows, kind="stable")
        rows, hashed, values = rows[order], hashed[order], values[order]
        bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
        for k, label in enumerate(labels[at:at + part.num_rows]):
            span = slice(bounds[k], bounds[k + 1])
            idx, inverse = np.unique(hashed[span], return_inverse=True)
            idx = np.r_[idx, len(weights) - 1]
            x = np.r_[np.bincount(inverse, values[span], len(idx) - 1), 1.0]
            active = np.abs(z[idx]) > L1
            w = np.where(active, -(z[idx] - np.sign(z[idx]) * L1) / ((BETA + np.sqrt(n[idx])) / ALPHA + L2), 0.0)
            gradient = (logistic(w @ x) - label) * x
            sigma = (np.sqrt(n[idx] + gradient * gradient) - np.sqrt(n[idx])) / ALPHA
            z[idx] += gradient - sigma * w
            n[idx] += gradient * gradient
        at += part.num_rows
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def _learner(shared):
    """A shard's pass from the broadcast weights; rows in the order of a hash of the id."""

    def learn(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["_order", "_text"], kind="stable")
        learnt = ftrl(shared.value, pa.array(shard["_text"], pa.string()), shard["_label"].to_numpy())
        return pd.DataFrame({"weights": [learnt.astype("<f4").tobytes()], "n": [len(shard)]})

    return learn


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_column: str = "doc_id",
          text_column: str = "text") -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled ids."""
    chosen = labels.filter(F.col(label).isNotNull()).groupBy(id_column).agg(F.max(label).alias("_label")).orderBy(
        F.xxhash64(id_column), id_column).limit(sample)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    rows = stored(
        texts.join(F.broadcast(chosen.withColumnRenamed(id_column, "_id")), "_id")
        .select("_text", F.col("_label").cast("int").alias("_label"), F.xxhash64("_id", F.lit(2)).alias("_order"),
                F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SHARDS)).alias("_shard"))
    )
    weights = np.zeros((1 << BITS) + 1)
    for _ in range(ROUNDS):
        learn = _learner(docs.sparkSession.sparkContext.broadcast(weights))
        parts = rows.groupBy("_shard").applyInPandas(learn, "weights binary, n bigint").collect()  # SHARDS rows of a fixed size
        total = sum(p["n"] for p in parts)
        if not total:
            break
        weights = sum(np.frombuffer(p["weights"], "<f4").astype(float) * (p["n"] / total) for p in parts)
    return weights


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """Per row: id, ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column):
            data, offsets = utf8(part.column(1))
            rows, hashed, values = features(data, offsets)
            sums = np.bincount(rows, shared.value[hashed] * values, part.num_rows) + shared.value[-1]
            scores = logistic(sums)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                [id_column, "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")


def keep(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that score ``threshold`` or more; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column):
            rows, hashed, values = features(*utf8(part.column(text_column)))
            sums = np.bincount(rows, shared.value[hashed] * values, part.num_rows) + shared.value[-1]
            yield part.filter(pa.array(logistic(sums) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Scores of ``docs`` by weights from ``all_docs`` and the labels outside the held-out fold (crc32 of the id mod 5 is 0)."""
    weights = train(all_docs, labels.filter(crc_of_id(id_column) % 5 != 0), id_column=id_column)
    held_out = F.coalesce(crc_of_id(id_column) % 5 == 0, F.lit(False))
    return score(docs, weights, id_column=id_column).withColumn("held_out", held_out)
