"""BPE encoding through a table of distinct words, decoding through a join of ids with pieces.

White space (``[\\x20\\x09-\\x0D]+``) separates words for the tokenizer, so a text's ids are its words' ids one after
another. Rows are dealt into chunks by a hash of id and text. A chunk sends each of its distinct words once, dealt into
buckets by the word's hash; a bucket holds every chunk's copies of a word, encodes the word once and sends its ids back
to the chunks that asked, in the order in which they asked; a chunk then joins ids to its texts by the words' places.
A frequent word counts once per chunk, so no bucket grows with the number of its occurrences. Ids are decoded by
joining them with the vocabulary's pieces (a table of fixed size, broadcast); pieces are put together as the
tokenizer's own decoder does where it has none: with single spaces between them.

A null text counts as empty (no ids, empty digests); texts of any length are handled whole; repeated rows give repeated
results; an empty table gives no rows. Only the id, of any type, and the text are read, so other columns cannot clash.
Tokenizers whose normaliser or splitter let words act on each other across white space are not for this operator.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carecheck.llm.common import BYTE_VALUES, pack_planes, slices, span_hashes, unpack_planes, utf8

CHUNK_BYTES = 16 << 20  # of text in a chunk
BUCKET_BYTES = 32 << 20  # of text per bucket of words
HASHED_BYTES = 1 << 19  # of words hashed at a time, for which workers keep the powers
CHUNK = "__words_chunk"
ROWS = pa.ipc.IpcWriteOptions(compression="zstd")


# --- rows as blobs ------------------------------------------------------------------------------------

def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, id, text) as compressed blobs, one per chunk and slice."""
    for batch in batches:
        for part in slices([batch], batch.schema.names[2], CHUNK_BYTES):
            chunk = part.column(0).to_numpy()
            order = np.argsort(chunk, kind="stable")
            cut = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            rows = pa.RecordBatch.from_arrays([part.column(1), part.column(2)], ["id", "text"])
            blobs = []
            for places in np.split(order, cut[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=ROWS) as out:
                    out.write_batch(rows.take(pa.array(places)))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order][cut], pa.int32()), pa.array(blobs, pa.binary())], [CHUNK, "blob"])


def unpack_rows(blobs: pa.ChunkedArray) -> list[pa.RecordBatch]:
    """Rows (id, text) in slices of bounded size. Blobs are joined first: with many chunks a blob has few rows."""
    rows = pa.Table.from_batches(batch for blob in blobs for batch in pa.ipc.open_stream(pa.py_buffer(blob.as_buffer())))
    return list(slices(rows.combine_chunks().to_batches(), "text"))


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    data, offsets = utf8(words)
    return pack_planes(np.diff(offsets).astype("<u4")), zstandard.ZstdCompressor(level=3).compress(data.tobytes())


def unpack_words(lengths: bytes, data: bytes) -> pa.Array:
    ends = np.cumsum(unpack_planes(lengths, "<u4"), dtype=np.int64)
    offsets = np.r_[np.int64(0), ends]
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(zstandard.ZstdDecompressor().decompress(data)))


# --- words --------------------------------------------------------------------------------------------

def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of each text as (distinct words, code of every word, each row's first word); empty words may occur."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def by_hash(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by hash, words of one hash by their bytes, and the hashes in that order."""
    hashes = np.zeros(len(words), np.uint64)
    at = 0
    for part in slices([pa.RecordBatch.from_arrays([words], ["word"])], "word", HASHED_BYTES):
        data, offsets = utf8(part.column("word"))
        hashes[at:at + part.num_rows] = span_hashes(BYTE_VALUES[data], offsets[:-1], offsets[1:])
        at += part.num_rows
    order = np.argsort(hashes, kind="stable")
    if (np.diff(hashes[order]) == 0).any():
        place = np.empty(len(words), np.int64)
        place[pc.array_sort_indices(words.cast(pa.large_binary())).to_numpy()] = np.arange(len(words))
        order = np.lexsort((place, hashes))
    return order, hashes[order]


def distinct(parts: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct words of several lists, and the code of every word. The lists are coded as one: unifying their
    dictionaries would read all distinct words again for every list."""
    coded = pa.chunked_array(parts, pa.large_string()).combine_chunks().dictionary_encode()
    return coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum([len(p) for p in parts])[:-1])


def chunk_words(buckets: int):
    """A chunk's distinct words in the order of their hashes, one row per bucket."""

    def run(chunk: pa.Table) -> pa.Table:
        parts = [split(rows.column("text"))[0] for rows in unpack_rows(chunk.column("blob"))]
        words, _ = distinct(parts)
        order, hashes = by_hash(words)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        sent = [pack_words(words.take(pa.array(x))) for x in np.split(order, cut[1:])] if len(cut) else []
        number = chunk.column(CHUNK)[0].as_py()
        return pa.table({
            "bucket": pa.array(bucket[cut], pa.int32()), "chunk": pa.array([number] * len(cut), pa.int32()),
            "lengths": pa.array([x for x, _ in sent], pa.binary()), "words": pa.array([x for _, x in sent], pa.binary()),
        })

    return run


_tokenizers: dict[str, Tokenizer] = {}  # one per worker, kept between tasks


def tokenizer_of(definition: str) -> Tokenizer:
    if definition not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        _tokenizers.clear()
        found = _tokenizers[definition] = Tokenizer.from_str(definition)
        found.no_truncation()
        found.no_padding()
    return _tokenizers[definition]


def encode_words(definition: str):
    """A bucket's words encoded, each distinct one once; ids per chunk in the order in which it sent its words."""

    def run(bucket: pa.Table) -> pa.Table:
        tokenizer = tokenizer_of(definition)
        rows = bucket.select(["chunk", "bucket", "lengths", "words"]).to_pylist()
        words, codes = distinct([unpack_words(r["lengths"], r["words"]) for r in rows])
        ids, counts = [np.zeros(0, "<u4")], []
        for at in range(0, len(words), 4096):
            found = [e.ids for e in tokenizer.encode_batch(words.slice(at, 4096).to_pylist(), add_special_tokens=False)]
            counts += map(len, found)
            ids.append(np.fromiter((i for x in found for i in x), "<u4"))
        table = Ragged(np.concatenate(ids), np.array(counts, np.int64))
        out = [table.take(c) for c in codes]
        return pa.table({
            "chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "counts": pa.array([pack_planes(c.astype("<u4")) for _, c in out], pa.binary()),
            "ids": pa.array([pack_planes(i.astype("<u4")) for i, _ in out], pa.binary()),
        })

    return run


class Ragged:
    """Lists of ids in one array."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        self.starts = np.cumsum(counts) - counts

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the rows, one after another, and their lengths."""
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        shift = np.repeat(self.starts[rows] - (ends - counts), counts)
        return self.ids[shift + np.arange(len(shift))], counts


# --- texts --------------------------------------------------------------------------------------------

def pieces_of(definition: str) -> list[str]:
    """The vocabulary's pieces by id, each with a space after it."""
    tokenizer = Tokenizer.from_str(definition)
    if json.loads(definition).get("decoder"):
        raise ValueError("the tokenizer has a decoder of its own; pieces can't be joined by spaces")
    return [(tokenizer.id_to_token(i) or "") + " " for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def joined(spaced: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The texts of rows of ids (row k has ids[cuts[k]:cuts[k + 1]]): pieces with single spaces between them."""
    data, offsets = utf8(spaced.take(pa.array(ids)))
    data, ends = data.tobytes(), offsets[cuts]
    return [data[a:b][:-1] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def texts_of_chunk(pieces, names: list[str], keep_ids: bool, keep_text: bool):
    """The chunk's rows with their ids by the words' places, and the texts that the ids decode to."""

    def run(chunk: pa.Table, encoded: pa.Table) -> Iterator[pa.RecordBatch]:
        spaced = pa.array(pieces.value, pa.large_string())
        rows = unpack_rows(chunk.column("blob"))
        parts = [split(r.column("text")) for r in rows]
        words, own = distinct([w for w, _, _ in parts])
        order, _ = by_hash(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        answers = sorted(zip(*(encoded.column(c).to_pylist() for c in ("bucket", "counts", "ids")), strict=True))
        table = Ragged(np.concatenate([np.zeros(0, "<u4"), *[unpack_planes(i, "<u4") for _, _, i in answers]]),
                       np.concatenate([np.zeros(0, "<u4"), *[unpack_planes(c, "<u4") for _, c, _ in answers]]).astype(np.int64))
        if len(table.counts) != len(words):
            raise ValueError(f"{len(words)} words were sent, {len(table.counts)} came back")
        for part, (_, codes, firsts), mine in zip(rows, parts, own, strict=True):
            ids, counts = table.take(place[mine[codes]])
            cuts = np.r_[0, np.cumsum(counts)][firsts]
            packed = ids.astype("<u4").tobytes()
            decoded = joined(spaced, ids, cuts)
            columns = [
                part.column("id"), pa.array(np.diff(cuts), pa.int64()),
                pa.array([hashlib.sha256(packed[4 * a:4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
            if keep_text:
                columns.append(pa.array([d.decode() for d in decoded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return lambda chunk, encoded: pa.Table.from_batches(run(chunk, encoded))


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
                  keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` (little-endian unsigned 32-bit ids), ``decoded_sha256``; with
    ``keep_ids`` also ``ids`` (array of int), with ``keep_text`` also ``decoded``.

    ``vocabulary`` is the tokenizer's JSON file, read on the driver.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as source:
        definition = source.read()
    pieces = spark.sparkContext.broadcast(pieces_of(definition))
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    number = lambda size: max(1, -(-total // size))
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_text]
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    dealt = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.col(text_column)), F.lit(number(CHUNK_BYTES))).cast("int")
    packed = docs.select(dealt.alias(CHUNK), F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        pack_rows, f"{CHUNK} int, blob binary")
    words = packed.groupBy(CHUNK).applyInArrow(
        chunk_words(number(BUCKET_BYTES)), "bucket int, chunk int, lengths binary, words binary")
    encoded = words.groupBy("bucket").applyInArrow(encode_words(definition), "chunk int, bucket int, counts binary, ids binary")
    found = packed.groupBy(CHUNK).cogroup(encoded.groupBy("chunk")).applyInArrow(
        texts_of_chunk(pieces, names, keep_ids, keep_text), schema)
    return found.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row: id and ``decoded``, the text of its ids; null ids give a null text."""
    with open(vocabulary, encoding="utf-8") as source:
        pieces = encoded.sparkSession.sparkContext.broadcast(pieces_of(source.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced = pa.array(pieces.value, pa.large_string())
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            cuts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
            texts = [t.decode() for t in joined(spaced, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), cuts)]
            kept = pc.if_else(batch.column(1).is_null(), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], ["id", "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids")).mapInArrow(
        run, f"id {kind}, decoded string").withColumnRenamed("id", id_column)
