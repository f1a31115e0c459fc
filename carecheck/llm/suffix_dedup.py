"""Removal of byte strings that repeat from earlier documents, by difference-cover suffix sorting.

Every byte covered by a ``length``-byte string that also starts in a document with a smaller id is removed.

The suffixes are dealt out so that equal strings meet: a string goes with its anchor, the 24-byte gram of least hash
in it, and neighbouring strings with one anchor travel as one piece. Documents are dealt over chunks once, and all passes
read that deal:

1. every chunk sends the hashes of its anchors to buckets, which return those that several documents have;
2. every chunk sends its pieces at such anchors to buckets. Pieces that several of its documents hold are settled in
   the chunk but for the smallest id, so that a passage which a third of all rows share leaves each chunk once. Pieces of
   an anchor with more than HOT_PIECES of them go as single windows, dealt by the windows' own bytes and settled alike;
3. the ranges that the buckets found meet the texts again.

Within a bucket, the distinct pieces are sorted by a difference cover modulo 3: triples at two thirds of the positions are sorted and named, the names are sorted recursively
(as deep as ``length`` bytes need), the remaining suffixes are merged in, and neighbours with equal prefixes of
``length`` bytes form the runs whose smallest id decides.

Texts are judged whole, as UTF-8 bytes, on the input. A null or empty text has no bytes and no spans; a null id counts as
larger than all others; rows with equal ids never remove each other's bytes; copies of one row get the same result; an
empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import (
    BYTE_VALUES, GOLDEN, mix, pack_planes, pack_sorted, powers, slices, span_hashes, unpack_planes, unpack_sorted, utf8,
)

LENGTH = 50
GRAM = 24
ANCHOR_SHIFT = 16  # anchors are named by 48 bits; a shared name costs work, not truth
SLICE_BYTES = 1 << 20  # text that is cut into pieces at once
CHUNK_BYTES = 8 << 20  # text of a chunk, on average
ANCHOR_BYTES = 32 << 20  # text whose anchors share a bucket
BUCKET_BYTES = 2 << 20  # text whose pieces share a bucket
RANGES_AT_ONCE = 1 << 20  # settled ranges in one row
HOT_PIECES = 4096  # pieces of an anchor that one bucket takes
LAST = (1 << 63) - 1  # stands for a null id
DOC, KEY, CHUNK = "__dedup_doc", "__dedup_text_key", "__dedup_chunk"  # columns that chunks carry beside the rows' own


# --- difference-cover suffix sorting ----------------------------------------------------------

def _dense(keys: np.ndarray, size: int) -> np.ndarray:
    """Ranks from 1 of keys in [0, size), equal for equal keys."""
    if size <= 1 << 24:
        present = np.zeros(size, bool)
        present[keys] = True
        return np.cumsum(present)[keys]
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes; suffixes that agree in ``depth`` symbols may come in any order."""
    n = len(symbols)
    if n < 4 or depth <= 1:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64) if n < 4 else np.argsort(symbols, kind="stable")
    t = np.r_[_dense(symbols - symbols.min(), int(symbols.max() - symbols.min()) + 1), 0, 0, 0].astype(np.int64)
    sigma = int(t.max()) + 1
    sample = np.r_[np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)]
    pairs = t[:-1] * sigma + t[1:]  # of each position and the next
    if sigma ** 3 >= 1 << 62:
        pairs = _dense(pairs, sigma * sigma)
    names = _dense(pairs[sample] * sigma + t[np.minimum(sample + 2, n)], (int(pairs.max()) + 1) * sigma)
    if depth <= 3 or names.max() == len(sample):
        ordered = sample[np.argsort(names, kind="stable")]
    else:
        ordered = sample[suffix_order(names, -(-depth // 3))]
    rank = np.zeros(n + 3, np.int64)
    rank[ordered] = np.arange(1, len(ordered) + 1)
    ranks = len(ordered) + 1
    ordered = ordered[ordered < n]
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    if (int(pairs.max()) + 1) * ranks >= 1 << 63:
        pairs = _dense(pairs, int(pairs.max()) + 1)
    by_one = lambda p: t[p] * ranks + rank[p + 1]
    by_two = lambda p: pairs[p] * ranks + rank[p + 2]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(by_one(rest), kind="stable")]
    # beyond the depth, neighbours may disagree with their keys; running maxima keep the merge monotone
    less = np.searchsorted(np.maximum.accumulate(by_one(first)), by_one(rest)) if len(first) else np.zeros(len(rest), np.int64)
    if len(second):
        less = less + np.searchsorted(np.maximum.accumulate(by_two(second)), by_two(rest))
    at = np.arange(len(rest)) + np.maximum.accumulate(less)
    out = np.empty(n, np.int64)
    others = np.ones(n, bool)
    others[at] = False
    out[at] = rest
    out[others] = ordered
    return out


def equal_runs(symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in suffix order and the run of equal windows each belongs to; symbols are bytes + 1, or 0 at borders."""
    valid = np.zeros(len(symbols) + 1, bool)
    valid[starts] = True
    order = suffix_order(symbols, length)
    order = order[valid[order]]
    same = np.ones(max(0, len(order) - 1), bool)
    raw = np.r_[(symbols - 1).astype(np.uint8), np.zeros(8, np.uint8)]
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    for k in [*range(0, length - 8, 8), length - 8]:
        loaded = words[order + k]
        same &= loaded[1:] == loaded[:-1]
    return order, np.cumsum(np.r_[True, ~same]) - 1


# --- pieces of texts by anchor --------------------------------------------------------------------

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i where it exists."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if done < width else x


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, anchor) of the pieces: maximal stretches of neighbouring windows with one anchor."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    grams = gram_hashes(BYTE_VALUES[data], GRAM)
    at = np.arange(len(grams), dtype=np.uint64)
    grams = (grams & ~np.uint64(63)) | (at & np.uint64(63))  # the low bits tell the position
    least = _sliding_min(grams, length - GRAM + 1)
    open_ = np.zeros(n + 1, np.int32)
    np.add.at(open_, offsets[:-1], 1)
    np.add.at(open_, np.maximum(offsets[:-1], offsets[1:] - length + 1), -1)
    valid = np.cumsum(open_)[:len(least)] > 0
    at = at[:len(least)]
    place = at + ((least - at) & np.uint64(63))
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    end = valid.copy()
    end[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + length
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends, least[starts] >> np.uint64(ANCHOR_SHIFT)


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """``span_hashes`` of every span of one size."""
    up, down = powers(len(values) + 1)
    n = len(values) - size + 1
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(values * up[:len(values)], dtype=np.uint64)]
        return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size * GOLDEN % (1 << 64)))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of an array one after the other, and their offsets there."""
    offsets = np.r_[0, np.cumsum(lengths)]
    index = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return data[index], offsets


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal ones, in order; ranges that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.r_[True, starts[1:] > ends[:-1]]
    return starts[cut], ends[np.r_[cut[1:], True]]


_FIELDS = ["<i8", "<i8", "<u4", "<i4", "u1", "<u8", "u1"]  # ids and text keys of rows; row, start, size, anchor of pieces; bytes


def _to_blob(doc, text, start, size, anchor, data) -> bytes:
    """Pieces as one compressed string; a row's id and text key stand there once."""
    new = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])] if len(doc) else np.zeros(0, bool)
    return _pack([doc[new], text[new], np.cumsum(new) - 1, start, size, anchor, data], _FIELDS)


def _from_blob(blob: bytes) -> list[np.ndarray]:
    """(doc, text, start, size, anchor, data) of pieces."""
    doc, text, row, *rest = _unpack(blob, _FIELDS)
    return [doc[row], text[row], *rest]


def _pack(arrays: list[np.ndarray], kinds: list[str]) -> bytes:
    """Arrays as one compressed string, each with its bytes sorted by place."""
    arrays = [a.astype(k) for a, k in zip(arrays, kinds, strict=True)]
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    planes = [a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<i8", len(kinds)), kinds, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


RANGES = "doc bigint, text_key bigint, start int, end int"
_RANGE_NAMES = ["doc", "text_key", "start", "end"]


_RANGE_FIELDS = ["<i8", "<i8", "<i4", "<i4"]


def _range_columns(doc, text, start, end) -> list[pa.Array]:
    return [pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]


def _text_slices(chunk: pa.Table, docs: str, text: str) -> Iterator[tuple]:
    """(ids, text keys, bytes, offsets) of a chunk's rows, some rows at a time."""
    for part in slices(iter(chunk.select([docs, KEY, text]).combine_chunks().to_batches()), text, SLICE_BYTES):
        yield part.column(0).to_numpy(), part.column(1).to_numpy(), *utf8(part.column(2))


def chunk_anchors(buckets: int, length: int, text_column: str):
    """For applyInArrow over a chunk: rows (bucket, chunk, blob, counts) of its anchors' hashes and numbers of pieces; the
    lowest bit of a hash tells that two ids of the chunk have the anchor."""

    def run(chunk: pa.Table) -> pa.Table:
        docs, anchors = [], []
        for ids, _, data, offsets in _text_slices(chunk, DOC, text_column):
            row, _, _, anchor = pieces(data, offsets, length)
            docs.append(ids[row])
            anchors.append(anchor)
        out = []
        if docs:
            doc, anchor = np.concatenate(docs), np.concatenate(anchors)
            order = np.argsort(anchor, kind="stable")
            doc, anchor = doc[order], anchor[order]
            cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
            if len(cut):
                many = np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)
                values = (anchor[cut] << np.uint64(1)) | many.astype(np.uint64)
                counts = np.minimum(np.diff(np.r_[cut, len(anchor)]), 0xFFFF).astype("<u2")
                bucket = (mix(anchor[cut]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # ascending values within a bucket
                values, counts, bucket = values[order], counts[order], bucket[order]
                ends = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
                out = [(int(bucket[x]), pack_sorted(values[x:y]), pack_planes(counts[x:y])) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        home = chunk.column(CHUNK)[0].as_py() if chunk.num_rows else 0
        return pa.table({
            "bucket": pa.array([x[0] for x in out], pa.int32()), "chunk": pa.array([home] * len(out), pa.int32()),
            "blob": pa.array([x[1] for x in out], pa.binary()), "counts": pa.array([x[2] for x in out], pa.binary())})

    return run


def shared_anchors(limit: int):
    """For applyInArrow over a bucket of anchors: rows (chunk, blob) of those that two ids or two chunks have; the lowest
    bit tells that an anchor has more than ``limit`` pieces."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(b) for b in table.column("blob").to_pylist()]
        values = np.concatenate(parts)
        counts = np.concatenate([unpack_planes(b, "<u2") for b in table.column("counts").to_pylist()])
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(p) for p in parts])
        order = np.argsort(values >> np.uint64(1), kind="stable")
        values, counts, chunk = values[order], counts[order], chunk[order]
        anchor = values >> np.uint64(1)
        cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        group = np.diff(np.r_[cut, len(anchor)])
        kept = np.repeat((group > 1) | (np.maximum.reduceat(values & np.uint64(1), cut) > 0), group)
        hot = np.repeat(np.add.reduceat(counts.astype(np.int64), cut) > limit, group)
        named, chunk = ((anchor << np.uint64(1)) | hot.astype(np.uint64))[kept], chunk[kept]
        order = np.argsort(chunk, kind="stable")
        named, chunk = named[order], chunk[order]
        ends = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)] if len(chunk) else np.zeros(1, np.int64)
        return pa.table({
            "chunk": pa.array(chunk[ends[:-1]], pa.int32()),
            "blob": pa.array([pack_sorted(named[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    return run


def split_windows(doc, text, start, size, data, at, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The windows of pieces, which stand in ``data`` from ``at`` on: (doc, text, start, size, name, at) of one id for
    each content, the smallest, and the merged ranges (doc, text, start, end) of the other ids' windows."""
    n = size.astype(np.int64) - length + 1
    piece = np.repeat(np.arange(len(n)), n)
    shift = np.arange(len(piece)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    inside, offsets = gather(data, at, size.astype(np.int64))
    local = offsets[piece] + shift
    name = span_hashes(BYTE_VALUES[inside], local, local + length)
    doc, text, start, at = doc[piece], text[piece], start[piece].astype(np.int64) + shift, at[piece] + shift
    order = np.lexsort((doc, name))
    first = np.r_[True, name[order][1:] != name[order][:-1]]
    settled = np.zeros(len(order), bool)
    settled[order] = doc[order] > doc[order][first][np.cumsum(first) - 1]
    by_row = np.lexsort((start, text, doc))
    sent, gone = by_row[~settled[by_row]], by_row[settled[by_row]]
    d, t, s = doc[gone], text[gone], start[gone]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + length)]) if len(d) else np.zeros(0, np.int64)
    last = np.r_[cut[1:], len(d)].astype(np.int64)[:len(cut)] - 1
    return ([doc[sent], text[sent], start[sent], np.full(len(sent), length, np.uint8), name[sent] >> np.uint64(ANCHOR_SHIFT), at[sent]],
            [d[cut], t[cut], s[cut], s[last] + length])


def chunk_pieces(buckets: int, length: int, text_column: str):
    """For a cogroup of chunks with their shared anchors: rows (bucket, blob) of pieces, and the ranges settled in the
    chunk in a bucket of its own, past the others."""

    def run(chunk: pa.Table, wanted: pa.Table) -> pa.Table:
        anchors = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(unpack_sorted, wanted.column("blob").to_pylist())]))
        anchors, hot_anchors = anchors >> np.uint64(1), (anchors & np.uint64(1)).astype(bool)
        seen: dict[int, int] = {}  # repeated pieces of this chunk: the smallest id that was passed on
        done: list[tuple[np.ndarray, ...]] = []  # ranges settled here
        kept: list[list[np.ndarray]] = []
        for docs, texts, data, offsets in _text_slices(chunk, DOC, text_column) if len(anchors) else ():
            row, start, end, anchor = pieces(data, offsets, length)
            hit = np.flatnonzero(anchors[np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)] == anchor)
            if not len(hit):
                continue
            row, start, end, anchor = row[hit], start[hit], end[hit], anchor[hit]
            content = mix(span_hashes(BYTE_VALUES[data], start, end) ^ anchor)
            order = np.lexsort((docs[row], content))
            row, start, end, anchor, content = row[order], start[order], end[order], anchor[order], content[order]
            first = np.r_[True, content[1:] != content[:-1]]
            group = np.cumsum(first) - 1
            keys = content[first].tolist()
            least = np.minimum(docs[row][first], np.array([seen.get(k, LAST) for k in keys]))
            seen.update(zip(keys, least.tolist(), strict=True))
            settled = docs[row] > least[group]
            if settled.any():
                r, s, e = row[settled], start[settled], end[settled]
                s, e = merge_ranges(s + r, e + r)  # rows stand one apart, so ranges of two rows never touch
                r = np.searchsorted(offsets + np.arange(len(offsets)), s, side="right") - 1
                s, e = s - r, e - r
                done.append((docs[r], texts[r], s - offsets[r], e - offsets[r]))
            left = ~settled
            row, start, end, anchor = row[left], start[left], end[left], anchor[left]
            inside, _ = gather(data, start, end - start)
            kept.append([docs[row], texts[row], start - offsets[row], (end - start).astype(np.uint8), anchor, inside])
        numbers, blobs = [], []
        if kept:
            doc, text, start, size, anchor, data = (np.concatenate(x) for x in zip(*kept, strict=True))
            del kept
            at = np.r_[0, np.cumsum(size, dtype=np.int64)][:-1]
            hot = hot_anchors[np.searchsorted(anchors, anchor)]
            if hot.any():
                windows, gone = split_windows(doc[hot], text[hot], start[hot], size[hot], data, at[hot], length)
                doc, text, start, size, anchor, at = (
                    np.r_[x[~hot], y] for x, y in zip([doc, text, start, size, anchor, at], windows, strict=True))
                done.append(tuple(gone))
            bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.r_[np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]), len(order)] if len(order) else np.zeros(1, np.int64)
            blobs = []
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                own = order[x:y]
                inside, _ = gather(data, at[own], size[own].astype(np.int64))
                blobs.append(_to_blob(doc[own], text[own], start[own], size[own], anchor[own], inside))
            numbers = bucket[order[ends[:-1]]].tolist()
        if done:
            ranges = [np.concatenate(x) for x in zip(*done, strict=True)]
            home = chunk.column(CHUNK)[0].as_py()
            for x in range(0, len(ranges[0]), RANGES_AT_ONCE):
                numbers.append(buckets + home)
                blobs.append(_pack([r[x:x + RANGES_AT_ONCE] for r in ranges], _RANGE_FIELDS))
        return pa.table({"bucket": pa.array(numbers, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def settle_bucket(buckets: int, length: int):
    """For applyInArrow over one bucket: the ranges to remove from the bucket's pieces, or those that a chunk settled."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            settled = [_unpack(b, _RANGE_FIELDS) for b in table.column("blob").to_pylist()]
            return pa.Table.from_arrays(_range_columns(*(np.concatenate(x) for x in zip(*settled, strict=True))), _RANGE_NAMES)
        parts = [_from_blob(b) for b in table.column("blob").to_pylist()]
        doc, text, start, size, anchor, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = size.astype(np.int64)
        offsets = np.r_[0, np.cumsum(size)]
        order = np.argsort(anchor, kind="stable")
        cut = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
        lows, highs = np.minimum.reduceat(doc[order], cut), np.maximum.reduceat(doc[order], cut)
        shared = order[np.repeat(lows != highs, np.diff(np.r_[cut, len(order)]))]
        if not len(shared):
            return pa.Table.from_arrays(_range_columns(doc[:0], text[:0], start[:0], start[:0]), _RANGE_NAMES)
        content = mix(span_hashes(BYTE_VALUES[data], offsets[shared], offsets[shared + 1]) ^ anchor[shared])
        by = np.lexsort((doc[shared], content))
        shared, content = shared[by], content[by]
        first = np.r_[True, content[1:] != content[:-1]]
        group = np.cumsum(first) - 1
        chosen = shared[first]  # one piece per content, with its smallest id
        least = doc[chosen]
        # the distinct pieces, each with a byte 0 behind it: symbols are bytes + 1, so no window crosses a border
        joined, at = gather(data, offsets[chosen], size[chosen])
        at = at + np.arange(len(at))
        symbols = np.zeros(at[-1], np.int16)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        symbols[inside] = joined.astype(np.int16) + 1
        windows = size[chosen] - length + 1
        window_piece = np.repeat(np.arange(len(chosen)), windows)
        window_start = np.arange(len(window_piece)) + np.repeat(at[:-1] - np.r_[0, np.cumsum(windows)[:-1]], windows)
        ordered, run_of = equal_runs(symbols, window_start, length)
        piece_of = np.zeros(len(symbols), np.int64)
        piece_of[window_start] = window_piece
        run_least = np.full(run_of[-1] + 1, LAST)
        np.minimum.at(run_least, run_of, least[piece_of[ordered]])
        hit = np.zeros(len(symbols) + 1, bool)
        hit[ordered] = run_least[run_of] < least[piece_of[ordered]]
        # pieces of larger ids go whole; those of the smallest id lose their windows that a smaller id has elsewhere
        whole = shared[doc[shared] > least[group]]
        out = [(doc[whole], text[whole], start[whole].astype(np.int64), start[whole] + size[whole])]
        edge = np.diff(np.r_[False, hit[:-1], False].astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length
        if len(lo):
            owners = shared[doc[shared] == least[group]]
            owner_group = group[doc[shared] == least[group]]
            piece = piece_of[lo]
            begin = np.searchsorted(owner_group, piece)
            many = np.searchsorted(owner_group, piece, side="right") - begin
            k = np.repeat(np.arange(len(lo)), many)
            owner = owners[np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)]
            shift = start[owner] - at[piece[k]]
            out.append((doc[owner], text[owner], lo[k] + shift, hi[k] + shift))
        return pa.Table.from_arrays(_range_columns(*(np.concatenate(x) for x in zip(*out, strict=True))), _RANGE_NAMES)

    return run


# --- whole tables -------------------------------------------------------------------------------------

def _chunked(docs: DataFrame, chunks: int, id_column: str, text_column: str) -> DataFrame:
    return docs.withColumns({
        DOC: F.coalesce(F.col(id_column).cast("bigint"), F.lit(LAST)), KEY: F.xxhash64(text_column),
    }).withColumn(CHUNK, F.pmod(F.xxhash64(DOC, KEY), F.lit(chunks)).cast("int"))


def _apply(docs: DataFrame, finish, schema, length: int, id_column: str, text_column: str) -> DataFrame:
    """``finish`` over every chunk of rows and its ranges (doc, text_key, start, end)."""
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    number = lambda size: max(1, -(-total // size))
    chunked = _chunked(docs, number(CHUNK_BYTES), id_column, text_column)  # one shuffle of the texts, read by all passes
    anchors = chunked.groupBy(CHUNK).applyInArrow(
        chunk_anchors(number(ANCHOR_BYTES), length, text_column), "bucket int, chunk int, blob binary, counts binary")
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors(HOT_PIECES), "chunk int, blob binary")
    cut = chunked.groupBy(CHUNK).cogroup(shared.groupBy("chunk")).applyInArrow(
        chunk_pieces(number(BUCKET_BYTES), length, text_column), "bucket int, blob binary")
    ranges = cut.groupBy("bucket").applyInArrow(settle_bucket(number(BUCKET_BYTES), length), RANGES)
    ranges = ranges.withColumn("chunk", F.pmod(F.xxhash64("doc", "text_key"), F.lit(number(CHUNK_BYTES))).cast("int"))
    return chunked.groupBy(CHUNK).cogroup(ranges.groupBy("chunk")).applyInArrow(finish, schema)


def removals(chunk: pa.Table, ranges: pa.Table, text_column: str) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(text, starts, ends) of the maximal removed ranges of every row of a chunk."""
    doc, key = ranges.column("doc").to_numpy(), ranges.column("text_key").to_numpy()
    start, end = ranges.column("start").to_numpy().astype(np.int64), ranges.column("end").to_numpy().astype(np.int64)
    order = np.lexsort((key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else []
    place = {(int(doc[x]), int(key[x])): (x, y) for x, y in zip(cut, np.r_[cut[1:], len(doc)].astype(int), strict=True)} if len(doc) else {}
    for d, k, text in zip(chunk.column(DOC).to_pylist(), chunk.column(KEY).to_pylist(), chunk.column(text_column).cast(pa.binary()).to_pylist(), strict=True):
        x, y = place.get((d, k), (0, 0))
        yield text, *merge_ranges(start[x:y], end[x:y])


def without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip(np.r_[0, ends], np.r_[starts, len(text)], strict=True))


def whole_characters(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges widened to character borders, so that what remains is UTF-8."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    starts, ends = starts.copy(), ends.copy()
    for k in range(len(starts)):
        while inside(starts[k]):
            starts[k] -= 1
        while inside(ends[k]):
            ends[k] += 1
    return merge_ranges(starts, ends)


def report(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""

    def run(chunk: pa.Table, ranges: pa.Table) -> pa.Table:
        rows = [
            (len(text or b""), int((ends - starts).sum()), len(starts), hashlib.sha256(without(text or b"", starts, ends)).hexdigest())
            for text, starts, ends in removals(chunk, ranges, text_column)
        ]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.Table.from_arrays(
            [chunk.column(id_column), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _apply(docs.select(id_column, text_column), run, f"`{id_column}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
                  length, id_column, text_column)


def clean_texts(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The same rows and columns with texts shortened; a character that loses a byte goes as a whole."""
    names = docs.columns

    def run(chunk: pa.Table, ranges: pa.Table) -> pa.Table:
        texts = [
            text and (without(text, *whole_characters(text, starts, ends)) if len(starts) else text).decode()
            for text, starts, ends in removals(chunk, ranges, text_column)
        ]
        out = chunk.select(names)
        return out.set_column(names.index(text_column), text_column, pa.array(["" if t == b"" else t for t in texts], pa.string()))

    return _apply(docs, run, docs.schema, length, id_column, text_column)
