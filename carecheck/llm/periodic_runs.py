"""Runs: stretches of words that repeat with a period, found by minimizers at several scales.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``LEAST`` words
and two periods long, that no neighbouring word extends keeping period q. Periods below ``SHORT`` are found by comparing
the words with themselves at every such lag. Scale Q finds the periods from Q to 2Q - 1: every window of Q/2 successive
Q/2-grams selects those of least hash. Within a run a window and the one a period later hold the same grams and select
the same places, so two equal minimizers lie a period apart; that pair is extended to both sides as far as words agree.

Equal minimizers at most half a gram apart overlap and belong to one stretch of a shorter period, which its own scale
finds; they count as one progression. Pairs are formed between progressions, once per lag, and at most nine
progressions of a gram lie within reach, so the pairs stay in proportion to the words and no pair is left out.
Extension goes by hashes of spans; found stretches are compared word by word, and where a hash was wrong the whole
lag is compared instead.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, no runs and the digest of an empty text; a text is
handled whole by one task, whatever its length; repeated rows give repeated results; an empty table gives no rows.
Only the id, of any type, and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import GOLDEN, mix, powers, slices, utf8

LEAST = 12  # words of the shortest run
SHORT = 16  # periods below are found by direct comparison
SLICE = 4 << 20  # bytes of text that are handled at once
NOTHING = hashlib.sha256(b"").hexdigest()


def sliding(op: np.ufunc, values: np.ndarray, width: int, none: int) -> np.ndarray:
    """``op`` over every ``width`` successive values; ``none`` changes nothing under ``op``."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, none, values.dtype)]).reshape(-1, width)
    heads = op.accumulate(blocks, axis=1).ravel()
    tails = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tails[:n - width + 1], heads[width - 1:n])


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the grams that are the least of some window; equal ones all count."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least = sliding(np.minimum, grams, window, np.iinfo(np.uint64).max)
    pad = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([pad, least, pad]), window, 0) == grams)


def progressions(grams: np.ndarray, places: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(gram, first, last, step) of the groups of equal grams at most ``most`` apart, by gram and place; step 0: one gram."""
    places = places[np.lexsort((places, grams[places]))]
    value = grams[places]
    gap = np.diff(places)
    cut = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (gap > most)])
    steps = np.r_[0, gap]
    steps[cut] = 0
    last = np.r_[cut[1:], len(places)] - 1
    return value[cut], places[cut], places[last], np.gcd.reduceat(steps, cut)


def seeds(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag): pairs of equal minimizers with lags from ``scale`` to twice it, one per lag of two progressions."""
    half = scale // 2
    places = minimizers(grams, half)
    if not len(places):
        return places, places
    value, first, last, step = progressions(grams, places, half // 2)
    out = []
    for ahead in range(1, len(value)):
        one = np.arange(len(value) - ahead)
        one = one[value[one] == value[one + ahead]]
        one = one[first[one + ahead] - last[one] < 2 * scale]
        if not len(one):
            break  # progressions of a gram lie in order, those further ahead are farther away
        two = one + ahead
        d = np.gcd(step[one], step[two])
        lo, hi = first[two] - last[one], np.minimum(last[two] - first[one], 2 * scale - 1)
        unit = np.maximum(d, 1)
        lo = np.where(lo < scale, lo + -(-(scale - lo) // unit) * unit, lo)
        many = np.where(lo <= hi, np.where(d > 0, (hi - lo) // unit + 1, 1), 0)
        pair = np.repeat(np.arange(len(one)), many)
        lag = lo[pair] + unit[pair] * (np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many))
        out.append((np.maximum(first[one][pair], first[two][pair] - lag), lag))
    if not out:
        return places[:0], places[:0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Spans:
    """Hashes of the spans of a sequence of codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            values = mix(codes.astype(np.uint64) + np.uint64(GOLDEN))
            self.sums = np.r_[np.uint64(0), np.cumsum(values * up[:len(codes)], dtype=np.uint64)]

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[starts + size] - self.sums[starts]) * self.down[starts]

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        with np.errstate(over="ignore"):
            return mix((self.sums[size:size + n] - self.sums[:n]) * self.down[:n])

    def agree(self, place: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many codes before the place, and from it on, equal those a lag later."""
        n = len(self.sums) - 1
        before, after = np.zeros_like(place), np.zeros_like(place)
        for bit in range(max(n, 1).bit_length() - 1, -1, -1):
            size = 1 << bit
            can = np.flatnonzero(place + lag + after + size <= n)
            at = place[can] + after[can]
            after[can[self.of(at, size) == self.of(at + lag[can], size)]] += size
            can = np.flatnonzero(place - before - size >= 0)
            at = place[can] - before[can] - size
            before[can[self.of(at, size) == self.of(at + lag[can], size)]] += size
        return before, after


def at_lag(codes: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretches whose codes a lag apart are equal, long enough for a run."""
    if len(codes) <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[0], (codes[lag:] == codes[:-lag]).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + lag
    long = end - start >= max(LEAST, 2 * lag)
    return start[long], end[long]


def at_scale(codes: np.ndarray, scale: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches with a period from ``scale`` to below twice it."""
    spans = Spans(codes)
    place, lag = seeds(spans.grams(scale // 2), scale)
    if not len(place):
        return []
    before, after = spans.agree(place, lag)
    long = before + after >= lag
    start, end, lag = (place - before)[long], (place + after + lag)[long], lag[long]
    out, wrong = [], set()
    for s, e, q in set(zip(start.tolist(), end.tolist(), lag.tolist(), strict=True)):
        if np.array_equal(codes[s:e - q], codes[s + q:e]):
            out.append((s, e, q))
        else:
            wrong.add(q)
    for q in wrong:
        out += [(s, e, q) for s, e in zip(*(x.tolist() for x in at_lag(codes, q)), strict=True)]
    return out


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of rows of codes (0 or more) as (row, start, length, period), by row, start and period."""
    sizes = np.diff(offsets)
    rows = np.arange(len(sizes))
    found = [np.zeros((0, 4), np.int64)]
    scale = SHORT
    while len(rows):
        # every row is followed by a code of its own, so no stretch leaves its row
        ends = np.cumsum(sizes[rows] + 1)
        starts = ends - sizes[rows] - 1
        own = np.empty(ends[-1], np.int64)
        inside = np.ones(len(own), bool)
        inside[ends - 1] = False
        own[ends - 1] = -1 - np.arange(len(rows))
        own[inside] = codes if len(rows) == len(sizes) else codes[np.repeat(offsets[rows] - starts, sizes[rows] + 1)[inside] + np.flatnonzero(inside)]
        runs = at_scale(own, scale)
        if scale == SHORT:
            for q in range(1, SHORT):
                runs += [(s, e, q) for s, e in zip(*(x.tolist() for x in at_lag(own, q)), strict=True)]
        if runs:
            s, e, q = np.array(runs, np.int64).T
            row = np.searchsorted(ends, s, side="right")
            found.append(np.stack([rows[row], s - starts[row], e - s, q], axis=1))
        scale *= 2
        rows = rows[sizes[rows] >= 2 * scale]
    found = np.concatenate(found)
    # a stretch is found at every multiple of its period that it holds twice: the smallest is its own
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.r_[True, (found[1:, :3] != found[:-1, :3]).any(axis=1)][:len(found)]]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


# --- rows ---------------------------------------------------------------------------------------------

def repeated_tail(doc_id, n: int) -> tuple[int, int] | None:
    """(start, period) from which a text of n words is made to repeat itself, as crc32 of its id decides; None: unchanged."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return (a := g % n, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words with a space after each, the code of every word, and the rows' offsets among the words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    words = pc.binary_join_element_wise(coded.dictionary, pa.array([""] * len(coded.dictionary), pa.large_string()), pa.scalar(" ", pa.large_string()))
    return words, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(full)][offsets]


def _rows(part: pa.RecordBatch, rewrite: Callable | None, keep: bool) -> Iterator[pa.Array]:
    words, codes, offsets = _words(part.column(1))
    if rewrite is not None:
        codes = codes.copy()
        for k, doc_id in enumerate(part.column(0).to_pylist()):
            base, end = int(offsets[k]), int(offsets[k + 1])
            change = rewrite(doc_id, end - base)
            if change is not None:
                a, p = base + change[0], change[1]
                codes[a:end] = codes[a + np.arange(end - a) % p]
    runs = find_runs(codes, offsets)
    row, start, length, period = runs.T
    many = np.bincount(row, minlength=part.num_rows)
    best = runs[np.lexsort((period, start, -length, row))]
    best = best[np.flatnonzero(np.diff(best[:, 0], prepend=-1))]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, offsets[row] + start + period, 1)
    np.add.at(cover, offsets[row] + start + length, -1)
    kept = np.cumsum(cover)[:-1] == 0
    data, ends = utf8(words.take(pa.array(codes[kept])))
    data, ends = data.tobytes(), ends[np.r_[0, np.cumsum(kept)][offsets]].tolist()
    texts = [data[a:b][:-1] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    lines = [f"{s},{n},{p}\n" for _, s, n, p in runs.tolist()]
    cuts = np.r_[0, np.cumsum(many)].tolist()
    digests = [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() if b > a else NOTHING for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def of_best(values: np.ndarray) -> pa.Array:
        out = np.zeros(part.num_rows, np.int64)
        out[best[:, 0]] = values
        return pa.array(out, mask=many == 0)

    yield part.column(0)
    yield pa.array(many, pa.int64())
    yield of_best(best[:, 1])
    yield of_best(best[:, 2])
    yield of_best(best[:, 3])
    yield of_best(1000 * best[:, 2] // best[:, 3])
    yield pa.array(digests, pa.string())
    yield pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
    if keep:
        spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
        yield pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)
        yield pa.array([t.decode() for t in texts], pa.string())


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: bool = False,
         rewrite: Callable[[object, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """Per row: id, ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run (ties: smallest
    start, then period; null without a run); ``runs_sha256`` of all runs' lines ``start,length,period``;
    ``collapsed_sha256`` of the words that no run repeats (all but a run's first period), joined by single spaces. With
    ``keep`` also ``runs`` (array of start, length, period) and the ``collapsed`` text.

    ``rewrite`` may name, for an id and a number of words, a (start, period) from which the words repeat themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays(list(_rows(part, rewrite, keep)), names)

    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *["runs", "collapsed"] * keep]
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
              + ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" * keep)
    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_column)
