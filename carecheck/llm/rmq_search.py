"""Ranked lexical search: range-maximum tables over posting lists, document intervals taken best first.

Rows are read in slices. A slice keeps the postings of the terms that the items ask for, one list per term, and over
each list a sparse table that names the posting of highest impact in any range. An item starts with the interval of all
the slice's documents. The bound of an interval is the sum, over the item's terms, of the highest impact that the term's
table finds within it. The interval of highest bound comes next: the document of the highest single impact in it is
scored exactly and splits it in two; intervals whose bound is below the item's k-th score so far are dropped, for no
document in them can enter. A task carries k-th scores from slice to slice and returns one list per item; scores from a
first, small part of the slices are where all tasks begin. Both only lower the work: what they drop can't be in a result.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A to Z lower-cased. With N documents that
have a term, L terms in all of them, n in one, df documents that hold a term and tf occurrences in one, a term weighs
w = floor(1000 ln((2N + 2) / (2df + 1))), a document has m = 75 + (25 n N) div L, and a score is the sum of
w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.

Equal texts of a slice are one entry with several ids. A null or empty text has no terms and is no document; every row
counts, also repeated ones and those without an id (null ids come last among equal scores). An item without terms, or
whose terms no document holds, has no rows; repeated items have their rows each. Items are taken in blocks of bounded
size, one pass over the documents each. A text of any length is indexed whole. Empty tables give no rows. Only ids and
texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carecheck.llm.common import lower_ascii, pack_planes, slices, stored, unpack_planes, utf8

SLICE = 16 << 20  # bytes of text that share posting lists
BLOCK = 1 << 20  # bytes of items that are asked in one pass
TOGETHER = 64  # items whose intervals are split in one step
AT_ONCE = 8  # intervals of an item that are split in one step
FIRST = 32  # one slice of so many gives the scores to begin with

TERM = np.zeros(256, bool)
TERM[128:] = True
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


# --- terms and postings -------------------------------------------------------------------------------

def term_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms and what lies between them by turns, over all texts, and the number of terms in each text."""
    data, offsets = utf8(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    data, inside = lower_ascii(data), TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # terms end where their text ends
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | edge[1:])) + 1
    cuts = np.stack([starts, ends], axis=1).ravel()
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(len(cuts) - 1, 0), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return pieces, np.diff(np.searchsorted(starts, offsets))


def terms_of(text: str | None) -> Counter:
    """An item's terms and how often it holds each."""
    return Counter(term_pieces(pa.array([text], pa.string()))[0].to_pylist()[::2])


def index_slices(asked: list[bytes], k: int):
    """Rows (id, text) to one row per slice: its documents, their numbers of terms and the asked terms' postings."""

    def index(part: pa.RecordBatch, kind: pa.DataType) -> tuple:
        coded = part.column(1).dictionary_encode()
        own = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        pieces, n = term_pieces(coded.dictionary)
        copies = np.bincount(own[own >= 0], minlength=len(n)).astype(np.int64)
        term = pc.fill_null(pc.index_in(pieces, value_set=pa.array(asked, pa.large_binary())), -1).to_numpy(zero_copy_only=False)[::2]
        entry = np.repeat(np.arange(len(n)), n)
        key, tf = np.unique((entry * len(asked) + term)[term >= 0], return_counts=True)
        entry, term = key // len(asked), key % len(asked)
        # entries in the order of their most frequent term, then of their lengths: bounds of intervals are tighter so
        lead = np.full(len(n), -1)
        by_tf = np.lexsort((-tf, entry))
        first = by_tf[np.flatnonzero(np.diff(entry[by_tf], prepend=-1))]
        lead[entry[first]] = term[first]
        order = np.lexsort((n, lead))
        order = order[lead[order] >= 0]
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(order))
        posting = np.lexsort((place[entry], term))
        members = [[] for _ in n]
        for x, doc_id in zip(own.tolist(), part.column(0).to_pylist(), strict=True):
            if x >= 0:
                members[x].append(doc_id)
        least = [heapq.nsmallest(k, members[x], key=lambda i: (i is None, i)) for x in order.tolist()]
        held = np.bincount(term, weights=copies[entry], minlength=len(asked)).astype(np.int64)
        return (
            int(copies[n > 0].sum()), int((copies * n).sum()), np.flatnonzero(held).tolist(), held[held > 0].tolist(),
            [i for x in least for i in x], *[pack_planes(x.astype("<u4")) for x in (
                np.array([len(x) for x in least], np.int64), n[order], term[posting], place[entry[posting]], tf[posting])],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, part in enumerate(slices(batches, "text", SLICE)):
            kind = part.column(0).type
            row = (task << 32 | number, *index(part, kind))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(kind), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], INDEX)

    return run


INDEX = ["slice", "documents", "words", "terms", "held", "ids", "copies", "n", "term", "place", "tf"]


# --- best first ---------------------------------------------------------------------------------------

class Lists:
    """Posting lists of a slice, by term, with a table of the highest impacts over all their ranges."""

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, entries: int):
        self.place, self.impact, self.entries = place, impact, entries
        self.key = term * entries + place
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.table = [np.arange(len(term))]
        for level in range(1, longest.bit_length()):
            half = 1 << (level - 1)
            below = self.table[-1]
            later = below[np.minimum(np.arange(len(below)) + half, len(below) - 1)]
            self.table.append(np.where(impact[below] >= impact[later], below, later))
        self.table = np.stack(self.table)
        self.level = np.r_[0, np.log2(np.arange(1, longest + 1) + 0.5)].astype(np.int64)

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The posting of highest impact in each range [a, b), which holds one at least."""
        level = self.level[b - a]
        x, y = self.table[level, a], self.table[level, b - (1 << level)]
        return np.where(self.impact[x] >= self.impact[y], x, y)

    def ranges(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.key, terms * self.entries), np.searchsorted(self.key, (terms + 1) * self.entries)


class Pool:
    """Columns of whole numbers that grow; a node is a stretch of their rows."""

    def __init__(self, columns: int):
        self.rows, self.used = np.empty((columns, 1 << 14), np.int64), 0

    def add(self, *columns: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(columns[0])
        while self.used > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)], axis=1)
        for row, column in zip(self.rows, columns, strict=True):
            row[at:self.used] = column
        return at


class Best:
    """The k best (score, id) of an item so far; ``floor`` is the least score that may still enter."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.found = k, max(floor, 1), []

    def add(self, score: int, ids: list) -> None:
        self.found = heapq.nsmallest(self.k, self.found + [(-score, i is None, i) for i in ids])
        if len(self.found) == self.k:
            self.floor = max(self.floor, -self.found[-1][0])


def search(lists: Lists, members: list[list], items: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> int:
    """Adds the slice's documents to the items' best ones; returns how many were scored."""
    scored = 0
    for group in range(0, len(items), TOGETHER):
        pool, heaps = Pool(5), {}  # per term: range start, its end, the highest posting's number, the term's count, its key
        for q in range(group, min(group + TOGETHER, len(items))):
            terms, count = items[q]
            a, b = lists.ranges(terms)
            some = a < b
            if some.any():
                a, b, high = a[some], b[some], lists.best(a[some], b[some])
                at = pool.add(a, b, high, count[some], terms[some] * lists.entries)
                heaps[q] = [(-int((count[some] * lists.impact[high]).sum()), at, len(a))]
        while heaps:
            nodes = []
            for q, heap in list(heaps.items()):
                floor = best[q].floor
                for _ in range(AT_ONCE):
                    if not heap or -heap[0][0] < floor:
                        heap.clear()
                        break
                    nodes.append((q, *heapq.heappop(heap)[1:]))
                if not heap and not (nodes and nodes[-1][0] == q):
                    del heaps[q]
            if nodes:
                scored += len(nodes)
                _split(lists, members, pool, nodes, heaps, best)
    return scored


def _split(lists: Lists, members: list[list], pool: Pool, nodes: list[tuple[int, int, int]], heaps: dict, best: list[Best]) -> None:
    """Scores the document of highest impact of each node and leaves the intervals on its two sides as nodes."""
    item, at, size = np.array(nodes, np.int64).T
    first = np.cumsum(size) - size
    node = np.repeat(np.arange(len(size)), size)
    a, b, high, count, base = pool.rows[:, np.repeat(at - first, size) + np.arange(len(node))]
    gain = count * lists.impact[high]
    leading = np.where(gain == np.maximum.reduceat(gain, first)[node], np.arange(len(node)), len(node))
    place = lists.place[high[np.minimum.reduceat(leading, first)]]
    cut = np.searchsorted(lists.key, base + place[node])
    at_cut = np.minimum(cut, len(lists.place) - 1)
    holds = (cut < b) & (lists.place[at_cut] == place[node])
    score = np.add.reduceat(np.where(holds, count * lists.impact[at_cut], 0), first)
    floors = np.array([best[q].floor for q in item.tolist()])
    for x in np.flatnonzero(score >= floors).tolist():
        best[item[x]].add(int(score[x]), members[place[x]])
    floors = np.array([best[q].floor for q in item.tolist()])
    side = np.concatenate([2 * node, 2 * node + 1])
    a, b = np.concatenate([a, cut + holds]), np.concatenate([cut, b])
    some = np.flatnonzero(a < b)
    some = some[np.argsort(side[some], kind="stable")]
    if not len(some):
        return
    a, b, side = a[some], b[some], side[some]
    count, base = np.concatenate([count, count])[some], np.concatenate([base, base])[some]
    high = lists.best(a, b)
    start = np.flatnonzero(np.diff(side, prepend=-1))
    bound = np.add.reduceat(count * lists.impact[high], start)
    owner = side[start] // 2
    stays = bound >= floors[owner]
    size = np.diff(np.r_[start, len(side)])
    rows = np.repeat(stays, size)
    at = pool.add(a[rows], b[rows], high[rows], count[rows], base[rows]) + np.r_[0, np.cumsum(size[stays])]
    for q, top, x, n in zip(item[owner[stays]].tolist(), bound[stays].tolist(), at.tolist(), size[stays].tolist()):  # noqa: B905
        heapq.heappush(heaps.setdefault(q, []), (-top, x, n))


def search_slices(items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, documents: int, words: int, floors: list[int], k: int):
    """Indexed slices to the k best rows (item, id, score) of each item in the whole task."""

    def load(row: dict) -> tuple[Lists, list[list]]:
        copies, n, term, place, tf = (unpack_planes(row[c], "<u4").astype(np.int64) for c in ("copies", "n", "term", "place", "tf"))
        sizes, back = np.unique(n, return_inverse=True)
        m = np.array([75 + 25 * x * documents // words for x in sizes.tolist()], np.int64)[back]
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
        cuts = np.r_[0, np.cumsum(copies)].tolist()
        return Lists(term, place, impact, len(n)), [row["ids"][x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = [Best(k, f) for f in floors], None
        for batch in batches:
            kind = batch.column(0).type.value_type
            for at in range(batch.num_rows):
                lists, members = load(batch.slice(at, 1).to_pylist()[0])
                if members:
                    search(lists, members, items, best)
        if kind is not None:
            rows = [(q, i, -s) for q, b in enumerate(best) for s, _, i in b.found]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["item", "id", "score"])

    return run


# --- whole tables -------------------------------------------------------------------------------------

def _block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(text, rank, id, score) for the texts of a block of items; ``docs`` has the columns id and text."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    asked_by = [(text, terms) for text in texts if (terms := terms_of(text))]
    asked = sorted(set().union(*[terms for _, terms in asked_by]))
    schema = (f"slice bigint, documents bigint, words bigint, terms array<int>, held array<bigint>, ids array<{kind}>, "
              "copies binary, n binary, term binary, place binary, tf binary")
    indexed = stored(docs.mapInArrow(index_slices(asked, k), schema))
    total = indexed.agg(F.sum("documents"), F.sum("words")).first()
    documents, words = total[0] or 0, total[1] or 0
    held = dict(indexed.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).groupBy("x.terms").agg(F.sum("x.held")).collect())
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(asked))], np.int64)
    number = {t: x for x, t in enumerate(asked)}
    items = []
    for _, terms in asked_by:
        known = sorted((number[t], c) for t, c in terms.items() if number[t] in held and weight[number[t]] > 0)
        items.append((np.array([t for t, _ in known], np.int64), np.array([c for _, c in known], np.int64)))
    postings = indexed.select("ids", "copies", "n", "term", "place", "tf")

    def found(rows: DataFrame, floors: list[int]) -> DataFrame:
        return rows.mapInArrow(search_slices(items, weight, documents, words, floors, k), f"item int, id {kind}, score bigint")

    first = found(postings.filter(F.pmod(F.xxhash64(indexed["slice"]), F.lit(FIRST)) == 0), [1] * len(items))
    floors = [1] * len(items)
    for row in _best(first, k).filter(F.col("rank") == k).collect():  # one row per item of the block
        floors[row["item"]] = row["score"]
    by_item = _best(found(postings, floors), k)
    names = spark.createDataFrame([(x, text) for x, (text, _) in enumerate(asked_by)], "item int, text string")
    return by_item.join(F.broadcast(names), "item").select("text", "rank", "id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every item with their ranks: first within shares of the tasks' lists, then of all."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    shares = found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64)))
    kept = shares.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).filter(F.col("rank") <= k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("share")


def top_k(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text",
          item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(item id, ``rank``, document id, ``score``): the k best documents of every item with a score above 0.

    Starts jobs when called: the index of every block of items is written to the shared folder and searched from there.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    items = items.select(F.col(item_column).alias("item"), F.col(item_text_column).alias("text")).filter("text IS NOT NULL")
    texts = items.select("text").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    of_block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    found = functools.reduce(DataFrame.unionByName, [
        _block(docs, sorted(r["text"] for r in texts.filter(of_block == b).collect()), k) for b in range(blocks)])
    return items.join(found, "text").select(
        F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * docs) // words) AS m FROM n, total),
q AS (SELECT item_id, i, term, count(*) AS many
      FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
