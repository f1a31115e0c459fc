"""Language-model scores from a hierarchical Pitman-Yor model of words.

Every word is a customer of the restaurant of its context, the word before it (or the start of the text); every context
has a restaurant of its own, and all share the root restaurant as their parent, whose own base is uniform over the known words and
one for all unknown. A table of a context's restaurant is a customer of the root. Seating is sampled: in every Gibbs
round each (context, word) gets its tables anew by the Chinese-restaurant process, given the root's probabilities and table
totals of the round before. Probabilities are averaged over the last rounds' seatings.

How it runs: texts become chunks of word codes, written to the shared folder once. A chunk sends its distinct (context,
word) pairs with training counts to buckets by word; all counts of a word meet there, so its seating and its share of the root
need only the totals of its contexts, which the buckets exchange after every round by context, and a few numbers of fixed size
through the driver. Words that make up a two-thousandth of all tokens or more, 2,000 at most, are dealt by word and
context instead; their root probabilities travel with those numbers. Buckets return a probability per pair to the chunks
that sent it, and a chunk adds up its texts. Seeds are fixed, so a repeated task repeats its seating. Buckets are stored as a
bucketed table in the shared folder, so that the rounds read them in place and only totals are shuffled.

A null or empty text is its end token. A null id counts as not held out; ids are of any type. Repeated rows get the same
scores. Without training rows every probability is that of the uniform base. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import (
    BYTE_VALUES, crc_of_id, lower_ascii, mix, pack_planes, pack_sorted, slices, span_hashes, stored, unpack_planes,
    unpack_sorted, utf8, word_spans,
)
from carecheck.session import shared_dir

ROUNDS, AVERAGED = 3, 2  # Gibbs rounds, and the last of them that are averaged
STRENGTH = (1.0, 1.0)  # of the root and of the contexts' restaurants
HOT_SHARE = 2000
CHUNK_BYTES = 8 << 20  # text that sends its pairs together
SLICE_BYTES = 1 << 20  # text hashed at a time
BUCKET_BYTES = 8 << 20  # text whose pairs share a bucket
BUCKETS_A_PART = 16  # buckets for each part of the contexts' exchange
MOST_PARTITIONS = 50_000  # of the table of buckets
START, END = np.uint64(1), np.uint64(2)
CONTEXT_BITS = 48
CONTEXT_MASK = np.uint64((1 << CONTEXT_BITS) - 1)


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token and the number of tokens per row; a row's last token is its end."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    rows = len(offsets) - 1
    word = np.empty(len(starts) + rows, np.uint64)
    at_end = first[1:] + np.arange(rows)
    inner = np.ones(len(word), bool)
    inner[at_end] = False
    word[at_end] = END
    if len(starts):
        word[inner] = span_hashes(BYTE_VALUES[data], starts, ends)
    return word, np.diff(first) + 1


def _cuts(*sorted_by: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    n = len(sorted_by[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for x in sorted_by:
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


# --- chunks ---------------------------------------------------------------------------------

CHUNKS = "chunk bigint, ids binary, words binary, codes binary, sizes binary"


def chunk_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (id, held_out, text): chunks of rows with their words as codes, numbered by task."""
    number = TaskContext.get().partitionId() << 32
    for part in slices(batches, "text", CHUNK_BYTES):
        if part.num_rows:
            found = [occurrences(*utf8(piece.column(2))) for piece in slices([part], "text", SLICE_BYTES)]
            words, codes = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
            sizes = np.concatenate([n for _, n in found])
            del found
            sink = pa.BufferOutputStream()
            ids = part.select(["id", "held_out"])
            with pa.ipc.new_stream(sink, ids.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(ids)
            blobs = [sink.getvalue().to_pybytes(), pack_sorted(words), pack_planes(codes.astype("<u4")), pack_planes(sizes.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]], _names(CHUNKS))
            number += 1


class Chunk:
    """A chunk's rows and its distinct (context, word) pairs in the order in which they are sent: by bucket, word, context."""

    def __init__(self, row: dict, buckets: int, hot: np.ndarray):
        self.number = row["chunk"]
        self.ids = pa.ipc.open_stream(pa.py_buffer(row["ids"])).read_all()
        words, self.sizes = unpack_sorted(row["words"]), unpack_planes(row["sizes"], "<u4").astype(np.int64)
        codes, n = unpack_planes(row["codes"], "<u4"), len(words)
        self.first = np.cumsum(self.sizes) - self.sizes
        key = codes.astype(np.int64) * (n + 1)
        key[1:] += codes[:-1]
        key[self.first] = codes[self.first].astype(np.int64) * (n + 1) + n
        del codes
        order = np.argsort(key)
        key = key[order]
        starts = _cuts(key)
        pairs, inverse = key[starts], np.empty(len(key), np.int32)
        del key
        inverse[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(order)]))
        del order, starts
        contexts = mix(np.r_[words, START]) >> np.uint64(64 - CONTEXT_BITS)
        self.word, self.context = words[pairs // (n + 1)], contexts[pairs % (n + 1)]
        del pairs, words, contexts
        place = mix(self.word)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, self.word), len(hot) - 1)] == self.word
            place[is_hot] = mix(self.word[is_hot] ^ mix(self.context[is_hot] + np.uint64(1)))
        self.bucket = (place % np.uint64(buckets)).astype(np.int32)
        del place
        order = np.lexsort((self.context, self.word, self.bucket))
        self.word, self.context, self.bucket = self.word[order], self.context[order], self.bucket[order]
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.pair = back[inverse]  # of every token

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums over the rows' tokens of values per pair; every row has a token."""
        return np.add.reduceat(values[self.pair], self.first)


def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over chunks: (word, n) of words with a part in HOT_SHARE of a chunk's tokens; word 0 has all."""
    found: dict[int, int] = {0: 0}
    for row in _stored_rows(batches):
        n = np.bincount(unpack_planes(row["codes"], "<u4"))
        word = unpack_sorted(row["words"])
        found[0] += int(n.sum())
        for k in np.flatnonzero(n * 2 * HOT_SHARE >= n.sum()).tolist():
            key = int(word[k].astype(np.int64))
            found[key] = found.get(key, 0) + int(n[k])
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


SENT = "bucket int, chunk bigint, words binary, pairs binary, contexts binary, counts binary"


def send(buckets: int, hot: np.ndarray):
    """For mapInArrow over chunks: their distinct pairs with training counts, one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _stored_rows(batches):
            c = Chunk(row, buckets, hot)
            train = np.repeat(~c.ids.column("held_out").to_numpy(), c.sizes)
            counts = np.bincount(c.pair[train], minlength=len(c.word)).astype("<u4")
            ends = np.r_[_cuts(c.bucket), len(c.bucket)]
            rows = []
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                cut = _cuts(c.word[x:y])
                rows.append((int(c.bucket[x]), c.number, pack_sorted(c.word[x:y][cut]), pack_planes(np.diff(np.r_[cut, y - x]).astype("<u4")),
                             pack_planes(np.diff(c.context[x:y], prepend=np.uint64(0)) & CONTEXT_MASK), pack_planes(counts[x:y])))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], _names(SENT))

    return run


STORED = "bucket int, n_contexts int, words binary, pairs binary, names binary, contexts binary, counts binary, chunks array<bigint>, places array<binary>"


def merge_bucket(table: pa.Table) -> pa.Table:
    """For applyInArrow over a bucket: its pairs with training counts, its contexts, and the places of each chunk's pairs."""
    rows = table.to_pylist()
    del table
    word = np.concatenate([np.repeat(unpack_sorted(r["words"]), unpack_planes(r["pairs"], "<u4")) for r in rows])
    context = np.concatenate([unpack_sorted(r["contexts"]) & CONTEXT_MASK for r in rows])
    count = np.concatenate([unpack_planes(r["counts"], "<u4") for r in rows])
    sent = [int(unpack_planes(r["pairs"], "<u4").sum()) for r in rows]
    chunks, number = [r["chunk"] for r in rows], rows[0]["bucket"]
    del rows
    order = np.lexsort((context, word))
    cut = _cuts(word[order], context[order])  # equal pairs of several chunks
    place = np.empty(len(order), np.uint64)
    place[order] = np.repeat(np.arange(len(cut), dtype=np.uint64), np.diff(np.r_[cut, len(order)]))
    counts = np.add.reduceat(count[order].astype(np.int64), cut)
    word, context = word[order[cut]], context[order[cut]]
    del order, count
    by_word = _cuts(word)
    names, local = np.unique(context, return_inverse=True)
    return pa.table({
        "bucket": pa.array([number], pa.int32()), "n_contexts": pa.array([len(names)], pa.int32()),
        "words": pa.array([pack_sorted(word[by_word])], pa.binary()),
        "pairs": pa.array([pack_planes(np.diff(np.r_[by_word, len(word)]).astype("<u4"))], pa.binary()),
        "names": pa.array([pack_sorted(names)], pa.binary()),
        "contexts": pa.array([pack_planes(local.astype("<u4"))], pa.binary()),
        "counts": pa.array([pack_planes(counts.astype("<i8"))], pa.binary()),
        "chunks": pa.array([chunks], pa.list_(pa.int64())),
        "places": pa.array([[pack_sorted(p) for p in np.split(place, np.cumsum(sent)[:-1])]], pa.list_(pa.binary())),
    })


# --- the model ------------------------------------------------------------------------------

@dataclass
class Round:
    """Numbers of fixed size that a round leaves: the root's totals, hot words' root probabilities."""

    root_customers: float
    root_tables: float
    hot: np.ndarray


@dataclass
class Model:
    hot: np.ndarray  # sorted hashes
    hot_counts: np.ndarray
    tokens: int
    words: int
    discounts: tuple[float, float]  # of the root and of the contexts
    rounds: list[Round] = field(default_factory=list)

    def root(self, customers: np.ndarray, tables: np.ndarray, r: Round) -> np.ndarray:
        d, strength = self.discounts[0], STRENGTH[0]
        return (customers - d * tables + (strength + d * r.root_tables) / (self.words + 1)) / (strength + r.root_customers)


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each restaurant's customers one by one; ``mass`` weighs a new table.

    From the 32nd customer on, an eighth of those seated come at a time with one probability.
    """
    tables = (customers > 0).astype(float)
    at, j = np.flatnonzero(customers > 1), 1
    while len(at):
        step = max(1, j // 8) if j >= 32 else 1
        new = mass[at] / (mass[at] + j - discount * tables[at])
        if step == 1:
            tables[at] += rng.random(len(at)) < new
        else:
            tables[at] += rng.binomial(np.minimum(step, customers[at] - j), new)
        j += step
        at = at[customers[at] > j]
    return tables


class Bucket:
    """One bucket's words and pairs, and the seatings of the rounds so far.

    ``totals``: of every context of the bucket its training tokens, its distinct words, then its tables after each round.
    """

    def __init__(self, row: dict, model: Model, totals: list[np.ndarray]):
        self.model, self.number, self.totals = model, row["bucket"], totals
        self.contexts = row["n_contexts"]
        self.word = unpack_sorted(row["words"])
        self.of = np.repeat(np.arange(len(self.word), dtype=np.int32), unpack_planes(row["pairs"], "<u4"))
        self.context = unpack_planes(row["contexts"], "<u4")
        self.count = unpack_planes(row["counts"], "<i8")
        place = np.searchsorted(model.hot, self.word)
        self.is_hot = np.zeros(len(self.word), bool)
        if len(model.hot):
            self.is_hot = model.hot[np.minimum(place, len(model.hot) - 1)] == self.word
        self.hot_place = place[self.is_hot]
        self.own_total = np.bincount(self.of, self.count, len(self.word)).astype(np.int64)
        self.total = self.own_total.copy()
        self.total[self.is_hot] = model.hot_counts[self.hot_place]

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, self.contexts).astype("<i8")

    def seatings(self, rounds: int) -> Iterator[tuple]:
        """(tables of pairs, root customers and tables of words) of each round; needs the totals of the round before."""
        m = self.model
        root = (self.total + 1.0) / (m.tokens + m.words + 1.0)
        for k in range(1, rounds + 1):
            rng = np.random.default_rng([17, self.number, k])
            tables = seat(self.count, (STRENGTH[1] + m.discounts[1] * self.totals[k][self.context]) * root[self.of], m.discounts[1], rng)
            customers = np.bincount(self.of, tables, len(self.word))
            mass = (STRENGTH[0] + m.discounts[0] * m.rounds[k - 1].root_tables) / (m.words + 1)
            own = seat(customers.astype(np.int64), np.full(len(self.word), mass), m.discounts[0], rng)
            yield tables, customers, own
            if k < len(m.rounds):
                root = self.root(customers, own, m.rounds[k])

    def root(self, customers: np.ndarray, own: np.ndarray, r: Round) -> np.ndarray:
        root = self.model.root(customers, own, r)
        root[self.is_hot] = r.hot[self.hot_place]
        return root

    def probabilities(self) -> np.ndarray:
        """Of every pair, averaged over the last rounds."""
        out = np.zeros(len(self.of))
        d, strength = self.model.discounts[1], STRENGTH[1]
        customers_of = self.totals[0][self.context]
        for k, (tables, customers, own) in enumerate(self.seatings(ROUNDS), 1):
            if k > ROUNDS - AVERAGED:
                root = self.root(customers, own, self.model.rounds[k])
                out += (self.count - d * tables + (strength + d * self.totals[k + 1][self.context]) * root[self.of]) / (strength + customers_of)
        return out / AVERAGED


# --- what buckets exchange --------------------------------------------------------------------

LEFT = "bucket int, part int, names binary, totals binary, kind string, id bigint, value double"


def _left(number: int, parts: int, names: dict[int, np.ndarray], totals: list[np.ndarray], numbers: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """What a bucket leaves for the next round: totals of its contexts by part of the exchange, and numbers to add up.

    ``names``: per part the contexts, ascending; ``totals`` are in their order. Numbers go to parts of their own, a few buckets' to each.
    """
    flat = [(k, int(i), float(x)) for k, (ids, values) in numbers.items() for i, x in zip(ids, values, strict=True) if x]
    n, m = len(names), len(flat)
    ends = np.cumsum([len(x) for x in names.values()])
    split = list(zip(*(np.split(t, ends[:-1]) for t in totals), strict=True))
    return pa.table({
        "bucket": pa.array([number] * (n + m), pa.int32()),
        "part": pa.array([*names, *[parts + number % parts] * m], pa.int32()),
        "names": pa.array([*map(pack_sorted, names.values()), *[None] * m], pa.binary()),
        "totals": pa.array([*(pack_planes(np.concatenate(t)) for t in split), *[None] * m], pa.binary()),
        "kind": pa.array([None] * n + [k for k, _, _ in flat], pa.string()),
        "id": pa.array([None] * n + [i for _, i, _ in flat], pa.int64()),
        "value": pa.array([None] * n + [x for _, _, x in flat], pa.float64()),
    })


SUMS = "bucket int, round int, part int, names binary, totals binary, kind string, id bigint, value double"


def add_totals(number: int):
    """For applyInArrow over a part of the exchange: the sums over all buckets, for each bucket its own contexts.

    The first round's answer also numbers a part's contexts; these short names take the place of hashes in later rounds.
    """

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() is not None:
            sums = table.group_by(["kind", "id"]).aggregate([("value", "sum")])
            none = lambda kind: pa.nulls(sums.num_rows, kind)
            return pa.table({
                "bucket": none(pa.int32()), "round": none(pa.int32()), "part": none(pa.int32()), "names": none(pa.binary()),
                "totals": none(pa.binary()), "kind": sums.column("kind"), "id": sums.column("id"), "value": sums.column("value_sum")})
        rows = table.select(["bucket", "part", "names", "totals"]).to_pylist()
        names = [unpack_sorted(r["names"]) for r in rows]
        sent = [unpack_planes(r["totals"], "<i8").reshape(-1, len(x)) for r, x in zip(rows, names, strict=True)]
        distinct, index = np.unique(np.concatenate(names), return_inverse=True)
        sums = [np.bincount(index, np.concatenate([t[k] for t in sent]), len(distinct)).astype("<i8") for k in range(len(sent[0]))]
        own, n = np.split(index, np.cumsum([len(x) for x in names])[:-1]), len(rows)
        return pa.table({
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "round": pa.array([number] * n, pa.int32()),
            "part": pa.array([r["part"] for r in rows], pa.int32()),
            "names": pa.array([None if number else pack_sorted(i.astype(np.uint64)) for i in own], pa.binary()),
            "totals": pa.array([pack_planes(np.concatenate([s[i] for s in sums])) for i in own], pa.binary()),
            "kind": pa.nulls(n, pa.string()), "id": pa.nulls(n, pa.int64()), "value": pa.nulls(n, pa.float64())})

    return run


def _totals(sums: pa.Table) -> tuple[dict[int, np.ndarray], list[np.ndarray]]:
    """A bucket's contexts by part of the exchange, and their totals: two of the first count, then one per round."""
    rows = sorted(sums.select(["round", "part", "names", "totals"]).to_pylist(), key=lambda r: (r["round"], r["part"]))
    names = {r["part"]: unpack_sorted(r["names"]) for r in rows if r["names"] is not None}
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["round"], []).append(unpack_planes(r["totals"], "<i8").reshape(-1, len(names[r["part"]])))
    return names, [column for k in sorted(found) for column in np.concatenate(found[k], axis=1).astype(float)]


def first_numbers(hot: np.ndarray, parts: int):
    """For mapInArrow over stored buckets: counts and distinct words per context, counts per hot word, counts of counts."""
    model = Model(hot, np.zeros(len(hot), np.int64), 0, 0, (0.5, 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _stored_rows(batches):
            b = Bucket(row, model, [])
            names = unpack_sorted(row["names"])
            part = (names >> np.uint64(CONTEXT_BITS - 32)) * np.uint64(parts) >> np.uint64(32)
            cut = _cuts(part)
            by_part = dict(zip(part[cut].tolist(), np.split(names, cut[1:]), strict=True))
            total = b.own_total[~b.is_hot]
            yield from _left(b.number, parts, by_part, [b.by_context(b.count), b.by_context(b.count > 0)], {
                "hot": (b.hot_place, b.own_total[b.is_hot]),
                "pairs": (np.arange(3), np.array([(b.count > 0).sum(), (b.count == 1).sum(), (b.count == 2).sum()])),
                "words": (np.arange(4), np.array([(total > 0).sum(), (total == 1).sum(), (total == 2).sum(), total.sum()])),
            }).to_batches()

    return run


def round_numbers(shared, parts: int):
    """For cogroup over a bucket and its totals: what the next round adds up."""

    def run(bucket: pa.Table, sums: pa.Table) -> pa.Table:
        model, row = shared.value, bucket.to_pylist()[0]
        names, totals = _totals(sums)
        b = Bucket(row, model, totals)
        *_, (tables, customers, own) = b.seatings(len(model.rounds))
        return _left(b.number, parts, names, [b.by_context(tables)], {
            "hot": (b.hot_place, customers[b.is_hot]), "root": (np.arange(2), np.array([tables.sum(), own[~b.is_hot].sum()]))})

    return run


ANSWERS = "chunk bigint, bucket int, scores binary, counts binary"


def score_bucket(shared):
    """For cogroup over a bucket and its totals: log10 probabilities of each chunk's pairs, training counts of its words."""

    def run(bucket: pa.Table, sums: pa.Table) -> pa.Table:
        row = bucket.to_pylist()[0]
        b = Bucket(row, shared.value, _totals(sums)[1])
        scores = np.log10(b.probabilities()).astype("<f4")
        packed, counts = [], []
        for blob in row["places"]:
            place = unpack_sorted(blob).astype(np.int64)
            of = b.of[place]
            packed.append(pack_planes(scores[place]))
            counts.append(pack_planes(b.total[of[_cuts(of)]].astype("<i8")))
        return pa.table({
            "chunk": pa.array(row["chunks"], pa.int64()), "bucket": pa.array([b.number] * len(packed), pa.int32()),
            "scores": pa.array(packed, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def add_up(shared, buckets: int):
    """For cogroup over a chunk and the answers to it: its rows' numbers."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        c = Chunk(chunk.to_pylist()[0], buckets, model.hot)
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        score = np.concatenate([unpack_planes(r["scores"], "<f4") for r in rows]).astype(float)
        cut = _cuts(c.bucket, c.word)
        count = np.repeat(np.concatenate([unpack_planes(r["counts"], "<i8") for r in rows]), np.diff(np.r_[cut, len(c.word)]))
        base = np.log10((count + 1.0) / (model.tokens + model.words + 1.0))
        return pa.table({
            "id": c.ids.column("id"), "held_out": c.ids.column("held_out"), "n_tokens": pa.array(c.sizes, pa.int64()),
            "n_known": pa.array(c.per_row((count > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([model.tokens] * len(c.sizes), pa.int64()),
            "base_score": pa.array(c.per_row(base), pa.float64()), "score": pa.array(c.per_row(score), pa.float64())})

    return run


# --- whole tables -----------------------------------------------------------------------------

def _stored_by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """The rows as a table in the shared folder that is bucketed by ``bucket``; its name leaves the catalog, its files stay."""
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    df.write.bucketBy(min(buckets, MOST_PARTITIONS), "bucket").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _collect(rows: DataFrame) -> dict[str, dict[int, float]]:
    """Sums of the tasks' numbers: contexts + hot words + a few values."""
    out: dict[str, dict[int, float]] = {}
    for r in rows.groupBy("kind", "id").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["kind"], {})[r["id"]] = r["value"]
    return out


def _array(found: dict[str, dict[int, float]], kind: str, n: int) -> np.ndarray:
    out = np.zeros(n)
    for k, v in found.get(kind, {}).items():
        out[k] = v
    return out


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


def fit(buckets: DataFrame, hot: np.ndarray, parts: int) -> tuple[Model, DataFrame]:
    """Seating rounds over the stored buckets, and the totals that they leave; the driver holds numbers of fixed size."""
    spark = buckets.sparkSession
    model_only = buckets.drop("names", "chunks", "places")

    def exchanged(left: DataFrame, number: int) -> tuple[dict, DataFrame]:
        sums = stored(left.groupBy("part").applyInArrow(add_totals(number), SUMS))
        return _collect(sums.filter("kind IS NOT NULL")), sums.filter("part IS NOT NULL").select("bucket", "round", "part", "names", "totals")

    found, sums = exchanged(buckets.drop("chunks", "places").mapInArrow(first_numbers(hot, parts), LEFT), 0)
    hot_counts = _array(found, "hot", len(hot)).astype(np.int64)
    words, pairs = _array(found, "words", 4), _array(found, "pairs", 3)
    model = Model(
        hot, hot_counts, int(words[3] + hot_counts.sum()), int(words[0] + (hot_counts > 0).sum()),
        (_discount(words[1], words[2]), _discount(pairs[1], pairs[2])))
    model.rounds.append(Round(pairs[0], float(model.words), (hot_counts + 1.0) / (model.tokens + model.words + 1.0)))
    for k in range(1, ROUNDS + 1):
        shared = spark.sparkContext.broadcast(model)
        left = model_only.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(round_numbers(shared, parts), LEFT)
        found, new_sums = exchanged(left, k)
        sums = sums.unionByName(new_sums)
        root, hot_customers = _array(found, "root", 2), _array(found, "hot", len(hot))
        mass = (STRENGTH[0] + model.discounts[0] * model.rounds[-1].root_tables) / (model.words + 1)
        hot_tables = seat(hot_customers.astype(np.int64), np.full(len(hot), mass), model.discounts[0], np.random.default_rng([17, -k % 2 ** 31, k]))
        new = Round(root[0], root[1] + hot_tables.sum(), np.zeros(0))
        new.hot = model.root(hot_customers, hot_tables, new)
        model = replace(model, rounds=[*model.rounds, new])
    return model, sums


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    parts = max(1, -(-n_buckets // BUCKETS_A_PART))
    held_out = F.coalesce(crc_of_id(id_column) % 7 == 2, F.lit(False))
    rows = docs.select(F.col(id_column).alias("id"), held_out.alias("held_out"), F.col(text_column).alias("text"))
    chunks = stored(rows.mapInArrow(chunk_texts, CHUNKS))
    often = chunks.select("words", "codes").mapInArrow(frequent, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = often.filter("word = 0").first()
    tokens = tokens["n"] if tokens else 0
    hot = often.filter((F.col("word") != 0) & (F.col("n") * HOT_SHARE >= tokens)).select("word").collect()  # HOT_SHARE at most
    hot = np.sort(np.array([r["word"] for r in hot], np.int64).view(np.uint64))
    sent = chunks.mapInArrow(send(n_buckets, hot), SENT)
    buckets = _stored_by_bucket(sent.groupBy("bucket").applyInArrow(merge_bucket, STORED), n_buckets)
    model, sums = fit(buckets, hot, parts)
    shared = spark.sparkContext.broadcast(model)
    answers = buckets.drop("names").groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(score_bucket(shared), ANSWERS)
    kind = docs.schema[id_column].dataType.simpleString()
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        add_up(shared, n_buckets), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    ).withColumnRenamed("id", id_column)
