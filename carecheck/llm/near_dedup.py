"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is its bag of shingles of five words (ASCII letters in lower case; a text of one to four words is one shingle), weighted
by tf * idf with idf = 1 + ln((1 + N) / (1 + df)) / (2 ln(1 + N)), N and df counted over all rows. Two texts are linked
if their weighted Jaccard similarity, the sum of minima over the sum of maxima, is 0.8 or more; classes are
the connected components of links, named by their smallest id. An empty text is like other empty texts only.

1. Documents are dealt over chunks. Chunks send their shingle hashes with counts to buckets, which add them up and return
   df where it is 2 or more.
2. A text whose shared shingles weigh less than 0.8 of it can have no link and is done: its similarity to any other is at most
   that share. The others are written with their weights; equal bags become one representative each.
3. Representatives are sampled BANDS * ROWS times; those that agree in all ROWS samples of a band meet in a group.
   Groups with the same members are checked once.
4. Within a group all similarities are computed exactly from the weights, and a spanning forest of the links goes on.
   Groups over GROUP members are cut in blocks first, which all hold the group's first members.
5. Components come from repeated joins to smaller neighbours, each round a written table.
6. Members of such a group that are still outside its largest component meet all other members of it, block against block,
   so no pair that agrees in a band stays unchecked unless it is in one component anyway.

A pair of similarity 0.8 misses all bands with a chance of 2e-5, in large groups too. A null text counts as empty; a null id is no smallest id
unless its class has no other; rows with one id and text are one; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import (
    BYTE_VALUES, GOLDEN, lower_ascii, mix, pack_planes, pack_sorted, slices, span_hashes, stored, unpack_planes,
    unpack_sorted, utf8, word_spans,
)

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 27, 5
GROUP = 1200  # members of a group that one task compares, or of a block
ANCHORS = 8  # members that the blocks of a group share
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20  # text whose shingles share a bucket
SLICE_BYTES = 2 << 20
HASH_BITS = 56
LAST = (1 << 63) - 1
DOC, KEY, CHUNK = "__near_doc", "__near_text_key", "__near_chunk"


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), sorted by row and hash."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(BYTE_VALUES[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = np.diff(first)
    shingles = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), shingles)
    if not len(row):
        return row, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(shingles)[:-1]], shingles) + first[row]
    hashed = span_hashes(words, begin, np.minimum(begin + WORDS, first[row + 1])) >> np.uint64(64 - HASH_BITS)
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])])
    return row[cut], hashed[cut], np.diff(np.r_[cut, len(row)])


def _bag_slices(chunk: pa.Table, text_column: str) -> Iterator[tuple]:
    """(slice of rows, row, hash, count) of a chunk, some rows at a time."""
    for part in slices(iter(chunk.select([DOC, KEY, text_column]).combine_chunks().to_batches()), text_column, SLICE_BYTES):
        yield part, *bags(*utf8(part.column(2)))


def chunk_counts(buckets: int, text_column: str):
    """For applyInArrow over a chunk: rows (bucket, chunk, hashes, counts) of its shingles and the rows that have them."""

    def run(chunk: pa.Table) -> pa.Table:
        hashes, counts = np.sort(np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in _bag_slices(chunk, text_column))])), None
        out = []
        if len(hashes):
            cut = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            counts = np.diff(np.r_[cut, len(hashes)]).astype("<u4")
            hashes = hashes[cut]
            bucket = (hashes >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            hashes, counts, bucket = hashes[order], counts[order], bucket[order]
            ends = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            out = [(int(bucket[x]), pack_sorted(hashes[x:y]), pack_planes(counts[x:y])) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        home = chunk.column(CHUNK)[0].as_py()
        return pa.table({
            "bucket": pa.array([x[0] for x in out], pa.int32()), "chunk": pa.array([home] * len(out), pa.int32()),
            "hashes": pa.array([x[1] for x in out], pa.binary()), "counts": pa.array([x[2] for x in out], pa.binary())})

    return run


def add_counts(table: pa.Table) -> pa.Table:
    """For applyInArrow over a bucket: rows (chunk, hashes, counts) with df of the shingles that two rows or more have."""
    parts = [unpack_sorted(b) for b in table.column("hashes").to_pylist()]
    hashes = np.concatenate(parts)
    counts = np.concatenate([unpack_planes(b, "<u4") for b in table.column("counts").to_pylist()]).astype(np.int64)
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(p) for p in parts])
    order = np.argsort(hashes, kind="stable")
    hashes, counts, chunk = hashes[order], counts[order], chunk[order]
    cut = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    df = np.repeat(np.add.reduceat(counts, cut), np.diff(np.r_[cut, len(hashes)]))
    kept = df > 1
    hashes, df, chunk = hashes[kept], np.minimum(df[kept], 0xFFFFFFFF).astype("<u4"), chunk[kept]
    order = np.argsort(chunk, kind="stable")
    hashes, df, chunk = hashes[order], df[order], chunk[order]
    ends = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)] if len(chunk) else np.zeros(1, np.int64)
    spans = list(zip(ends[:-1], ends[1:], strict=True))
    return pa.table({
        "chunk": pa.array(chunk[ends[:-1]], pa.int32()),
        "hashes": pa.array([pack_sorted(hashes[x:y]) for x, y in spans], pa.binary()),
        "counts": pa.array([pack_planes(df[x:y]) for x, y in spans], pa.binary())})


def idf(df: np.ndarray, rows: int) -> np.ndarray:
    return 1.0 + np.log((1.0 + rows) / (1.0 + df)) / (2.0 * np.log(1.0 + rows))


def candidates(rows: int, text_column: str):
    """For a cogroup of chunks with their df: (doc, text_key, bag, weights) of the texts that may have a link.

    ``bag`` names the bag of shingles; the packed hashes and weights stand at its first row in the chunk only.
    """

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        parts = [unpack_sorted(b) for b in found.column("hashes").to_pylist()]
        known = np.concatenate([np.zeros(0, np.uint64), *parts])
        counts = np.concatenate([np.zeros(0, np.uint32), *(unpack_planes(b, "<u4") for b in found.column("counts").to_pylist())])
        order = np.argsort(known)
        known, counts = known[order], counts[order]
        out, seen = [], set()
        for part, row, hashed, tf in _bag_slices(chunk, text_column):
            df = np.ones(len(hashed))
            if len(known):
                at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                df = np.where(known[at] == hashed, counts[at], 1).astype(float)
            weight = tf * idf(df, rows)
            n = part.num_rows
            total, shared = np.bincount(row, weight, n), np.bincount(row, np.where(df > 1, weight, 0.0), n)
            chosen = np.flatnonzero(shared >= SIMILARITY * total - 1e-9)
            bounds = np.searchsorted(row, np.arange(n + 1))
            with np.errstate(over="ignore"):
                name = np.zeros(n, np.uint64)
                np.add.at(name, row, mix(hashed * np.uint64(GOLDEN) + tf.astype(np.uint64)))
            docs, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
            for k in chosen.tolist():
                bag, blobs = int(name[k].astype(np.int64)), (None, None)
                if bag not in seen:
                    seen.add(bag)
                    span = slice(bounds[k], bounds[k + 1])
                    blobs = pack_sorted(hashed[span]), pack_planes(weight[span].astype("<f8"))
                out.append((int(docs[k]), int(keys[k]), bag, *blobs))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)],
                        ["doc", "text_key", "bag", "hashes", "weights"])

    return run


# --- sampling ---------------------------------------------------------------------------------

def _uniforms(hashed: np.ndarray, sample: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) per shingle, fixed by shingle, sample and k."""
    with np.errstate(over="ignore"):
        x = mix(hashed + np.uint64((GOLDEN * (4 * sample + k + 1)) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> np.uint64(32)).astype(float) + 0.5) / 2 ** 32, ((x & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) / 2 ** 32


def band_keys(hashed: np.ndarray, weight: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(bags, BANDS) keys by improved consistent weighted sampling; no bag may be empty."""
    log_weight = np.log(weight)
    keys = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    lengths = np.diff(offsets)
    for sample in range(BANDS * ROWS):
        a, b = _uniforms(hashed, sample, 0)
        r = -np.log(a * b)  # Gamma(2, 1)
        a, b = _uniforms(hashed, sample, 1)
        log_c = np.log(-np.log(a * b))
        beta, _ = _uniforms(hashed, sample, 2)
        t = np.floor(log_weight / r + beta)
        log_a = log_c - r * (t - beta) - r
        least = np.repeat(np.minimum.reduceat(log_a, offsets[:-1]), lengths)
        hits = np.flatnonzero(log_a == least)
        chosen = hits[np.searchsorted(hits, offsets[:-1])]
        with np.errstate(over="ignore"):
            value = mix(hashed[chosen] ^ mix(t[chosen].astype(np.int64).astype(np.uint64)))
            band = sample // ROWS
            keys[:, band] = mix(keys[:, band] * np.uint64(31) + value)
    return keys.astype(np.int64)


def sample_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (rep, hashes, weights): the rows with ``bands``."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            hashed = [unpack_sorted(b) for b in part.column(1).to_pylist()]
            weights = [unpack_planes(b, "<f8") for b in part.column(2).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(h) for h in hashed])]
            keys = band_keys(np.concatenate(hashed), np.concatenate(weights), offsets)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(keys), pa.list_(pa.int64()))], ["rep", "hashes", "weights", "bands"])


# --- checking groups ----------------------------------------------------------------------------

def similarities(hashed: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> Callable[[int], np.ndarray]:
    """A function from a member to its weighted Jaccard similarities to all members, from postings of shared shingles."""
    total = np.bincount(owner, weight, n)
    order = np.argsort(hashed, kind="stable")
    hashed, weight, owner = hashed[order], weight[order], owner[order]
    cut = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]])
    ends = np.r_[cut[1:], len(hashed)]
    term = np.repeat(np.arange(len(cut)), ends - cut)
    by_owner = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[by_owner], np.arange(n + 1))

    def of(k: int) -> np.ndarray:
        mine = by_owner[bounds[k]:bounds[k + 1]]
        begin, size = cut[term[mine]], (ends - cut)[term[mine]]
        posting = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        minima = np.bincount(owner[posting], np.minimum(np.repeat(weight[mine], size), weight[posting]), n)
        return minima / np.maximum(total[k] + total - minima, 1e-300)

    return of


def check_group(table: pa.Table) -> pa.Table:
    """For applyInArrow over a group (rep, label, visits, hashes, weights): a spanning forest (a, b) of its links, a < b.

    Members of one label count as linked. Where some visit the others, links of a visitor and another are wanted only.
    """
    rep, visits = table.column("rep").to_numpy(), table.column("visits").to_numpy(zero_copy_only=False)
    hashed = [unpack_sorted(b) for b in table.column("hashes").to_pylist()]
    weights = [unpack_planes(b, "<f8") for b in table.column("weights").to_pylist()]
    n = len(rep)
    root = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
    edges = []
    similar = similarities(np.concatenate(hashed), np.concatenate(weights), np.repeat(np.arange(n), [len(h) for h in hashed]), n)
    done = np.zeros(n, bool)
    while True:
        # two members that are not linked yet are not both in the largest component
        left = [~done & (root != np.bincount(root).argmax())]
        if visits.any():
            left += [~done & visits, ~done & ~visits]
        left = min(left, key=np.count_nonzero)
        if not left.any():
            break
        k = int(left.argmax())
        done[k] = True
        for other in np.flatnonzero((similar(k) >= SIMILARITY - 1e-9) & (root != root[k])):
            if root[k] != root[other]:
                root[root == root[other]] = root[k]
                edges.append((int(min(rep[k], rep[other])), int(max(rep[k], rep[other]))))
    return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _check(members: DataFrame, sampled: DataFrame, *by: str) -> DataFrame:
    """(a, b): the links in the groups named by ``by``, of members (*by, rep, label, visits)."""
    return members.join(sampled.select("rep", "hashes", "weights"), "rep").groupBy(*by).applyInArrow(check_group, "a bigint, b bigint")


def _homes(met: DataFrame) -> DataFrame:
    """(rep, home, block): members of large groups (band, key, rep), each in the first of its groups, cut in blocks of about GROUP."""
    homes = met.groupBy("rep").agg(F.min(F.struct("band", "key")).alias("home"))
    sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
    return homes.join(sizes, "home").select("rep", "home", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"))


def _groups(met: DataFrame, homes: DataFrame) -> DataFrame:
    """(members): distinct lists of representatives that meet; of large groups the blocks of ``homes``, which share some members."""
    members = F.sort_array(F.collect_list("rep")).alias("members")
    small = met.filter(F.col("n") <= GROUP).groupBy("band", "key").agg(members).select("members")
    blocks = homes.groupBy("home", "block").agg(members)
    shared = blocks.groupBy("home").agg(F.array_sort(F.flatten(F.collect_list(F.slice("members", 1, ANCHORS)))).alias("firsts"))
    cut = blocks.join(shared, "home").select(F.array_sort(F.array_union("members", F.slice("firsts", 1, ANCHORS))).alias("members"))
    return small.unionByName(cut).distinct()


def _visits(large: DataFrame, homes: DataFrame, joined: DataFrame) -> DataFrame:
    """(home, block, chunk, rep, label, visits): the pairs of large groups that ``joined`` (node, root) does not link.

    In every large group, the members outside its most frequent component visit the blocks of all members. Visitors of a
    block come in chunks of about GROUP, each of which meets the whole block.
    """
    labelled = stored(large.select("band", "key", "rep").join(joined, F.col("rep") == F.col("node"), "left").select(
        "band", "key", "rep", F.coalesce("root", "rep").alias("label")))
    mixed = labelled.groupBy("band", "key", "label").count().groupBy("band", "key").agg(
        F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = stored(labelled.join(mixed, ["band", "key"]).select("band", "key", "rep", (F.col("label") != F.col("main")).alias("apart")))
    blocks = mixed.join(homes, "rep").select("band", "key", "home", "block").distinct()
    visits = stored(mixed.filter("apart").join(blocks, ["band", "key"]).select("rep", "home", "block").distinct())
    chunks = visits.groupBy("home", "block").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
    visitors = visits.join(chunks, ["home", "block"]).select(
        "home", "block", F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk"), "rep", F.lit(True).alias("visits"))
    hosts = homes.join(chunks, ["home", "block"]).select(
        "home", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "rep", F.lit(False).alias("visits"))
    labels = labelled.select("rep", "label").distinct()
    return visitors.unionByName(hosts).join(labels, "rep")


def linked(sampled: DataFrame) -> DataFrame:
    """(node, root): the components of all links between representatives that meet in a band."""
    met = sampled.select("rep", F.posexplode("bands").alias("band", "key"))
    met = stored(met.join(met.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), ["band", "key"]))
    large = met.filter(F.col("n") > GROUP)
    homes = stored(_homes(large))
    groups = _groups(met, homes).withColumn("group", F.xxhash64("members")).select("group", F.explode("members").alias("rep"))
    joined = components(_check(groups.withColumns({"label": F.col("rep"), "visits": F.lit(False)}), sampled, "group"))
    if homes.isEmpty():
        return joined
    joined = stored(joined)
    more = _check(_visits(large, homes, joined), sampled, "home", "block", "chunk")
    return components(joined.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component; every round ends in a written table."""
    edges = stored(edges.select("a", "b").distinct())
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        # larger neighbours, and the node itself, hang on the smallest one around it
        hung = both.filter("b > a").join(least, "a").select(F.col("least").alias("a"), "b").unionByName(
            least.filter("least < a").select(F.col("least").alias("a"), F.col("a").alias("b")))
        hung = stored(hung.filter("a < b").distinct())
        # a node with several smaller neighbours ties them to the smallest
        smallest = hung.groupBy("b").agg(F.min("a").alias("least"), F.count("*").alias("n"))
        tied = hung.join(smallest, "b").select(F.col("least").alias("a"), F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("b"))
        tied = stored(tied.filter("a < b").distinct())
        edges = tied
        chains = tied.join(tied.select(F.col("b").alias("node")), F.col("a") == F.col("node"), "left_semi")
        if chains.isEmpty() and tied.groupBy("b").count().filter("count > 1").isEmpty():
            break  # stars only
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: bool = False) -> DataFrame:
    """(doc, text_key, class_id) of the rows that have a copy or a link; ``doc`` is the id or LAST for null.

    With ``rows`` a class is named by its first row (doc, text_key), not by the row's id alone.
    """
    stats = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_column)).alias("bytes")).first()
    number = lambda size: max(1, -(-(stats["bytes"] or 0) // size))
    chunked = docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(LAST)).alias(DOC), F.xxhash64(text_column).alias(KEY), F.col(text_column).alias("text"),
    ).withColumn(CHUNK, F.pmod(F.xxhash64(DOC, KEY), F.lit(number(CHUNK_BYTES))).cast("int"))
    counts = chunked.groupBy(CHUNK).applyInArrow(
        chunk_counts(number(BUCKET_BYTES), "text"), "bucket int, chunk int, hashes binary, counts binary")
    df = counts.groupBy("bucket").applyInArrow(add_counts, "chunk int, hashes binary, counts binary")
    left = stored(chunked.groupBy(CHUNK).cogroup(df.groupBy("chunk")).applyInArrow(
        candidates(stats["n"], "text"), "doc bigint, text_key bigint, bag bigint, hashes binary, weights binary"))
    row = F.struct("doc", "text_key") if rows else F.col("doc")
    named = left.groupBy("bag").agg(F.min(row).alias("rep"), F.count("*").alias("n"))
    whole = left.filter("hashes IS NOT NULL").groupBy("bag").agg(F.first(F.struct("hashes", "weights")).alias("x"))
    reps = stored(named.join(whole, "bag").select("bag", "rep", "x.hashes", "x.weights"))
    sampled = stored(reps.filter(F.col("bag") != 0).select(F.col("bag").alias("rep"), "hashes", "weights").mapInArrow(
        sample_bands, "rep bigint, hashes binary, weights binary, bands array<bigint>"))
    joined = linked(sampled)
    of_bag = reps.select("bag", "rep").join(joined, F.col("bag") == F.col("node"), "left").select(
        "bag", "rep", F.coalesce("root", "bag").alias("root"))
    least = of_bag.groupBy("root").agg(F.min("rep").alias("class_id"))
    named_bags = of_bag.join(least, "root").select("bag", "class_id")
    return left.select("doc", "text_key", "bag").distinct().join(named_bags, "bag").select("doc", "text_key", "class_id")


def _keyed(docs: DataFrame, found: DataFrame, id_column: str, text_column: str, how: str) -> DataFrame:
    """The rows joined with what was found for their id and text; names made here do not clash with the rows' own."""
    found = found.toDF(*[f"__near_found_{c}" for c in found.columns])
    keyed = docs.withColumns({DOC: F.coalesce(F.col(id_column).cast("bigint"), F.lit(LAST)), KEY: F.xxhash64(text_column)})
    return keyed.join(found, (F.col(DOC) == F.col("__near_found_doc")) & (F.col(KEY) == F.col("__near_found_text_key")), how)


def with_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = "class_id") -> DataFrame:
    """The rows with ``class_id``: the smallest id of the row's class, its own id if it has no near copy.

    A column of that name is replaced.
    """
    joined = _keyed(docs, classes(docs, id_column, text_column), id_column, text_column, "left")
    own = F.coalesce(F.nullif(F.col("__near_found_class_id"), F.lit(LAST)), F.col(id_column).cast("bigint"))
    return joined.select(*[c for c in docs.columns if c != name], own.alias(name))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class, the first by id and then by the text's hash; a row repeated with id and text stays once.

    Rows are told apart by id and text: rows that share an id, or have none, stay unless their texts are near copies.
    """
    found = classes(docs, id_column, text_column, rows=True)
    gone = found.filter((F.col("doc") != F.col("class_id.doc")) | (F.col("text_key") != F.col("class_id.text_key")))
    kept = _keyed(docs, gone.select("doc", "text_key").distinct(), id_column, text_column, "left_anti")
    if not docs.groupBy(id_column).count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([DOC, KEY])
    return kept.select(*docs.columns)
