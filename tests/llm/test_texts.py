"""Operators on documents against plain evaluations of their definitions, on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as tok
import pytest
import tiktoken
from tokenizers import Tokenizer

from carecheck.llm import byte_bpe, common, near_dedup, packing, pitman_yor, quality, ring, rule_ledger, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def crc(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def plain(r):
    return tuple(r)


# --- 1 ------------------------------------------------------------------------------------

def removed(rows, length=50):
    first = {}
    for doc_id, text in rows:
        data, key = (text or "").encode(), LAST if doc_id is None else doc_id
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            first[w] = min(first.get(w, LAST), key)
    for doc_id, text in rows:
        data, key = (text or "").encode(), LAST if doc_id is None else doc_id
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < key:
                gone[i:i + length] = True
        yield doc_id, data, gone


def test_suffix_dedup(docs, rows):
    want = []
    for doc_id, data, gone in removed(rows):
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(plain, suffix_dedup.report(docs).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [0, 2])
def test_suffix_dedup_of_hot_anchors(docs, monkeypatch, limit):
    want = sorted(map(plain, suffix_dedup.report(docs).collect()), key=repr)
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", limit)
    assert sorted(map(plain, suffix_dedup.report(docs).collect()), key=repr) == want


def test_suffix_dedup_deals_a_hot_anchor_over_buckets():
    """A phrase of 40 bytes that all texts have, each between other bytes."""
    rng = np.random.default_rng(2)
    letters = lambda: "".join(map(chr, rng.integers(97, 123, 40)))
    phrase, n = letters(), 5000
    texts = [letters() + phrase + letters() for _ in range(n)]
    chunk = pa.table({
        suffix_dedup.DOC: pa.array(range(n), pa.int64()), suffix_dedup.KEY: pa.array(range(n), pa.int64()),
        suffix_dedup.CHUNK: pa.array([0] * n, pa.int32()), "text": texts})
    shared = suffix_dedup.shared_anchors(suffix_dedup.HOT_PIECES)(suffix_dedup.chunk_anchors(1, 50, "text")(chunk))
    cut = suffix_dedup.chunk_pieces(16, 50, "text")(chunk, shared).to_pylist()
    sizes = [len(suffix_dedup._from_blob(r["blob"])[0]) for r in cut if r["blob"] is not None]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_clean_texts_keeps_columns_and_characters(docs, rows):
    got = suffix_dedup.clean_texts(docs)
    assert got.schema == docs.schema
    found = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    want = collections.Counter()
    for (doc_id, text), (_, data, gone) in zip(rows, removed(rows), strict=True):
        at, kept = 0, []
        for c in text or "":
            n = len(c.encode())
            if not gone[at:at + n].any():
                kept.append(c)
            at += n
        want[doc_id, "".join(kept) if text is not None else None] += 1
    assert found == want


def test_suffix_order_is_the_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(9), 50, 301]:
        for letters in (1, 2, 5):
            x = rng.integers(0, letters, n)
            assert suffix_dedup.suffix_order(x, n + 1).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
            heads = [x[i:i + 7].tolist() for i in suffix_dedup.suffix_order(x, 7)]
            assert heads == sorted(heads)


def test_every_chunk_is_cut_once(spark, docs, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 40_000)
    made = suffix_dedup.chunk_pieces

    def counted(*args):
        run = made(*args)

        def cut(chunk, wanted):
            calls.add(1)
            return run(chunk, wanted)

        return cut

    monkeypatch.setattr(suffix_dedup, "chunk_pieces", counted)
    assert suffix_dedup.report(docs).collect()
    total = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert 1 < calls.value <= -(-total // 40_000)


# --- 2 ------------------------------------------------------------------------------------

def test_packing(docs, rows):
    path = tok.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    ids = collections.defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    pieces = packing.pack(docs, path, 2, size=256, windows=3).collect()
    sequences = collections.defaultdict(list)
    starts = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        starts[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 256 and at & (at - 1) == 0  # nothing is padded
    for doc_id, copies in ids.items():
        want = sum(len(c) for c in copies)
        assert sum(p[1] for p in starts[doc_id]) == want
        for start, length, check, n in starts[doc_id]:
            packed = np.array(copies[0][start:start + length], "<u4").tobytes()
            assert n == len(copies[0]) and zlib.crc32(packed) == check


def test_packing_merges_in_rounds(docs, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 2)
    path = tok.path("word_bpe_49k.json")
    one = packing.pack(docs.repartition(7), path, 2, size=512, windows=2)
    assert one.groupBy().sum("length").first()[0] == packing.pack(docs, path, 2).groupBy().sum("length").first()[0]
    assert one.groupBy("sequence_id").sum("length").filter("`sum(length)` > 512").isEmpty()


# --- 3 ------------------------------------------------------------------------------------

def near_classes(rows):
    bags = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        bags.append(collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    df, n = collections.Counter(k for b in bags for k in b), len(rows)
    idf = {k: 1 + math.log((1 + n) / (1 + d)) / (2 * math.log(1 + n)) for k, d in df.items()}
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            low = sum(min(c, bags[j][k]) * idf[k] for k, c in bags[i].items())
            high = sum(c * idf[k] for b in (bags[i], bags[j]) for k, c in b.items()) - low
            if bags[i] == bags[j] or high and low / high >= 0.8 - 1e-9:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (doc_id, _), r in zip(rows, root, strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, LAST), doc_id)
    return [(doc_id, text, least.get(r)) for (doc_id, text), r in zip(rows, root, strict=True)]


@pytest.mark.parametrize("group", [1200, 3])
def test_near_dedup(docs, rows, monkeypatch, group):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    got = [(r["doc_id"], r["text"], r["class_id"]) for r in near_dedup.with_classes(docs).collect()]
    assert sorted(got, key=repr) == sorted(near_classes(rows), key=repr)


def test_near_dedup_links_across_blocks_of_a_large_group(spark, monkeypatch):
    """Pairs of near copies of one template that all meet in all bands: the links are the pairs' own."""

    def all_meet(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[0] * 27] * b.num_rows, pa.list_(pa.int64()))], ["rep", "hashes", "weights", "bands"])

    monkeypatch.setattr(near_dedup, "sample_bands", all_meet)
    monkeypatch.setattr(near_dedup, "GROUP", 3)
    monkeypatch.setattr(near_dedup, "ANCHORS", 1)
    template = " ".join(f"word{k}" for k in range(60))
    rows = [
        (2 * k + j, template + " " + " ".join(f"own{k}x{x}" for x in range(28)) + f" last{j}")
        for k in range(20) for j in range(2)
    ]
    want = near_classes(rows)
    assert len({c for _, _, c in want}) == 20
    got = near_dedup.with_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["text"], r["class_id"]) for r in got) == sorted(want)


def test_near_dedup_keeps_one_of_each_class(docs, rows):
    got = near_dedup.keep_first(docs)
    assert got.columns == docs.columns
    want = {c for _, _, c in near_classes(rows) if c is not None}
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted(want)


def test_near_dedup_tells_rows_apart_by_id_and_text(spark):
    """Rows without an id, or of one id, stay while their texts differ; copies and repeated rows go."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [" ".join(words[k:] + words[:k]) + f" own{k}" for k in range(7)]
    probe = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:]]
    more = [(7, texts[5]), (9, texts[6]), (None, texts[0]), (8, texts[1])]
    rows = lambda x: spark.createDataFrame(x, "doc_id bigint, text string")
    assert sorted(map(plain, near_dedup.keep_first(rows(probe)).collect()), key=repr) == sorted(probe, key=repr)
    want = [(8, t) if t == texts[1] else (i, t) for i, t in probe]
    assert sorted(map(plain, near_dedup.keep_first(rows(probe + more)).collect()), key=repr) == sorted(want, key=repr)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (150, 200), (150, 300), (7, 400)]
    got = dict(map(plain, near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {k: 0 for k in [*range(41), 400]} | {100: 100, 150: 100, 200: 100, 300: 100}


# --- 4 ------------------------------------------------------------------------------------

def test_quality_learns_and_never_sees_the_fold(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    first = {r["doc_id"]: r for r in quality.classify(docs, docs, labels).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (crc(i) % 5 == 0) for i, r in first.items())
    known = [(first[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in first]
    held = [(r["score"], q) for r, q in known if r["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(s > t) + (s == t) / 2 for s in good for t in bad]) > 0.9
    turned = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, docs, turned).collect()}
    assert all(again[i] == r["score"] for i, r in first.items())


@pytest.mark.parametrize("from_zero", [True, False])
def test_ftrl_takes_the_same_steps_as_a_plain_one(from_zero):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["care", "ward", "Bed", "x1", "!!"], rng.integers(0, 12))) for _ in range(60)]
    labels = np.array([int("care" in t) for t in texts])
    start = np.zeros((1 << quality.BITS) + 1)
    if not from_zero:
        start[-1] = 0.25
        start[np.unique(quality.features(*quality.utf8(pa.array(texts)))[1])[::2]] = -0.5
    got = quality.ftrl(start, pa.array(texts), labels)

    root_of = lambda n: (quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2
    weight = lambda z, n: 0.0 if abs(z) <= quality.L1 else -(z - math.copysign(quality.L1, z)) / root_of(n)
    state = {}
    for text, label in zip(texts, labels, strict=True):
        _, hashed, values = quality.features(*quality.utf8(pa.array([text])))
        x = collections.Counter()
        for key, value in zip(hashed.tolist(), values.tolist(), strict=True):
            x[key] += value
        x[len(start) - 1] = 1.0
        for key in x:
            sign = int(start[key] > 0) - int(start[key] < 0)
            state.setdefault(key, (-start[key] * root_of(1.0) - sign * quality.L1, 1.0))
        w = {key: weight(*state[key]) for key in x}
        off = 1 / (1 + math.exp(-sum(w[key] * x[key] for key in x))) - label
        for key in x:
            z, n = state[key]
            g = off * x[key]
            state[key] = (z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / quality.ALPHA * w[key], n + g * g)
    assert len(state) > 10
    for key, (z, n) in state.items():
        assert got[key] == pytest.approx(weight(z, n), abs=1e-9)
    others = np.delete(np.arange(len(start)), list(state))
    assert np.allclose(got[others], start[others])


def test_training_holds_the_features_of_a_slice_only(monkeypatch):
    """Features take some 50 times the space of their text; a shard's are not held at once."""
    rng = np.random.default_rng(7)
    words = np.array(["care", "ward", "Bed", "x1", "!!", "über"])
    texts = pa.array([None, "", *(" ".join(words[rng.integers(0, 6, 1000)]) for _ in range(400))])
    labels = np.arange(len(texts)) % 3 % 2
    seen, features = [], quality.features
    monkeypatch.setattr(quality, "features", lambda data, offsets: seen.append(len(data)) or features(data, offsets))
    got = quality.ftrl(np.zeros((1 << quality.BITS) + 1), texts, labels)
    whole = sum(len((t or "").encode()) for t in texts.to_pylist())
    assert sum(seen) == whole and max(seen) <= quality.TRAINED_AT_ONCE < whole / 4
    monkeypatch.setattr(quality, "TRAINED_AT_ONCE", whole)
    assert np.array_equal(got, quality.ftrl(np.zeros((1 << quality.BITS) + 1), texts, labels))


def test_long_power_arrays_are_not_kept():
    """Workers outlive a task; what one long chunk needed must not stay in memory beside the next stage."""
    n = 3 * common.KEPT_POWERS
    up, down = common.powers(n)
    with np.errstate(over="ignore"):
        assert len(up) >= n and (up[:n] * down[:n] == 1).all() and (up[1:n] == up[:n - 1] * up[1]).all()
    common.powers(10)
    assert sum(p.nbytes for p in common._powers) <= 16 * common.KEPT_POWERS
    assert np.array_equal(common.powers(5000)[0][:5000], up[:5000])


def test_quality_of_odd_rows(docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (999, 1)], "doc_id bigint, quality int")
    got = quality.classify(docs, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality.classify(docs, docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}


# --- 5 ------------------------------------------------------------------------------------

def test_byte_bpe(docs, rows):
    tokens = byte_bpe.read_ranks(tok.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = []
    for doc_id, text in rows:
        ids = encoding.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = byte_bpe.encode_decode(docs, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).collect()
    assert sorted(map(plain, got), key=repr) == sorted(want, key=repr)


# --- 6 ------------------------------------------------------------------------------------

def measured(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_rule_ledger(docs, rows):
    got = rule_ledger.judge(docs)
    found = [tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got.collect()]
    want = []
    for doc_id, text in rows:
        m = measured(text)
        want.append((doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert not [r for r in got.collect() if r["kept"] and r["base_failed"]]
    kept = rule_ledger.keep(docs)
    assert kept.schema == docs.schema and kept.count() == got.filter("kept").count()


def test_ablation_reads_bits_alone(docs):
    ledger = rule_ledger.ledger(rule_ledger.measure(docs))
    bits = [r["fail_bits"] for r in ledger.collect()]
    for r in rule_ledger.ablation(ledger, "v2").collect():
        bit = rule_ledger.mask([r["rule"]])
        assert r["rows_failed"] == sum(b & bit != 0 for b in bits) and r["rows_failed_alone"] == sum(b == bit for b in bits)


# --- 8 ------------------------------------------------------------------------------------

@pytest.mark.parametrize("cell", [20_000, 5])
def test_ring(docs, rows, cell):
    got = ring.assign(docs, shards=4, nodes=8, cell_rows=cell).collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("seed", range(20))
def test_stretches_are_a_plain_clockwise_walk(seed):
    rng = np.random.default_rng(seed)
    shards, slack = int(rng.integers(1, 6)), float(rng.choice([0.0, 0.3]))
    nodes = [*range(shards), *rng.integers(0, shards, rng.integers(0, 20)).tolist()]
    rng.shuffle(nodes)
    counts = {a: int(rng.choice([0, 1, 3, 40])) for a in range(len(nodes)) if rng.random() < 0.8}
    most = ring.bounds(sum(counts.values()), shards, slack)
    got = {}
    for arc, first, end, shard, slot in ring.fill(nodes, counts, most):
        got.update({(arc, r): (shard, slot + r - first) for r in range(first, end)})
    want, used = {}, [0] * shards
    for arc in range(len(nodes)):
        for r in range(counts.get(arc, 0)):  # one row after the other, node by node
            at = arc
            while used[nodes[at]] == most[nodes[at]]:
                at = (at + 1) % len(nodes)
            want[arc, r] = (nodes[at], used[nodes[at]])
            used[nodes[at]] += 1
    assert got == want


def test_ring_with_one_hot_key_and_with_slack(spark):
    hot = spark.range(0, 3000, 1, 4).selectExpr("if(id % 3 = 0, 5L, id) AS doc_id", "'t' AS text")
    sizes = [r["count"] for r in ring.assign(hot, shards=7, cell_rows=100).groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    plenty = ring.assign(spark.range(3000).selectExpr("id AS doc_id", "'t' AS text"), shards=7, slack=9.0)
    assert plenty.filter("shard != home_shard").isEmpty()


# --- 9 ------------------------------------------------------------------------------------

def test_pitman_yor(docs, rows):
    counts = collections.Counter()
    tokens = [WORD.findall(lower(t)) + [None] for _, t in rows]
    for (doc_id, _), ts in zip(rows, tokens, strict=True):
        if doc_id is None or crc(doc_id) % 7 != 2:
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    want = [
        (i, i is not None and crc(i) % 7 == 2, len(ts), sum(x in counts for x in ts), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), 6))
        for (i, _), ts in zip(rows, tokens, strict=True)
    ]
    got = pitman_yor.score(docs).collect()
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_pitman_yor_beats_its_base_on_held_out_texts(spark, small):
    got = pitman_yor.score(spark.read.parquet(f"{small}/documents.parquet")).filter("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_probabilities_sum_to_one():
    """Over all known words and one unknown, for a context, with the seating and the totals it gives."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 6, (5, 30))  # contexts x words
    d, strength = (0.6, 0.7), pitman_yor.STRENGTH
    root = (counts.sum(0) + 1) / (counts.sum() + 31)
    tables = pitman_yor.seat(counts.ravel(), np.outer(np.ones(5), root).ravel(), d[1], rng).reshape(5, 30)
    own = pitman_yor.seat(tables.sum(0).astype(int), np.full(30, 1 / 31), d[0], rng)
    assert ((tables > 0) == (counts > 0)).all() and (tables <= counts).all() and (own <= tables.sum(0)).all()
    model = pitman_yor.Model(np.zeros(0), np.zeros(0), int(counts.sum()), 30, d)
    totals = pitman_yor.Round(tables.sum(), own.sum(), np.zeros(0))
    p = model.root(np.r_[tables.sum(0), 0], np.r_[own, 0], totals)
    assert abs(p.sum() - 1) < 1e-12
    for u in range(5):
        c, t = np.r_[counts[u], 0], np.r_[tables[u], 0]
        assert abs(((c - d[1] * t + (strength[1] + d[1] * t.sum()) * p) / (strength[1] + c.sum())).sum() - 1) < 1e-12


def test_pitman_yor_over_many_buckets(docs, monkeypatch):
    """Buckets and parts of the exchange change the seeds, not the counts."""
    key = lambda r: (repr(r["doc_id"]), r["n_tokens"], round(r["base_score"], 6))
    one = sorted(pitman_yor.score(docs).collect(), key=key)
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 8000)
    monkeypatch.setattr(pitman_yor, "BUCKETS_A_PART", 3)
    many = sorted(pitman_yor.score(docs).collect(), key=key)
    assert [(*r[:5], round(r["base_score"], 6)) for r in one] == [(*r[:5], round(r["base_score"], 6)) for r in many]
    assert all(abs(a["score"] - b["score"]) <= 0.1 * abs(a["score"]) + 0.2 for a, b in zip(one, many, strict=True))


def test_pitman_yor_reads_its_buckets_in_place(spark, docs, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 2_000)
    made = []
    keep = pitman_yor._stored_by_bucket
    monkeypatch.setattr(pitman_yor, "_stored_by_bucket", lambda df, n: made.append((keep(df, n), n)) or made[-1][0])
    assert pitman_yor.score(docs).count() == docs.count()
    (buckets, n), = made
    assert n > 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("llm_")]
    again = buckets.groupBy("bucket").count()
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    assert again.filter("count > 1").isEmpty()


def test_pitman_yor_takes_text_ids(spark):
    rows = [("a", "one two one"), ("b", None), (None, "two"), ("b", None)]
    got = pitman_yor.score(spark.createDataFrame(rows, "page string, body string"), "page", "body").collect()
    assert sorted(((r["page"], r["n_tokens"]) for r in got), key=repr) == sorted([("a", 4), ("b", 1), (None, 2), ("b", 1)], key=repr)
    assert all(r["held_out"] == (r["page"] is not None and zlib.crc32(r["page"].encode()) % 7 == 2) for r in got)


@pytest.mark.parametrize("customers", [2, 7, 31, 200])
def test_seating_agrees_with_a_plain_one_in_expectation(customers):
    mass, d, rng = 0.8, 0.6, np.random.default_rng(6)

    def plain() -> int:
        """Customers one by one: the next one opens a table with the chance of a new table against the seated ones."""
        tables = 1
        for j in range(1, customers):
            tables += rng.random() < mass / (mass + j - d * tables)
        return tables

    one_by_one = [plain() for _ in range(1000)]
    got = pitman_yor.seat(np.full(20000, customers), np.full(20000, mass), d, rng)
    assert got.min() >= 1 and got.max() <= customers
    assert abs(got.mean() - np.mean(one_by_one)) < 0.05 * np.mean(one_by_one)


# --- all -----------------------------------------------------------------------------------

def test_empty_tables(spark, docs):
    none = docs.filter("false")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert suffix_dedup.report(none).count() == suffix_dedup.clean_texts(none).count() == 0
    assert packing.pack(none, tok.path("word_bpe_49k.json"), 2).count() == 0
    assert near_dedup.with_classes(none).count() == near_dedup.keep_first(none).count() == 0
    assert quality.classify(none, none, labels).count() == 0
    assert byte_bpe.encode_decode(none, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).count() == 0
    assert rule_ledger.judge(none).count() == 0
    assert ring.assign(none).count() == 0
    assert pitman_yor.score(none).count() == 0
