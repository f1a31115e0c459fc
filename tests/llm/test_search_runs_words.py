"""Ranked search, periodic runs and the word table against plain evaluations of their definitions, on odd rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as tok
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from carecheck.llm import periodic_runs, rmq_search, word_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VOCABULARY = tok.path("word_bpe_49k.json")


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- 11 -----------------------------------------------------------------------------------

def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(rows, items, k):
    """Every document scored for every item."""
    docs = [(i, collections.Counter(t), len(t)) for i, text in rows if (t := terms(text))]
    n, words = len(docs), sum(d[2] for d in docs)
    held = collections.Counter(t for _, tf, _ in docs for t in tf)
    for item, text in items:
        scores = []
        for doc_id, tf, size in docs:
            m = 100 - 25 + 25 * size * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        scores = sorted(scores)[:k]
        yield from ((item, r, d, -s) for r, (s, _, d) in enumerate(scores, 1))


@pytest.fixture(scope="module")
def items(spark, texts):
    asked = [texts[6][:300], texts[9], "  ", None, "", texts[16], texts[16], "The FOX's dog dog dog é80 中文", "zzzz", "a"]
    rows = [(k if k != 2 else None, t, 1, 2) for k, t in enumerate(asked)]
    return spark.createDataFrame([*rows, rows[1]], "item_id bigint, text string, rank int, score string")


@pytest.mark.parametrize("slice_bytes", [1 << 24, 700])
def test_ranked_search(docs, rows, items, monkeypatch, slice_bytes):
    monkeypatch.setattr(rmq_search, "SLICE", slice_bytes)
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    for k in (3, 20):
        got = rmq_search.top_k(docs, items, k).collect()
        want = list(ranked(rows, asked, k))
        assert by_repr(got) == by_repr(want)


def test_ranked_search_in_blocks_of_items(docs, rows, items, monkeypatch):
    monkeypatch.setattr(rmq_search, "BLOCK", 400)
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    assert by_repr(rmq_search.top_k(docs, items, 5).collect()) == by_repr(ranked(rows, asked, 5))


def test_ranked_search_on_empty_tables(docs, items):
    assert rmq_search.top_k(docs.filter("false"), items).count() == 0
    assert rmq_search.top_k(docs, items.filter("false")).count() == 0
    assert rmq_search.top_k(docs.select("doc_id", docs.text.substr(0, 0).alias("text")), items).count() == 0


def test_tables_name_the_highest_impact_of_every_range():
    rng = np.random.default_rng(3)
    impact = rng.integers(0, 9, 60)
    lists = rmq_search.Lists(np.repeat([0, 1, 4], 20), np.tile(np.arange(20), 3), impact, 20)
    for base in (0, 20, 40):
        for a in range(20):
            for b in range(a + 1, 21):
                top = lists.best(np.array([base + a]), np.array([base + b]))[0]
                assert base + a <= top < base + b and impact[top] == impact[base + a:base + b].max()


def test_most_documents_are_never_scored():
    """4000 documents, one in a hundred about the items' terms: far fewer than all are scored, the best are exact."""
    rng = np.random.default_rng(7)
    entries, term, place = 4000, [], []
    for t in range(12):
        own = np.flatnonzero(rng.random(entries) < (0.01 if t % 2 else 0.3))
        term.append(np.full(len(own), t))
        place.append(own)
    term, place = np.concatenate(term), np.concatenate(place)
    impact = rng.integers(1, 100, len(term)) * np.where(term % 2, 1000, 10)
    lists = rmq_search.Lists(term, place, impact, entries)
    asked = [(np.array([1, 2, 3]), np.array([1, 2, 1])), (np.array([5, 6, 7, 8, 9]), np.ones(5, int))]
    best = [rmq_search.Best(10, 1) for _ in asked]
    scored = rmq_search.search(lists, [[x] for x in range(entries)], asked, best)
    assert scored < 0.2 * entries * len(asked)
    for (own, many), b in zip(asked, best, strict=True):
        scores = np.zeros(entries, np.int64)
        for t, c in zip(own, many, strict=True):
            scores[place[term == t]] += c * impact[term == t]
        want = sorted((-s, False, x) for x, s in enumerate(scores.tolist()) if s > 0)[:10]
        assert b.found == want


# --- 12 -----------------------------------------------------------------------------------

def plain_runs(x):
    """Every period and every stretch compared word by word."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            e = i + q
            if e - s >= max(12, 2 * q) and not any(all(x[j] == x[j + p] for j in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_sequences(rng):
    letters = rng.choice([1, 2, 2, 3, 5, 50])
    some = lambda m: [rng.randrange(letters) for _ in range(m)]
    unit = some(rng.randrange(1, 70))
    yield some(rng.randrange(200))
    yield some(rng.randrange(9)) + unit * rng.randrange(2, 5) + unit[:rng.randrange(len(unit) + 1)] + some(rng.randrange(9))
    short = (some(rng.randrange(1, 4)) * 40)[:rng.randrange(1, 80)]
    yield short * rng.randrange(1, 4) + some(3) + short + short
    fib = [[0], [0, 1]]
    while len(fib[-1]) < rng.randrange(20, 300):
        fib.append(fib[-1] + fib[-2])
    yield fib[-1] + fib[-2] + some(2)
    thue = [bin(i).count("1") % 2 for i in range(rng.randrange(300))]
    yield thue + thue[:rng.randrange(len(thue) + 1)]
    part = ((some(rng.randrange(1, 30)) * 2 + some(1)) * 3)[:rng.randrange(1, 90)]
    yield part + part + some(2) + part[::-1] + part[::-1]


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_odd_sequences(seed):
    rng = random.Random(seed)
    for _ in range(4):
        sequences = list(odd_sequences(rng))
        offsets = np.r_[0, np.cumsum([len(s) for s in sequences])]
        got = periodic_runs.find_runs(np.array([c for s in sequences for c in s], np.int64), offsets)
        assert got.tolist() == [[k, *r] for k, s in enumerate(sequences) for r in plain_runs(s)]


def test_wrong_hashes_are_noticed(monkeypatch):
    rng = random.Random(1)
    unit = [rng.randrange(9) for _ in range(40)]
    codes = np.array(unit * 3 + [7] + unit[::-1] + unit[::-1], np.int64)
    honest = periodic_runs.Spans.agree
    monkeypatch.setattr(periodic_runs.Spans, "agree", lambda self, p, q: (honest(self, p, q)[0], np.minimum(honest(self, p, q)[1] + 1, len(codes) - p - q)))
    got = periodic_runs.find_runs(codes, np.array([0, len(codes)])).tolist()
    assert got == [[0, *r] for r in plain_runs(codes.tolist())]


def want_runs(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words) if n < 2000 else []
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()))


def test_runs_query(docs, rows):
    got = periodic_runs.runs(docs, rewrite=periodic_runs.repeated_tail, keep=True).collect()
    assert by_repr(r[:8] for r in got) == by_repr(want_runs(*r) for r in rows)
    for r in got:
        assert sha(r["collapsed"].encode()) == r["collapsed_sha256"]
        assert sha("".join(f"{s.start},{s.length},{s.period}\n" for s in r["runs"]).encode()) == r["runs_sha256"]
    assert any(r["n_runs"] for r in got)
    assert periodic_runs.runs(docs.filter("false")).count() == 0


def test_runs_over_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = periodic_runs.runs(docs, rewrite=periodic_runs.repeated_tail).collect()
    assert by_repr(got) == by_repr(want_runs(r["doc_id"], r["text"]) for r in docs.collect())


# --- 13 -----------------------------------------------------------------------------------

ODD = ["<|endoftext|>x <|startoftext|>", "x<|endoftext|><|endoftext|>", "ΣΑΣ Σ", "é ́e", "a b c\x85d", "\x00 a\x00b", "İI", "don't'S 12"]


def want_words(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return (doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())), ids, decoded


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 900])
def test_word_table(spark, docs, rows, monkeypatch, chunk_bytes):
    monkeypatch.setattr(word_table, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(word_table, "BUCKET_BYTES", 4 * chunk_bytes)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string")
    got = word_table.encode_decode(docs.unionByName(more, allowMissingColumns=True), VOCABULARY, keep_ids=True, keep_text=True)
    want = [want_words(tokenizer, *r) for r in rows + [(1000 + k, t) for k, t in enumerate(ODD)]]
    found = got.collect()
    assert by_repr(r[:4] for r in found) == by_repr(w for w, _, _ in want)
    assert by_repr((r["ids"], r["decoded"]) for r in found) == by_repr((i, d) for _, i, d in want)
    back = word_table.decode(got.select("doc_id", "ids"), VOCABULARY)
    assert by_repr(back.collect()) == by_repr((r["doc_id"], r["decoded"]) for r in found)


def test_word_table_without_rows(docs):
    assert word_table.encode_decode(docs.filter("false"), VOCABULARY).count() == 0


def test_words_of_one_hash_keep_their_order(monkeypatch):
    monkeypatch.setattr(word_table, "span_hashes", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    words = pa.array(["b", "ab", "", "a"], pa.large_string())
    assert words.take(pa.array(word_table.by_hash(words)[0])).to_pylist() == ["", "a", "ab", "b"]


def test_words_are_coded_in_time_by_their_number_not_by_lists():
    def seconds(lists):
        parts = [pa.array([f"word{k}" for k in range(first, 60_000, lists)], pa.large_string()) for first in range(lists)]
        took = []
        for _ in range(3):
            start = time.thread_time()
            words, codes = word_table.distinct(parts)
            took.append(time.thread_time() - start)
        assert sorted(words.to_pylist()) == sorted(f"word{k}" for k in range(60_000))
        for part, own in zip(parts, codes, strict=True):
            assert words.take(pa.array(own)).equals(part)
        return min(took)

    assert seconds(600) < 25 * seconds(2)  # with a dictionary per list: over 100 times


def test_distinct_words_of_lists_without_words():
    no = pa.array([], pa.large_string())
    assert len(word_table.distinct([])[0]) == 0
    words, codes = word_table.distinct([no, pa.array(["b", "a"], pa.large_string()), no, pa.array(["a", ""], pa.large_string())])
    assert words.to_pylist() == ["b", "a", ""] and [c.tolist() for c in codes] == [[], [0, 1], [], [1, 2]]


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    words = pa.array(["", "a" * 70, "b", "é" * 9, *map(str, range(200))], pa.large_string())
    order, hashes = word_table.by_hash(words)
    for size in (1, 64):
        monkeypatch.setattr(word_table, "HASHED_BYTES", size)
        again, same = word_table.by_hash(words)
        assert again.tolist() == order.tolist() and same.tolist() == hashes.tolist()


def test_blobs_of_few_rows_are_split_together():
    texts = ["a b", None, "", "c\nd"] * 50
    dealt = pa.RecordBatch.from_arrays([pa.array([3] * 200, pa.int32()), pa.array(range(200)), pa.array(texts)], ["chunk", "id", "text"])
    blobs = pa.Table.from_batches(b for k in range(200) for b in word_table.pack_rows([dealt.slice(k, 1)]))
    assert blobs.num_rows == 200
    rows, = word_table.unpack_rows(blobs.column("blob"))
    assert rows.column("id").to_pylist() == list(range(200)) and rows.column("text").to_pylist() == texts
