import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carecheck.operators import fusion, search


def plain_bm25(docs, queries):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    counts = {i: Counter(words(t)) for i, t in docs.items()}
    length = {i: sum(c.values()) for i, c in counts.items()}
    mean, n = sum(length.values()) / len(docs), len(docs)
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for q, (text, k) in queries.items():
        scores = {}
        for w in set(words(text)):
            for i, c in counts.items():
                if w in c:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    scores[i] = scores.get(i, 0) + idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean))
        out[q] = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
    return out


def test_bm25_against_plain_scores(spark):
    docs = {i: " ".join(["the"] * (i % 4 + 1) + [f"w{i % 5}", f"W{i % 7}", "x-ray" if i % 3 else "Été 24/7"]) for i in range(60)}
    docs[60], docs[61] = "", None
    queries = {1: ("the W1 w1 xyz", 5), 2: ("été ray", 100), 3: ("nothing here", 4), 4: ("24 w3", 7)}
    ddf = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    qdf = spark.createDataFrame([(q, t, k) for q, (t, k) in queries.items()], "query_id long, query string, k int")
    got = {}
    for r in search.bm25_top_k(qdf, ddf, "doc_id", "text").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    want = {q: rows for q, rows in plain_bm25({i: t or "" for i, t in docs.items()}, queries).items() if rows}
    assert {q: [i for _, i in rows] for q, rows in got.items()} == {q: [i for _, i in rows] for q, rows in want.items()}


def test_bm25_with_floors_over_many_chunks(spark, monkeypatch):
    """More chunks than the first pass reads: the same rows, ties and hot terms included."""
    monkeypatch.setattr(search, "CHUNK_DOCS", 16)
    monkeypatch.setattr(search, "FLOOR_CHUNKS", 4)
    monkeypatch.setattr(search, "FLOOR_DOCS", 100)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    rng = np.random.default_rng(3)
    docs = {i: " ".join(rng.choice(["the", "sun", "sea", "sky", "sand"], 1 + i % 7)) for i in range(400)}
    docs |= {i: "sun sea" for i in range(400, 520)}  # copies
    queries = {1: ("the sun", 5), 2: ("sea sky sand", 40), 3: ("sun sea", 130), 4: ("zzz", 3)}
    ddf = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    qdf = spark.createDataFrame([(q, t, k) for q, (t, k) in queries.items()], "query_id long, query string, k int")
    got = {}
    for r in search.bm25_top_k(qdf, ddf, "doc_id", "text").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: [i for _, i in rows] for q, rows in plain_bm25(docs, queries).items() if rows}


def test_most_postings_are_skipped():
    """A chunk of 4096 documents, a tenth of them rich in the asked terms: exact best, few postings scored."""
    rng = np.random.default_rng(4)
    rows = [(d, t, (2.0 if d < 400 else 0.3) * rng.random()) for d in range(4096) for t in rng.choice(list("abcdefgh"), 4, replace=False)]
    posts = pd.DataFrame(rows, columns=["doc_id", "term", "part"])
    asked = pd.DataFrame([(q, t, 1.0 + q) for q in range(5) for t in "abcdefgh"[q:q + 3]], columns=["query_id", "term", "idf"])
    blocks, queries = search.Blocks(posts), np.arange(5)
    scores = search._best_of_chunk(blocks, queries, asked, np.full(5, 10), np.zeros(5))
    whole = posts.merge(asked, "inner", "term")
    assert blocks.scored < 0.3 * len(whole)
    whole = whole.assign(s=whole["part"] * whole["idf"]).groupby(["query_id", "doc_id"])["s"].sum().round(6)
    for q in queries:
        want = sorted((-s, d) for d, s in whole[q].items())[:10]
        assert sorted((-s, d) for d, s in enumerate(scores[q]))[:10] == want


@pytest.mark.parametrize("hot", [False, True])
def test_vector_search_is_exact(spark, hot, monkeypatch):
    monkeypatch.setattr(search, "CHUNK_VECTORS", 50)
    monkeypatch.setattr(search, "CHUNK_QUERIES", 10)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16)) * 4
    corpus = centres[rng.integers(0, 6, 700)] + rng.normal(size=(700, 16))
    if hot:
        corpus[::3] = corpus[0]  # copies hold a third of all rows
    corpus[5] = 0.0
    queries = np.vstack([corpus[:20] + 0.1 * rng.normal(size=(20, 16)), np.zeros((1, 16))])
    ks = [1, 3, 10, 700, 900][:5] * 5
    cdf = spark.createDataFrame(pd.DataFrame({"doc_id": range(700), "vector": corpus.astype("float32").tolist()}),
                                "doc_id long, vector array<float>")
    qdf = spark.createDataFrame([(i, v.tolist(), ks[i]) for i, v in enumerate(queries.astype("float32"))],
                                "query_id long, vector array<float>, k int")
    got = {}
    for r in search.vector_top_k(qdf, cdf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    unit = search._unit(pd.Series(list(corpus.astype("float32"))))
    for i, v in enumerate(search._unit(pd.Series(list(queries.astype("float32"))))):
        similarity = np.round(unit @ v, 6) + 0.0
        want = sorted(range(700), key=lambda d: (-similarity[d], d))[:ks[i]]
        assert got[i] == want, i


def test_queries_skip_cells_that_cannot_matter(spark):
    rng = np.random.default_rng(1)
    pivots = np.eye(8)
    corpus = np.repeat(np.eye(8), 50, axis=0) + 0.01 * rng.normal(size=(400, 8))
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "doc_id long, vector array<double>")
    placed = search._cells(cdf, pivots)
    stats = placed.groupBy("cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count(F.lit(1)).alias("n")).toPandas()
    qdf = spark.createDataFrame([(0, corpus[3].tolist(), 5)], "query_id long, vector array<double>, k int")
    assert search._visits(qdf, pivots, stats).first().cells == [0]


def plain_fusion(keyword, vector, k):
    """Reciprocal ranks over whole lists of ids."""
    scores = Counter()
    for ranked in (keyword, vector):
        for rank, i in enumerate(ranked, 1):
            scores[i] += 1 / (60 + rank)
    return sorted(((-round(s, 8), i) for i, s in scores.items()))[:k]


def hybrid_case(spark, words, vectors, queries):
    """The operator's lists and the plain ones; ``words``: texts by id, ``vectors``: vectors by id, queries: id -> (text, vector, k)."""
    ddf = spark.createDataFrame(list(words.items()), "doc_id long, text string")
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "doc_id long, vector array<double>")
    qdf = spark.createDataFrame([(q, t, k) for q, (t, _, k) in queries.items()], "query_id long, query string, k int")
    vdf = spark.createDataFrame([(q, [float(x) for x in v], k) for q, (_, v, k) in queries.items() if v is not None],
                                "query_id long, vector array<double>, k int")
    got = {}
    for r in fusion.hybrid_top_k(qdf, ddf, "doc_id", "text", vdf, cdf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    want = {}
    ranked = plain_bm25(words, {q: (t, 10**6) for q, (t, _, _) in queries.items()})
    for q, (_, v, k) in queries.items():
        near = []
        if v is not None and vectors:
            unit = search._unit(pd.Series(list(map(np.array, vectors.values()))))
            cosine = np.round(unit @ search._unit(pd.Series([np.array(v)]))[0], 6) + 0.0
            near = [i for _, i in sorted(zip(-cosine, vectors))]
        best = plain_fusion([i for _, i in ranked[q]], near, k)
        if best:
            want[q] = best
    assert {q: [i for _, i in rows] for q, rows in got.items()} == {q: [i for _, i in rows] for q, rows in want.items()}
    assert all(abs(a - b) < 2e-8 for q in want for (a, _), (b, _) in zip(got[q], want[q]))  # halves may round either way
    return got


def test_a_document_deep_in_both_lists_wins(spark):
    """Documents 0 to 59 lead the keyword list, 60 to 119 the vector list, and document 500 is the 51st of both."""
    words = {i: "drum " * (70 - i) + "pad " * i for i in range(60) if i < 50}
    words |= {500: "drum " * 20 + "pad " * 50} | {i: "drum " + "pad " * 69 for i in range(50, 60)} | {i: "pad " * 70 for i in range(60, 200)}
    angle = {i: 0.001 * (i - 59) for i in range(60, 110)} | {500: 0.0505} | {i: 0.001 * (i - 57) for i in range(110, 200)} | {i: 2 + 0.001 * i for i in range(60)}
    angle |= {i: 1 + 0.0005 * (i - 1000) for i in range(1000, 2000)}  # so that the keyword list's leaders are far down the other list
    vectors = {i: (math.cos(a), math.sin(a)) for i, a in angle.items()}
    got = hybrid_case(spark, words, vectors, {1: ("drum", (1, 0), 1), 2: ("drum", (1, 0), 3)})
    assert got[1] == [(-round(2 / 111, 8), 500)]


def test_fusion_counts_ranks_over_whole_lists(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK_DOCS", 64)
    monkeypatch.setattr(search, "CHUNK_VECTORS", 50)
    rng = np.random.default_rng(11)
    words = {i: " ".join(rng.choice(["sun", "sea", "sky", "sand"], 1 + i % 9)) if i % 3 else "rock" for i in range(600)}
    vectors = {i: rng.normal(size=6) for i in range(100, 700)}
    vectors |= {i: vectors[120] for i in range(300, 400)}  # copies
    queries = {1: ("sun sky", rng.normal(size=6), 10), 2: ("sea", rng.normal(size=6), 1), 3: ("nothing", rng.normal(size=6), 4),
               4: ("sand sun", None, 5), 5: ("rock", vectors[120], 200), 6: ("sky", rng.normal(size=6), 900)}
    assert set(hybrid_case(spark, words, vectors, queries)) == {1, 2, 3, 4, 5, 6}


def test_fusion_without_vectors(spark):
    assert set(hybrid_case(spark, {1: "a b", 2: "a", 3: "c"}, {}, {1: ("a", (1, 0), 2), 2: ("zz", (1, 0), 2)})) == {1}


def test_keyword_search_reads_the_texts_for_postings_and_totals_only(spark):
    """What is searched may be a whole pipeline, and was computed again by every side that needs postings or totals."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    docs = spark.createDataFrame([(i, f"care ward{i % 7} word{i}") for i in range(300)], "doc_id int, text string").mapInPandas(
        read, "doc_id int, text string")
    queries = spark.createDataFrame([(1, "care ward3", 5), (2, "word7", 5), (3, "absent", 5)], "query_id int, query string, k int")
    found = search.bm25_top_k(queries, docs, "doc_id", "text").collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: (r["query_id"], r["rank"]))] == [3, 10, 17, 24, 31, 7]
    assert seen.value == 2 * 300
