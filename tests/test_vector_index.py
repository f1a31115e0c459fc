"""The stored vector index: recall, updates, deletions, late versions, rebuilding."""

import numpy as np
import pandas as pd
import pytest

from carecheck.operators import search
from carecheck.streaming import sync, vector_index

N, D = 3000, 30


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, D))
    rows = centres[rng.integers(0, 40, N)] + 0.6 * rng.normal(size=(N, D))
    rows[7::3] = rows[7]  # copies hold a third of all rows
    return rows


def changes(spark, rows, version=1, deleted=False):
    return spark.createDataFrame(
        [(int(i), version, None if v is None else [float(x) for x in v], deleted) for i, v in rows],
        "doc_id long, version int, vector array<double>, deleted boolean")


def asked(spark, vectors, k=10):
    return spark.createDataFrame([(i, [float(x) for x in v], k) for i, v in enumerate(vectors)], "query_id long, vector array<double>, k int")


def plain(points, vectors, k):
    unit = search._unit(pd.Series(list(points.values())))
    ids = np.array(list(points))
    for v in search._unit(pd.Series(list(vectors))):
        similarity = np.round(unit @ v, 6) + 0.0
        yield [(int(ids[d]), float(similarity[d])) for d in np.lexsort((ids, -similarity))[:k]]


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.similarity))
    return [out[q] for q in sorted(out)]


def recall(got, want):
    """Share of the similarities found, so that any of several copies counts."""
    hits = [sum(a[1] >= w[-1][1] for a in g) for g, w in zip(got, want, strict=True)]
    return sum(hits) / sum(map(len, want))


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vectors") / "index")
    vector_index.index_vectors(changes(spark, enumerate(points)), 0, folder)
    return folder


def test_recall_and_exactness(spark, points, index):
    queries = points[:60] + 0.1
    want = list(plain(dict(enumerate(points)), queries, 10))
    got = answers(vector_index.search_vectors(asked(spark, queries), index))
    assert recall(got, want) >= 0.9
    model = vector_index.Model.load(spark, index)
    assert 40 <= len(model.centres) <= 70  # about the root of 3000
    whole = answers(vector_index.search_vectors(asked(spark, queries), index, probes=1.0, rerank=300))
    assert [[s for _, s in a] for a in whole] == [[s for _, s in w] for w in want]


def test_updates_and_deletions(spark, points, index):
    moved = {i: -points[i] for i in range(20, 40)}
    vector_index.index_vectors(changes(spark, moved.items(), 2), 1, index)
    vector_index.index_vectors(changes(spark, ((i, None) for i in range(40, 50)), 2, True), 2, index)
    vector_index.index_vectors(changes(spark, ((i, points[i]) for i in range(20, 50))), 3, index)  # an old version, late
    vector_index.index_vectors(changes(spark, [(50, [float("nan")] * D), (51, None)], 2), 4, index)  # no longer usable
    held = {i: moved.get(i, v) for i, v in enumerate(points) if i not in range(40, 52)}
    assert {r.doc_id for r in sync.live_keys(spark, index).collect()} == set(held)
    queries = [moved[25], points[45], points[0]]
    want = list(plain(held, queries, 5))
    whole = answers(vector_index.search_vectors(asked(spark, queries, 5), index, probes=1.0, rerank=600))
    assert [[s for _, s in a] for a in whole] == [[s for _, s in w] for w in want]
    assert (25, 1.0) in whole[0] and 45 not in dict(whole[1])


def test_rebuilding_keeps_what_counts(spark, points, index, tmp_path):
    target = str(tmp_path / "again")
    before = {(r.doc_id, r.version) for r in vector_index.live_vectors(spark, index).collect()}
    vector_index.rebuild(spark, index, target)
    assert {(r.doc_id, r.version) for r in vector_index.live_vectors(spark, target).collect()} == before
    vector_index.index_vectors(changes(spark, [(45, points[45])]), 1, target)
    assert 45 not in {r.doc_id for r in vector_index.live_vectors(spark, target).collect()}


def test_a_stream_of_batches(spark, points, tmp_path):
    feed, folder, checkpoint = (str(tmp_path / x) for x in ("feed", "index", "checkpoint"))
    for part in (range(300), range(200, 400)):
        changes(spark, ((i, points[i]) for i in part), 1 + part.start).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(changes(spark, []).schema).parquet(feed)
        vector_index.sync_vectors(stream, folder, checkpoint).awaitTermination()
    assert sync.live_keys(spark, folder).count() == 400
    got = answers(vector_index.search_vectors(asked(spark, [points[250]], 1), folder, probes=1.0, rerank=50))
    assert got[0][0][1] == 1.0


def test_other_lengths_raise(spark, points, index):
    with pytest.raises(Exception, match="components"):
        vector_index.index_vectors(changes(spark, [(9000, [1.0, 2.0])]), 9, index)
