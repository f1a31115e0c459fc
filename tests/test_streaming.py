from pyspark.sql import functions as F

from carecheck.operators import search, trust
from carecheck.plans import pipeline
from carecheck.sources import lookups
from carecheck.sources.facilities import customer_facilities
from carecheck.streaming import sync

CHANGE = "doc_id string, version int, text string"


def live(spark, folder):
    rows = sync.live_postings(spark, folder).collect()
    return {(r.doc_id, r.term): r.tf for r in rows}


def test_index_follows_changes(spark, tmp_path):
    feed, folder, checkpoint = (str(tmp_path / n) for n in ("feed", "index", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), CHANGE).coalesce(1).write.mode("append").parquet(feed)
        changes = spark.readStream.schema(CHANGE).parquet(feed)
        sync.sync_index(changes, folder, checkpoint).awaitTermination()

    arrive(("a", 1, "old words here"), ("b", 1, "cath lab lab"), ("a", 2, "new words"))
    assert live(spark, folder) == {("a", "new"): 1, ("a", "words"): 1, ("b", "cath"): 1, ("b", "lab"): 2}
    arrive(("b", 2, "closed"), ("c", 1, "words"), ("d", 1, ""))
    want = {("a", "new"): 1, ("a", "words"): 1, ("b", "closed"): 1, ("c", "words"): 1}
    assert live(spark, folder) == want
    # the same changes written once more, twice as one batch, change nothing
    again = spark.createDataFrame([("b", 2, "closed"), ("c", 1, "words"), ("d", 1, "")], CHANGE)
    for _ in range(2):
        sync.index_batch(again, 1, folder, "again")
        assert live(spark, folder) == want
    # an older version that comes late is not taken
    arrive(("b", 1, "cath lab"))
    assert live(spark, folder) == want
    arrive(("a", 3, ""))
    assert ("a", "new") not in live(spark, folder)

    queries = spark.createDataFrame([(1, "words closed", 5)], "query_id int, query string, k int")
    docs = spark.createDataFrame([("a", ""), ("b", "closed"), ("c", "words"), ("d", "")], "doc_id string, text string")
    stored = sync.search_index(spark, folder, queries).orderBy("rank").collect()
    fresh = search.bm25_top_k(queries, docs, "doc_id", "text").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in stored] == [(r.doc_id, r.score) for r in fresh]
    sync.compact_index(spark, folder, str(tmp_path / "compact"))
    assert live(spark, str(tmp_path / "compact")) == live(spark, folder)

    # a fresh stream on the compacted index keeps what is there
    feed, folder, checkpoint = str(tmp_path / "feed2"), str(tmp_path / "compact"), str(tmp_path / "checkpoint2")
    arrive(("e", 1, "fresh"))
    assert live(spark, folder) == {("b", "closed"): 1, ("c", "words"): 1, ("e", "fresh"): 1}


def test_deleted_documents_stay_away(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = lambda *r: spark.createDataFrame(list(r), CHANGE + ", deleted boolean")
    sync.index_batch(rows(("a", 1, "one", False), ("b", 1, "two", False)), 0, folder)
    sync.index_batch(rows(("a", 2, None, True)), 1, folder)
    assert live(spark, folder) == {("b", "two"): 1}
    sync.compact_index(spark, folder, str(tmp_path / "compact"))
    sync.index_batch(rows(("a", 1, "one", False)), 2, str(tmp_path / "compact"), "late")
    assert live(spark, str(tmp_path / "compact")) == {("b", "two"): 1}
    sync.index_batch(rows(("a", 3, "back", None)), 3, str(tmp_path / "compact"), "late")
    assert live(spark, str(tmp_path / "compact")) == {("b", "two"): 1, ("a", "back"): 1}


def test_an_uncommitted_batch_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "index")
    sync.index_batch(spark.createDataFrame([("a", 1, "one")], CHANGE), 0, folder)
    spark.createDataFrame([("a", 2, False, 1)], "doc_id string, version int, deleted boolean, length int").write.parquet(
        f"{folder}/keys/batch=half-1")
    assert live(spark, folder) == {("a", "one"): 1}


def test_rules_on_a_stream_match_the_batch(spark, small, tmp_path):
    raw = customer_facilities(spark, small)
    raw.write.parquet(str(tmp_path / "raw"))
    arriving = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw"))
    flagged = sync.flag_stream(arriving, lookups.state_boxes(spark), lookups.state_aliases(spark), pipeline.AS_OF)
    assert flagged.isStreaming
    sync.append_flagged(flagged.select("facility_id", "trust_score", "flags"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = pipeline.build(spark, raw).trust
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0
    assert streamed.count() == batch.count()
    assert trust.contradictions(streamed).where(F.col("rule_id").isNull()).count() == 0


def test_changes_of_one_partition_are_dealt_before_texts_are_sorted(spark, tmp_path, monkeypatch):
    """A file of one row group is one task; what picks versions and holds postings must not be."""
    seen, latest = [], sync.latest_changes
    monkeypatch.setattr(sync, "latest_changes", lambda changes: seen.append(changes.rdd.getNumPartitions()) or latest(changes))
    changes = spark.range(5000).selectExpr(
        "concat('d', id % 4500) AS doc_id", "cast(id / 4500 AS int) AS version", "concat('word', id, ' word') AS text").coalesce(1)
    sync.index_batch(changes, 0, str(tmp_path / "index"))
    assert seen[0] >= 5
    found = live(spark, str(tmp_path / "index"))
    assert len(found) == 9000 and found["d499", "word4999"] == 1 and found["d500", "word500"] == 1
    assert ("d499", "word499") not in found


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_an_index_picks_versions_once(spark, tmp_path, monkeypatch):
    """Keys that count, and lengths, are not derived again by everything that reads them; rows without an id have no key."""
    folder, written, picked = str(tmp_path / "index"), [], []
    write, last = sync._write, sync._last_keys
    monkeypatch.setattr(sync, "_write", lambda keys, posts, *where: written.append(_joins(keys)) or write(keys, posts, *where))
    monkeypatch.setattr(sync, "_last_keys", lambda *where: picked.append(where) or last(*where))
    rows = [("a", 1, "old words"), ("a", 2, "new words"), ("b", 1, None), (None, 1, "no id")]
    sync.index_batch(spark.createDataFrame(rows, CHANGE), 0, folder)
    assert written == [0]
    assert {r["doc_id"]: r["length"] for r in sync.live_keys(spark, folder).collect()} == {"a": 2, "b": 0}
    assert live(spark, folder) == {("a", "new"): 1, ("a", "words"): 1}
    picked.clear()
    queries = spark.createDataFrame([(1, "words", 5)], "query_id int, query string, k int")
    assert [r["doc_id"] for r in sync.search_index(spark, folder, queries).collect()] == ["a"]
    assert len(picked) == 1
