"""Feeds from two versions of a table, and requests of which most share one id."""

import pytest
from pyspark.sql import functions as F

import checks.queries as q
from carecheck.functions import sql_functions
from carecheck.operators import requests, verify
from carecheck.streaming import changes, sync
from checks import inputs

SCHEMA = "id long, text string, n double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OLD = [(1, "same", 1.0), (2, "was", 2.0), (3, None, 3.0), (4, "goes", None), (None, "no key", 0.0), (6, "n only", 6.0), (7, "", None)]
NEW = [(1, "same", 1.0), (2, "is", 2.0), (3, "", 3.0), (5, "comes", 5.0), (None, "null key", 0.0), (6, "n only", None), (7, "", None)]


def test_feed_holds_what_changed(spark):
    feed = changes.feed_from_versions(table(spark, OLD), table(spark, NEW).select("n", "id", "text"), "id", 9)
    assert feed.columns == ["id", "text", "n", "change", "version"]
    pairs = [(2, 2), (3, 3), (None, None), (6, 6)]
    old, new = {r[0]: r for r in OLD}, {r[0]: r for r in NEW}
    want = [(*old[4], "delete", 9), (*new[5], "insert", 9)]
    want += [(*old[a], "update_before", 9) for a, _ in pairs] + [(*new[b], "update_after", 9) for _, b in pairs]
    assert plain(feed) == sorted(want, key=repr)


def test_applying_a_feed_gives_the_new_version(spark):
    for a, b in ((OLD, NEW), (NEW, OLD), (OLD, OLD), ([], NEW), (OLD, [])):
        old, new = table(spark, a), table(spark, b)
        feed = changes.feed_from_versions(old, new, "id", 2)
        assert plain(changes.apply_feed(old, feed, "id")) == plain(new)
        assert a != b or feed.isEmpty()


def test_a_feed_keeps_an_index(spark, tmp_path):
    old = table(spark, [(1, "red blue", None), (2, "red", None), (3, "green", None)])
    new = table(spark, [(1, "red yellow", None), (3, "green", None), (4, "red", None)])
    folder = str(tmp_path / "index")
    for version, (a, b) in enumerate(((old.where("false"), old), (old, new)), 1):
        feed = changes.feed_from_versions(a, b, "id", version)
        sync.index_batch(changes.index_changes(feed, "id", "text"), version, folder)
    got = sync.live_postings(spark, folder).select("doc_id", "term").collect()
    assert sorted(map(tuple, got)) == [(1, "red"), (1, "yellow"), (3, "green"), (4, "red")]


def test_feeds_that_cannot_be_told_raise(spark):
    twice = table(spark, [(1, "a", 1.0), (1, "b", 1.0)])
    with pytest.raises(Exception, match="key not unique in the old version: 1"):
        changes.feed_from_versions(twice, table(spark, NEW), "id", 2).collect()
    with pytest.raises(ValueError, match="columns"):
        changes.feed_from_versions(table(spark, OLD), table(spark, NEW).drop("n"), "id", 2)
    with pytest.raises(ValueError, match="version"):
        changes.feed_from_versions(table(spark, OLD).withColumn("version", F.lit(1)), table(spark, NEW).withColumn("version", F.lit(1)), "id", 2)


def test_no_task_gets_a_hot_id_whole(spark):
    """90 % of the requests ask for one id, some for none; they stay spread over their tasks, and every request is answered."""
    asked = spark.range(20_000, numPartitions=8).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 10 != 0, "hot").when(F.col("id") % 40 == 0, None).otherwise(F.concat(F.lit("F"), F.col("id") % 700)).alias("facility_id"))
    facts = spark.createDataFrame([("hot", 1), *[(f"F{k}", k) for k in range(0, 350)]], "facility_id string, score int")
    joined = requests.join_facts(asked, facts)
    assert plain(joined) == plain(asked.join(facts, "facility_id", "left").select(*joined.columns))
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 20_000 / 8


def test_trust_report_answers_hot_unknown_and_missing_ids(spark):
    gold = spark.createDataFrame([("A", 90, [])], "facility_id string, trust_score int, flags array<struct<rule_id:string>>")
    rows = [(i, "A") for i in range(600)] + [(600, "Z"), (601, None)]
    got = dict(map(tuple, verify.trust_report(spark.createDataFrame(rows, "request_id long, facility_id string"), gold).select("request_id", "json").collect()))
    assert len(got) == 602 and got[5] == '{"facility_id":"A","trust_score":90,"flags":[]}'
    assert got[600] == '{"facility_id":"Z","error":"not found"}' and got[601] == '{"error":"not found"}'


def test_request_views_join_by_keys(spark, small):
    run = q.Run(spark, small)
    run.stored_gold.createOrReplaceTempView("gold_facilities")
    run.request(inputs.RADIUS_REQUESTS).createOrReplaceTempView("radius_requests")
    run.request(inputs.CLAIM_REQUESTS).createOrReplaceTempView("claim_requests")
    for view in sql_functions.register_request_views(spark, "gold_facilities", "radius_requests", "claim_requests"):
        plan = spark.table(view)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, view
