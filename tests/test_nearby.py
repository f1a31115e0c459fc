import math

import pytest
from pyspark.sql import functions as F

from carecheck.functions import geo
from carecheck.operators import nearby
from carecheck.operators.topk import top_k

REQUEST = "query_id bigint, lat double, lon double, radius_km double, specialty string, limit int"


@pytest.fixture(scope="module")
def places(spark):
    """4,000 facilities; a third share one pair of coordinates, some sit at the date line and pole."""
    df = spark.range(4000).selectExpr(
        "concat('F', lpad(cast(id AS string), 6, '0')) AS facility_id", "concat('n', id) AS name",
        "'clinic' AS facility_type", "'Bihar' AS state", "'Gaya' AS city",
        "CASE WHEN id % 3 = 0 THEN 25.5D WHEN id % 17 = 0 THEN NULL WHEN id % 11 = 0 THEN 89.5D"
        " ELSE (id * 37 % 1700) / 10D - 85 END AS latitude",
        "CASE WHEN id % 3 = 0 THEN 85.0D WHEN id % 13 = 0 THEN 179.9D WHEN id % 19 = 0 THEN -179.9D"
        " ELSE (id * 53 % 3600) / 10D - 180 END AS longitude",
        "cast(id % 101 AS int) AS trust_score",
        "CASE WHEN id % 5 = 0 THEN array('Cardiology') WHEN id % 7 = 0 THEN NULL ELSE array('dentistry', 'oncology') END AS specialties",
        "array('emergency desk') AS capability", "array('ecg') AS equipment",
    )
    return df.cache()


REQUESTS = [
    (1, 25.59, 85.13, 25.0, "cardio", 7), (2, 25.59, 85.13, 25.0, "", 2000), (3, 0.0, 179.95, 300.0, "", 50),
    (4, 0.0, -179.95, 300.0, "ONCO ", 50), (5, 89.9, 10.0, 400.0, "", 40), (6, -84.0, 0.0, 3000.0, "dent", 60),
    (7, 25.5, 85.0, 0.0, "", 5), (8, 40.0, 40.0, 20020.0, "", 5000), (9, 10.0, 10.0, 1.0, "nothing", 5),
    (10, 25.59, 85.13, 25.0, None, 3),
]


def test_cells_find_what_a_full_scan_finds(spark, places):
    requests = spark.createDataFrame(REQUESTS, REQUEST)
    found = {}
    for r in nearby.radius_search(requests, places).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.facility_id, r.distance_km))
    for request in requests.collect():
        want = [tuple(r) for r in nearby.full_scan_radius(request.asDict(), places).collect()]
        got = found.get(request.query_id, [])
        assert [i for i, _ in got] == [i for i, _ in want], request
        assert all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got, want))


def test_ring_covers_every_hit(spark, places):
    requests = spark.createDataFrame(REQUESTS[:1], REQUEST)
    ring = {r[0] for r in nearby.in_ring(places, requests).select("facility_id").collect()}
    hits = {r[0] for r in nearby.full_scan_radius(dict(requests.first().asDict(), limit=9999, specialty=""), places).select("facility_id").collect()}
    assert hits <= ring and len(ring) < places.count()


def test_a_request_touches_few_cells(spark):
    requests = spark.createDataFrame(REQUESTS, REQUEST)
    per_request = nearby.covering_cells(requests).groupBy("query_id").count()
    assert per_request.agg(F.max("count")).first()[0] <= 12
    assert per_request.count() == len(REQUESTS)


def test_empty_result_keeps_its_centre(spark, places):
    requests = spark.createDataFrame(REQUESTS, REQUEST)
    made = nearby.radius_json(requests, nearby.radius_search(requests, places)).where("query_id = 9").first().json
    assert made == '{"center":{"lat":10.0,"lon":10.0},"radius_km":1.0,"specialty":"nothing","results":[]}'


def test_top_k_with_hot_group_and_own_limits(spark):
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('g', id % 7) END AS g", "id * 7919 % 3001 AS v", "id",
    ).withColumn("k", F.when(F.col("g") == "hot", 40).otherwise(3))
    got = {}
    for r in top_k(df, ["g"], [F.col("v"), F.col("id")], F.col("k"), ["id"]).orderBy("g", "rank").collect():
        got.setdefault(r.g, []).append((r.v, r.id))
    want = {}
    for r in df.collect():
        want.setdefault((r.g, r.k), []).append((r.v, r.id))
    assert got == {g: sorted(rows)[:k] for (g, k), rows in want.items()}


def test_providers_against_plain_ranking(spark, places):
    questions = spark.createDataFrame(
        [(1, "I need dialysis near 110001 (Delhi)"), (2, "Cardiac angioplasty within 50 km of Jaipur"), (3, "Cardiac angioplasty within 50 km of Jaipur")],
        "query_id bigint, query string")
    got = nearby.rank_providers(questions, places).where("query_id = 3").orderBy("rank").collect()
    words = ["interventionalcardiology", "cardiology", "cardiac", "angioplasty", "cath"]
    ranked = []
    for r in places.collect():
        if r.latitude is None or r.longitude is None:
            continue
        match = 1.0 if any(w in s.lower() for s in r.specialties or [] for w in words) else 0.0
        a, b = math.radians(26.9124), math.radians(r.latitude)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(r.longitude - 75.7873) / 2) ** 2
        km = 2 * 6371.0 * math.asin(math.sqrt(h))
        if match and km <= 1500:
            ranked.append((-round(0.45 * r.trust_score / 100 + 0.35 * match - 0.2 * min(1, km / 1500), 6), r.facility_id))
    assert [r.facility_id for r in got] == [i for _, i in sorted(ranked)[:5]]


def test_known_distances(spark):
    df = spark.createDataFrame([(28.6139, 77.2090, 19.0760, 72.8777), (10.0, 10.0, 10.0, 10.0)], "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    sphere, ellipsoid = (geo.distance_km(m, *cols) for m in (geo.SPHERE, geo.ELLIPSOID))
    first, same = df.select(sphere, ellipsoid).collect()
    assert abs(first[0] - 1148.1) < 1 and abs(first[1] - 1145.9) < 3 and tuple(same) == (0.0, 0.0)


def test_exploded_sides_are_not_broadcast(spark, places):
    """Cells and salts multiply rows beyond the size that Spark estimates, so small requests must not become a broadcast."""
    def built(df):
        plan = df._jdf.queryExecution().executedPlan()
        return plan.toString()

    requests = spark.createDataFrame(REQUESTS, REQUEST)
    pairs = nearby.sites_in_reach(requests, places)
    assert pairs.count() > 0
    assert "SortMergeJoin" in built(pairs) and "BroadcastHashJoin" not in built(pairs)
    wants = pairs.select(*nearby.SITE).distinct()
    offered = nearby._at_sites(places, wants, F.lit(True))
    assert offered.count() > 0
    joins = [line for line in built(offered).splitlines() if "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_sites_that_tie_with_the_last_one_count(spark):
    """Two sites at one distance and a limit between them: the lower id wins, whatever site it is at."""
    rows = [(f"F{i}", "n", "clinic", "Bihar", "Gaya", lat, lon, 50, [kind]) for i, lat, lon, kind in [
        (9, 10.0, 20.0, "cardio"), (5, 10.0, 20.5, "cardio"), (3, 10.0, 19.5, "cardio"), (1, 10.0, 20.25, "dental"),
        (7, 10.0, 20.5, "cardio"), (2, 10.0, 25.0, "cardio")]]
    places = spark.createDataFrame(
        rows, "facility_id string, name string, facility_type string, state string, city string, latitude double,"
              " longitude double, trust_score int, specialties array<string>")
    requests = spark.createDataFrame(
        [(n, 10.0, 20.0, 60.0, "Cardio", n) for n in (1, 2, 3, 9)] + [(20, 10.0, 20.0, 600.0, "cardio", 9)], REQUEST)
    found = {}
    for r in nearby.radius_search(requests, places).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.facility_id)
    assert found == {1: ["F9"], 2: ["F9", "F3"], 3: ["F9", "F3", "F5"], 9: ["F9", "F3", "F5", "F7"],
                     20: ["F9", "F3", "F5", "F7", "F2"]}


def test_distances_are_taken_of_sites_with_a_match(spark, places, monkeypatch):
    """A fragment that few facilities list meets their sites alone."""
    seen, pairs = [], nearby._pairs
    monkeypatch.setattr(nearby, "_pairs", lambda asked, sites, *rest: seen.append(sites.count()) or pairs(asked, sites, *rest))
    requests = spark.createDataFrame([(1, 40.0, 40.0, 20020.0, "onc", 5), (2, 40.0, 40.0, 20020.0, "nothing", 5)], REQUEST)
    assert nearby.radius_search(requests, places).count() == 5
    listed = nearby.sites_of(places.where(F.array_contains("specialties", "oncology"))).count()
    assert seen and 0 < max(seen) <= listed < nearby.sites_of(places).count()


def test_pairs_of_a_crowded_cell_are_dealt_over_tasks(spark, monkeypatch):
    """All requests and sites are in one cell of the coarsest level; a third of the requests are copies of one row."""
    for name, value in (("BLOCK_REQUESTS", 16), ("BLOCK_SITES", 64), ("TASK_PAIRS", 4000)):
        monkeypatch.setattr(nearby, name, value, raising=False)
    sites = spark.range(1500).selectExpr("id * 37 % 1499 / 60D + 8 AS latitude", "id * 53 % 1493 / 60D + 70 AS longitude").cache()
    requests = spark.range(150).selectExpr(
        "if(id % 3 = 0, 0, id) AS query_id", "if(id % 3 = 0, 25.5D, 8 + id / 10D) AS lat", "if(id % 3 = 0, 85D, 70 + id / 8D) AS lon",
        "if(id % 3 = 0, 2500D, if(id % 3 = 1, 2000D, 3000D)) AS radius_km").cache()
    for metric in (geo.SPHERE, geo.ELLIPSOID):
        km = geo.distance_km(metric, *[F.col(c) for c in ("lat", "lon", "latitude", "longitude")])
        want = requests.crossJoin(sites.distinct()).withColumn("km", km).where("km <= radius_km").select(
            "query_id", F.col("latitude").alias("site_lat"), F.col("longitude").alias("site_lon"), F.round("km", 6).alias("distance_km"))
        got = nearby.sites_in_reach(requests, sites, metric)
        assert got.columns == [*requests.columns, "site_lat", "site_lon", "distance_km"]
        rows = got.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
        assert max(r[1] for r in rows) < sum(r[1] for r in rows) / 4
        got = got.select(*want.columns)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_rounding_without_decimals_is_rounding(spark):
    """Halves, their neighbours and numbers beyond the plain form included."""
    halves = spark.range(20000).selectExpr("(id * 7919 + 0.5D) / 1e6D AS km")
    near = halves.selectExpr("km + 1e-12D AS km").unionByName(halves.selectExpr("km - 2e-12D AS km"))
    others = spark.range(20000).selectExpr("rand(1) * pow(10D, id % 9 - 2) AS km")
    odd = spark.createDataFrame([(x,) for x in (0.0, -0.0, -1.5e-6, 1e6, 1e6 + 0.1234565, 1e300, 5e-324, math.inf, math.nan, None)], "km double")
    df = halves.unionByName(near).unionByName(others).unionByName(odd)
    different = df.select(geo.round_km(F.col("km")).alias("a"), F.round("km", 6).alias("b")).where("NOT a <=> b")
    assert different.count() == 0


def test_the_distance_of_a_pair_is_computed_once(spark, places):
    plan = nearby.sites_in_reach(spark.createDataFrame(REQUESTS, REQUEST), places, geo.SPHERE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ASIN") == 1 and "lambdafunction((lambda d" not in plan
