"""Radius search and provider ranking for tables of requests.

Requests meet places by equality on a grid cell whose size follows the radius, so a
request touches at most nine cells whatever its reach. Facilities sharing one pair of
coordinates form a *site*: distances are computed per site, and a site that holds a
large part of the table costs one distance per request, not one per facility.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carecheck import rule_values as rv
from carecheck.functions import geo, stats
from carecheck.functions import text as tx
from carecheck.operators.topk import top_k
from carecheck.session import cut_lineage

# Grid levels: level z cuts 360 degrees into 2**z cells.
LEVELS = [1, 4, 6, 8, 10, 12]
KM_PER_DEGREE = 110.0  # below the true length everywhere, so covers are never too small
LEAST_EARTH_KM = 6300.0  # an angle of one radian is longer than this everywhere, so what it drops is out of reach
SALTS = 16
BLOCK = ["_request_block", "_site_block"]
BLOCK_REQUESTS, BLOCK_SITES = 4096, 1024  # of one cell that meet in a group
TASK_PAIRS = 4_000_000  # pairs of one cell that a task holds against each other, on average
FIRST_PASS = 1 / 8  # exact power of two, so a radius survives the round trip
EDGE_KM = 0.00001  # distances are rounded, so a hit on the edge may tie with one beyond it
SITE = ["site_lat", "site_lon"]


def _level_size(z: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), z)


def _reach(lat: Column, radius_km: Column) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that a radius can span from a latitude."""
    d_lat = radius_km / KM_PER_DEGREE
    furthest = F.least(F.abs(lat) + d_lat, F.lit(90.0))
    shrink = F.cos(F.radians(furthest))
    d_lon = F.when(shrink > 0.001, F.least(d_lat / shrink, F.lit(180.0))).otherwise(F.lit(180.0))
    return d_lat, d_lon


def covering_cells(requests: DataFrame) -> DataFrame:
    """Requests exploded over the cells their circle can touch (columns level, row, column)."""
    d_lat, d_lon = _reach(F.col("lat"), F.col("radius_km"))
    span = F.greatest(d_lat, d_lon)
    level = F.when(F.lit(False), F.lit(0))
    for z in reversed(LEVELS[1:]):
        level = level.when(span <= 360.0 / 2**z, F.lit(z))
    sized = requests.select(
        "*", d_lat.alias("_d_lat"), d_lon.alias("_d_lon"), level.otherwise(LEVELS[0]).alias("level")
    )
    size = _level_size(F.col("level"))
    columns = F.pow(F.lit(2.0), F.col("level")).cast("bigint")

    def index(degrees: Column, offset: float) -> Column:
        return F.floor((degrees + offset) / size).cast("bigint")

    rows = F.sequence(
        index(F.greatest(F.col("lat") - F.col("_d_lat"), F.lit(-90.0)), 90.0),
        index(F.least(F.col("lat") + F.col("_d_lat"), F.lit(90.0)), 90.0),
    )
    around = F.sequence(
        index(F.col("lon") - F.col("_d_lon"), 180.0), index(F.col("lon") + F.col("_d_lon"), 180.0)
    )
    wrapped = F.array_distinct(F.transform(around, lambda c: F.pmod(c, F.col("_columns"))))
    return (
        sized.withColumn("_columns", columns)
        .withColumn("row", F.explode(rows))
        .withColumn("column", F.explode(wrapped))
        .drop("_d_lat", "_d_lon", "_columns")
    )


def site_cells(sites: DataFrame) -> DataFrame:
    """Sites on every grid level."""
    def at(offset: float, degrees: str) -> Column:
        return F.floor((F.col(degrees) + offset) / _level_size(F.col("level"))).cast("bigint")

    levels = F.explode(F.array(*[F.lit(z) for z in LEVELS]))
    columns = F.pow(F.lit(2.0), F.col("level")).cast("bigint")
    return sites.withColumn("level", levels).select(
        *sites.columns, "level",
        at(90.0, "site_lat").alias("row"), F.pmod(at(180.0, "site_lon"), columns).alias("column"),
    )


def sites_of(facilities: DataFrame) -> DataFrame:
    """Distinct coordinates; copies are merged before anything is shuffled."""
    return (
        facilities.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select(F.col("latitude").alias("site_lat"), F.col("longitude").alias("site_lon"))
        .distinct()
    )


def sites_in_reach(
    requests: DataFrame, facilities: DataFrame, metric: geo.Metric = geo.ELLIPSOID
) -> DataFrame:
    """Request columns × site columns + ``distance_km`` for every site within ``radius_km``."""
    return _pairs(requests, cut_lineage(sites_of(facilities)), metric, [])


def _blocks(requests: DataFrame, sites: DataFrame, cell: list[str], request: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by cell, dealt over blocks of bounded size that they are to meet by as well.

    The requests of a cell, told apart by the columns ``request``, are cut in blocks that all its sites visit, and its sites
    in blocks that all its requests visit, so a crowded cell is not one task. Requests in cells without a site go no further.
    Spark sizes partitions by their bytes, which say little of their pairs, so their number is fixed by the pairs, which are
    counted in a job of its own.
    """
    counted = cut_lineage(
        requests.groupBy(*cell).agg(F.count(F.lit(1)).alias("_requests")).hint("merge")
        .join(sites.groupBy(*cell).agg(F.count(F.lit(1)).alias("_sites")), cell)
    )
    # in doubles, which no number of pairs overflows
    pairs = counted.agg(F.sum(F.col("_requests").cast("double") * F.col("_sites"))).first()[0] or 0.0
    parts = max(requests.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))
    cut = counted.select(
        *cell, F.ceil(F.col("_requests") / BLOCK_REQUESTS).alias("_request_blocks"),
        F.ceil(F.col("_sites") / BLOCK_SITES).alias("_site_blocks"),
    )

    def dealt(df: DataFrame, key: list[str], own: str, others: str) -> DataFrame:
        return (
            df.hint("merge").join(cut, cell)
            .withColumn(own, F.pmod(F.xxhash64(*key), F.col(f"{own}s")))
            .withColumn(others, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{others}s") - 1)))
            .drop("_request_blocks", "_site_blocks")
            .repartition(parts, *cell, *BLOCK)
        )

    return dealt(requests, request, *BLOCK), dealt(sites, SITE, *BLOCK[::-1])


def _pairs(requests: DataFrame, sites: DataFrame, metric: geo.Metric, equal: list[str]) -> DataFrame:
    """Requests and sites within their radius that agree in the ``equal`` columns. Both are read twice.

    Both sides are exploded, which Spark's size estimates leave out, so the join is never to be broadcast.
    Unit vectors tell most of a cell's sites outside of the circle, so the distance is taken of few others.
    """
    def prepared(df: DataFrame, lat: str, lon: str, side: str) -> DataFrame:
        b, l = metric.latitude(F.col(lat)), F.radians(lon)
        return df.withColumns({f"_b{side}": b, f"_l{side}": l, f"_c{side}": F.cos(b)}).withColumns({
            f"_x{side}": F.col(f"_c{side}") * F.cos(f"_l{side}"),
            f"_y{side}": F.col(f"_c{side}") * F.sin(f"_l{side}"), f"_z{side}": F.sin(f"_b{side}"),
        })

    # an angle that no distance within the radius exceeds, and slack for rounding
    least = F.cos(F.least(F.col("radius_km") / LEAST_EARTH_KM, F.lit(math.pi))) - F.lit(1e-9)
    cell = ["level", "row", "column", *equal]
    asked, offered = _blocks(
        covering_cells(prepared(requests, "lat", "lon", "1").withColumn("_least", least)),
        site_cells(prepared(sites, "site_lat", "site_lon", "2")), cell, requests.columns,
    )
    close = F.abs(F.col("lat") - F.col("site_lat")) * KM_PER_DEGREE <= F.col("radius_km")
    cosine = sum((F.col(f"_{c}1") * F.col(f"_{c}2") for c in "yz"), F.col("_x1") * F.col("_x2"))
    angle = geo.central_angle(*[F.col(c) for c in ("_b1", "_l1", "_b2", "_l2", "_c1", "_c2")])
    measured = (
        asked.hint("merge").join(offered, [*cell, *BLOCK])
        .where(close & (cosine >= F.col("_least")))
        .withColumn("_angle", angle)
        .withColumn("distance_km", metric.km(F.col("_b1"), F.col("_b2"), F.col("_angle")))
    )
    return geo.within(measured, "distance_km", "radius_km").select(
        *requests.columns, *SITE, geo.round_km(F.col("distance_km")).alias("distance_km")
    )


def _at_sites(facilities: DataFrame, wants: DataFrame, keep: Column) -> DataFrame:
    """Facilities joined to what is wanted at their site; a crowded site is salted.

    Wants are exploded, which Spark's size estimates leave out, so the join is never to be broadcast.
    """
    spread = facilities.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "*", F.col("latitude").alias("site_lat"), F.col("longitude").alias("site_lon"),
        F.pmod(F.xxhash64("facility_id"), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    everywhere = wants.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(everywhere.hint("merge"), [*SITE, "_salt"]).where(keep).drop("_salt")


SHOWN = ["facility_id", "name", "facility_type", "state", "city", "trust_score", "specialties"]


def radius_search(requests: DataFrame, facilities: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The nearest ``limit`` facilities of each request within its radius.

    ``requests``: query_id, lat, lon, radius_km, specialty (fragment, empty for any), limit.
    A first pass looks within a fraction of each radius. A request that finds its ``limit``
    there is settled, since nothing further out can be nearer; only the others, which have
    few matches nearby, search their whole circle.
    """
    asked = requests.select(
        "query_id", "lat", "lon", "radius_km", "limit",
        F.lower(F.trim(F.coalesce("specialty", F.lit("")))).alias("needle"),
    )
    close = _nearest(asked.withColumn("radius_km", F.col("radius_km") * FIRST_PASS), facilities, extra)
    own = Window.partitionBy("query_id")
    full = (F.count(F.lit(1)).over(own) == F.col("limit")) & (
        F.max("distance_km").over(own) < F.col("radius_km") - EDGE_KM
    )
    settled = cut_lineage(
        close.withColumn("_full", full).where("_full")
        .withColumn("radius_km", F.col("radius_km") / FIRST_PASS).drop("_full")
    )
    rest = asked.join(settled.select("query_id").distinct(), "query_id", "left_anti")
    return settled.unionByName(_nearest(rest, facilities, extra))


def _nearest_sites(hits: DataFrame) -> DataFrame:
    """The ``limit`` nearest of a request's sites, each of which has a match, and those at the distance of the last."""
    part = F.pmod(F.xxhash64(*SITE), F.lit(SALTS))
    for by in (["query_id", part], ["query_id"]):
        before = F.rank().over(Window.partitionBy(*by).orderBy("distance_km"))
        hits = hits.withColumn("_before", before).where(F.col("_before") <= F.col("limit")).drop("_before")
    return hits


def _nearest(asked: DataFrame, facilities: DataFrame, extra: list[str] | None) -> DataFrame:
    """One pass. Sites in the cells of a request's circle are held against its fragment first, so that distances are taken
    of sites with a match alone. Of one site a request can need no more than its ``limit`` lowest ids per fragment, so that
    many are picked per site and fragment before sites and requests meet.
    """
    cell = ["level", "row", "column"]
    around = covering_cells(asked.select("lat", "lon", "radius_km", "needle", "limit"))
    asked_cells = around.groupBy(*cell, "needle").agg(F.max("limit").alias("_most"))
    wants = (
        asked_cells.join(site_cells(sites_of(facilities)).hint("merge"), cell)
        .groupBy(*SITE, "needle").agg(F.max("_most").alias("_most"))
    )
    matches = (F.col("needle") == "") | tx.any_element_contains_column("specialties", "needle")
    offered = _at_sites(
        facilities.select(*SHOWN, "latitude", "longitude", *(extra or [])), wants, matches
    )
    per_site = cut_lineage(top_k(
        offered, [*SITE, "needle"], [F.col("facility_id")], F.col("_most"), ["facility_id"], "_at_site"
    ).drop("_most"))
    hits = _pairs(asked, per_site.where("_at_site = 1").select(*SITE, "needle"), geo.ELLIPSOID, ["needle"])
    found = _nearest_sites(hits).join(per_site.drop("_at_site"), [*SITE, "needle"])
    nearest = [F.col("distance_km"), F.col("facility_id")]
    return top_k(found, ["query_id"], nearest, F.col("limit"), [*SITE, "facility_id"]).drop(*SITE)


def radius_json(requests: DataFrame, found: DataFrame) -> DataFrame:
    """One JSON text per request: centre, radius, specialty and its results in order."""
    row = F.struct(
        "rank", "facility_id", "name", "facility_type", "state", "city", "latitude", "longitude",
        "trust_score", F.round("distance_km", 4).alias("distance_km"), "specialties",
    )
    # at most ``limit`` rows per request
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    results = F.transform(
        F.coalesce("rows", F.array().cast(lists.schema["rows"].dataType)), lambda r: r.dropFields("rank")
    )
    document = F.struct(
        F.struct("lat", "lon").alias("center"),
        "radius_km",
        F.lower(F.trim(F.coalesce("specialty", F.lit("")))).alias("specialty"),
        results.alias("results"),
    )
    return requests.join(lists, "query_id", "left").select(
        "query_id", F.to_json(document).alias("json")
    )


def full_scan_radius(request: dict, facilities: DataFrame) -> DataFrame:
    """One request against every facility, without cells: the form to check the others by."""
    km = geo.distance_km(
        geo.ELLIPSOID, F.lit(request["lat"]), F.lit(request["lon"]), F.col("latitude"), F.col("longitude")
    )
    needle = (request.get("specialty") or "").strip().lower()
    rows = facilities.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if needle:
        rows = rows.where(tx.any_element_contains("specialties", [needle]))
    return (
        rows.select("facility_id", km.alias("distance_km"))
        .where(F.col("distance_km") <= request["radius_km"])
        .withColumn("distance_km", F.round("distance_km", 6))
        .orderBy("distance_km", "facility_id")
        .limit(request["limit"])
    )


def in_ring(facilities: DataFrame, requests: DataFrame) -> DataFrame:
    """Facilities in any cell that some request's circle touches: the coarse filter alone."""
    cells = covering_cells(requests.select("lat", "lon", "radius_km")).select("level", "row", "column")
    located = sites_of(facilities)
    near = site_cells(located).join(cells.distinct(), ["level", "row", "column"], "left_semi")
    sites = near.select(F.col("site_lat").alias("latitude"), F.col("site_lon").alias("longitude"))
    return facilities.join(sites.distinct(), ["latitude", "longitude"], "left_semi")


def provider_match(keywords: str) -> Column:
    """1.0 for a match in specialties, else 0.7 in capability, else 0.5 in equipment, else 0."""
    def any_in(items: str) -> str:
        return f"coalesce(exists({items}, s -> exists({keywords}, w -> contains(lower(s), w))), false)"

    return F.expr(
        f"CASE WHEN {any_in('specialties')} THEN 1.0D WHEN {any_in('capability')} THEN 0.7D"
        f" WHEN {any_in('equipment')} THEN 0.5D ELSE 0.0D END"
    )


def rank_providers(questions: DataFrame, facilities: DataFrame, k: int = 5) -> DataFrame:
    """The best providers for each question (query_id, query).

    A question becomes an anchor (specialty and place). Questions sharing an anchor are
    answered once: facilities are ranked per distinct anchor, then handed back.
    """
    anchored = questions.select("query_id", tx.preset("query").alias("anchor")).select(
        "query_id", "anchor.*"
    )
    key = ["specialty", "lat", "lon"]
    anchors = anchored.select(*key).distinct().withColumn("radius_km", F.lit(rv.RANK_REACH_KM))
    hits = sites_in_reach(anchors, facilities, geo.SPHERE).withColumn(
        "keywords", tx.specialty_keywords("specialty")
    )
    columns = [
        "facility_id", "name", "facility_type", "trust_score", "specialties", "capability",
        "equipment", "latitude", "longitude",
    ]
    offered = _at_sites(facilities.select(*columns), hits, F.lit(True)).withColumn(
        "spec_match", provider_match("keywords")
    ).where(F.col("spec_match") > 0)
    trust = stats.trust01(F.col("trust_score"))
    bonus = F.when(F.lower("facility_type") == "hospital", rv.RANK_HOSPITAL).otherwise(0.0)
    far = F.least(F.lit(1.0), F.col("distance_km") / rv.RANK_REACH_KM)
    score = F.lit(rv.RANK_TRUST) * trust + F.lit(rv.RANK_MATCH) * F.col("spec_match") + bonus
    scored = offered.select(
        *key, "facility_id", "name", trust.alias("trust"), stats.trust_tier(trust).alias("tier"),
        "spec_match", "distance_km", F.round(score - F.lit(rv.RANK_DISTANCE) * far, 6).alias("score"),
    )
    best = top_k(
        scored, key, [F.desc("score"), F.col("facility_id")], F.lit(k), ["facility_id"]
    )
    # k rows for each of the fixed presets, so questions need not be gathered by anchor
    return anchored.join(F.broadcast(best), key)
