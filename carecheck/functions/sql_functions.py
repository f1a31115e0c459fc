"""Helpers and tools as temporary SQL functions, for use from SQL text.

The tools read the gold table. They suit calls with a few rows; for a table of radius
requests use ``nearby.radius_search``, which meets the facilities through grid cells.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from carecheck import rule_values as rv
from carecheck.functions import geo
from carecheck.functions import text as tx
from carecheck.functions.patterns import LABEL_PATTERNS

def ellipsoid_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Lambert's formula as SQL text; the array binds the angle and two mean latitudes by name."""
    b1, b2 = (f"atan({1 - geo.WGS84_FLATTENING!r}D * tan(radians({lat})))" for lat in (lat1, lat2))
    angle = (
        f"2 * asin(sqrt(least(1D, pow(sin(({b2} - {b1}) / 2), 2)"
        f" + cos({b1}) * cos({b2}) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )
    return (
        f"transform(array(named_struct('s', {angle}, 'p', ({b1} + {b2}) / 2, 'q', ({b2} - {b1}) / 2)), g ->"
        f" CASE WHEN g.s = 0 THEN 0D ELSE {geo.WGS84_KM}D * (g.s - {geo.WGS84_FLATTENING / 2!r}D * ("
        "(g.s - sin(g.s)) * pow(sin(g.p) * cos(g.q) / cos(g.s / 2), 2)"
        " + (g.s + sin(g.s)) * pow(cos(g.p) * sin(g.q) / sin(g.s / 2), 2))) END)[0]"
    )


FUNCTIONS = {
    "repair_pin(pin STRING) RETURNS STRING": (
        r"CASE WHEN length(regexp_replace(pin, '\\.0$', '')) < 6"
        r" THEN lpad(regexp_replace(pin, '\\.0$', ''), 6, '0') ELSE regexp_replace(pin, '\\.0$', '') END"
    ),
    "trust_tier(score DOUBLE) RETURNS STRING": (
        f"CASE WHEN score >= {rv.TIER_HIGH}D THEN 'High' WHEN score >= {rv.TIER_MODERATE}D"
        " THEN 'Moderate' ELSE 'Low' END"
    ),
    "claim_needles(claim STRING) RETURNS ARRAY<STRING>": tx.needles("claim"),
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
        f"2 * {rv.EARTH_RADIUS_KM}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
    ),
}


FUNCTIONS["ellipsoid_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE"] = (
    ellipsoid_sql("lat1", "lon1", "lat2", "lon2")
)


def _labels() -> str:
    """All labels of free-text extraction as a struct; null where nothing is found."""
    fields = []
    for label in rv.EXTRACT_LABELS:
        hits = f"regexp_extract_all(lower(p_text), {tx.quoted(LABEL_PATTERNS[label])}, 1)"
        fields.append(f"'{label}', array_sort(array_distinct(nullif({hits}, {tx.EMPTY_LIST})))")
    return f"named_struct({', '.join(fields)})"


FACTS = [
    "specialties", "capability", "equipment", "procedure", "description", "capacity", "number_doctors",
]


def _claim_report() -> dict[str, str]:
    """Cross-source report from the facts of one facility; null facts mean an unknown id."""
    facts = (
        "STRUCT<specialties: ARRAY<STRING>, capability: ARRAY<STRING>, equipment: ARRAY<STRING>,"
        " procedure: ARRAY<STRING>, description: STRING, capacity: INT, number_doctors: INT>"
    )
    supporting = tx.supporting_sources("claim")
    for name in FACTS:
        supporting = re.sub(rf"(?<!')\b{name}\b(?!')", f"facts.{name}", supporting)
    known = (
        f"named_struct('facility_id', fid, 'claim', claim, 'agree', size({supporting}) >= 2,"
        f" 'sources_supporting', {supporting}, 'sources_total', {len(rv.CLAIM_SOURCES)})"
    )
    unknown = (
        "named_struct('facility_id', fid, 'claim', claim, 'agree', false, 'reason', 'facility not found',"
        f" 'sources_supporting', {tx.EMPTY_LIST}, 'sources_total', 0)"
    )
    return {
        f"claim_report(fid STRING, claim STRING, facts {facts}) RETURNS STRING":
            f"CASE WHEN facts IS NULL THEN to_json({unknown}) ELSE to_json({known}) END"
    }


def _tools(gold: str) -> dict[str, str]:
    score = "named_struct('facility_id', facility_id, 'trust_score', trust_score, 'flags', flags)"
    nearby = (
        f"SELECT *, round({ellipsoid_sql('p_lat', 'p_lon', 'latitude', 'longitude')}, 6) AS distance_km FROM {gold}"
        " WHERE latitude IS NOT NULL AND longitude IS NOT NULL"
        # a degree of latitude is longer than 110 km, so this drops nothing that counts
        " AND abs(latitude - p_lat) * 110 <= p_radius_km"
        " AND (trim(coalesce(p_specialty, '')) = ''"
        " OR exists(specialties, x -> contains(lower(x), lower(trim(p_specialty)))))"
    )
    part = "pmod(xxhash64(facility_id), 256)"
    order = "ORDER BY distance_km, facility_id"
    first = (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} {order}) AS rn FROM ({nearby})"
        " WHERE distance_km <= p_radius_km) WHERE rn <= p_limit"
    )
    last = f"SELECT * FROM (SELECT *, row_number() OVER ({order}) AS pos FROM ({first})) WHERE pos <= p_limit"
    row = (
        "named_struct('pos', pos, 'facility_id', facility_id, 'name', name, 'facility_type', facility_type,"
        " 'state', state, 'city', city, 'latitude', latitude, 'longitude', longitude,"
        " 'trust_score', trust_score, 'distance_km', distance_km, 'specialties', specialties)"
    )
    shown = row.replace("'pos', pos, ", "")
    results = f"(SELECT transform(array_sort(collect_list(struct(pos, {shown} AS hit))), x -> x.hit) FROM ({last}))"
    return {
        "score_claim_consistency(fid STRING) RETURNS STRING": (
            f"coalesce((SELECT max(to_json({score})) FROM {gold} g WHERE g.facility_id = fid),"
            " to_json(named_struct('facility_id', fid, 'error', 'not found')))"
        ),
        "cross_source_disagree(p_fid STRING, p_claim STRING) RETURNS STRING": (
            f"claim_report(p_fid, p_claim, (SELECT any_value(struct({', '.join(FACTS)})) FROM {gold} g"
            " WHERE g.facility_id = p_fid))"
        ),
        "parse_messy_field(p_text STRING) RETURNS STRING": (
            "CASE WHEN length(trim(coalesce(p_text, ''))) = 0 THEN '{}'"
            f" ELSE to_json({_labels()}, map('ignoreNullFields', 'false')) END"
        ),
        "geo_radius(p_lat DOUBLE, p_lon DOUBLE, p_radius_km DOUBLE, p_specialty STRING, p_limit INT)"
        " RETURNS STRING": (
            "to_json(named_struct('center', named_struct('lat', p_lat, 'lon', p_lon), 'radius_km', p_radius_km,"
            f" 'specialty', lower(trim(coalesce(p_specialty, ''))), 'results', {results}))"
        ),
    }


def _create(spark: SparkSession, functions: dict[str, str]) -> list[str]:
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in functions]


def register(spark: SparkSession) -> list[str]:
    """The scalar helpers."""
    return _create(spark, FUNCTIONS)


def register_request_views(spark: SparkSession, gold: str, places: str, claims: str) -> list[str]:
    """The tools that read gold, answered for whole tables of requests, as views to join by their id.

    ``places`` (query_id, lat, lon, radius_km, specialty, limit) and ``claims`` (request_id, facility_id, claim) name views
    or tables. Scalar functions meet every request with every facility; the views go by grid cells and by ids.
    """
    from carecheck.operators import nearby, verify  # these use this module's expressions

    facilities, places, claims = (spark.table(x) for x in (gold, places, claims))
    views = {
        "geo_radius_results": nearby.radius_json(places, nearby.radius_search(places, facilities)),
        "score_claim_consistency_results": verify.trust_report(claims, facilities),
        "cross_source_disagree_results": verify.cross_source_json(verify.cross_source(claims, facilities)),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return list(views)


def register_tools(spark: SparkSession, gold: str) -> list[str]:
    """The four tools over a gold table or view, with the helpers they use."""
    return register(spark) + _create(spark, _claim_report()) + _create(spark, _tools(gold))
