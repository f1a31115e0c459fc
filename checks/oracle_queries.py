"""One DuckDB statement per registered query."""

from __future__ import annotations

from carecheck import rule_values as rv
from carecheck.functions.patterns import LABEL_PATTERNS
from carecheck.plans.pipeline import COMMENTS
from carecheck.plans.reports import REMEDIES
from checks import inputs
from checks.oracles import (
    AS_OF, HAV, LISTS, any_contains, json_list, lambert, num, pct, q, sql, strip, values,
)


def js(x: str) -> str:
    return f"cast(to_json({x}) as varchar)"


ORACLES: dict[str, str] = {}
O = ORACLES

_zero_fill = "case when length(n) < 6 then lpad(n, 6, '0') else n end"
O["headers_and_ids"] = f"""
SELECT row_key, "Facility Name " AS Facility_Name, " Market Segment" AS Market_Segment, balance,
  'F' || {_zero_fill} AS facility_id
FROM (SELECT *, cast(row_number() OVER (ORDER BY row_key) - 1 as varchar) AS n FROM ({inputs.UNTIDY}))
"""
O["pin_repair"] = sql("SELECT facility_id, pin AS address_postalCode FROM clean")
O["numeric_coerce"] = sql(
    "SELECT facility_id, " + ", ".join(
        f"{num(c)} AS {c}" for c in ["latitude", "longitude", "capacity", "numberDoctors", "yearEstablished"]
    ) + " FROM fac"
)
O["type_normalise"] = sql(
    "SELECT facility_id, facility_type_raw, facility_type, capacity, number_doctors, year_established, recency_ts FROM clean"
)
O["json_array_parse"] = sql("SELECT facility_id, " + ", ".join(f"{js(c)} AS {c}" for c in LISTS) + " FROM clean")
O["rule_lists"] = sql("SELECT facility_id, " + ", ".join(f"{js('l_' + c)} AS {c}" for c in LISTS) + " FROM ins")
_bracketed = (
    "list_filter(list_transform(regexp_split_to_array(substring(s, 2, length(s)-2), '[,|]'),"
    f" lambda x: {strip('x')}), lambda x: x <> '')"
)
O["lenient_array"] = f"""
SELECT p_partkey, {js('''case when s is null or s = '' then cast([] as varchar[])
  when parsed is not null then list_filter(parsed, lambda x: x is not null)
  when len(quoted) > 0 then quoted
  when starts_with(s, '[') and ends_with(s, ']') then ''' + _bracketed + ''' else [s] end''')} AS items
FROM (SELECT *, try_cast(try_cast(s as json) as varchar[]) AS parsed,
    regexp_extract_all(s, '[''"]([^''"]+)[''"]', 1) AS quoted
  FROM (SELECT p_partkey, {strip('messy')} AS s FROM ({inputs.MESSY_LISTS})))
"""
_fields = ["rule_id", "severity", "message", "evidence", "citation_column"]
O["flag_json_parse"] = f"""
SELECT event_id, '[' || coalesce((
    SELECT string_agg('{{' || {" || ',' || ".join(f"'" + '"' + f + '":' + "' || cast(to_json(coalesce(json_extract_string(x, '$." + f + "'), '')) as varchar)" for f in _fields)} || '}}', ',')
    FROM (SELECT unnest(case when json_valid(flags_text) and json_type(try_cast(flags_text as json)) = 'ARRAY' then cast(try_cast(flags_text as json) as json[]) else [] end) AS x)
    WHERE json_type(x) = 'OBJECT'), '') || ']' AS flags
FROM ({inputs.FLAG_TEXTS})
"""
O["state_resolve"] = sql("SELECT facility_id, state_raw, state FROM clean")
O["recency_months"] = (
    f"SELECT o_orderkey, cast(date_sub('month', o_orderdate, {AS_OF}) as int) AS months FROM orders"
)
_text = (
    "'name: ' || coalesce(name,'') || ' | type: ' || coalesce(facility_type,'') || ' | state: ' || coalesce(state,'')"
    " || ' | city: ' || coalesce(city,'')"
    + "".join(f" || ' | {c}: ' || array_to_string({c}, ', ')" for c in LISTS)
    + " || ' | description: ' || coalesce(description,'')"
)
O["facility_text"] = sql(
    f"SELECT facility_id, {_text} AS facility_text, name, facility_type, state, city, description FROM clean"
)
_kinds = {"specialty": "specialties", "procedure": "procedure", "equipment": "equipment", "capability": "capability"}
_claims = " UNION ALL ".join(
    f"SELECT facility_id, '{kind}' AS claim_type, lower(trim(c)) AS claim_value FROM"
    f" (SELECT facility_id, unnest({col}) AS c FROM clean) WHERE length(trim(c)) > 0"
    for kind, col in _kinds.items()
)
O["claims_long"] = sql(_claims)
O["claims_long_parts"] = """
SELECT cast(p_partkey as varchar) AS facility_id, 'specialty' AS claim_type, lower(c) AS claim_value FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS c FROM part) WHERE c <> ''
UNION ALL SELECT cast(p_partkey as varchar), 'procedure', lower(c) FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS c FROM part) WHERE c <> ''
UNION ALL SELECT cast(p_partkey as varchar), 'equipment', lower(p_brand) FROM part
"""
O["claim_evidence"] = sql(f"""
SELECT k.*, c.facility_type, c.state, c.city, len(c.equipment) > 0 AS has_equipment,
  coalesce(c.capacity, 0) <> 0 AS has_capacity, coalesce(c.number_doctors, 0) <> 0 AS has_doctors
FROM ({_claims}) k JOIN clean c USING (facility_id)
""")
_presets = values([(i, text, s, float(la), float(lo)) for i, (text, s, la, lo) in enumerate(rv.QUERY_PRESETS)])
_default = rv.DEFAULT_PRESET
_anchored = f"""
SELECT n.query_id, n.query, coalesce(p.specialty, '{_default[0]}') AS specialty,
  coalesce(p.lat, {_default[1]}::double) AS lat, coalesce(p.lon, {_default[2]}::double) AS lon
FROM questions n LEFT JOIN (SELECT * FROM ({_presets}) AS t(i, text, specialty, lat, lon)) p ON p.text = n.query
"""
_kw = values([(k, "|".join(v)) for k, v in rv.RANK_KEYWORDS.items()])


def _key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


O["specialty_keywords"] = sql(f"""
SELECT a.*, coalesce(k.words, lower(a.specialty)) AS keywords, coalesce(o.words, lower(a.query)) AS own_keywords,
  case when contains(lower(a.query), 'emergency') then 'high' else 'routine' end AS urgency
FROM ({_anchored}) a
LEFT JOIN (SELECT * FROM ({_kw}) AS t(key, words)) k ON k.key = {_key('a.specialty')}
LEFT JOIN (SELECT * FROM ({_kw}) AS t(key, words)) o ON o.key = {_key('a.query')}
""")

_flag_columns = "facility_id, rule_id, severity, message, evidence, citation_column"
for _rule in rv.RULES:
    O[f"rule_{_rule.lower()}"] = sql(f"SELECT {_flag_columns} FROM flags WHERE rule_id = '{_rule}'")
O["trust_scores"] = sql("SELECT facility_id, trust_score, cast(n_flags as int) AS n_flags FROM gold")
O["contradictions_long"] = sql(f"SELECT {_flag_columns} FROM flags")
O["rule_counts"] = sql("SELECT rule_id, severity, count(*) AS n FROM flags GROUP BY ALL")
O["severity_counts"] = sql("SELECT severity, count(*) AS n FROM flags GROUP BY ALL")
O["trust_percentiles"] = sql("""
SELECT quantile_disc(trust_score, 0.1) AS p10, quantile_disc(trust_score, 0.5) AS p50,
  quantile_disc(trust_score, 0.9) AS p90, round(avg(trust_score), 6) AS mean_score FROM gold
""")


def _cell(per: int) -> str:
    return (
        f"case when latitude is not null and longitude is not null then cast(cast(floor((latitude+90)*{per}) as bigint) as varchar)"
        f" || '_' || cast(cast(floor((longitude+180)*{per}) as bigint) as varchar) end"
    )


_wkt = "case when latitude is not null and longitude is not null then 'POINT(' || cast(longitude as varchar) || ' ' || cast(latitude as varchar) || ')' end"
O["gold_facilities"] = sql(f"""
SELECT facility_id, name, facility_type_raw, facility_type, state_raw, state, city, pin, latitude, longitude,
  description, capacity, number_doctors, year_established, {', '.join(f'{js(c)} AS {c}' for c in LISTS)},
  trust_score, flags_json AS flags, {_cell(25)} AS cell_coarse, {_cell(200)} AS cell_fine, {_wkt} AS st_geom_wkt
FROM gold
""")
O["gold_from_tables"] = sql(
    f"SELECT facility_id, trust_score, cast(n_flags as int) AS n_flags, {_wkt} AS st_geom_wkt FROM gold"
)
O["flags_collect"] = sql("""
SELECT facility_id, string_agg(rule_id || ':' || message, '; ' ORDER BY rule_id, severity, message, evidence) AS flags
FROM flags GROUP BY facility_id
""")

O["state_counts"] = sql("SELECT state, count(*) AS n FROM gold WHERE state IS NOT NULL GROUP BY state")
O["type_counts"] = sql("SELECT facility_type, count(*) AS n FROM gold GROUP BY ALL")
O["typo_count"] = sql("SELECT facility_type_raw, count(*) AS n FROM gold WHERE facility_type_raw = 'farmacy' GROUP BY 1")
_ph = "count_if(facility_type = 'pharmacy')"
_ty = "count_if(facility_type_raw = 'farmacy')"
O["typo_share"] = sql(f"SELECT {_ty} AS n_typo, {_ph} AS n_pharmacy, {pct(_ty, _ph)} AS typo_pct FROM gold")
O["typo_by_state"] = sql(f"""
SELECT state, count_if(facility_type_raw='pharmacy') AS n_listed, {_ph} AS n_corrected, {_ty} AS n_typo,
  {pct(_ty, _ph)} AS undercount_pct FROM gold WHERE state IS NOT NULL GROUP BY state
""")
O["typo_examples"] = sql("""
SELECT facility_id, name, facility_type_raw, facility_type, state FROM gold
WHERE facility_type_raw = 'farmacy' ORDER BY facility_id LIMIT 5
""")
_onco = any_contains("specialties", ["oncolog"])
_zero = sql(f"""
SELECT DISTINCT city FROM gold g WHERE state = 'Bihar' AND city IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM gold o WHERE o.city = g.city AND {_onco.replace('specialties', 'o.specialties')})
""")
O["zero_coverage_cities"] = _zero
O["zero_coverage_anti_join"] = _zero
O["zero_coverage_pharmacies"] = _zero.replace("FROM gold", "FROM (SELECT * FROM gold WHERE facility_type = 'pharmacy')")
O["zero_coverage_pharmacies_anti_join"] = O["zero_coverage_pharmacies"]
O["lowest_trust"] = sql("""
SELECT facility_id, name, state, city, trust_score FROM gold WHERE facility_type = 'hospital'
ORDER BY trust_score, facility_id LIMIT 25
""")
O["overview_kpis"] = sql("""
SELECT count(*) AS n_facilities, round(avg(trust_score)/100, 6) AS mean_trust,
  count_if(n_flags > 0) AS n_with_flags, cast(sum(n_flags) as bigint) AS n_flags_total FROM gold
""")
O["audit_list"] = sql("""
SELECT facility_id, name, facility_type_raw, facility_type, state, city, latitude, longitude, trust_score,
  cast(n_flags as int) AS n_flags FROM gold WHERE n_flags > 0 ORDER BY trust_score, facility_id LIMIT 100
""")
O["audit_kpis"] = sql(f"""
SELECT {_ty} AS n_typo, cast(sum(n_high) as bigint) AS n_high, cast(sum(n_med) as bigint) AS n_med,
  cast(sum(n_low) as bigint) AS n_low, count(*) AS n_total, count_if(n_r3 > 0) AS n_coord_flags,
  {pct('count_if(n_r3 > 0)', 'count(*)')} AS coord_pct FROM gold
""")
_staffed = "count_if(number_doctors is not null and capacity is not null and len(equipment) > 0)"
O["fully_staffed"] = sql(f"""
SELECT city, count(*) AS n_hospitals, {_staffed} AS n_staffed, {pct(_staffed, 'count(*)')} AS staffed_pct
FROM gold WHERE facility_type = 'hospital' GROUP BY city
""")
O["claims_with_evidence"] = sql(f"""
SELECT facility_id, city, state, {any_contains('equipment', ['cath', 'ecg'])} AS has_evidence FROM gold
WHERE {any_contains('specialties', ['cardio'])}
""")
_un = ["oncolog", "chemotherapy", "radiotherapy"]
O["unsupported_capability"] = sql(f"""
SELECT facility_id, state, city, trust_score FROM gold
WHERE ({any_contains('specialties', _un)} OR {any_contains('capability', _un)})
  AND NOT {any_contains('equipment', dict(rv.SPECIALTY_HINTS)['oncology'])}
""")
O["sample_distribution"] = sql("""
SELECT severity, rule_id, count(*) AS n FROM flags
WHERE facility_id IN (SELECT facility_id FROM gold ORDER BY md5(facility_id), facility_id LIMIT 50) GROUP BY ALL
""")
_abroad = "contains(message, 'outside India')"
_wrong = f"SELECT facility_id FROM flags WHERE rule_id = 'R3' AND NOT {_abroad}"
O["wrong_state"] = sql(
    f"SELECT facility_id, state, latitude, longitude FROM gold WHERE facility_id IN ({_wrong})"
)
for _name, _per in (("cell_density", 25), ("cell_density_fine", 200)):
    O[_name] = sql(f"""
SELECT {_cell(_per)} AS cell, count(*) AS n, round(avg(trust_score), 6) AS mean_trust FROM gold
WHERE latitude is not null and longitude is not null GROUP BY 1
""")


def _desert(specialty: str) -> str:
    words = rv.DESERT_KEYWORDS[specialty]
    hit = " OR ".join(any_contains(c, words) for c in ("specialties", "capability", "equipment"))
    z2 = "cast(3.8416 as double)"
    centre, scale = f"(p + {z2}/(2*n))", f"(1 + {z2}/n)"
    half = f"(cast(1.96 as double)*sqrt(p*(1-p)/n + {z2}/(4*n*n)))"
    return f"""
SELECT state, district, n_facilities, n_specialty, lat, lon, coverage_pct,
  round(greatest(cast(0 as double), {centre}/{scale} - {half}/{scale})*100, 2) AS ci_low,
  round(least(cast(1 as double), {centre}/{scale} + {half}/{scale})*100, 2) AS ci_high,
  round((100-coverage_pct)/100*n, 2) AS deficit_score
FROM (SELECT *, cast(n_facilities as double) AS n, n_specialty/cast(n_facilities as double) AS p,
    round(n_specialty/cast(n_facilities as double)*100, 2) AS coverage_pct
  FROM (SELECT state, city AS district, count(*) AS n_facilities, count_if({hit}) AS n_specialty,
      round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon
    FROM gold WHERE state is not null and city is not null and latitude is not null and longitude is not null
    GROUP BY state, city))
"""


for _specialty in rv.DESERT_KEYWORDS:
    O[f"desert_{_specialty.lower()}"] = sql(_desert(_specialty))
_view = f"(SELECT * FROM ({_desert('Oncology')}) WHERE n_facilities >= 5)"
O["desert_worst"] = sql(f"SELECT * FROM {_view} ORDER BY deficit_score DESC, state, district LIMIT 10")
O["desert_summary"] = sql(f"""
SELECT count(*) AS n_cities, cast(coalesce(sum(n_facilities), 0) as bigint) AS total_facilities,
  cast(coalesce(sum(n_specialty), 0) as bigint) AS total_specialty,
  {pct('coalesce(sum(n_specialty), 0)', 'coalesce(sum(n_facilities), 0)', 1)} AS coverage_pct,
  (SELECT district FROM {_view} ORDER BY deficit_score DESC, state, district LIMIT 1) AS worst_district,
  max(deficit_score) AS worst_deficit FROM {_view}
""")
_clean_columns = [
    "facility_id", "name", "facility_type_raw", "facility_type", "state_raw", "state", "city", "pin",
    "latitude", "longitude", "description", "capacity", "number_doctors", "year_established",
    *rv.LINK_COLUMNS, "recency_ts", "recency_months", *LISTS,
]
O["fill_rate"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_filled, {pct(f'count({c})', 'count(*)')} AS filled_pct FROM clean"
    for c in _clean_columns
))
_unfilled = "count_if(capacity is null and number_doctors is null and year_established is null)"
O["unfilled_core"] = sql(
    f"SELECT count(*) AS n_total, {_unfilled} AS n_unfilled, {pct(_unfilled, 'count(*)')} AS unfilled_pct FROM clean"
)
O["nation_counts"] = (
    "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
)
O["compound_high"] = sql("""
SELECT facility_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM flags
WHERE severity = 'HIGH' GROUP BY facility_id HAVING count(DISTINCT rule_id) > 2
""")
O["compound_high_asked"] = O["compound_high"].replace("> 2", "> 3")
O["zero_match_audit"] = sql("""
SELECT r.rule_id, r.severity, count(f.facility_id) AS n_flags, count(DISTINCT f.facility_id) AS n_facilities
FROM rules r LEFT JOIN flags f ON f.rule_id = r.rule_id GROUP BY ALL
""")
O["top_issues"] = sql(f"""
SELECT i.rule_id, i.n_facilities, s.next_step FROM (
  SELECT rule_id, count(DISTINCT facility_id) AS n_facilities FROM flags GROUP BY rule_id
  ORDER BY n_facilities DESC, rule_id LIMIT 3) i
JOIN (SELECT * FROM ({values(list(REMEDIES.items()))}) AS t(rule_id, next_step)) s USING (rule_id)
""")
O["coordinate_audit"] = sql(f"""
SELECT count_if({_abroad}) AS n_outside_country, count_if(NOT {_abroad}) AS n_wrong_state FROM flags WHERE rule_id = 'R3'
""")
O["emergency_examples"] = sql(f"SELECT {_flag_columns} FROM flags WHERE rule_id='R2' ORDER BY facility_id LIMIT 5")
O["ghost_hospitals"] = sql(f"SELECT {_flag_columns} FROM flags WHERE rule_id='R4'")
_rates = f"""
SELECT p.state, p.population, count(g.facility_id) AS n_specialty,
  round(count(g.facility_id)/cast(p.population as double)*1000000, 4) AS per_million
FROM population p LEFT JOIN (SELECT * FROM gold WHERE {_onco}) g ON g.state = p.state GROUP BY p.state, p.population
"""
O["per_million"] = sql(f"SELECT *, rank() OVER (ORDER BY per_million DESC) AS rank FROM ({_rates})")
O["below_one_per_five_million"] = sql(f"SELECT * FROM ({_rates}) WHERE n_specialty*5000000 < population")
O["worst_districts"] = sql(f"""
SELECT d.district, d.state, count(g.facility_id) AS n_facilities, count_if(g.facility_id is not null and {_onco}) AS n_specialty
FROM districts d LEFT JOIN gold g ON lower(g.city) = lower(d.district) AND g.state = d.state
GROUP BY ALL ORDER BY n_specialty, d.state, d.district LIMIT 10
""")
O["mismatch_overlay"] = sql(f"""
SELECT g.facility_id, g.city, g.state, d.district FROM gold g
JOIN districts d ON lower(g.city) = lower(d.district) AND g.state = d.state WHERE g.facility_id IN ({_wrong})
""")
_inside = "c.latitude >= b.min_lat AND c.latitude <= b.max_lat AND c.longitude >= b.min_lon AND c.longitude <= b.max_lon"
O["point_in_state"] = sql(f"""
SELECT c.facility_id, c.state, c.latitude, c.longitude, b.state AS box_state FROM clean c JOIN boxes b ON {_inside}
""")
O["landing_states"] = sql(f"""
SELECT c.facility_id, c.state, c.latitude, c.longitude, string_agg(b.state, ',' ORDER BY b.state) AS candidates,
  coalesce(bool_or(b.state = c.state), false) AS claim_matches FROM clean c JOIN boxes b ON {_inside} GROUP BY ALL
""")
_fill = " + ".join(
    f"(case when coalesce(cast({c} as varchar), '') <> '' then 1 else 0 end)" for c in rv.FILL_COLUMNS
)
O["facility_cards"] = sql(f"""
SELECT facility_id, coalesce(nullif(name, ''), '—') AS name, coalesce(nullif(city, ''), '—') AS city,
  coalesce(nullif(state, ''), '—') AS state, coalesce(pin, '') AS pin,
  coalesce(nullif(facility_type, ''), 'facility') AS facility_type, latitude, longitude,
  {js('specialties')} AS specialties, {js('capability')} AS capability, {js('equipment')} AS equipment,
  round(trust_score/cast(100 as double), 2) AS trust,
  case when trust_score >= 70 then 'High' when trust_score >= 45 then 'Moderate' else 'Low' end AS tier,
  round(least(cast(1 as double), (len(capability)+len(equipment))/cast(20 as double)), 2) AS claim_density,
  cast(case when len(equipment) > 0 then 0.95 else 0.30 end as double) AS evidence_agreement,
  round(greatest(cast(0 as double), 1 - cast(0.18 as double)*n_flags), 2) AS contradiction_penalty,
  round(greatest(cast(0.30 as double), cast(0.95 as double) - cast(0.20 as double)*n_high), 2) AS location_coherence,
  round(({_fill})/cast(11 as double), 2) AS structured_fillrate
FROM gold WHERE latitude is not null and longitude is not null
""")
O["citations"] = sql(f"""
SELECT facility_id, cast(i as int) AS pos, cap AS claim, 'capability' AS source_field,
  cast(case when len(equipment) > 0 then 0.95 else 0.65 end as double) AS extraction_confidence,
  case when len(list_filter(messages, lambda m: contains(lower(m), lower(cap)))) > 0 then 'failed' else 'passed' end AS validator_status,
  {js('equipment')} AS supporting_evidence
FROM (SELECT *, unnest(capability) AS cap, unnest(range(len(capability))) AS i FROM gold)
UNION ALL
SELECT facility_id, cast(n_cap + rn - 1 as int), message, citation_column, cast(1 as double), 'failed',
  case when evidence = '' then '[]' else {js('[evidence]')} end
FROM (SELECT f.*, len(c.capability) AS n_cap,
    row_number() OVER (PARTITION BY f.facility_id ORDER BY rule_id, pos) AS rn
  FROM flags f JOIN clean c USING (facility_id))
""")

_sites = "(SELECT DISTINCT latitude, longitude FROM clean WHERE latitude is not null and longitude is not null)"
for _name, _km in (
    ("haversine_pairs", HAV.format(lat1="r.lat", lon1="r.lon", lat2="s.latitude", lon2="s.longitude")),
    ("ellipsoid_pairs", lambert("r.lat", "r.lon", "s.latitude", "s.longitude")),
):
    O[_name] = sql(f"""
SELECT query_id, latitude AS site_lat, longitude AS site_lon, round(km, 6) AS distance_km
FROM (SELECT r.query_id, r.radius_km, s.latitude, s.longitude, {_km} AS km FROM radius_requests r CROSS JOIN {_sites} s)
WHERE km <= radius_km
""")
O["radius_search"] = sql("""
SELECT query_id, rank, facility_id, state, city, trust_score, round(km, 6) AS distance_km FROM radius_hits
""")
O["radius_json"] = sql("""
SELECT r.query_id, r.lat, r.lon, r.radius_km, lower(r.specialty) AS specialty,
  coalesce(string_agg(h.facility_id, ',' ORDER BY h.rank), '') AS ids, cast(count(h.facility_id) as int) AS n_results
FROM radius_requests r LEFT JOIN radius_hits h ON h.query_id = r.query_id GROUP BY ALL
""")
O["sql_radius_requests"] = f"SELECT query_id, lat, lon, specialty, ids FROM ({O['radius_json']})"
O["nearest_equipped"] = sql("""
SELECT query_id, facility_id, round(km, 6) AS distance_km FROM radius_scan
WHERE km <= 100 AND len(equipment) > 0 AND len(list_filter(specialties, lambda x: contains(lower(x), 'cardio'))) > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(km, 6), facility_id) = 1
""")
O["radius_trust_check"] = sql(f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(km, 6), s.facility_id) AS rank, s.facility_id,
  s.trust_score, cast(g.n_flags as int) AS n_flags
FROM radius_scan s JOIN gold g ON g.facility_id = s.facility_id
WHERE km <= 50 AND {any_contains('s.capability', ['icu'])} QUALIFY rank <= "limit"
""")
_hav = HAV.format(lat1="a.lat", lon1="a.lon", lat2="g.latitude", lon2="g.longitude")


def _kw_hit(c: str) -> str:
    return f"len(list_filter({c}, lambda x: len(list_filter(string_split(words, '|'), lambda w: contains(lower(x), w))) > 0)) > 0"


O["provider_rank"] = sql(f"""
SELECT query_id, rank, facility_id, trust, tier, spec_match, round(km, 6) AS distance_km, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, facility_id) AS rank FROM (
    SELECT *, round(cast(0.45 as double)*trust + cast(0.35 as double)*spec_match
        + cast(case when facility_type = 'hospital' then 0.05 else 0 end as double)
        - cast(0.20 as double)*least(cast(1 as double), round(km, 6)/1500), 6) AS score,
      case when trust >= 0.7 then 'High' when trust >= 0.45 then 'Moderate' else 'Low' end AS tier
    FROM (SELECT m.*, cast(case when {_kw_hit('specialties')} then 1.0 when {_kw_hit('capability')} then 0.7
          when {_kw_hit('equipment')} then 0.5 else 0 end as double) AS spec_match
      FROM (SELECT a.query_id, coalesce(k.words, lower(a.specialty)) AS words, g.facility_id, g.facility_type,
          g.specialties, g.capability, g.equipment, round(g.trust_score/cast(100 as double), 2) AS trust, {_hav} AS km
        FROM ({_anchored}) a LEFT JOIN (SELECT * FROM ({_kw}) AS t(key, words)) k ON k.key = {_key('a.specialty')}
        JOIN gold g ON g.latitude is not null and g.longitude is not null) m
      WHERE km <= 1500)
    WHERE spec_match > 0))
WHERE rank <= 5
""")


def _bm25(docs: str, key: str, text: str, k: int) -> str:
    def tokens(x: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"

    return f"""
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.query_id, p.doc_id,
      round(sum(ln(1 + (s.n - d.df + 0.5::double)/(d.df + 0.5::double)) * p.tf * 2.2::double
        / (p.tf + 1.2::double*(0.25::double + 0.75::double*p.length/s.mean))), 6) AS score
    FROM (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark) q
    JOIN (SELECT doc_id, length, term, cast(count(*) as double) AS tf FROM (
        SELECT {key} AS doc_id, len(t) AS length, unnest(t) AS term FROM (SELECT {key}, {tokens(text)} AS t FROM {docs}))
      GROUP BY ALL) p ON p.term = q.term
    JOIN (SELECT term, cast(count(*) as double) AS df FROM (
        SELECT DISTINCT {key}, unnest({tokens(text)}) AS term FROM {docs}) GROUP BY term) d ON d.term = q.term
    CROSS JOIN (SELECT cast(count(*) as double) AS n, avg(len({tokens(text)})) AS mean FROM {docs}) s
    GROUP BY q.query_id, p.doc_id)
  QUALIFY rank <= {k}
"""


def _vector(k: int) -> str:
    return f"""
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM (
    SELECT b.item_id AS query_id, e.vec_id AS doc_id,
      round(list_cosine_similarity(cast(m.embedding as double[]), cast(e.embedding as double[])), 6) AS similarity
    FROM benchmark b JOIN embeddings m ON m.vec_id = b.item_id CROSS JOIN embeddings e)
  QUALIFY rank <= {k}
"""


O["bm25_topk"] = (
    f"SELECT query_id, doc_id, score, rank FROM ({_bm25('documents', 'doc_id', 'text', 10)})"
)
O["vector_topk"] = f"SELECT query_id, doc_id, similarity, rank FROM ({_vector(10)})"
_versions = """
WITH old AS (SELECT doc_id, text, source FROM documents),
new AS (SELECT doc_id, case when quality = 0 then 'revised ' || text else text end AS text, source
  FROM old LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0
  UNION ALL SELECT item_id + 1000000000, text, null FROM benchmark)
"""
O["feed_applied"] = _versions + "SELECT * FROM new"
O["feed_from_versions"] = _versions + """
SELECT *, cast(2 as bigint) AS version FROM (
  SELECT n.*, 'insert' AS change FROM new n ANTI JOIN old USING (doc_id)
  UNION ALL SELECT o.*, 'delete' FROM old o ANTI JOIN new USING (doc_id)
  UNION ALL SELECT o.*, 'update_before' FROM old o JOIN new n USING (doc_id) WHERE (o.text, o.source) IS DISTINCT FROM (n.text, n.source)
  UNION ALL SELECT n.*, 'update_after' FROM old o JOIN new n USING (doc_id) WHERE (o.text, o.source) IS DISTINCT FROM (n.text, n.source))
"""
O["vector_index_exact"] = O["vector_topk"]
O["hybrid_topk"] = f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(1::double/(60+rank)), 8) AS score FROM (
    SELECT query_id, doc_id, rank FROM ({_bm25('documents', 'doc_id', 'text', 1 << 40)})
    UNION ALL SELECT query_id, doc_id, rank FROM ({_vector(1 << 40)}))
  GROUP BY ALL)
QUALIFY rank <= case when query_id%8=0 then 60 else 10 end
"""
O["facility_search"] = sql(f"""
SELECT f.doc_id AS facility_id, f.query_id, f.score, f.rank, c.name, c.city, c.state, c.facility_type
FROM ({_bm25(f"(SELECT facility_id, {_text} AS facility_text FROM clean)", 'facility_id', 'facility_text', 10)}) f
JOIN clean c ON c.facility_id = f.doc_id
""")


def _found(x: str, label: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), {q(LABEL_PATTERNS[label])}, 1)))"


O["field_extract"] = sql(
    "SELECT facility_id, " + ", ".join(
        f"case when len({_found('description', label)}) > 0 then array_to_string({_found('description', label)}, '|') end AS {label}"
        for label in rv.EXTRACT_LABELS
    ) + " FROM clean"
)


def _extract(table: str, key: str, text: str) -> str:
    parts = " || ',' || ".join(
        f"'\"{label}\":' || case when len({_found(text, label)}) > 0 then {js(_found(text, label))} else 'null' end"
        for label in rv.EXTRACT_LABELS
    )
    return (
        f"SELECT {key}, case when length(trim(coalesce({text}, ''))) = 0 then '{{}}'"
        f" else '{{' || {parts} || '}}' end AS fields FROM {table}"
    )


O["page_extract"] = _extract("pages", "page_id", "html")
O["document_extract"] = _extract("documents", "doc_id", "text")


def _needles(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(f'lower({x})')}, '\\s+'), lambda w: length(w) > 3)"


O["needle_tokens"] = sql(
    f"SELECT request_id, array_to_string({_needles('claim')}, '|') AS needles FROM claim_requests"
)


def _supports(needles: str) -> str:
    """Supporting sources, joined by ``|``, for a list of needles and a row of ``clean`` named c."""
    def hit(text: str) -> str:
        return f"len(list_filter({needles}, lambda n: contains({text}, n))) > 0"

    texts = {c: f"lower(array_to_string(c.{c}, ' '))" for c in ("specialties", "capability", "equipment", "procedure")}
    texts["description"] = "lower(coalesce(c.description, ''))"
    cases = [f"case when {hit(t)} then '{name}' end" for name, t in texts.items()]
    cases.append("case when coalesce(c.capacity, 0) <> 0 or coalesce(c.number_doctors, 0) <> 0 then 'capacity_or_doctors' end")
    return f"list_filter([{', '.join(cases)}], lambda x: x is not null)"


_cross = f"""
SELECT r.request_id, r.facility_id, r.claim, c.facility_id is not null AS known,
  case when c.facility_id is null then cast([] as varchar[]) else {_supports(_needles('r.claim'))} end AS s
FROM claim_requests r LEFT JOIN clean c ON c.facility_id = r.facility_id
"""
O["cross_source"] = sql(f"""
SELECT request_id, facility_id, len(s) >= 2 AS agree, array_to_string(s, '|') AS sources_supporting,
  case when known then 6 else 0 end AS sources_total, case when not known then 'facility not found' end AS reason
FROM ({_cross})
""")
_cross_json = f"""
SELECT request_id, '{{"facility_id":"' || facility_id || '","claim":' || {js('claim')} || ',"agree":'
  || case when len(s) >= 2 then 'true' else 'false' end || case when known then '' else ',"reason":"facility not found"' end
  || ',"sources_supporting":' || {js('s')} || ',"sources_total":' || case when known then '6' else '0' end || '}}' AS json
FROM ({_cross})
"""
O["cross_source_json"] = sql(_cross_json)
O["trust_report"] = sql("""
SELECT r.request_id, r.facility_id, case when g.facility_id is null
  then '{"facility_id":"' || r.facility_id || '","error":"not found"}'
  else '{"facility_id":"' || g.facility_id || '","trust_score":' || g.trust_score || ',"flags":' || g.flags_json || '}' end AS json
FROM claim_requests r LEFT JOIN gold g ON g.facility_id = r.facility_id
""")


def _sentences(x: str, under: str = "") -> str:
    marked = f"regexp_replace({strip(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return (
        f"list_filter(string_split({marked}, chr(1)), lambda s: length(s) > 20{under})"
    )


_ids = "list_sort(list_distinct(regexp_extract_all(text, '\\[([A-Za-z0-9][\\w\\-]{4,})\\]', 1)))"
_parsed = f"""
SELECT *, case when allowed = '' then {_ids} else list_filter({_ids}, lambda i: list_contains(string_split(allowed, ','), i)) end AS ids,
  list_transform({_sentences('text')}, lambda s: {strip('s')}) AS claims FROM answers
"""
O["citation_ids"] = sql(f"SELECT answer_id, array_to_string(ids, ',') AS ids FROM ({_parsed})")
O["sentence_claims"] = (
    f"SELECT doc_id, {js(f"list_transform({_sentences('text', ' and length(s) < 400')}, lambda s: {strip('s')})")} AS claims FROM documents"
)
O["verify_answers"] = sql(f"""
, parsed AS ({_parsed})
, cited AS (SELECT answer_id, claims, unnest(ids) AS fid, unnest(range(len(ids))) AS id_pos FROM parsed)
, pairs AS (SELECT answer_id, fid, id_pos, unnest(claims) AS claim, unnest(range(len(claims))) AS claim_pos FROM cited)
, doubts AS (
  SELECT p.answer_id, count(*) AS n, list(p.fid || ': ' || p.claim ORDER BY id_pos, claim_pos) AS found
  FROM pairs p LEFT JOIN clean c ON c.facility_id = p.fid
  WHERE c.facility_id is null OR len({_supports(_needles('p.claim'))}) < 2 GROUP BY p.answer_id)
, highs AS (
  SELECT answer_id, count(*) AS n, list(fid || '/' || rule_id ORDER BY id_pos, rule_id) AS found
  FROM cited JOIN flags f ON f.facility_id = fid WHERE severity = 'HIGH' GROUP BY answer_id)
, judged AS (
  SELECT p.answer_id, p.iter + 1 AS iter, p.text, p.ids, coalesce(d.n, 0) AS nd, coalesce(h.n, 0) AS nh,
    coalesce(d.found, []) AS doubts, coalesce(h.found, []) AS highs,
    concat_ws(' | ', d.n || ' cross-source disagreements: ' || array_to_string(list_transform(d.found[1:3], lambda x: substring(x, 1, 80)), '; '),
      h.n || ' HIGH contradiction flags: ' || array_to_string(list_transform(h.found[1:3], lambda x: substring(x, 1, 80)), '; ')) AS why
  FROM parsed p LEFT JOIN doubts d USING (answer_id) LEFT JOIN highs h USING (answer_id))
SELECT answer_id, iter, case when iter > 8 then 'capped' when nd + nh > 0 then 'refine' else 'accept' end AS decision,
  case when iter > 8 then 'low' when nd + nh > 0 then null when len(ids) > 0 then 'high' else 'medium' end AS confidence,
  cast(nd as int) AS n_disagreements, cast(nh as int) AS n_high_flags, {js('doubts')} AS disagreements, {js('highs')} AS high_flags,
  case when iter <= 8 and nd + nh > 0 then why end AS reason,
  case when iter > 8 then text || {q(rv.CAP_TAIL)} when nd + nh > 0 then {q(rv.REFINE_HEAD)} || why || {q(rv.REFINE_TAIL)} else text end AS message
FROM judged
""")
O["answer_checks"] = sql(r"""
SELECT answer_id, len(regexp_extract_all(text, '\[([A-Za-z0-9][\w\-]{4,})\]', 1)) > 0 AS cites_facility,
  regexp_matches(list_last(string_split(regexp_replace(text, '\s+$', ''), chr(10))), '^Confidence: (high|medium|low)$') AS ends_with_confidence,
  case when regexp_matches(question, '(data quality|farmacy|w\.?ho award|coordinate)', 'i') then
    regexp_matches(text, '([0-9][0-9,]*\s+(rows|facilities|entries|matches))', 'i')
    or regexp_matches(text, '(0 (rows|matches|facilities)|zero (rows|matches|facilities)|fired zero times)', 'i') end AS reports_known_bug
FROM answers
""")
_messages = f"""
SELECT conv_id, turn, case when role <> '' then role when kind = 'message' then 'assistant' else 'user' end AS role,
  replace(text, chr(10), '') AS content FROM ({inputs.TRANSCRIPTS})
"""

O["transcript_flatten"] = _messages
_drafts = f"""(SELECT conv_id AS answer_id, max_by(content, turn) AS text, 0 AS iter, '' AS allowed
FROM ({_messages}) WHERE role = 'assistant' GROUP BY conv_id)"""
O["transcript_verdicts"] = O["verify_answers"].replace("FROM answers", f"FROM {_drafts}")
O["raw_csv"] = "SELECT cast(c_custkey as varchar) AS c_custkey, c_name, c_mktsegment FROM customer"
O["golden_read"] = "SELECT text AS question, cast(item_id as varchar) AS expected_facts FROM benchmark"
O["boxes_json"] = """
SELECT s_name AS state, cast(s_suppkey as double) AS min_lat, cast(s_suppkey + 2 as double) AS max_lat,
  cast(-s_suppkey as double) AS min_lon, cast(3 - s_suppkey as double) AS max_lon FROM supplier
"""
O["aliases_json"] = """
SELECT case when c_custkey % 3 = 0 then lower(c_name) else 'of ' || lower(c_name) end AS alias, n_name AS state,
  case when c_custkey % 3 = 0 then 'city' else 'alias' end AS kind
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
O["table_comment"] = "SELECT n_nationkey, n_name FROM nation"
O["ring_covers_radius"] = sql("SELECT count(DISTINCT facility_id) AS n_found, 0::bigint AS n_missed FROM radius_hits")

O["metric_delta"] = f"""
SELECT coalesce(b.metric, c.metric) AS metric, round(b.value, 6) AS baseline, round(c.value, 6) AS candidate,
  round(coalesce(c.value, 0) - coalesce(b.value, 0), 6) AS delta
FROM ({inputs.METRICS['baseline']}) b FULL OUTER JOIN ({inputs.METRICS['candidate']}) c ON b.metric = c.metric
"""
O["golden_normalise"] = """
SELECT text AS question, coalesce(source, '') AS expected_facts
FROM documents WHERE lang IS DISTINCT FROM 'de' AND lang IS NOT NULL
"""
O["concat_frames"] = sql("""
SELECT name, city, state, latitude AS lat, longitude AS lon, cast(null as double) AS trust, cast(null as varchar) AS tier FROM clean
UNION ALL SELECT s_name, null, null, null, null, cast(1 as double), 'Anchor' FROM supplier
""")
_toks = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
O["index_incremental"] = f"""
SELECT doc_id, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM (
  SELECT doc_id, unnest({_toks}) AS term FROM (
    SELECT d.doc_id, case when l.doc_id is null then d.text else 'relabelled quality ' || l.quality || ' ' || d.text end AS text
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)) GROUP BY doc_id
"""
_counted = f"SELECT doc_id, unnest({_toks}) AS term FROM documents"
O["index_late_versions"] = f"SELECT doc_id, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM ({_counted}) GROUP BY doc_id"
O["index_deletes"] = f"""
SELECT doc_id, cast(len({_toks}) as bigint) AS length FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""
O["index_search"] = O["bm25_topk"]
O["rules_stream"] = O["rule_counts"]
O["tools_smoke"] = sql(f"""
, worst AS (SELECT * FROM gold ORDER BY trust_score, facility_id LIMIT 1)
SELECT cast(1 as bigint) AS request_id,
  '{{"facility_id":"' || facility_id || '","trust_score":' || trust_score || ',"flags":' || flags_json || '}}' AS score,
  (SELECT len({_supports("['cardiac', 'surgery']")}) >= 2 FROM clean c WHERE c.facility_id = worst.facility_id) AS agree,
  (SELECT string_agg(facility_id, ',' ORDER BY facility_id) FROM (
    SELECT facility_id FROM (SELECT facility_id, {lambert('25.59::double', '85.13::double', 'latitude', 'longitude')} AS km FROM gold
      WHERE latitude is not null and longitude is not null and {any_contains('specialties', ['cardiology'])})
    WHERE km <= 25 ORDER BY round(km, 6), facility_id LIMIT 5)) AS nearby,
  (SELECT fields FROM ({_extract('worst', 'facility_id', 'description')})) AS fields
FROM worst
""")
_km = HAV.format(lat1="latitude", lon1="longitude", lat2="25.59::double", lon2="85.13::double")
O["temp_functions"] = sql(f"""
SELECT facility_id, pin, case when coalesce(capacity, 0) >= 70 then 'High' when coalesce(capacity, 0) >= 45 then 'Moderate' else 'Low' end AS tier,
  round({_km}, 4) AS km,
  array_to_string({_needles('description')}, '|') AS needles
FROM clean
""")
_not_found = '\'{"facility_id":"\' || r.facility_id || \'","error":"not found"}\''
O["sql_tools"] = sql(f"""
SELECT r.request_id, case when g.facility_id is null then {_not_found}
    else '{{"facility_id":"' || g.facility_id || '","trust_score":' || g.trust_score || ',"flags":' || g.flags_json || '}}' end AS score,
  x.json AS cross_source, p.fields
FROM claim_requests r LEFT JOIN gold g ON g.facility_id = r.facility_id
JOIN ({_cross_json}) x ON x.request_id = r.request_id
JOIN ({_extract('claim_requests', 'request_id', 'claim')}) p ON p.request_id = r.request_id
""")
O["sql_claim_requests"] = f"SELECT request_id, score, cross_source FROM ({O['sql_tools']})"
O["sql_radius"] = sql(f"""
SELECT 'cardio' AS specialty, cast(row_number() OVER (ORDER BY round(km, 6), facility_id) - 1 as int) AS pos, facility_id,
  round(km, 6) AS distance_km
FROM (SELECT facility_id, {lambert('25.59::double', '85.13::double', 'latitude', 'longitude')} AS km FROM gold
  WHERE latitude is not null and longitude is not null and {any_contains('specialties', ['cardio'])})
WHERE km <= 50 QUALIFY pos < 20
""")
O["write_roundtrip"] = O["trust_scores"]
_gold_columns = [c for c in COMMENTS if c not in ("recency_months",)]
O["column_comments"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({expr}) AS n_filled, {q(COMMENTS[c])} AS comment FROM gold"
    for c in _gold_columns
    for expr in [{"flags": "flags_json", "cell_coarse": _cell(25), "cell_fine": _cell(200), "st_geom_wkt": _wkt}.get(c, c)]
))
O["rows_json"] = sql("""
SELECT '{"facility_id":"' || facility_id || '","name":"' || name || '"' || case when state is null then '' else ',"state":"' || state || '"' end
  || case when capacity is null then '' else ',"capacity":' || capacity end || '}' AS json FROM clean
""")
O["sample_documents"] = sql(
    f"SELECT facility_id AS doc_uri, {_text} AS content FROM clean ORDER BY facility_id LIMIT 200"
)
O["batch_read"] = sql(
    "SELECT facility_id, name, state FROM clean WHERE facility_id IN (SELECT facility_id FROM claim_requests)"
)
