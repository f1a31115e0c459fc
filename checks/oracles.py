"""DuckDB forms of the registered queries.

Written independently of the Spark operators: lists are unnested and joined where the
operators use array functions, searches scan everything where the operators use cells.
"""

from __future__ import annotations

from carecheck import lookup_values as lv
from carecheck import rule_values as rv
from checks import inputs

BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
AS_OF = "timestamp '2026-01-01'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        if isinstance(v, str):
            return q(v)
        if isinstance(v, list):
            return "[" + ", ".join(q(x) for x in v) + "]"
        return f"cast({v} as double)" if isinstance(v, float) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def json_list(c: str) -> str:
    loose = (
        f"list_filter(list_transform(regexp_split_to_array(regexp_replace({c}, '[\\[\\]\"]', '', 'g'), '[,|]'),"
        f" lambda x: {strip('x')}), lambda x: x <> '')"
    )
    return (
        f"coalesce(try_cast(try_cast({c} as json) as varchar[]),"
        f" case when length(trim({c})) > 0 then {loose} else cast([] as varchar[]) end)"
    )


def rule_list(c: str) -> str:
    return f"list_transform(list_filter({c}, lambda x: x is not null and x <> ''), lambda x: lower({strip('x')}))"


def any_contains(c: str, words: list[str]) -> str:
    hit = " or ".join(f"contains(lower(x), {q(w)})" for w in words)
    return f"coalesce(len(list_filter({c}, lambda x: {hit})) > 0, false)"


def text_contains(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def num(c: str) -> str:
    return f"case when not isnan(try_cast({c} as double)) then try_cast({c} as double) end"


def whole(c: str) -> str:
    return f"cast(trunc({num(c)}) as int)"


def pct(part: str, total: str, digits: int = 2) -> str:
    return f"case when {total} = 0 then cast(0 as double) else round(100 * cast({part} as double) / cast({total} as double), {digits}) end"


HAV = (
    "12742.0::double * asin(sqrt(least(1.0::double, pow(sin(radians({lat2}-{lat1})/2),2)"
    " + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2))))"
)


def lambert(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Ellipsoidal distance in km as a lateral-free expression over two reduced latitudes."""
    f = "(1::double/298.257223563::double)"
    b1, b2 = (f"atan((1-{f})*tan(radians({x})))" for x in (lat1, lat2))
    s = (
        f"(2*asin(sqrt(least(1::double, pow(sin(({b2}-{b1})/2),2)"
        f" + cos({b1})*cos({b2})*pow(sin((radians({lon2})-radians({lon1}))/2),2)))))"
    )
    p, d = f"(({b1}+{b2})/2)", f"(({b2}-{b1})/2)"
    x = f"(({s}-sin({s}))*pow(sin({p}),2)*pow(cos({d}),2)/pow(cos({s}/2),2))"
    y = f"(({s}+sin({s}))*pow(cos({p}),2)*pow(sin({d}),2)/pow(sin({s}/2),2))"
    return f"case when {s} = 0 then 0::double else 6378.137::double*({s}-{f}/2*({x}+{y})) end"


LISTS = ["specialties", "procedure", "equipment", "capability"]
FLAG_JSON = "to_json({'rule_id': rule_id, 'severity': severity, 'message': message, 'evidence': evidence, 'citation_column': citation_column})"

CTES: dict[str, str] = {}
CTES["boxes(state, min_lat, max_lat, min_lon, max_lon)"] = values(lv.STATE_BOXES)
CTES["aliases(alias, state, kind)"] = values(
    [(a, s, "alias") for a, s in lv.STATE_ALIASES] + [(a, s, "city") for a, s in lv.CITY_STATES]
)
CTES["population(state, population)"] = f"SELECT col0, cast(col1 as bigint) FROM ({values(lv.STATE_POPULATION)})"
CTES["districts(district, state)"] = values(lv.PRIORITY_DISTRICTS)
CTES["hints(key_pos, key, hints)"] = values(
    [(i, k, h) for i, (k, h) in enumerate(rv.SPECIALTY_HINTS)]
)
CTES["rules(rule_id, severity)"] = values([(r, s) for r, (s, _) in rv.RULES.items()])
CTES["fac"] = inputs.RAW_FACILITIES
CTES["clean"] = f"""
SELECT facility_id, name, lower(facilityTypeId) AS facility_type_raw,
  replace(lower(facilityTypeId), 'farmacy', 'pharmacy') AS facility_type,
  address_stateOrRegion AS state_raw,
  coalesce((select min(b.state) from boxes b where b.state = address_stateOrRegion),
    (select min(a.state) from aliases a where a.kind='alias' and a.alias = lower(address_stateOrRegion)),
    (select min(a.state) from aliases a where a.kind='city' and a.alias = lower(address_stateOrRegion))) AS state,
  address_city AS city,
  case when length(regexp_replace(address_postalCode, '\\.0$', '')) < 6
    then lpad(regexp_replace(address_postalCode, '\\.0$', ''), 6, '0')
    else regexp_replace(address_postalCode, '\\.0$', '') end AS pin,
  {num('latitude')} AS latitude, {num('longitude')} AS longitude, description,
  {whole('capacity')} AS capacity, {whole('numberDoctors')} AS number_doctors,
  {whole('yearEstablished')} AS year_established,
  facebookLink, twitterLink, instagramLink, linkedinLink, websites, officialWebsite,
  try_cast(recency_of_page_update as timestamp) AS recency_ts,
  cast(date_sub('month', try_cast(recency_of_page_update as timestamp), {AS_OF}) as int) AS recency_months,
  {', '.join(f'{json_list(c)} AS {c}' for c in LISTS)}
FROM fac
"""
_null = "coalesce(cast({} as varchar), 'null')"
CTES["ins"] = f"""
SELECT c.*, {', '.join(f'{rule_list(c)} AS l_{c}' for c in LISTS)},
  b.min_lat, b.max_lat, b.min_lon, b.max_lon, coalesce(c.description, '') AS d,
  nullif(c.number_doctors, 0) AS docs, nullif(c.recency_months, 0) AS months
FROM clean c LEFT JOIN boxes b ON b.state = c.state
"""
CTES["blobs"] = """
SELECT *, array_to_string(l_specialties || l_capability || l_procedure, ' ') AS claims,
  array_to_string(l_equipment, ' ') AS eq_text
FROM ins
"""
_awards = [p.replace(r"\d", "[0-9]") for p in rv.AWARD_PATTERNS]
_links = [f"coalesce({c}, '') <> ''" for c in rv.LINK_COLUMNS]
CTES["spec"] = """
SELECT facility_id, eq_text, l_equipment, unnest(l_specialties) AS sp, unnest(range(len(l_specialties))) AS sp_pos
FROM blobs
"""
CTES["spec_miss"] = f"""
SELECT s.facility_id, s.sp, s.sp_pos, any_value(s.l_equipment) AS l_equipment, arg_min(h.hints, h.key_pos) AS hints
FROM spec s JOIN hints h ON contains(s.sp, h.key)
WHERE NOT regexp_matches(s.sp, '{rv.PEDIATRIC_DENTAL_PATTERN}')
  AND len(list_filter(h.hints, lambda w: contains(s.eq_text, w))) = 0
GROUP BY ALL
"""


def _flag(rule: str, message: str, evidence: str, where: str, source: str = "blobs",
          citation: str | None = None, pos: str = "0") -> str:
    severity, column = rv.RULES[rule]
    return (
        f"SELECT facility_id, '{rule}' AS rule_id, '{severity}' AS severity, {message} AS message,"
        f" {evidence} AS evidence, {q(citation or column)} AS citation_column,"
        f" {pos} AS pos FROM {source} WHERE {where}"
    )


_in_country = "(latitude >= 6.5 and latitude <= 35.5 and longitude >= 68 and longitude <= 97.5)"
_in_box = "(latitude >= min_lat and latitude <= max_lat and longitude >= min_lon and longitude <= max_lon)"
_at = "'lat=' || cast(latitude as varchar) || ', lon=' || cast(longitude as varchar)"
CTES["flags"] = " UNION ALL ".join([
    _flag(
        "R1", q(rv.R1_MESSAGE),
        "'specialties=' || cast(to_json(l_specialties) as varchar) || ' equipment=' || cast(to_json(l_equipment) as varchar)"
        f" || ' doctors=' || {_null.format('docs')} || ' capacity=' || {_null.format('capacity')}",
        f"{text_contains('claims', rv.ADVANCED_KEYWORDS)} and (len(l_equipment) = 0 or (docs is null and coalesce(capacity, 0) = 0))",
    ),
    _flag(
        "R2", f"replace({q(rv.R2_MESSAGE)}, '%s', facility_type)", "d",
        f"facility_type in ({', '.join(q(t) for t in rv.NON_HOSPITAL_TYPES)}) and ("
        + " or ".join(f"regexp_matches(d, {q(p)}, 'i')" for p in rv.EMERGENCY_PATTERNS) + ")",
    ),
    _flag("R3", q(rv.R3_COUNTRY_MESSAGE), _at,
          f"latitude is not null and longitude is not null and not {_in_country}"),
    _flag("R3", f"replace({q(rv.R3_STATE_MESSAGE)}, '%s', state)", f"{_at} || ', state=' || state",
          f"{_in_country} and min_lat is not null and not {_in_box}", citation=rv.R3_STATE_CITATION),
    _flag(
        "R4", q(rv.R4_MESSAGE),
        f"'capacity=' || {_null.format('capacity')} || ' doctors=' || {_null.format('docs')} || ' equipment=' || cast(to_json(l_equipment) as varchar)",
        "facility_type = 'hospital' and coalesce(capacity, 0) = 0 and docs is null and len(l_equipment) = 0",
    ),
    _flag("R5", q(rv.R5_MESSAGE), "'facilityTypeId=''' || facility_type_raw || ''''",
          "facility_type_raw = 'farmacy'"),
    _flag(
        "R6", q(rv.R6_MESSAGE),
        "coalesce(" + ", ".join(f"nullif(regexp_extract(d, {q(p)}, 0, 'i'), '')" for p in _awards) + ")",
        " or ".join(f"regexp_matches(d, {q(p)}, 'i')" for p in _awards),
    ),
    _flag(
        "R7", f"replace(replace({q(rv.R7_MESSAGE.replace('%s', chr(1), 1))}, chr(1), sp), '%s', array_to_string(hints[1:3], ', '))",
        "'specialty=' || sp || ' equipment=' || cast(to_json(l_equipment) as varchar)", "true",
        source="spec_miss", pos="sp_pos",
    ),
    _flag(
        "R8", q(rv.R8_MESSAGE),
        f"'recency_months=' || {_null.format('months')} || ' socials_present=' || cast(to_json([{', '.join(_links)}]) as varchar)",
        f"coalesce(months > 24, false) or not ({' or '.join(_links)})",
    ),
])
CTES["per_fac"] = f"""
SELECT facility_id, list({FLAG_JSON} ORDER BY rule_id, pos) AS flag_list, count(*) AS n_flags,
  count_if(severity='HIGH') AS n_high, count_if(severity='MED') AS n_med, count_if(severity='LOW') AS n_low,
  count_if(rule_id='R3') AS n_r3,
  list(rule_id ORDER BY rule_id, pos) FILTER (WHERE severity='HIGH') AS high_rules,
  list(message ORDER BY rule_id, pos) AS messages
FROM flags GROUP BY facility_id
"""
CTES["gold"] = """
SELECT c.*, coalesce(n_flags, 0) AS n_flags, coalesce(n_high, 0) AS n_high, coalesce(n_med, 0) AS n_med,
  coalesce(n_low, 0) AS n_low, coalesce(n_r3, 0) AS n_r3, high_rules, messages,
  cast(greatest(0, 100 - 35*coalesce(n_high,0) - 15*coalesce(n_med,0) - 5*coalesce(n_low,0)) as int) AS trust_score,
  '[' || coalesce(array_to_string(flag_list, ','), '') || ']' AS flags_json
FROM clean c LEFT JOIN per_fac p USING (facility_id)
"""
CTES["radius_requests"] = inputs.RADIUS_REQUESTS
CTES["claim_requests"] = inputs.CLAIM_REQUESTS
CTES["answers"] = inputs.ANSWERS
CTES["questions"] = inputs.QUESTIONS
CTES["radius_scan"] = f"""
SELECT r.query_id, r.lat, r.lon, r.radius_km, lower(r.specialty) AS needle, r."limit", g.facility_id, g.name,
  g.facility_type, g.state, g.city, g.trust_score, g.specialties, g.equipment, g.capability, g.latitude, g.longitude, g.flags_json,
  {lambert('r.lat', 'r.lon', 'g.latitude', 'g.longitude')} AS km
FROM radius_requests r JOIN gold g ON g.latitude is not null and g.longitude is not null
"""
CTES["radius_hits"] = """
SELECT *, round(km, 6) AS km6, row_number() OVER (PARTITION BY query_id ORDER BY round(km, 6), facility_id) AS rank
FROM radius_scan
WHERE km <= radius_km AND (needle = '' OR len(list_filter(specialties, lambda x: contains(lower(x), needle))) > 0)
QUALIFY rank <= "limit"
"""


def bigint_counts(statement: str) -> str:
    """``count_if`` returns HUGEINT; every call is cast to the BIGINT that Spark gives."""
    call, done, at = "count_if(", "", 0
    while (start := statement.find(call, at)) >= 0:
        end, depth = start + len(call), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(statement[end], 0)
            end += 1
        done += statement[at:start] + f"cast({statement[start:end]} as bigint)"
        at = end
    return done + statement[at:]


def sql(body: str) -> str:
    """A statement with the shared tables it may use in front; unused ones cost nothing."""
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in CTES.items())
    return bigint_counts(f"WITH {ctes}\n{body}")
