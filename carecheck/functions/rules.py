"""The eight contradiction rules and the trust score as native expressions.

Each rule is SQL text over one clean facility row (plus the box of its claimed state), so
a whole rule set is parsed in one call; nothing shuffles and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from carecheck import rule_values as rv
from carecheck.functions import text as tx
from carecheck.functions.text import FLAG_TYPE, contains_any, pattern_any, pattern_lower, quoted

LISTS = ["specialties", "procedure", "equipment", "capability"]
IN_COUNTRY = (
    f"(latitude BETWEEN {rv.COUNTRY_MIN_LAT}D AND {rv.COUNTRY_MAX_LAT}D"
    f" AND longitude BETWEEN {rv.COUNTRY_MIN_LON}D AND {rv.COUNTRY_MAX_LON}D)"
)
IN_BOX = "(latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon)"


def _flag(rule: str, message: str, evidence: str, citation: str | None = None) -> str:
    severity, column = rv.RULES[rule]
    return (
        f"named_struct('rule_id', '{rule}', 'severity', '{severity}', 'message', {message},"
        f" 'evidence', coalesce({evidence}, ''),"
        f" 'citation_column', {quoted(citation or column)})"
    )


def _shown(value: str) -> str:
    return f"coalesce(cast({value} AS string), 'null')"


def _award() -> str:
    """What the first award pattern in list order matches; null where none does.

    The lower-case text decides (case-blind matching is far slower); a hit is then read
    from the text as written.
    """
    tries = ", ".join(
        f"CASE WHEN {contains_any('_folded', needs)} AND _folded RLIKE {quoted(pattern_lower(p))}"
        f" THEN nullif(regexp_extract(_description, {quoted(pattern_any([p]))}, 0), '') END"
        for p, needs in zip(rv.AWARD_PATTERNS, rv.AWARD_NEEDS)
    )
    return f"coalesce({tries})"


def with_rule_inputs(clean: DataFrame) -> DataFrame:
    """Add the normalised inputs the rules share, each computed once per row."""
    normal = clean.selectExpr(
        "*",
        *[f"{tx.rule_list(c)} AS _{c}" for c in LISTS],
        "lower(coalesce(facility_type, '')) AS _type",
        "lower(coalesce(facility_type_raw, '')) AS _type_raw",
        "coalesce(description, '') AS _description",
        "lower(coalesce(description, '')) AS _folded",
        "nullif(number_doctors, 0) AS _doctors",
        "nullif(recency_months, 0) AS _months",
    )
    return normal.selectExpr(
        "*",
        f"{_award()} AS _award",
        "array_join(concat(_specialties, _capability, _procedure), ' ') AS _claims",
        "array_join(_equipment, ' ') AS _equipment_text",
    )


def rule_r1() -> str:
    fires = (
        f"{contains_any('_claims', rv.ADVANCED_KEYWORDS)} AND"
        " (size(_equipment) = 0 OR (_doctors IS NULL AND coalesce(capacity, 0) = 0))"
    )
    evidence = (
        "concat('specialties=', to_json(_specialties), ' equipment=', to_json(_equipment),"
        f" ' doctors=', {_shown('_doctors')}, ' capacity=', {_shown('capacity')})"
    )
    return f"CASE WHEN {fires} THEN {_flag('R1', quoted(rv.R1_MESSAGE), evidence)} END"


def rule_r2() -> str:
    types = ", ".join(quoted(t) for t in rv.NON_HOSPITAL_TYPES)
    worded = " OR ".join(
        f"({contains_any('_folded', needs)} AND _folded RLIKE {quoted(pattern_lower(p))})"
        for p, needs in zip(rv.EMERGENCY_PATTERNS, rv.EMERGENCY_NEEDS)
    )
    fires = f"_type IN ({types}) AND ({worded})"
    message = f"format_string({quoted(rv.R2_MESSAGE)}, _type)"
    return f"CASE WHEN {fires} THEN {_flag('R2', message, '_description')} END"


def rule_r3() -> str:
    """Outside the country, else outside the box of the claimed state; no box, no flag."""
    at = "concat('lat=', cast(latitude AS string), ', lon=', cast(longitude AS string))"
    abroad = _flag("R3", quoted(rv.R3_COUNTRY_MESSAGE), at)
    elsewhere = _flag(
        "R3", f"format_string({quoted(rv.R3_STATE_MESSAGE)}, state)",
        f"concat({at}, ', state=', state)", rv.R3_STATE_CITATION,
    )
    return (
        f"CASE WHEN latitude IS NULL OR longitude IS NULL THEN NULL WHEN NOT {IN_COUNTRY} THEN {abroad}"
        f" WHEN min_lat IS NOT NULL AND NOT {IN_BOX} THEN {elsewhere} END"
    )


def rule_r4() -> str:
    fires = "_type = 'hospital' AND coalesce(capacity, 0) = 0 AND _doctors IS NULL AND size(_equipment) = 0"
    evidence = (
        f"concat('capacity=', {_shown('capacity')}, ' doctors=', {_shown('_doctors')},"
        " ' equipment=', to_json(_equipment))"
    )
    return f"CASE WHEN {fires} THEN {_flag('R4', quoted(rv.R4_MESSAGE), evidence)} END"


def rule_r5() -> str:
    evidence = "concat('facilityTypeId=\\'', coalesce(nullif(_type_raw, ''), 'farmacy'), '\\'')"
    return (
        "CASE WHEN _type = 'farmacy' OR _type_raw = 'farmacy'"
        f" THEN {_flag('R5', quoted(rv.R5_MESSAGE), evidence)} END"
    )


def rule_r6() -> str:
    return f"CASE WHEN _award IS NOT NULL THEN {_flag('R6', quoted(rv.R6_MESSAGE), '_award')} END"


def rule_r7() -> str:
    """Array of flags: one per specialty whose first unmet key finds no expected equipment.

    A key met by the equipment does not end the search, so later keys still count. The
    expected equipment of a specialty is worked out first, then turned into its flag.
    """
    unmet = " ".join(
        f"WHEN contains(sp, {quoted(key)}) AND NOT {contains_any('_equipment_text', hints)}"
        f" THEN {quoted(', '.join(hints[:3]))}"
        for key, hints in rv.SPECIALTY_HINTS
    )
    flag = _flag(
        "R7", f"format_string({quoted(rv.R7_MESSAGE)}, x.sp, x.hints)",
        "concat('specialty=', x.sp, ' equipment=', to_json(_equipment))",
    )
    checked = f"filter(_specialties, sp -> NOT sp RLIKE {quoted(rv.PEDIATRIC_DENTAL_PATTERN)})"
    hinted = f"transform({checked}, sp -> named_struct('sp', sp, 'hints', CASE {unmet} END))"
    return f"transform(filter({hinted}, x -> x.hints IS NOT NULL), x -> {flag})"


def rule_r8() -> str:
    present = ", ".join(f"coalesce({c}, '') <> ''" for c in rv.LINK_COLUMNS)
    fires = f"coalesce(_months > {rv.STALE_MONTHS}, false) OR NOT array_contains(array({present}), true)"
    evidence = f"concat('recency_months=', {_shown('_months')}, ' socials_present=', to_json(array({present})))"
    return f"CASE WHEN {fires} THEN {_flag('R8', quoted(rv.R8_MESSAGE), evidence)} END"


RULES = {
    "R1": rule_r1, "R2": rule_r2, "R3": rule_r3, "R4": rule_r4,
    "R5": rule_r5, "R6": rule_r6, "R7": rule_r7, "R8": rule_r8,
}


def rule_array(rule: str) -> str:
    """Flags of one rule as an array, empty where it does not fire."""
    made = RULES[rule]()
    return made if rule == "R7" else f"array_compact(array({made}))"


def all_flags() -> str:
    """All flags of a row in rule order; empty where none fires."""
    head = ", ".join(RULES[r]() for r in ("R1", "R2", "R3", "R4", "R5", "R6"))
    made = f"concat(array_compact(array({head})), {rule_array('R7')}, {rule_array('R8')})"
    return f"cast({made} AS array<{FLAG_TYPE}>)"


def trust_score(flags: str) -> str:
    """100 minus the points of every flag, never below 0."""
    points = " ".join(f"WHEN '{s}' THEN {p}" for s, p in rv.SEVERITY_POINTS.items())
    return f"greatest(0, aggregate({flags}, 100, (left, f) -> left - CASE f.severity {points} ELSE 0 END))"
