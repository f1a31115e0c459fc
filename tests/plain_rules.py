"""The rules as plain Python over one dict: what the native expressions are held against."""

import re

from carecheck import rule_values as rv


def clean_list(items):
    return [x.strip(" \t\n\r\f\v").lower() for x in items or [] if x]


def hits(text, words):
    return any(w in text for w in words)


def first_unmet(specialty, equipment_text):
    for key, hints in rv.SPECIALTY_HINTS:
        if key in specialty and not hits(equipment_text, hints):
            return hints
    return None


def fired(row, boxes):
    """List of (rule, detail) for a clean row."""
    out = []
    spec, proc, equip, cap = (
        clean_list(row[c]) for c in ("specialties", "procedure", "equipment", "capability")
    )
    text = row["description"] or ""
    kind = (row["facility_type"] or "").lower()
    no_staff = not row["number_doctors"] and not row["capacity"]
    if hits(" ".join(spec + cap + proc), rv.ADVANCED_KEYWORDS) and (not equip or no_staff):
        out.append(("R1", None))
    if kind in rv.NON_HOSPITAL_TYPES and any(re.search(p, text, re.I) for p in rv.EMERGENCY_PATTERNS):
        out.append(("R2", kind))
    lat, lon = row["latitude"], row["longitude"]
    if lat is not None and lon is not None:
        if not (rv.COUNTRY_MIN_LAT <= lat <= rv.COUNTRY_MAX_LAT and rv.COUNTRY_MIN_LON <= lon <= rv.COUNTRY_MAX_LON):
            out.append(("R3", "country"))
        elif row["state"] in boxes:
            a, b, c, d = boxes[row["state"]]
            if not (a <= lat <= b and c <= lon <= d):
                out.append(("R3", row["state"]))
    if kind == "hospital" and no_staff and not equip:
        out.append(("R4", None))
    if "farmacy" in (kind, (row["facility_type_raw"] or "").lower()):
        out.append(("R5", None))
    awards = [m.group(0) for p in rv.AWARD_PATTERNS for m in [re.search(p, text, re.I)] if m]
    if awards:
        out.append(("R6", awards[0]))
    for sp in spec:
        if not re.search(rv.PEDIATRIC_DENTAL_PATTERN, sp):
            hints = first_unmet(sp, " ".join(equip))
            if hints:
                out.append(("R7", (sp, ", ".join(hints[:3]))))
    stale = (row["recency_months"] or 0) > rv.STALE_MONTHS
    if stale or not any(row[c] for c in rv.LINK_COLUMNS):
        out.append(("R8", None))
    return out


def score(found):
    return max(0, 100 - sum(rv.SEVERITY_POINTS[rv.RULES[rule][0]] for rule, _ in found))
