"""Column functions over text and string arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carecheck import rule_values as rv

QUOTED_TOKEN = r"""['"]([^'"]+)['"]"""
BLANKS = " \t\n\r\f\x0b"

FLAG_TYPE = (
    "struct<rule_id:string,severity:string,message:string,evidence:string,citation_column:string>"
)


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(c: str) -> str:
    """Drop blanks of any kind at both ends (plain ``trim`` drops spaces only)."""
    return f"btrim({c}, ' \\t\\n\\r\\u000c\\u000b')"


EMPTY_LIST = "cast(array() AS array<string>)"


def empty_list() -> Column:
    return F.expr(EMPTY_LIST)


def pattern_any(patterns: list[str]) -> str:
    """One case-blind pattern for a list; classes such as ``\\s`` cover all of Unicode."""
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


def pattern_lower(pattern: str) -> str:
    """A lower-case pattern for lower-case text; classes such as ``\\s`` cover all of Unicode."""
    return "(?U)" + pattern


def contains_any(text: str, needles: list[str]) -> str:
    """Whether lower-case ``text`` holds one of the literal fragments; false for null."""
    hits = " OR ".join(f"contains({text}, {quoted(n)})" for n in needles)
    return f"coalesce({hits}, false)"


def any_element_contains(arr: str, needles: list[str]) -> Column:
    """Whether an element of the array holds one of the literal fragments; false for null."""
    return F.expr(f"coalesce(exists({arr}, x -> {contains_any('lower(x)', needles)}), false)")


def any_element_contains_column(arr: str, needle: str) -> Column:
    """As ``any_element_contains`` for a fragment that comes from a column."""
    return F.expr(f"coalesce(exists({arr}, x -> contains(lower(x), {needle})), false)")


def pad_pin(c: str) -> str:
    """Repair a postal code: drop a trailing ``.0``, zero-fill to six; longer values stay whole."""
    bare = f"regexp_replace({c}, '\\\\.0$', '')"
    return f"CASE WHEN length({bare}) < 6 THEN lpad({bare}, 6, '0') ELSE {bare} END"


def number(c: str) -> str:
    """Text to double; anything that is no number becomes null."""
    return f"nullif(try_cast({c} AS double), double('NaN'))"


def _split_loose(c: str) -> str:
    return f"filter(transform(split({c}, '[,|]'), x -> {strip('x')}), x -> x <> '')"


def json_list(c: str) -> str:
    """JSON-array text to a string array; text that is no JSON array is split on ``,`` and ``|``."""
    bare = f"regexp_replace({c}, '[\\\\[\\\\]\"]', '')"
    return (
        f"coalesce(from_json({c}, 'array<string>'),"
        f" CASE WHEN length(trim({c})) > 0 THEN {_split_loose(bare)} ELSE {EMPTY_LIST} END)"
    )


def lenient_list(c: str) -> str:
    """Best-effort array: JSON array, else quoted tokens, else a bracketed list, else the text itself."""
    s = strip(c)
    parsed = f"array_compact(from_json({s}, 'array<string>'))"
    tokens = f"regexp_extract_all({s}, {quoted(QUOTED_TOKEN)}, 1)"
    inner = strip(f"substring({s}, 2, length({s}) - 2)")
    return (
        f"CASE WHEN {s} IS NULL OR {s} = '' THEN {EMPTY_LIST} WHEN {parsed} IS NOT NULL THEN {parsed}"
        f" WHEN size({tokens}) > 0 THEN {tokens}"
        f" WHEN length({s}) >= 2 AND startswith({s}, '[') AND endswith({s}, ']') THEN {_split_loose(inner)}"
        f" ELSE array({s}) END"
    )


def rule_list(arr: str) -> str:
    """Array as the rules read it: no null or empty elements, stripped, lower case."""
    kept = f"filter({arr}, x -> x IS NOT NULL AND x <> '')"
    return f"coalesce(transform({kept}, x -> lower({strip('x')})), {EMPTY_LIST})"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def flags_from_json(c: Column) -> Column:
    """JSON text to an array of flags: objects only, absent fields become empty text."""
    names = ["rule_id", "severity", "message", "evidence", "citation_column"]
    items = F.filter(
        F.from_json(stripped(c), "array<string>"), lambda x: F.startswith(x, F.lit("{"))
    )

    def flag(x: Column) -> Column:
        parsed = F.from_json(x, FLAG_TYPE)
        return F.struct(*[F.coalesce(parsed[n], F.lit("")).alias(n) for n in names])

    return F.coalesce(F.transform(items, flag), F.array().cast(f"array<{FLAG_TYPE}>"))


def facility_text() -> str:
    """The nine labelled parts of a facility joined into one searchable text."""
    plain = {"name": "name", "type": "facility_type", "state": "state", "city": "city"}
    lists = ["specialties", "procedure", "equipment", "capability"]
    parts = [f"concat('{label}: ', coalesce({c}, ''))" for label, c in plain.items()]
    parts += [f"concat('{c}: ', coalesce(array_join({c}, ', '), ''))" for c in lists]
    parts.append("concat('description: ', coalesce(description, ''))")
    return f"concat_ws(' | ', {', '.join(parts)})"


def urgency(c: Column) -> Column:
    return F.when(F.contains(F.lower(c), F.lit("emergency")), "high").otherwise("routine")


def specialty_keywords(c: str) -> Column:
    """Fragments that count as a match for a specialty; an unknown one stands for itself."""
    known = " ".join(
        f"WHEN '{name}' THEN array({', '.join(quoted(w) for w in words)})"
        for name, words in rv.RANK_KEYWORDS.items()
    )
    return F.expr(f"CASE regexp_replace(lower({c}), '[^a-z0-9]+', '') {known} ELSE array(lower({c})) END")


def preset(query: str) -> Column:
    """Quick-start question to (specialty, lat, lon); any other text gets the default."""
    def row(specialty: str, lat: float, lon: float) -> str:
        return f"named_struct('specialty', '{specialty}', 'lat', {lat}D, 'lon', {lon}D)"

    found = " ".join(f"WHEN {quoted(text)} THEN {row(*rest)}" for text, *rest in rv.QUERY_PRESETS)
    return F.expr(f"CASE {query} {found} ELSE {row(*rv.DEFAULT_PRESET)} END")


def flatten_parts(parts: Column) -> Column:
    """Message parts to one text; parts without text count as empty."""
    return F.coalesce(
        F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit("")
    )


def message_role(role: Column, kind: Column) -> Column:
    named = F.when(role != "", role)
    return F.coalesce(named, F.when(kind == "message", "assistant").otherwise("user"))


def needles(claim: str) -> str:
    """Words of a claim longer than three characters, lower case."""
    return f"filter(split({strip(f'lower({claim})')}, '\\\\s+'), w -> length(w) > 3)"


def supporting_sources(claim: str) -> str:
    """Which of the six sources of a facility row back a claim, in report order.

    The arrays of one value bind the needles and a source's text by name, so that both are made once per row and not once per
    source or needle.
    """
    def found(text: str) -> str:
        return f"coalesce(exists(array({text}), txt -> exists(ndl, n -> contains(txt, n))), false)"

    tests = {c: found(f"lower(array_join({c}, ' '))") for c in rv.CLAIM_SOURCES[:4]}
    tests["description"] = found("lower(description)")
    tests["capacity_or_doctors"] = "coalesce(capacity, 0) <> 0 OR coalesce(number_doctors, 0) <> 0"
    cases = ", ".join(f"CASE WHEN {tests[s]} THEN '{s}' END" for s in rv.CLAIM_SOURCES)
    return f"transform(array({needles(claim)}), ndl -> array_compact(array({cases})))[0]"


def terms(text: Column) -> Column:
    """Search terms: runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def sentence_claims(text: Column, over: int = 20, under: int | None = 400) -> Column:
    """Sentences of more than ``over`` and fewer than ``under`` characters (None: of any length)."""
    sentences = F.split(stripped(text), r"(?<=[.!?])\s+")
    kept = F.filter(sentences, lambda s: (F.length(s) > over) & (F.lit(True) if under is None else F.length(s) < under))
    return F.coalesce(F.transform(kept, stripped), empty_list())


def cited_ids(text: Column) -> Column:
    """Distinct ids cited in square brackets, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rv.CITATION_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def allowed_ids(ids: Column, allowed: Column) -> Column:
    """Cited ids restricted to the allowed ones; no allowed list means no restriction."""
    return F.when(
        F.coalesce(F.size(allowed), F.lit(0)) > 0, F.array_sort(F.array_intersect(ids, allowed))
    ).otherwise(ids)


def cites_facility(text: Column) -> Column:
    return F.size(cited_ids(text)) > 0


def ends_with_confidence(text: Column) -> Column:
    """Whether the last line is exactly a confidence line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", ""), "\n")
    return F.element_at(lines, -1).rlike(rv.CONFIDENCE_PATTERN)


KNOWN_BUG_TOPIC = r"(?i)(data quality|farmacy|w\.?ho award|coordinate)"
ROW_COUNT = r"(?i)([0-9][0-9,]*\s+(rows|facilities|entries|matches))"
ZERO_REPORT = r"(?i)(0 (rows|matches|facilities)|zero (rows|matches|facilities)|fired zero times)"


def reports_known_bug(question: Column, answer: Column) -> Column:
    """For questions on known data bugs: does the answer carry a count or an honest zero?

    Null where the question is about something else.
    """
    text = F.coalesce(answer, F.lit(""))
    return F.when(
        F.coalesce(question, F.lit("")).rlike(KNOWN_BUG_TOPIC),
        text.rlike(ROW_COUNT) | text.rlike(ZERO_REPORT),
    )
