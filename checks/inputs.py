"""Request and answer tables for the registered queries, derived from the benchmark tables.

The SQL here runs unchanged on Spark and on DuckDB, so both sides of a check start from
the same rows. Each statement reads a whole table.
"""

from __future__ import annotations

from carecheck import rule_values as rv
from carecheck.sources.facilities import RAW_EXPRESSIONS

RAW_FACILITIES = (
    "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in RAW_EXPRESSIONS.items())
    + " FROM (SELECT c_custkey AS k, c_name AS name, text FROM customer"
    + " LEFT JOIN documents ON doc_id = c_custkey) base"
)

# A third of the requests share one place, next to the coordinates a third of the rows share.
RADIUS_REQUESTS = """
SELECT s_suppkey AS query_id,
  case when s_suppkey%3=0 then cast('25.59' as double) else cast(8 as double) + cast((s_suppkey*37)%2700 as double)/100 end AS lat,
  case when s_suppkey%3=0 then cast('85.13' as double) else cast(69 as double) + cast((s_suppkey*53)%2800 as double)/100 end AS lon,
  cast(case s_suppkey%5 when 0 then 5 when 1 then 50 when 2 then 100 when 3 then 300 else 2000 end as double) AS radius_km,
  case s_suppkey%4 when 0 then 'cardio' when 1 then '' when 2 then 'Oncolog' else 'dent' end AS specialty,
  cast(3 + s_suppkey%20 as int) AS "limit"
FROM supplier
"""

CLAIM_REQUESTS = """
SELECT conv_id*1000 + turn AS request_id,
  case when turn%5=4 then 'F999999' else concat('F', lpad(cast(conv_id*3+turn as string),6,'0')) end AS facility_id,
  case (conv_id+turn)%4 when 0 then 'advanced cardiology surgery' when 1 then '24x7 Emergency care'
    when 2 then 'x-ray and ultrasound imaging' else text end AS claim
FROM conversations
"""

ANSWERS = """
SELECT conv_id*1000 + turn AS answer_id,
  case conv_id%3 when 0 then 'How many farmacy entries are there?' else 'Where is the next clinic?' end AS question,
  concat(case when turn%6=5 then '' else concat('Facility [F', lpad(cast(conv_id*3 as string),6,'0'),
      '] offers cardiology with bypass surgery. See also [F', lpad(cast(conv_id+turn as string),6,'0'), '] and [X-unknown]. ') end,
    case when conv_id%4=0 then '12 rows are affected. ' when conv_id%4=1 then 'The rule fired zero times. ' else '' end,
    text, chr(10),
    case turn%4 when 1 then 'Confidence: high' when 3 then 'Confidence: low' else 'Confidence: unsure' end) AS text,
  cast(turn%10 as int) AS iter,
  case when conv_id%5=0 then concat('F', lpad(cast(conv_id*3 as string),6,'0')) else '' end AS allowed
FROM conversations
WHERE role = 'assistant'
"""

SEARCH_REQUESTS = "SELECT item_id AS query_id, text AS query, cast(10 as int) AS k FROM benchmark"

VECTOR_REQUESTS = """
SELECT item_id AS query_id, embedding AS vector, cast(10 as int) AS k
FROM benchmark JOIN embeddings ON vec_id = item_id
"""

# Every eighth request asks for more than the usual depth of the fused lists.
DEEP_K = "cast(case when item_id%8=0 then 60 else 10 end as int)"
DEEP_SEARCH_REQUESTS = SEARCH_REQUESTS.replace("cast(10 as int)", DEEP_K)
DEEP_VECTOR_REQUESTS = VECTOR_REQUESTS.replace("cast(10 as int)", DEEP_K)

_PRESET_CASES = " ".join(
    f"when {i} then '{text}'" for i, (text, *_) in enumerate(rv.QUERY_PRESETS)
)
QUESTIONS = (
    f"SELECT s_suppkey AS query_id, case s_suppkey%7 {_PRESET_CASES} else s_name end AS query FROM supplier"
)

METRICS = {
    "baseline": """
SELECT 'accuracy' AS metric, avg(case when (case when n_chars > 1000 then 1 else 0 end) = quality then cast(1 as double) else cast(0 as double) end) AS value
FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT 'positives', cast(count(*) as double) FROM documents WHERE n_chars > 1000
UNION ALL SELECT 'labelled', cast(count(*) as double) FROM labels
""",
    "candidate": """
SELECT 'accuracy' AS metric, avg(case when (case when n_chars > 500 then 1 else 0 end) = quality then cast(1 as double) else cast(0 as double) end) AS value
FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT 'positives', cast(count(*) as double) FROM documents WHERE n_chars > 500
UNION ALL SELECT 'toxic_share', avg(cast(toxic as double)) FROM labels
""",
}

# Messy list text for the lenient parser, one per part.
MESSY_LISTS = """
SELECT p_partkey,
  case p_partkey%8 when 0 then concat('["', p_brand, '", "', p_type, '", null]')
    when 1 then concat('[''', p_brand, ''', ''', p_type, ''']') when 2 then concat('[', p_brand, ' | ', p_type, ' ]')
    when 3 then p_name when 4 then '  ' when 5 then null when 6 then '[]' else concat('{"brand": "', p_brand, '"}') end AS messy
FROM part
"""

# Flag text as JSON, one per event, with absent fields, non-objects and broken text.
FLAG_TEXTS = """
SELECT event_id,
  case event_id%5 when 0 then concat('[{"rule_id":"R', cast(event_id%8+1 as string), '","severity":"HIGH","message":"', event_type, '"}]')
    when 1 then concat('[1, {"severity":"LOW","evidence":"', event_type, '"}]') when 2 then props
    when 3 then '[broken' else null end AS flags_text
FROM events
"""

# Message parts of a turn: every line of the text is a part; an empty role means none was given.
TRANSCRIPTS = """
SELECT conv_id, turn, case when turn%4=3 then '' else role end AS role,
  case when turn%2=1 then 'message' else 'input' end AS kind, text
FROM conversations
"""

# Raw rows without an id and with untidy headers.
UNTIDY = """
SELECT c_custkey AS row_key, c_name AS "Facility Name ", c_mktsegment AS " Market Segment", c_acctbal AS balance FROM customer
"""
