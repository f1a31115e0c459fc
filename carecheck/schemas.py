"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
LIST = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LINKS = dict(
    facebookLink=S, twitterLink=S, instagramLink=S, linkedinLink=S, websites=S, officialWebsite=S
)

RAW = _struct(
    facility_id=S, name=S, facilityTypeId=S, address_stateOrRegion=S, address_city=S,
    address_postalCode=S, latitude=S, longitude=S, description=S, capacity=S, numberDoctors=S,
    yearEstablished=S, **LINKS, recency_of_page_update=S,
    specialties=S, procedure=S, equipment=S, capability=S,
)

CLEAN = _struct(
    facility_id=S, name=S, facility_type_raw=S, facility_type=S, state_raw=S, state=S, city=S,
    pin=S, latitude=D, longitude=D, description=S, capacity=I, number_doctors=I,
    year_established=I, **LINKS, recency_ts=T.TimestampType(), recency_months=I,
    specialties=LIST, procedure=LIST, equipment=LIST, capability=LIST,
)

FLAG = _struct(rule_id=S, severity=S, message=S, evidence=S, citation_column=S)
TRUST = _struct(facility_id=S, trust_score=I, flags=T.ArrayType(FLAG))
CONTRADICTION = _struct(
    facility_id=S, rule_id=S, severity=S, message=S, evidence=S, citation_column=S
)
CLAIM = _struct(facility_id=S, claim_type=S, claim_value=S)
FACILITY_TEXT = _struct(
    facility_id=S, facility_text=S, name=S, facility_type=S, state=S, city=S, description=S
)

RADIUS_REQUEST = _struct(query_id=L, lat=D, lon=D, radius_km=D, specialty=S, limit=I)
CLAIM_REQUEST = _struct(request_id=L, facility_id=S, claim=S)
SEARCH_REQUEST = _struct(query_id=L, query=S, k=I)
ANSWER = _struct(answer_id=L, text=S, iter=I, allowed_facility_ids=LIST)
GOLDEN = _struct(question=S, expected_facts=LIST, expected_facility_ids=LIST, tags=LIST)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order and type; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
