"""Structured fields from free text by dictionaries and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck import rule_values as rv
from carecheck.functions.patterns import LABEL_PATTERNS

def found(text: Column, label: str) -> Column:
    """Distinct matches of a label in lower-case text, sorted; null where there is none."""
    hits = F.array_sort(
        F.array_distinct(F.regexp_extract_all(text, F.lit(LABEL_PATTERNS[label]), F.lit(1)))
    )
    return F.when(F.size(hits) > 0, hits)


def extract_fields(df: DataFrame, text: str) -> DataFrame:
    """Add one array column per label, over the whole text."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("_lower", lowered).select(
        *df.columns, *[found(F.col("_lower"), label).alias(label) for label in rv.EXTRACT_LABELS]
    )


def extract_json(df: DataFrame, text: str, out: str = "fields") -> DataFrame:
    """The same as one JSON text per row: ``{}`` for blank text, null for a label not found."""
    blank = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    document = F.to_json(F.struct(*rv.EXTRACT_LABELS), {"ignoreNullFields": "false"})
    return extract_fields(df, text).select(
        *df.columns, F.when(blank, "{}").otherwise(document).alias(out)
    )
