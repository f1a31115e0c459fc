"""The batch pipeline: raw rows to clean, flagged and gold tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from carecheck.operators import clean as cl
from carecheck.operators import trust
from carecheck.sources import lookups
from carecheck.session import spread
from carecheck.sources.tables import with_comments, write_table

AS_OF = "2026-01-01"

COMMENTS = {
    "facility_id": "Unique facility id, e.g. F000123.",
    "facility_type_raw": "Type as listed, lower case, before typo repair.",
    "facility_type": "Type with the farmacy typo mapped to pharmacy.",
    "state_raw": "State as listed.",
    "state": "Canonical state, or null where the listed one is unknown.",
    "city": "Listed city; stands in for the district, which the listing lacks.",
    "pin": "Postal code as text; leading zeros kept.",
    "latitude": "WGS-84 degrees.",
    "longitude": "WGS-84 degrees.",
    "recency_months": "Whole months since the page was updated.",
    "trust_score": "100 minus 35 per HIGH, 15 per MED and 5 per LOW flag; never below 0.",
    "flags": "Contradictions found on the row.",
    "cell_coarse": "Grid cell of 0.04 degrees, for density maps.",
    "cell_fine": "Grid cell of 0.005 degrees, for street-level maps.",
    "st_geom_wkt": "Point as well-known text.",
}


@dataclass
class Pipeline:
    """The tables of one run, each lazy until read."""

    clean: DataFrame
    boxes: DataFrame

    @cached_property
    def flagged(self) -> DataFrame:
        return trust.flagged(self.clean, self.boxes)

    @property
    def claims(self) -> DataFrame:
        return cl.claims_long(self.clean)

    @property
    def text(self) -> DataFrame:
        return cl.search_text(self.clean)

    @property
    def trust(self) -> DataFrame:
        return trust.trust_table(self.flagged)

    @property
    def contradictions(self) -> DataFrame:
        return trust.contradictions(self.flagged)

    @cached_property
    def gold(self) -> DataFrame:
        return trust.gold(self.flagged)


def build(spark: SparkSession, raw: DataFrame, as_of: str = AS_OF) -> Pipeline:
    boxes, aliases = lookups.state_boxes(spark), lookups.state_aliases(spark)
    return Pipeline(clean=cl.clean(raw, boxes, aliases, as_of), boxes=boxes)


def store(run: Pipeline, folder: str) -> Pipeline:
    """Write the tables and return a run that reads them back.

    The flags are computed once, into the flagged table; the others derive from it. Rows are dealt by their id over
    files of bounded size before anything is computed on their texts, whatever the files of the source.
    """
    spark = run.clean.sparkSession
    dealt = Pipeline(clean=spread(run.clean, "facility_id"), boxes=run.boxes)
    write_table(dealt.flagged, f"{folder}/flagged")
    flagged = spark.read.parquet(f"{folder}/flagged")
    stored = Pipeline(clean=flagged.select(*run.clean.columns), boxes=run.boxes)
    stored.flagged = flagged
    for name in ("claims", "text", "trust", "contradictions", "gold"):
        write_table(with_comments(getattr(stored, name), COMMENTS), f"{folder}/{name}")
    return stored
