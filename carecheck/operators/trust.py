"""Contradiction flags, trust scores and the gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.functions import geo, rules
from carecheck.functions.text import FLAG_TYPE

GOLD_COLUMNS = [
    "facility_id", "name", "facility_type_raw", "facility_type", "state_raw", "state", "city",
    "pin", "latitude", "longitude", "description", "capacity", "number_doctors",
    "year_established", "specialties", "procedure", "equipment", "capability",
]
FLAG_FIELDS = ["rule_id", "severity", "message", "evidence", "citation_column"]


def flagged(clean: DataFrame, boxes: DataFrame) -> DataFrame:
    """Clean rows plus ``flags`` and ``trust_score``; also runs on a stream of clean rows."""
    with_box = clean.join(boxes, "state", "left")
    kept = [f"`{c}`" for c in clean.columns]
    return (
        rules.with_rule_inputs(with_box)
        .selectExpr(*kept, f"{rules.all_flags()} AS flags")
        .selectExpr("*", f"{rules.trust_score('flags')} AS trust_score")
    )


def single_rule(clean: DataFrame, boxes: DataFrame, rule: str) -> DataFrame:
    """Flags of one rule only, long form."""
    inputs = rules.with_rule_inputs(clean.join(boxes, "state", "left"))
    flags = f"explode_outer({rules.rule_array(rule)}) AS flag"
    return inputs.selectExpr("facility_id", flags).select("facility_id", "flag.*").where(
        F.col("rule_id").isNotNull()
    )


def trust_table(flagged_df: DataFrame) -> DataFrame:
    return flagged_df.select("facility_id", "trust_score", "flags")


def contradictions(flagged_df: DataFrame) -> DataFrame:
    """Long form: one row per facility and flag.

    The outer form keeps Catalyst from adding a ``size(flags) > 0`` filter below the
    explode, which would evaluate every rule twice.
    """
    return (
        flagged_df.select("facility_id", F.explode_outer("flags").alias("flag"))
        .select("facility_id", "flag.*")
        .where(F.col("rule_id").isNotNull())
    )


def collect_flags(long: DataFrame) -> DataFrame:
    """Long flags back to one sorted array per facility (a facility has few flags)."""
    return long.groupBy("facility_id").agg(
        F.array_sort(F.collect_list(F.struct(*FLAG_FIELDS))).alias("flags")
    )


def _with_places(df: DataFrame) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.select(
        *GOLD_COLUMNS,
        F.coalesce("trust_score", F.lit(100)).alias("trust_score"),
        F.coalesce("flags", F.array().cast(f"array<{FLAG_TYPE}>")).alias("flags"),
        geo.cell_id(lat, lon, geo.CELL_COARSE).alias("cell_coarse"),
        geo.cell_id(lat, lon, geo.CELL_FINE).alias("cell_fine"),
        geo.wkt_point(lat, lon).alias("st_geom_wkt"),
    )


def gold(flagged_df: DataFrame) -> DataFrame:
    """Gold straight from flagged rows: the flags are on the row, so nothing is joined."""
    return _with_places(flagged_df)


def gold_from_tables(clean: DataFrame, trust: DataFrame, long: DataFrame) -> DataFrame:
    """Gold from stored tables: clean ⟕ trust ⟕ flags, both on ``facility_id``."""
    scores = trust.select("facility_id", "trust_score")
    joined = clean.join(scores, "facility_id", "left").join(
        collect_flags(long), "facility_id", "left"
    )
    return _with_places(joined)
