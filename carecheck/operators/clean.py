"""Raw listing to clean facility rows, the claims table and the search text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck import schemas
from carecheck.functions import text as tx
from carecheck.functions.rules import LISTS

NUMERIC = ["latitude", "longitude", "capacity", "numberDoctors", "yearEstablished"]


def is_pin_column(name: str) -> bool:
    return any(part in name.lower() for part in ("pin", "postal", "zip"))


def bronze(raw: DataFrame) -> DataFrame:
    """Repair postal codes and coerce the numeric columns; every other column stays text."""
    def repaired(c: str) -> str:
        if is_pin_column(c):
            return f"{tx.pad_pin(f'`{c}`')} AS `{c}`"
        return f"{tx.number(c)} AS {c}" if c in NUMERIC else f"`{c}`"

    return raw.selectExpr(*[repaired(c) for c in raw.columns])


def resolve_state(df: DataFrame, boxes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``state``: exact spelling, else alias, else city; null where none applies.

    ``boxes`` holds a state once, ``aliases`` a spelling once per kind.
    """
    exact = boxes.select(F.col("state").alias("_exact"))

    def spelled(kind: str) -> DataFrame:
        return aliases.where(F.col("kind") == kind).select(
            F.col("alias").alias(f"_{kind}_key"), F.col("state").alias(f"_{kind}")
        )

    key = F.lower(F.coalesce("state_raw", F.lit("")))
    return (
        df.join(exact, F.col("state_raw") == F.col("_exact"), "left")
        .join(spelled("alias"), key == F.col("_alias_key"), "left")
        .join(spelled("city"), key == F.col("_city_key"), "left")
        .withColumn("state", F.coalesce("_exact", "_alias", "_city"))
        .drop("_exact", "_alias_key", "_alias", "_city_key", "_city")
    )


def recency_months(as_of: str, ts: Column) -> Column:
    return F.months_between(F.lit(as_of).cast("timestamp"), ts).cast("int")


def clean(raw: DataFrame, boxes: DataFrame, aliases: DataFrame, as_of: str) -> DataFrame:
    """The clean facility table. ``as_of`` fixes the day that page age is measured from."""
    typed = bronze(raw).selectExpr(
        "cast(facility_id AS string) AS facility_id",
        "name",
        "lower(facilityTypeId) AS facility_type_raw",
        "CASE WHEN lower(facilityTypeId) = 'farmacy' THEN 'pharmacy' ELSE lower(facilityTypeId) END AS facility_type",
        "address_stateOrRegion AS state_raw",
        "address_city AS city",
        "address_postalCode AS pin",
        "latitude",
        "longitude",
        "description",
        "try_cast(capacity AS int) AS capacity",
        "try_cast(numberDoctors AS int) AS number_doctors",
        "try_cast(yearEstablished AS int) AS year_established",
        *schemas.LINKS,
        "try_cast(recency_of_page_update AS timestamp) AS recency_ts",
        *[f"{tx.json_list(c)} AS {c}" for c in LISTS],
    )
    resolved = resolve_state(typed, boxes, aliases)
    aged = resolved.withColumn("recency_months", recency_months(as_of, F.col("recency_ts")))
    return aged.select(*schemas.CLEAN.fieldNames())


def claims_long(df: DataFrame) -> DataFrame:
    """(facility_id, claim_type, claim_value), one row per non-blank list element; one scan."""
    kinds = {
        "specialty": "specialties", "procedure": "procedure",
        "equipment": "equipment", "capability": "capability",
    }
    lists = ", ".join(f"named_struct('kind', '{kind}', 'items', {c})" for kind, c in kinds.items())
    return (
        df.selectExpr("facility_id", f"explode(array({lists})) AS list")
        .selectExpr("facility_id", "list.kind AS claim_type", "explode(list.items) AS item")
        .selectExpr("facility_id", "claim_type", "lower(trim(item)) AS claim_value")
        .where("length(claim_value) > 0")
    )


def claim_evidence(claims: DataFrame, clean_df: DataFrame) -> DataFrame:
    """Claims beside the facility they belong to."""
    facts = clean_df.select(
        "facility_id", "facility_type", "state", "city",
        (F.size("equipment") > 0).alias("has_equipment"),
        (F.coalesce("capacity", F.lit(0)) != 0).alias("has_capacity"),
        (F.coalesce("number_doctors", F.lit(0)) != 0).alias("has_doctors"),
    )
    return claims.join(facts, "facility_id")


def search_text(df: DataFrame) -> DataFrame:
    """One searchable text per facility with its display columns."""
    return df.select(
        "facility_id", F.expr(tx.facility_text()).alias("facility_text"),
        "name", "facility_type", "state", "city", "description",
    )
