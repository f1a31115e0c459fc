"""Small lookup tables, from the fixed values or from JSON files of the same shape.

The built-in ones are literal tables: Spark knows their exact size and decides on
broadcasting by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecheck import lookup_values as lv
from carecheck import rule_values as rv


def _sql_value(v: object) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, list):
        return "array(" + ", ".join(_sql_value(x) for x in v) + ")"
    return f"{v}L" if isinstance(v, int) else str(v)


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    values = ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def state_boxes(spark: SparkSession) -> DataFrame:
    columns = ["state", "min_lat", "max_lat", "min_lon", "max_lon"]
    rows = [(s, float(a), float(b), float(c), float(d)) for s, a, b, c, d in lv.STATE_BOXES]
    return literal_table(spark, columns, rows)


def state_aliases(spark: SparkSession) -> DataFrame:
    rows = [(a, s, "alias") for a, s in lv.STATE_ALIASES]
    rows += [(a, s, "city") for a, s in lv.CITY_STATES]
    return literal_table(spark, ["alias", "state", "kind"], rows)


def state_population(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["state", "population"], lv.STATE_POPULATION)


def priority_districts(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["district", "state"], lv.PRIORITY_DISTRICTS)


def specialty_hints(spark: SparkSession) -> DataFrame:
    rows = [(i, key, hints) for i, (key, hints) in enumerate(rv.SPECIALTY_HINTS)]
    return literal_table(spark, ["key_pos", "key", "hints"], rows)


def rule_dimension(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, ["rule_id", "severity"], [(r, severity) for r, (severity, _) in rv.RULES.items()]
    )


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document, unparsed."""
    return spark.read.text(path, wholetext=True)


def boxes_from_json(documents: DataFrame) -> DataFrame:
    """``{state: {min_lat, ...}}`` documents (column ``value``) to one row per state."""
    kind = "map<string,struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>>"
    return documents.select(F.explode(F.from_json("value", kind)).alias("state", "box")).select(
        "state", "box.*"
    )


def aliases_from_json(documents: DataFrame) -> DataFrame:
    """Alias documents (column ``value``) to (alias, state, kind).

    Top-level keys are aliases, except those starting with ``_``; the cities are
    under ``_city_to_state``.
    """
    aliases = documents.select(
        F.explode(F.from_json("value", "map<string,string>")).alias("alias", "state")
    ).where(~F.startswith("alias", F.lit("_")))
    cities = documents.select(
        F.explode(
            F.from_json("value", "struct<_city_to_state:map<string,string>>")["_city_to_state"]
        ).alias("alias", "state")
    )
    return (
        aliases.withColumn("kind", F.lit("alias"))
        .unionByName(cities.withColumn("kind", F.lit("city")))
        .select(F.lower("alias").alias("alias"), "state", "kind")
    )
