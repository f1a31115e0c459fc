"""Reading raw rows, writing tables, and row-level result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carecheck import schemas

ID_COLUMNS = {"facilityid", "id", "facility"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with every column as text; ``multi_line`` for quoted fields that span lines, at one task per file."""
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"'
    )


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GOLDEN).json(path)


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def with_facility_id(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Ensure a trimmed ``facility_id``: keep it, take an id-like column, or number the rows.

    Numbering needs ``order_by``, a numeric column that fixes the row order.
    """
    if "facility_id" in df.columns:
        source = "facility_id"
    else:
        source = next((c for c in df.columns if c.lower() in ID_COLUMNS), None)
    if source:
        return df.withColumn("facility_id", F.trim(F.col(source).cast("string")))
    if order_by is None:
        raise ValueError("no id column; name a column to number the rows by")
    numbered = number_rows(df, order_by)
    return numbered.withColumn(
        "facility_id", F.concat(F.lit("F"), _zero_fill(F.col("_row"), 6))
    ).drop("_row")


def _zero_fill(n: Column, width: int) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def number_rows(df: DataFrame, order_by: str, slices: int = 200) -> DataFrame:
    """Add ``_row`` = 0, 1, 2, … in the order of a numeric column, without one global sort.

    Quantiles of the column (a driver read of ``slices`` numbers) cut the rows into
    slices; rows are numbered inside each slice and shifted by the rows of the slices before.
    """
    at = [i / slices for i in range(1, slices)]
    cuts = sorted({c for c in df.approxQuantile(order_by, at, 0.001)})
    key = F.col(order_by).cast("double")
    slice_of = F.size(F.filter(F.lit(cuts), lambda c: c <= key)) if cuts else F.lit(0)
    sliced = df.withColumn("_slice", F.coalesce(slice_of, F.lit(-1)))
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(order_by))
    # at most ``slices`` + 1 rows, by construction
    return (
        sliced.withColumn("_in", inside)
        .join(F.broadcast(shifts), "_slice")
        .withColumn("_row", F.col("_in") + F.col("_shift") - 1)
        .drop("_slice", "_in", "_shift")
    )


def write_table(df: DataFrame, target: str, fmt: str = "parquet") -> None:
    """Replace a table or folder, schema included."""
    writer = df.write.mode("overwrite").format(fmt).option("overwriteSchema", "true")
    if "/" in target:
        writer.save(target)
    else:
        writer.saveAsTable(target)


def create_table_as(df: DataFrame, target: str, comment: str | None = None) -> DataFrame:
    """Create or replace a table from a query and return the stored table."""
    write_table(df, target)
    if comment is not None:
        text = comment.replace("\\", "\\\\").replace("'", "\\'")
        df.sparkSession.sql(f"COMMENT ON TABLE {target} IS '{text}'")
    return df.sparkSession.table(target)


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Attach column comments; they travel with the schema into written tables."""
    for name, text in comments.items():
        if name in df.columns:
            df = df.withMetadata(name, {**df.schema[name].metadata, "comment": text})
    return df


def column_comments(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["comment"] for f in df.schema if "comment" in f.metadata}


def point_read(df: DataFrame, facility_id: str) -> DataFrame:
    return df.where(F.col("facility_id") == F.lit(facility_id)).limit(1)


def batch_read(df: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per requested id that exists; ``ids`` has the column ``facility_id``."""
    return df.join(ids.select("facility_id").distinct(), "facility_id", "left_semi")


def sample_documents(df: DataFrame, n: int = 200) -> DataFrame:
    """Source documents for question writing: (doc_uri, content), lowest ids first."""
    return (
        df.select(F.col("facility_id").alias("doc_uri"), F.col("facility_text").alias("content"))
        .orderBy("doc_uri")
        .limit(n)
    )


def rows_as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text; the rows stay distributed."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(column))
