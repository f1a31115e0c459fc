"""Comparing evaluation runs and shaping question sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUESTION_COLUMNS = ["question", "inputs", "input", "request"]


def metric_delta(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Baseline against candidate per metric (metric, value); a metric may be on one side only."""
    before = baseline.select("metric", F.col("value").alias("baseline"))
    after = candidate.select("metric", F.col("value").alias("candidate"))
    gain = F.coalesce("candidate", F.lit(0.0)) - F.coalesce("baseline", F.lit(0.0))
    return (
        before.join(after, "metric", "full_outer")
        .select("metric", "baseline", "candidate", F.round(gain, 6).alias("delta"))
        .orderBy("metric")
    )


def concat_frames(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def normalise_golden(df: DataFrame, order_by: list[str] | None = None, n: int | None = None) -> DataFrame:
    """All rows, or the first n that have a question in the given order, as (question, expected_facts).

    The question is taken from the first of the known columns that exists; a struct
    column holds it in its field ``question``.
    """
    source = next((c for c in QUESTION_COLUMNS if c in df.columns), None)
    if source is None:
        raise ValueError(f"no question-like column in {df.columns}")
    is_struct = df.schema[source].dataType.typeName() == "struct"
    question = F.col(source)["question"] if is_struct else F.col(source)
    facts = F.array().cast("array<string>")
    if "expected_facts" in df.columns:
        given = F.col("expected_facts")
        if df.schema["expected_facts"].dataType.typeName() != "array":
            given = F.when(given.isNotNull(), F.array(given.cast("string")))
        facts = F.coalesce(given, facts)
    asked = df.where(question.isNotNull())
    if n is not None:
        asked = asked.orderBy(*(order_by or [])).limit(n)
    return asked.select(question.alias("question"), facts.alias("expected_facts"))
