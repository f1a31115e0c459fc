"""The pipeline's stages, and the registered queries of the subpackage."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from carecheck.llm import near_dedup, queries
from check import rows_of

TABLES = ["documents", "embeddings", "benchmark"]


def test_every_operator_is_registered():
    found = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{k}" for k in range(1, 14)} <= found and "pipeline" in found


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df, result = entry.queries()[name](spark, small), duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
        docs = docs.cache()
        counts.append(docs.count())
        if name == "near_dedup":
            again = near_dedup.with_classes(docs).filter("class_id != doc_id")
            assert again.isEmpty()
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_odd_rows_pass_all_stages(spark, docs, small):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    docs.collect()


def test_an_empty_table_passes_all_stages(spark, docs, small):
    docs = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
