import json

import pytest

from carecheck import lookup_values as lv
from carecheck import schemas
from carecheck.operators import clean as cl
from carecheck.operators import evaluation
from carecheck.plans import pipeline
from carecheck.sources import lookups, tables
from carecheck.sources.facilities import customer_facilities


def test_csv_stays_text(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id, Pin Code ,note\n1,001234,"two\nlines, ""quoted"""\n2,,x\n')
    df = tables.clean_headers(tables.read_raw_csv(spark, str(tmp_path / "in.csv"), multi_line=True))
    assert df.columns == ["id", "Pin_Code", "note"]
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}
    rows = tables.with_facility_id(df).orderBy("facility_id").collect()
    assert rows[0].note == 'two\nlines, "quoted"' and rows[0].facility_id == "1" and rows[1].Pin_Code is None


def test_parquet_as_text(spark, small):
    df = tables.read_raw_parquet(spark, f"{small}/customer.parquet")
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS pos", "'x' AS name").repartition(5)
    rows = {r.pos: r.facility_id for r in tables.with_facility_id(df, order_by="pos").collect()}
    assert all(rows[i] == f"F{i:06d}" for i in range(1000))
    same = spark.range(50).selectExpr("cast(3 AS bigint) AS pos")
    assert sorted(r._row for r in tables.number_rows(same, "pos").collect()) == list(range(50))
    with pytest.raises(ValueError):
        tables.with_facility_id(df)


def test_lookup_files_give_the_built_in_tables(spark, tmp_path):
    boxes = {s: dict(min_lat=a, max_lat=b, min_lon=c, max_lon=d) for s, a, b, c, d in lv.STATE_BOXES}
    aliases = {"_comment": "x", **dict(lv.STATE_ALIASES), "_city_to_state": dict(lv.CITY_STATES)}
    (tmp_path / "boxes.json").write_text(json.dumps(boxes, indent=1))
    (tmp_path / "aliases.json").write_text(json.dumps(aliases, indent=1))
    read = lookups.boxes_from_json(lookups.read_json_text(spark, str(tmp_path / "boxes.json")))
    assert sorted(read.collect()) == sorted(lookups.state_boxes(spark).collect())
    read = lookups.aliases_from_json(lookups.read_json_text(spark, str(tmp_path / "aliases.json")))
    assert sorted(read.collect()) == sorted(lookups.state_aliases(spark).collect())
    assert lookups.state_population(spark).count() == lookups.state_boxes(spark).count() == 36
    assert lookups.priority_districts(spark).distinct().count() == 118
    assert lookups.specialty_hints(spark).count() == 17


def test_golden_lines(spark, tmp_path):
    lines = [
        {"question": "a?", "expected_facts": ["x"], "expected_facility_ids": [], "tags": ["t"]},
        {"question": None, "expected_facts": None}, {"question": "b?"},
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, lines)))
    df = tables.read_golden(spark, str(tmp_path / "g.jsonl"))
    assert df.schema.names == schemas.GOLDEN.names
    shaped = evaluation.normalise_golden(df, ["question"]).orderBy("question").collect()
    assert [(r.question, r.expected_facts) for r in shaped] == [("a?", ["x"]), ("b?", [])]
    other = spark.createDataFrame([("q1", "fact"), (None, "y")], "request string, expected_facts string")
    assert [tuple(r) for r in evaluation.normalise_golden(other, ["request"]).collect()] == [("q1", ["fact"])]
    with pytest.raises(ValueError):
        evaluation.normalise_golden(spark.range(1), ["id"])


@pytest.mark.parametrize("given,want", [
    ("1001.0", "001001"), ("855107", "855107"), ("12", "000012"), ("1234567", "1234567"), (None, None), ("", "000000"),
])
def test_pin_repair(spark, given, want):
    df = spark.createDataFrame([(given,)], "address_postalCode string")
    assert cl.bronze(df).first()[0] == want


def test_typed_columns(spark, small):
    run = pipeline.build(spark, customer_facilities(spark, small))
    assert [(f.name, f.dataType) for f in run.clean.schema] == [(f.name, f.dataType) for f in schemas.CLEAN]
    conformed = schemas.conform(customer_facilities(spark, small), schemas.RAW)
    assert conformed.schema.names == schemas.RAW.names
    with pytest.raises(ValueError):
        schemas.conform(spark.range(1), schemas.RAW)


def test_numbers(spark):
    df = spark.createDataFrame([("12.0",), ("x",), ("NaN",), ("1e3",), (None,), ("99999999999",)], "capacity string")
    out = cl.bronze(df).selectExpr("capacity", "try_cast(capacity AS int) AS whole").collect()
    assert [r.capacity for r in out] == [12.0, None, None, 1000.0, None, 99999999999.0]
    assert [r.whole for r in out] == [12, None, None, 1000, None, None]


def test_store_and_comments(spark, small, tmp_path):
    run = pipeline.build(spark, customer_facilities(spark, small))
    stored = pipeline.store(run, str(tmp_path))
    gold = spark.read.parquet(str(tmp_path / "gold"))
    assert gold.count() == run.clean.count() == stored.gold.count()
    assert "trust_score" in tables.column_comments(gold)
    assert tables.point_read(gold, "F000001").count() == 1
    assert tables.point_read(gold, "nobody").count() == 0
    tables.write_table(gold.select("facility_id"), str(tmp_path / "gold2"))
    tables.write_table(gold.select("name", "state"), str(tmp_path / "gold2"))
    assert spark.read.parquet(str(tmp_path / "gold2")).columns == ["name", "state"]
