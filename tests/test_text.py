import pytest
from pyspark.sql import functions as F

from carecheck.functions import stats
from carecheck.functions import text as tx


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(F.expr(expression) if isinstance(expression, str) else expression).first()[0]


@pytest.mark.parametrize("given,want", [
    ('["a","b c"]', ["a", "b c"]), ("[]", []), ("", []), (None, []), ("  ", []),
    ("Cardiology | nephrology", ["Cardiology", "nephrology"]), ("x-ray, ultrasound", ["x-ray", "ultrasound"]),
    ('["ecg", "ct ', ["ecg", "ct"]), ('["a", 1]', ["a", "1"]), ("a,,b", ["a", "b"]),
])
def test_json_list(spark, given, want):
    assert one(spark, given, tx.json_list("c")) == want


@pytest.mark.parametrize("given,want", [
    (None, []), (" ", []), ('["a", null]', ["a"]), ("['x', 'y z']", ["x", "y z"]), ("[a | b]", ["a", "b"]),
    ("[]", []), ("[ ]", []), ("plain text", ["plain text"]), ("[", ["["]), ('{"k": "v"}', ["k", "v"]),
])
def test_lenient_list(spark, given, want):
    assert one(spark, given, tx.lenient_list("c")) == want


def test_rule_list(spark):
    assert one(spark, [" ECG\t", None, "", "staff \x0c", " "], tx.rule_list("c"), "array<string>") == ["ecg", "staff", ""]
    assert one(spark, None, tx.rule_list("c"), "array<string>") == []


def test_flags_from_json(spark):
    flags = one(spark, '[{"rule_id":"R1"}, 3, {"severity":"LOW"}]', tx.flags_from_json(F.col("c")))
    assert [(f.rule_id, f.severity, f.message) for f in flags] == [("R1", "", ""), ("", "LOW", "")]
    for broken in (None, "", "[x", '{"rule_id":"R1"}'):
        assert one(spark, broken, tx.flags_from_json(F.col("c"))) == []


def test_null_array_contains_nothing(spark):
    assert one(spark, None, tx.any_element_contains("c", ["x"]), "array<string>") is False
    assert one(spark, ["aXb"], tx.any_element_contains("c", ["x"]), "array<string>") is True


def test_quotes_and_backslashes_survive(spark):
    for text in ["it's", "back\\slash", "\\d+", 'say "x"']:
        assert spark.sql(f"SELECT {tx.quoted(text)}").first()[0] == text


def test_sentences_and_citations(spark):
    text = "Short one. This sentence is long enough to count! See [F000123] and [F000123] or [ab]. Is this one kept too? "
    assert one(spark, text, tx.sentence_claims(F.col("c"))) == [
        "This sentence is long enough to count!", "See [F000123] and [F000123] or [ab].",
        "Is this one kept too?"]
    assert one(spark, text, tx.cited_ids(F.col("c"))) == ["F000123"]
    assert one(spark, "y" * 400 + ".", tx.sentence_claims(F.col("c"))) == []
    assert one(spark, None, tx.cited_ids(F.col("c"))) == []


@pytest.mark.parametrize("text,good", [
    ("x\nConfidence: high", True), ("Confidence: low\n\n", True), ("Confidence: High", False),
    ("Confidence: high.", False), ("Confidence: high\nmore", False), (None, False),
])
def test_confidence_line(spark, text, good):
    assert one(spark, text, tx.ends_with_confidence(F.col("c"))) is good


def test_needles(spark):
    assert one(spark, " The  Cardiac\tsurgery unit ", tx.needles("c")) == ["cardiac", "surgery", "unit"]


def test_presets_and_keywords(spark):
    row = one(spark, "Cardiac angioplasty within 50 km of Jaipur", tx.preset("c"))
    assert row.specialty == "interventionalCardiology" and row.lat == 26.9124
    assert one(spark, "else", tx.preset("c")).specialty == "generalMedicine"
    assert one(spark, "General Surgery!", tx.specialty_keywords("c"))[0] == "generalsurgery"
    assert one(spark, "Podiatry", tx.specialty_keywords("c")) == ["podiatry"]


def test_wilson(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    df = spark.createDataFrame([(0, 0), (0, 10), (5, 10), (10, 10)], "k int, n int")
    got = [(round(r[0], 4), round(r[1], 4)) for r in df.select(low, high).collect()]
    assert got == [(0.0, 0.0), (0.0, 0.2775), (0.2366, 0.7634), (0.7225, 1.0)]


def test_tiers(spark):
    df = spark.createDataFrame([(70,), (45,), (44,), (None,), (120,), (-5,)], "s int")
    rows = df.select(stats.trust01(F.col("s")).alias("t")).select("t", stats.trust_tier(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [
        (0.7, "High"), (0.45, "Moderate"), (0.44, "Low"), (0.0, "Low"), (1.0, "High"), (0.0, "Low")]
