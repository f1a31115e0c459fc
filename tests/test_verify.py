import json

import pytest
from pyspark.sql import functions as F

from carecheck import rule_values as rv
from carecheck import schemas
from carecheck.functions import text as tx
from carecheck.operators import evaluation, extract, trust, verify
from carecheck.sources import lookups


@pytest.fixture(scope="module")
def gold(spark):
    rows = []
    for fid, given in {
        "F000001": dict(facility_type="hospital", specialties=["cardiology"], capability=["cardiac surgery"], equipment=["ecg", "cath lab"], procedure=["bypass surgery"], capacity=40, number_doctors=3, facebookLink="x"),
        "F000002": dict(facility_type="clinic", specialties=["dentistry"], description="Open 24x7 for emergency care"),
        "F000003": dict(facility_type="dentist", specialties=["dentistry"], equipment=["dental chair"], facebookLink="x"),
    }.items():
        row = {f: None for f in schemas.CLEAN.fieldNames()}
        row.update(facility_id=fid, specialties=[], procedure=[], equipment=[], capability=[])
        row.update(given)
        rows.append(tuple(row.values()))
    return trust.gold(trust.flagged(spark.createDataFrame(rows, schemas.CLEAN), lookups.state_boxes(spark))).cache()


def test_cross_source(spark, gold):
    asked = [(1, "F000001", "performs cardiac surgery"), (2, "F000002", "cardiac surgery"), (3, "none", "cardiac"), (4, "F000001", "a b c"), (5, "F000002", "EMERGENCY dentistry")]
    requests = spark.createDataFrame(asked, "request_id long, facility_id string, claim string")
    out = {r.request_id: json.loads(r.json) for r in verify.cross_source_json(verify.cross_source(requests, gold)).collect()}
    assert out[1]["agree"] and out[1]["sources_supporting"] == ["capability", "procedure", "capacity_or_doctors"] and out[1]["sources_total"] == 6
    assert not out[2]["agree"] and out[2]["sources_supporting"] == []
    assert out[3] == {"facility_id": "none", "claim": "cardiac", "agree": False, "reason": "facility not found", "sources_supporting": [], "sources_total": 0}
    assert not out[4]["agree"] and out[4]["sources_supporting"] == ["capacity_or_doctors"]
    assert out[5]["agree"] and out[5]["sources_supporting"] == ["specialties", "description"]


def test_needles_and_texts_are_made_once_per_row(spark):
    """As a plain evaluation says, nulls included; a source's text is not lowered anew for every needle."""
    made = tx.supporting_sources("claim")
    assert made.count("split(") == 1 and "ndl, n -> contains(txt, n)" in made
    lists = [None, [], [None], ["Cardiac Surgery", None], ["ecg"]]
    rows = [(claim, *[lists[(i * j + i) % 5] for j in range(1, 5)], text, capacity, None if i % 2 else 0)
            for i, (claim, text, capacity) in enumerate(
                (c, t, n) for c in (None, "", "a b", "CARDIAC  x surgery", "the ecg desk\tcare") for t in (None, "", "Desk of CARE") for n in (None, 0, 3))]
    df = spark.createDataFrame(rows, "claim string, specialties array<string>, capability array<string>, equipment array<string>,"
                                     " procedure array<string>, description string, capacity int, number_doctors int")
    for r in df.selectExpr("*", f"{made} AS got").collect():
        words = [w for w in (r.claim or "").lower().split() if len(w) > 3]
        texts = {c: " ".join(x for x in r[c] if x is not None).lower() for c in rv.CLAIM_SOURCES[:4] if r[c] is not None}
        texts["description"] = (r.description or "").lower()
        texts["capacity_or_doctors"] = ""
        want = [s for s in rv.CLAIM_SOURCES if any(w in texts.get(s, "") for w in words) or (s == "capacity_or_doctors" and (r.capacity or r.number_doctors))]
        assert r.got == want, r


def test_trust_report(spark, gold):
    requests = spark.createDataFrame([(1, "F000002"), (2, "gone"), (3, "F000002")], "request_id long, facility_id string")
    out = {r.request_id: json.loads(r.json) for r in verify.trust_report(requests, gold).collect()}
    assert out[2] == {"facility_id": "gone", "error": "not found"} and out[1] == out[3]
    assert out[1]["trust_score"] == 100 - 35 - 5 and [f["rule_id"] for f in out[1]["flags"]] == ["R2", "R8"]


def test_verify_answers(spark, gold):
    good = "The facility [F000001] offers cardiac surgery with bypass."
    rows = [
        (1, good, 0, []), (2, "The facility [F000002] offers cardiac surgery. It is a large heart centre now!", 0, []),
        (3, "No facility could be named for this question at all.", 0, []), (4, good, 8, []),
        (5, "Both [F000001] and [F000009] offer cardiac bypass surgery here.", 0, ["F000001"]),
        (6, "Both [F000001] and [F000009] offer cardiac bypass surgery here.", 0, []), (7, None, 0, []),
    ]
    answers = spark.createDataFrame(rows, "answer_id long, text string, iter int, allowed_facility_ids array<string>")
    out = {r.answer_id: r for r in verify.verify_answers(answers, gold).collect()}
    assert (out[1].decision, out[1].confidence) == ("accept", "high")
    assert out[2].decision == "refine" and out[2].n_disagreements == 2 and out[2].n_high_flags == 1
    assert out[2].reason.startswith("2 cross-source disagreements: F000002: The facility [F000002]")
    assert out[2].reason.endswith("1 HIGH contradiction flags: F000002/R2") and out[2].confidence is None
    assert (out[3].decision, out[3].confidence) == ("accept", "medium")
    assert (out[4].decision, out[4].confidence, out[4].iter) == ("capped", "low", 9)
    assert out[5].decision == "accept"
    assert out[6].decision == "refine" and out[6].n_disagreements == 1
    assert out[7].decision == "accept" and out[7].message == ""


def test_all_ids_and_claims_are_paired_unless_limits_are_given(spark, gold):
    text = " ".join(f"[XX{i:04d}]" for i in range(9)) + " Nothing here can be backed by data. " * 6
    answers = spark.createDataFrame([(1, text, 0)], "answer_id long, text string, iter int")
    found = verify.verify_answers(answers, gold).first()
    assert found.n_disagreements == len(found.disagreements) == 54
    assert verify.verify_answers(answers, gold, ids=5, claims=3).first().n_disagreements == 15


def test_citations(gold):
    rows = verify.citations(gold).where("facility_id = 'F000002'").orderBy("pos").collect()
    assert [r.validator_status for r in rows] == ["failed", "failed"] and rows[0].source_field == "description|facilityTypeId"
    cap = verify.citations(gold).where("facility_id = 'F000001' AND source_field = 'capability'").first()
    assert (cap.claim, cap.extraction_confidence, cap.validator_status, cap.supporting_evidence) == (
        "cardiac surgery", 0.95, "passed", ["ecg", "cath lab"])


def test_extraction(spark):
    df = spark.createDataFrame(
        [(1, "24x7 emergency, ICU, MRI, Dr. Sharma cardiology, W.HO award 2019"), (2, "  "), (3, None), (4, "x" * 5000 + " ISO 9001:2015")],
        "id int, text string")
    out = {r.id: json.loads(r.fields) for r in extract.extract_json(df, "text").collect()}
    assert out[1]["specialties"] == ["cardiology"] and out[1]["awards"] == ["w.ho award 2019"] and out[1]["languages"] is None
    assert out[1]["operating_hours"] == ["24x7"] and out[2] == out[3] == {}
    assert out[4]["certifications"] == ["iso 9001:2015"]


def test_metric_delta_and_concat(spark):
    a = spark.createDataFrame([("m1", 0.5), ("m2", None)], "metric string, value double")
    b = spark.createDataFrame([("m1", 0.75), ("m3", 1.0)], "metric string, value double")
    got = [(r.metric, r.delta) for r in evaluation.metric_delta(a, b).collect()]
    assert got == [("m1", 0.25), ("m2", 0.0), ("m3", 1.0)]
    joined = evaluation.concat_frames(a, a.select("metric", F.lit(1).alias("extra")))
    assert joined.columns == ["metric", "value", "extra"] and joined.count() == 4
