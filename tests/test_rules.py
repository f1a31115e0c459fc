import pytest
from pyspark.sql import functions as F

from carecheck import lookup_values as lv
from carecheck import schemas
from carecheck.operators import trust
from carecheck.plans import pipeline
from carecheck.sources import lookups
from carecheck.sources.facilities import customer_facilities
from tests.plain_rules import fired, score

IN_BIHAR = dict(latitude=25.5, longitude=85.0, state="Bihar")
STAFFED = dict(capacity=10, number_doctors=1)
LINKED = dict(facebookLink="https://fb.example/x")

CASES = [
    ("advanced claim without evidence", dict(facility_type="hospital", specialties=["cardiology"], capability=["advanced surgery"]), {"R1"}, set()),
    ("advanced claim with equipment and staff", dict(facility_type="hospital", specialties=["cardiology"], capability=["cardiac surgery"], equipment=["ECG", "Echo", "Cath Lab"], number_doctors=12, capacity=80), set(), {"R1"}),
    ("equipment but nobody and no beds", dict(specialties=["cardiology"], equipment=["ECG"], number_doctors=0, capacity=0), {"R1"}, set()),
    ("keyword across two elements", dict(specialties=[], capability=["open"], procedure=["heart surgery"]), {"R1"}, set()),
    ("clinic around the clock", dict(facility_type="clinic", description="We provide 24x7 emergency care"), {"R2"}, set()),
    ("hospital around the clock", dict(facility_type="hospital", description="We provide 24x7 emergency care", equipment=["ECG"], **STAFFED), set(), {"R2"}),
    ("outside the country", dict(facility_type="hospital", latitude=51.5, longitude=-0.1, **STAFFED), {"R3"}, set()),
    ("outside the claimed state", dict(facility_type="hospital", state="Kerala", **STAFFED), {"R3"}, set()),
    ("on the edge of the state", dict(latitude=24.3, longitude=88.2), set(), {"R3"}),
    ("on the edge of the country", dict(latitude=35.5, longitude=97.5, state=None), set(), {"R3"}),
    ("unknown state", dict(state="Atlantis", latitude=10.0), set(), {"R3"}),
    ("no coordinates", dict(latitude=None), set(), {"R3"}),
    ("ghost hospital", dict(facility_type="hospital"), {"R4"}, set()),
    ("zero counts as nothing", dict(facility_type="hospital", capacity=0, number_doctors=0), {"R4"}, set()),
    ("typo", dict(facility_type="farmacy"), {"R5"}, set()),
    ("repaired typo", dict(facility_type="pharmacy", facility_type_raw="farmacy"), {"R5"}, set()),
    ("award", dict(description="Recipient of W.HO award 2019 and ISO 9001:2027 certification", equipment=["x-ray"], **STAFFED), {"R6"}, set()),
    ("genuine certificate year", dict(description="ISO 9001:2015 certified"), set(), {"R6"}),
    ("specialty without its equipment", dict(specialties=["cardiology"], equipment=["bandage", "thermometer"], capacity=30, number_doctors=5), {"R7"}, set()),
    ("medicaloncology", dict(specialties=["medicaloncology"], equipment=["bandage"]), {"R7"}, set()),
    ("orthopedicsurgery", dict(specialties=["orthopedicsurgery"], equipment=["bandage"]), {"R7"}, set()),
    ("neonatology", dict(specialties=["neonatologyperinatalmedicine"], equipment=["bandage"]), {"R7"}, set()),
    ("gynecology", dict(specialties=["gynecologyandobstetrics"], equipment=["bandage"]), {"R7"}, set()),
    ("pediatric dentistry", dict(facility_type="dentist", specialties=["pediatricdentistry"], equipment=["dental chair"]), set(), {"R7"}),
    ("first key met, later key not", dict(specialties=["cardiology and nephrology"], equipment=["ecg"]), {"R7"}, set()),
    ("stale page", dict(facility_type="clinic", recency_months=36), {"R8"}, set()),
    ("stale page with links", dict(recency_months=36, **LINKED), {"R8"}, set()),
    ("fresh page with links", dict(facility_type="clinic", recency_months=3, equipment=["x-ray"], websites="https://x.example", **LINKED, **STAFFED), set(), {"R8"}),
    ("blank link", dict(facebookLink=""), {"R8"}, set()),
    ("null lists", dict(specialties=None, equipment=None, capability=None, procedure=None), set(), {"R1", "R7"}),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = []
    for name, given, *_ in CASES:
        row = {f: None for f in schemas.CLEAN.fieldNames()}
        row.update(facility_id=name, specialties=[], procedure=[], equipment=[], capability=[], **IN_BIHAR)
        row.update(given)
        rows.append(tuple(row[f] for f in schemas.CLEAN.fieldNames()))
    flagged = trust.flagged(spark.createDataFrame(rows, schemas.CLEAN), lookups.state_boxes(spark))
    return {r.facility_id: r for r in flagged.select("facility_id", "flags", "trust_score").collect()}


@pytest.mark.parametrize("name,fires,silent", [(n, f, s) for n, _, f, s in CASES])
def test_rule_case(outcomes, name, fires, silent):
    found = {f.rule_id for f in outcomes[name].flags}
    assert fires <= found and not (silent & found)


def test_severities_and_score(outcomes):
    points = {"HIGH": 35, "MED": 15, "LOW": 5}
    for row in outcomes.values():
        assert row.trust_score == max(0, 100 - sum(points[f.severity] for f in row.flags))


def test_one_flag_per_specialty_element(spark):
    row = {f: None for f in schemas.CLEAN.fieldNames()}
    row.update(facility_id="X", specialties=["cardiology", "cardiology", "urology"], procedure=[], equipment=["bandage"], capability=[])
    df = spark.createDataFrame([tuple(row.values())], schemas.CLEAN)
    flags = trust.flagged(df, lookups.state_boxes(spark)).first().flags
    assert [f.rule_id for f in flags].count("R7") == 3


def test_score_never_below_zero(spark):
    flags = spark.createDataFrame(
        [([("R", "HIGH", "", "", "")] * 10,), ([("R", "HIGH", "", "", ""), ("R", "MED", "", "", ""), ("R", "LOW", "", "", "")],), ([],)],
        "flags array<struct<rule_id:string,severity:string,message:string,evidence:string,citation_column:string>>",
    )
    from carecheck.functions.rules import trust_score
    assert [r[0] for r in flags.selectExpr(trust_score("flags")).collect()] == [0, 45, 100]


def test_award_evidence_follows_list_order(spark):
    row = {f: None for f in schemas.CLEAN.fieldNames()}
    row.update(facility_id="X", description="ISO 9001:2027 and W.HO award", specialties=[], procedure=[], equipment=[], capability=[])
    df = spark.createDataFrame([tuple(row.values())], schemas.CLEAN)
    award = [f for f in trust.flagged(df, lookups.state_boxes(spark)).first().flags if f.rule_id == "R6"]
    assert award[0].evidence == "W.HO award"


def test_rules_agree_with_plain_evaluation(spark, small):
    run = pipeline.build(spark, customer_facilities(spark, small))
    boxes = {s: rest for s, *rest in lv.STATE_BOXES}
    rows = run.flagged.collect()
    assert len(rows) == spark.read.parquet(f"{small}/customer.parquet").count()
    for row in rows:
        want = fired(row.asDict(), boxes)
        assert [f.rule_id for f in row.flags] == [rule for rule, _ in want], row.facility_id
        assert row.trust_score == score(want)
        for flag, (rule, detail) in zip(row.flags, want):
            if rule == "R6":
                assert flag.evidence == detail
            if rule == "R7":
                assert flag.message == f"Lists '{detail[0]}' specialty but no expected equipment ({detail[1]}…) found."
            if rule == "R2":
                assert flag.evidence == row.description and flag.message.endswith(f"registered as a {detail}.")


def test_long_and_wide_forms_match(spark, small):
    run = pipeline.build(spark, customer_facilities(spark, small))
    long = run.contradictions.count()
    wide = run.gold.agg(F.sum(F.size("flags"))).first()[0]
    assert long == wide
    again = trust.gold_from_tables(run.clean, run.trust, run.contradictions)
    assert again.agg(F.sum(F.size("flags"))).first()[0] == wide
    assert run.trust.where("trust_score < 0 OR trust_score > 100").count() == 0


def test_rules_compute_no_python_and_no_shuffle(spark, small):
    run = pipeline.build(spark, spark.read.parquet(f"{small}/customer.parquet").selectExpr(
        *[f"cast(null as string) AS {c}" for c in schemas.RAW.fieldNames()]))
    plan = run.flagged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan
