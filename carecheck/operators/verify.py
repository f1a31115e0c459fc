"""Checking claims and answers against the facility table, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck import rule_values as rv
from carecheck.functions import text as tx
from carecheck.operators.requests import join_facts

FACTS = [
    "facility_id", "specialties", "capability", "equipment", "procedure", "description",
    "capacity", "number_doctors",
]


def trust_report(requests: DataFrame, gold: DataFrame) -> DataFrame:
    """Score and flags of each requested facility as JSON; an unknown id says so.

    ``requests`` holds (request_id, facility_id). Ids are read once however often they are asked for, and no id is one task.
    """
    known = gold.select("facility_id", "trust_score", "flags").withColumn("known", F.lit(True))
    report = F.when(
        F.col("known"), F.to_json(F.struct("facility_id", "trust_score", "flags"))
    ).otherwise(F.to_json(F.struct("facility_id", F.lit("not found").alias("error"))))
    answered = (
        requests.select("facility_id").distinct().join(known, "facility_id", "left")
        .select("facility_id", report.alias("json"))
    )
    unknown = F.to_json(F.struct("facility_id", F.lit("not found").alias("error")))  # of a request without an id
    return join_facts(requests.select("request_id", "facility_id"), answered).select(
        "request_id", "facility_id", F.coalesce("json", unknown).alias("json"))


def cross_source(requests: DataFrame, clean: DataFrame) -> DataFrame:
    """Whether at least two of six sources back each claim (request_id, facility_id, claim)."""
    facts = clean.select(*FACTS).withColumn("known", F.lit(True))
    joined = join_facts(requests.select("request_id", "facility_id", "claim"), facts)
    known = F.coalesce("known", F.lit(False))
    supporting = F.when(known, F.expr(tx.supporting_sources("claim"))).otherwise(tx.empty_list())
    return joined.select(
        "request_id", "facility_id", "claim", supporting.alias("supporting"), known.alias("known")
    ).select(
        "request_id", "facility_id", "claim",
        (F.size("supporting") >= 2).alias("agree"),
        F.col("supporting").alias("sources_supporting"),
        F.when(F.col("known"), len(rv.CLAIM_SOURCES)).otherwise(0).alias("sources_total"),
        F.when(~F.col("known"), "facility not found").alias("reason"),
    )


def cross_source_json(checked: DataFrame) -> DataFrame:
    """The check as one JSON text per request; the reason appears only for unknown ids."""
    document = F.struct(
        "facility_id", "claim", "agree", "reason", "sources_supporting", "sources_total"
    )
    return checked.select("request_id", F.to_json(document).alias("json"))


def with_citations_and_claims(answers: DataFrame, under: int | None = None) -> DataFrame:
    """Answers with the ids they cite and the claims they make; ``under`` leaves out sentences of so many characters."""
    allowed = F.col("allowed_facility_ids") if "allowed_facility_ids" in answers.columns else tx.empty_list()
    return answers.select(
        "answer_id", "text", "iter",
        tx.allowed_ids(tx.cited_ids(F.col("text")), allowed).alias("ids"),
        tx.sentence_claims(F.col("text"), under=under).alias("claims"),
    )


def verify_answers(
    answers: DataFrame, gold: DataFrame,
    ids: int | None = None, claims: int | None = None, scored: int | None = None,
) -> DataFrame:
    """Accept or send back each answer.

    All cited facilities are held against all claims, and the HIGH flags of all of them are
    listed; ``ids``, ``claims`` and ``scored`` limit that to the first ones where asked for.
    Any disagreement or flag means ``refine``; beyond the pass limit the answer goes out with
    low confidence, its counts kept. ``disagreements`` and ``high_flags`` hold every finding in
    full, ``reason`` is a short text. One row per cited facility meets the gold table; the
    claims stay in an array on that row.
    """
    def first(items: str, n: int | None) -> Column:
        return F.col(items) if n is None else F.slice(items, 1, n)

    parsed = with_citations_and_claims(answers)
    cited = parsed.select(
        "answer_id",
        first("claims", claims).alias("claims"),
        F.posexplode(first("ids", ids)).alias("id_pos", "facility_id"),
    )
    facts = gold.select(*FACTS, "flags")
    joined = cited.join(facts, "facility_id", "left")
    # without a facility no source can back a claim, so every claim is doubted
    doubted = F.expr(f"filter(claims, c -> size({tx.supporting_sources('c')}) < 2)")
    high = F.filter(F.coalesce("flags", F.expr("array()").cast(facts.schema["flags"].dataType)),
                    lambda f: f["severity"] == "HIGH")
    checked = joined.select(
        "answer_id", "id_pos",
        F.transform(
            doubted, lambda c: F.concat(F.col("facility_id"), F.lit(": "), c)
        ).alias("doubts"),
        F.when(
            F.lit(True) if scored is None else F.col("id_pos") < scored,
            F.transform(high, lambda f: F.concat(F.col("facility_id"), F.lit("/"), f["rule_id"])),
        ).otherwise(tx.empty_list()).alias("highs"),
    )
    # as many rows per answer as its text has citations
    per_answer = checked.groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct("id_pos", "doubts", "highs"))).alias("rows")
    ).select(
        "answer_id",
        F.flatten(F.transform("rows", lambda r: r["doubts"])).alias("doubts"),
        F.flatten(F.transform("rows", lambda r: r["highs"])).alias("highs"),
    )
    full = parsed.join(per_answer, "answer_id", "left").select(
        "answer_id", "text", (F.col("iter") + 1).alias("iter"), "ids",
        F.coalesce("doubts", tx.empty_list()).alias("doubts"),
        F.coalesce("highs", tx.empty_list()).alias("highs"),
    )
    return _decide(full)


def _decide(full: DataFrame) -> DataFrame:
    capped = F.col("iter") > rv.MAX_VERIFY_PASSES
    refine = ~capped & ((F.size("doubts") > 0) | (F.size("highs") > 0))

    def part(items: str, label: str) -> Column:
        shown = F.transform(F.slice(items, 1, rv.REASONS_SHOWN), lambda x: F.substring(x, 1, rv.REASON_CHARS))
        return F.when(
            F.size(items) > 0,
            F.concat(F.size(items).cast("string"), F.lit(f" {label}: "), F.array_join(shown, "; ")),
        )

    reason = F.concat_ws(
        " | ",
        part("doubts", "cross-source disagreements"),
        part("highs", "HIGH contradiction flags"),
    )
    decision = F.when(capped, "capped").when(refine, "refine").otherwise("accept")
    confidence = (
        F.when(capped, "low").when(refine, None).when(F.size("ids") > 0, "high").otherwise("medium")
    )
    message = (
        F.when(capped, F.concat(F.coalesce("text", F.lit("")), F.lit(rv.CAP_TAIL)))
        .when(refine, F.concat(F.lit(rv.REFINE_HEAD), reason, F.lit(rv.REFINE_TAIL)))
        .otherwise(F.coalesce("text", F.lit("")))
    )
    return full.select(
        "answer_id", "iter", decision.alias("decision"), confidence.alias("confidence"),
        F.size("doubts").alias("n_disagreements"), F.size("highs").alias("n_high_flags"),
        F.col("doubts").alias("disagreements"), F.col("highs").alias("high_flags"),
        F.when(refine, reason).alias("reason"), message.alias("message"),
    )


def drafts(messages: DataFrame) -> DataFrame:
    """The last assistant message of each conversation (conv_id, turn, role, content), as an answer to verify."""
    return (
        messages.where(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("answer_id"))
        .agg(F.max_by("content", "turn").alias("text"))
        .withColumn("iter", F.lit(0))
    )


def check_answers(answers: DataFrame) -> DataFrame:
    """Form checks of answers (answer_id, question, text)."""
    text = F.col("text")
    return answers.select(
        "answer_id",
        tx.cites_facility(text).alias("cites_facility"),
        tx.ends_with_confidence(text).alias("ends_with_confidence"),
        tx.reports_known_bug(F.col("question"), text).alias("reports_known_bug"),
    )


def citations(gold: DataFrame) -> DataFrame:
    """Row-level citations: all capabilities, then all flags. A capability fails if a flag's message names it in full."""
    backed = F.size("equipment") > 0

    def from_capability(c: Column) -> Column:
        failed = F.exists(
            "flags",
            lambda f: (F.coalesce(f["message"], F.lit("")) != "")
            & F.contains(F.lower(f["message"]), F.lower(c)),
        )
        return F.struct(
            c.alias("claim"),
            F.lit("capability").alias("source_field"),
            F.when(backed, 0.95).otherwise(0.65).alias("extraction_confidence"),
            F.when(failed, "failed").otherwise("passed").alias("validator_status"),
            F.col("equipment").alias("supporting_evidence"),
        )

    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    def from_flag(f: Column) -> Column:
        claim = F.coalesce(filled(f["message"]), filled(f["rule_id"]), F.lit("validator flag"))
        return F.struct(
            claim.alias("claim"),
            F.coalesce(filled(f["citation_column"]), F.lit("flag")).alias("source_field"),
            F.lit(1.0).alias("extraction_confidence"),
            F.lit("failed").alias("validator_status"),
            F.array_compact(F.array(filled(f["evidence"]))).alias("supporting_evidence"),
        )

    cited = F.concat(
        F.transform("capability", from_capability),
        F.transform("flags", from_flag),
    )
    return (
        gold.select("facility_id", F.posexplode_outer(cited).alias("pos", "citation"))
        .where("citation IS NOT NULL")
        .select("facility_id", "pos", "citation.*")
    )
