"""The registered queries: each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carecheck import rule_values as rv
from carecheck import schemas
from carecheck.functions import geo, sql_functions, stats
from carecheck.functions import text as tx
from carecheck.functions.rules import LISTS
from carecheck.operators import clean as cl
from carecheck.operators import evaluation, extract, fusion, nearby, search, trust, verify
from carecheck.plans import pipeline, reports
from carecheck.session import new_folder
from carecheck.sources import lookups, tables
from carecheck.sources.facilities import customer_facilities
from carecheck.streaming import changes, sync, vector_index
from checks import inputs

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
Query = Callable[[SparkSession, str], DataFrame]


class Run:
    """Tables and pipeline of one (session, folder)."""

    def __init__(self, spark: SparkSession, folder: str, stored: pipeline.Pipeline | None = None):
        self.spark, self.folder = spark, folder
        self.stored = stored is not None
        if stored is not None:
            self.tables = stored
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.folder, name)

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    def request(self, statement: str) -> DataFrame:
        """One of the shared input statements over this folder's tables."""
        names = {t: self.table(t) for t in TABLES if t in statement}
        for name, df in names.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(statement.replace('"limit"', "`limit`"))

    @property
    def raw(self) -> DataFrame:
        return customer_facilities(self.spark, self.folder)

    @cached_property
    def tables(self) -> pipeline.Pipeline:
        return pipeline.build(self.spark, self.raw)

    @property
    def clean(self) -> DataFrame:
        return self.tables.clean

    @property
    def gold(self) -> DataFrame:
        return self.tables.gold

    @cached_property
    def stored_gold(self) -> DataFrame:
        """Gold as a written table, for queries that read it several times."""
        if self.stored:
            return self.gold
        target = f"{self.scratch()}/gold"
        tables.write_table(self.gold, target)
        return self.spark.read.parquet(target)

    @cached_property
    def stored_text(self) -> DataFrame:
        """The searchable texts as a written table, for queries that read them several times."""
        if self.stored:
            return self.tables.text
        target = f"{self.scratch()}/text"
        tables.write_table(self.tables.text, target)
        return self.spark.read.parquet(target)

    @property
    def contradictions(self) -> DataFrame:
        return self.tables.contradictions

    def scratch(self) -> str:
        """A new folder under the cluster's shared one."""
        return new_folder(self.spark)


QUERIES: dict[str, Query] = {}
BUILDERS: dict[str, Callable[[Run], DataFrame]] = {}


def query(name: str) -> Callable[[Callable[[Run], DataFrame]], Callable[[Run], DataFrame]]:
    def register(build: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
        BUILDERS[name] = build
        QUERIES[name] = lambda spark, folder: build(Run(spark, folder))
        return build

    return register


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as JSON text, for comparison with other engines."""
    for c in columns:
        df = df.withColumn(c, F.to_json(c))
    return df


# --- sources and cleaning -------------------------------------------------------------

@query("headers_and_ids")
def _(r: Run) -> DataFrame:
    untidy = r.table("customer").select(
        F.col("c_custkey").alias("row_key"), F.col("c_name").alias("Facility Name "),
        F.col("c_mktsegment").alias(" Market Segment"), F.col("c_acctbal").alias("balance"),
    )
    return tables.with_facility_id(tables.clean_headers(untidy), order_by="row_key")


@query("raw_csv")
def _(r: Run) -> DataFrame:
    """Raw text written and read back; every column is text."""
    folder = r.scratch()
    r.table("customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(folder)
    return tables.clean_headers(tables.read_raw_csv(r.spark, folder))


@query("golden_read")
def _(r: Run) -> DataFrame:
    folder = r.scratch()
    r.table("benchmark").select(
        F.col("text").alias("question"), F.array(F.col("item_id").cast("string")).alias("expected_facts")
    ).write.json(folder)
    return tables.read_golden(r.spark, folder).select("question", F.array_join("expected_facts", "|").alias("expected_facts"))


@query("boxes_json")
def _(r: Run) -> DataFrame:
    folder, key = r.scratch(), F.col("s_suppkey").cast("double")
    box = F.struct(key.alias("min_lat"), (key + 2).alias("max_lat"), (-key).alias("min_lon"), (3 - key).alias("max_lon"))
    r.table("supplier").select(F.to_json(F.create_map("s_name", box))).write.text(folder)
    return lookups.boxes_from_json(r.spark.read.text(folder))


@query("aliases_json")
def _(r: Run) -> DataFrame:
    """Alias documents, one per customer; every third one has cities."""
    folder = r.scratch()
    named = r.table("customer").join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    aliases = F.to_json(F.create_map(F.concat(F.lit("Of "), "c_name"), "n_name"))
    cities = F.to_json(F.struct(F.create_map("c_name", "n_name").alias("_city_to_state")))
    named.select(F.when(F.col("c_custkey") % 3 == 0, cities).otherwise(aliases)).write.text(folder)
    return lookups.aliases_from_json(r.spark.read.text(folder))


@query("table_comment")
def _(r: Run) -> DataFrame:
    """A table made from a query, its rows read back by name."""
    name = "carecheck_" + r.scratch().rsplit("-", 1)[1]
    made = tables.create_table_as(r.table("nation").select("n_nationkey", "n_name"), name, "Nations, as they're named")
    return made.select("n_nationkey", "n_name")


@query("pin_repair")
def _(r: Run) -> DataFrame:
    return cl.bronze(r.raw).select("facility_id", "address_postalCode")


@query("numeric_coerce")
def _(r: Run) -> DataFrame:
    return cl.bronze(r.raw).select("facility_id", *cl.NUMERIC)


@query("type_normalise")
def _(r: Run) -> DataFrame:
    return r.clean.select(
        "facility_id", "facility_type_raw", "facility_type", "capacity", "number_doctors",
        "year_established", "recency_ts",
    )


@query("json_array_parse")
def _(r: Run) -> DataFrame:
    return as_json(r.clean.select("facility_id", *LISTS), *LISTS)


@query("rule_lists")
def _(r: Run) -> DataFrame:
    lists = r.clean.select("facility_id", *[F.expr(tx.rule_list(c)).alias(c) for c in LISTS])
    return as_json(lists, *LISTS)


@query("lenient_array")
def _(r: Run) -> DataFrame:
    parsed = r.request(inputs.MESSY_LISTS).select("p_partkey", F.expr(tx.lenient_list("messy")).alias("items"))
    return as_json(parsed, "items")


@query("flag_json_parse")
def _(r: Run) -> DataFrame:
    parsed = r.request(inputs.FLAG_TEXTS).select("event_id", tx.flags_from_json(F.col("flags_text")).alias("flags"))
    return as_json(parsed, "flags")


@query("state_resolve")
def _(r: Run) -> DataFrame:
    return r.clean.select("facility_id", "state_raw", "state")


@query("recency_months")
def _(r: Run) -> DataFrame:
    return r.table("orders").select(
        "o_orderkey", cl.recency_months(pipeline.AS_OF, F.col("o_orderdate")).alias("months")
    )


@query("facility_text")
def _(r: Run) -> DataFrame:
    return r.tables.text


@query("claims_long")
def _(r: Run) -> DataFrame:
    return r.tables.claims


@query("claims_long_parts")
def _(r: Run) -> DataFrame:
    listed = r.table("part").select(
        F.col("p_partkey").cast("string").alias("facility_id"),
        F.split("p_type", " ").alias("specialties"), F.split("p_name", " ").alias("procedure"),
        F.array("p_brand").alias("equipment"), F.array(F.lit("  "), F.lit(None)).alias("capability"),
    )
    return cl.claims_long(listed)


@query("claim_evidence")
def _(r: Run) -> DataFrame:
    return cl.claim_evidence(r.tables.claims, r.clean)


@query("specialty_keywords")
def _(r: Run) -> DataFrame:
    words = r.request(inputs.QUESTIONS).select("query_id", tx.preset("query").alias("preset"), "query")
    chosen = words.select("query_id", "query", "preset.*").withColumn(
        "keywords", F.array_join(tx.specialty_keywords("specialty"), "|")
    )
    own = F.array_join(tx.specialty_keywords("query"), "|")
    return chosen.withColumn("own_keywords", own).withColumn("urgency", tx.urgency(F.col("query")))


# --- rules and gold -------------------------------------------------------------------

def _rule(rule: str, r: Run) -> DataFrame:
    return trust.single_rule(r.clean, lookups.state_boxes(r.spark), rule)


for _name in rv.RULES:
    query(f"rule_{_name.lower()}")(partial(_rule, _name))


@query("trust_scores")
def _(r: Run) -> DataFrame:
    return r.tables.trust.select("facility_id", "trust_score", F.size("flags").alias("n_flags"))


@query("contradictions_long")
def _(r: Run) -> DataFrame:
    return r.contradictions


@query("rule_counts")
def _(r: Run) -> DataFrame:
    return reports.rule_counts(r.contradictions)


@query("severity_counts")
def _(r: Run) -> DataFrame:
    return reports.severity_counts(r.contradictions)


@query("trust_percentiles")
def _(r: Run) -> DataFrame:
    return reports.trust_percentiles(r.tables.trust)


@query("gold_facilities")
def _(r: Run) -> DataFrame:
    return as_json(r.gold, *LISTS, "flags")


@query("gold_from_tables")
def _(r: Run) -> DataFrame:
    run = r.tables
    gold = trust.gold_from_tables(run.clean, run.trust, run.contradictions)
    return gold.select("facility_id", "trust_score", F.size("flags").alias("n_flags"), "st_geom_wkt")


@query("flags_collect")
def _(r: Run) -> DataFrame:
    flags = trust.collect_flags(r.contradictions)
    return flags.select(
        "facility_id",
        F.array_join(F.transform("flags", lambda f: F.concat(f["rule_id"], F.lit(":"), f["message"])), "; ").alias("flags"),
    )


# --- reports --------------------------------------------------------------------------

def _gold_report(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    query(name)(lambda r: build(r.gold))


_gold_report("state_counts", reports.states_ranked)
_gold_report("type_counts", lambda g: reports.count_by(g, "facility_type"))
_gold_report("typo_count", reports.typo_count)
_gold_report("typo_share", reports.typo_share)
_gold_report("typo_by_state", reports.typo_by_state)
_gold_report("typo_examples", reports.typo_examples)
_gold_report("zero_coverage_cities", lambda g: reports.zero_coverage_cities(g, "Bihar", "oncolog"))
_gold_report("zero_coverage_anti_join", lambda g: reports.zero_coverage_by_anti_join(g, "Bihar", "oncolog"))
# among pharmacies alone some cities are covered and some are not
_gold_report("zero_coverage_pharmacies", lambda g: reports.zero_coverage_cities(
    g.where("facility_type = 'pharmacy'"), "Bihar", "oncolog"))
_gold_report("zero_coverage_pharmacies_anti_join", lambda g: reports.zero_coverage_by_anti_join(
    g.where("facility_type = 'pharmacy'"), "Bihar", "oncolog"))
_gold_report("lowest_trust", reports.lowest_trust)
_gold_report("overview_kpis", reports.overview)
_gold_report("audit_list", reports.audit_list)
_gold_report("audit_kpis", reports.audit_kpis)
_gold_report("fully_staffed", reports.fully_staffed)
_gold_report("claims_with_evidence", lambda g: reports.claims_with_evidence(g, "cardio", ["cath", "ecg"]))
_gold_report("unsupported_capability", lambda g: reports.unsupported_capability(
    g, ["oncolog", "chemotherapy", "radiotherapy"], dict(rv.SPECIALTY_HINTS)["oncology"]))
_gold_report("sample_distribution", reports.sample_distribution)
_gold_report("wrong_state", lambda g: reports.wrong_state(g).select(
    "facility_id", "state", "latitude", "longitude"))
_gold_report("cell_density", reports.cell_density)
_gold_report("cell_density_fine", lambda g: reports.cell_density(g, "cell_fine"))
for _specialty in rv.DESERT_KEYWORDS:
    _gold_report(f"desert_{_specialty.lower()}", lambda g, s=_specialty: reports.desert_table(g, s))
_gold_report("desert_worst", lambda g: reports.worst_deserts(g, "Oncology"))
_gold_report("desert_summary", lambda g: reports.desert_summary(g, "Oncology"))


@query("fill_rate")
def _(r: Run) -> DataFrame:
    return reports.fill_rate(r.clean)


@query("unfilled_core")
def _(r: Run) -> DataFrame:
    return reports.unfilled_core(r.clean)


@query("nation_counts")
def _(r: Run) -> DataFrame:
    named = r.table("customer").join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.count_by(named.withColumnRenamed("n_name", "nation"), "nation")


@query("compound_high")
def _(r: Run) -> DataFrame:
    found = reports.compound_high(r.contradictions, more_than=2)
    return found.withColumn("rules", F.array_join("rules", ","))


@query("compound_high_asked")
def _(r: Run) -> DataFrame:
    found = reports.compound_high(r.contradictions, more_than=3)
    return found.withColumn("rules", F.array_join("rules", ","))


@query("zero_match_audit")
def _(r: Run) -> DataFrame:
    return reports.zero_match_audit(r.contradictions, lookups.rule_dimension(r.spark))


@query("top_issues")
def _(r: Run) -> DataFrame:
    return reports.top_issues(r.contradictions)


@query("coordinate_audit")
def _(r: Run) -> DataFrame:
    return reports.coordinate_audit(r.contradictions)


@query("emergency_examples")
def _(r: Run) -> DataFrame:
    return reports.rule_examples(r.contradictions, "R2")


@query("ghost_hospitals")
def _(r: Run) -> DataFrame:
    return reports.rule_examples(r.contradictions, "R4", n=None)


@query("per_million")
def _(r: Run) -> DataFrame:
    return reports.specialty_per_million(r.gold, lookups.state_population(r.spark), "oncolog")


@query("below_one_per_five_million")
def _(r: Run) -> DataFrame:
    rates = reports.specialty_per_million(r.gold, lookups.state_population(r.spark), "oncolog")
    return reports.below_one_per_five_million(rates)


@query("worst_districts")
def _(r: Run) -> DataFrame:
    return reports.worst_districts(r.gold, lookups.priority_districts(r.spark), "oncolog")


@query("mismatch_overlay")
def _(r: Run) -> DataFrame:
    return reports.wrong_state_in_districts(r.gold, lookups.priority_districts(r.spark))


@query("point_in_state")
def _(r: Run) -> DataFrame:
    return reports.states_of_point(r.clean, lookups.state_boxes(r.spark))


@query("landing_states")
def _(r: Run) -> DataFrame:
    landed = reports.landing_states(r.clean, lookups.state_boxes(r.spark))
    return landed.withColumn("candidates", F.array_join("candidates", ","))


@query("facility_cards")
def _(r: Run) -> DataFrame:
    cards = reports.facility_cards(r.gold)
    return as_json(cards, "specialties", "capability", "equipment").drop("flags")


@query("citations")
def _(r: Run) -> DataFrame:
    return as_json(verify.citations(r.gold), "supporting_evidence")


# --- places ---------------------------------------------------------------------------

@query("haversine_pairs")
def _(r: Run) -> DataFrame:
    pairs = nearby.sites_in_reach(r.request(inputs.RADIUS_REQUESTS), r.clean, geo.SPHERE)
    return pairs.select("query_id", "site_lat", "site_lon", "distance_km")


@query("ellipsoid_pairs")
def _(r: Run) -> DataFrame:
    pairs = nearby.sites_in_reach(r.request(inputs.RADIUS_REQUESTS), r.clean)
    return pairs.select("query_id", "site_lat", "site_lon", "distance_km")


@query("radius_search")
def _(r: Run) -> DataFrame:
    found = nearby.radius_search(r.request(inputs.RADIUS_REQUESTS), r.stored_gold)
    return found.select(
        "query_id", "rank", "facility_id", "state", "city", "trust_score",
        "distance_km",
    )


@query("ring_covers_radius")
def _(r: Run) -> DataFrame:
    """The coarse cell filter keeps every facility that an exact search finds."""
    requests = r.request(inputs.RADIUS_REQUESTS)
    found = nearby.radius_search(requests, r.stored_gold).select("facility_id").distinct()
    ring = nearby.in_ring(r.stored_gold, requests).select("facility_id").distinct().withColumn("kept", F.lit(1))
    return found.join(ring, "facility_id", "left").agg(
        F.count("*").alias("n_found"), F.count_if(F.col("kept").isNull()).alias("n_missed"))


@query("radius_json")
def _(r: Run) -> DataFrame:
    requests = r.request(inputs.RADIUS_REQUESTS)
    made = nearby.radius_json(requests, nearby.radius_search(requests, r.stored_gold))
    parsed = F.from_json(
        "json", "struct<center:struct<lat:double,lon:double>,radius_km:double,specialty:string,"
                "results:array<struct<facility_id:string,distance_km:double>>>"
    )
    return made.select("query_id", parsed.alias("j")).select(
        "query_id", F.col("j.center.lat").alias("lat"), F.col("j.center.lon").alias("lon"),
        "j.radius_km", "j.specialty",
        F.array_join(F.transform("j.results", lambda x: x["facility_id"]), ",").alias("ids"),
        F.size("j.results").alias("n_results"),
    )


@query("nearest_equipped")
def _(r: Run) -> DataFrame:
    """The one nearest facility with a cardiology listing and any equipment, within 100 km."""
    equipped = r.stored_gold.where(F.size("equipment") > 0)
    requests = r.request(inputs.RADIUS_REQUESTS).select(
        "query_id", "lat", "lon", F.lit(100.0).alias("radius_km"), F.lit("cardio").alias("specialty"),
        F.lit(1).alias("limit"),
    )
    found = nearby.radius_search(requests, equipped)
    return found.select("query_id", "facility_id", "distance_km")


@query("radius_trust_check")
def _(r: Run) -> DataFrame:
    """Facilities within 50 km that claim intensive care, each with its trust report."""
    icu = r.stored_gold.where(tx.any_element_contains("capability", ["icu"]))
    requests = r.request(inputs.RADIUS_REQUESTS).withColumn("radius_km", F.lit(50.0)).withColumn(
        "specialty", F.lit("")
    )
    found = nearby.radius_search(requests, icu, extra=["flags"])
    return found.select(
        "query_id", "rank", "facility_id", "trust_score", F.size("flags").alias("n_flags"),
    )


@query("provider_rank")
def _(r: Run) -> DataFrame:
    ranked = nearby.rank_providers(r.request(inputs.QUESTIONS), r.stored_gold)
    return ranked.select(
        "query_id", "rank", "facility_id", "trust", "tier", "spec_match",
        "distance_km", "score",
    )


# --- search and extraction ------------------------------------------------------------

@query("bm25_topk")
def _(r: Run) -> DataFrame:
    found = search.bm25_top_k(r.request(inputs.SEARCH_REQUESTS), r.documents, "doc_id", "text")
    return found


def _corpus(r: Run) -> DataFrame:
    return r.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@query("vector_topk")
def _(r: Run) -> DataFrame:
    found = search.vector_top_k(r.request(inputs.VECTOR_REQUESTS), _corpus(r))
    return found


@query("hybrid_topk")
def _(r: Run) -> DataFrame:
    return fusion.hybrid_top_k(
        r.request(inputs.DEEP_SEARCH_REQUESTS), r.documents, "doc_id", "text",
        r.request(inputs.DEEP_VECTOR_REQUESTS), _corpus(r),
    )


@query("facility_search")
def _(r: Run) -> DataFrame:
    text = r.stored_text
    found = search.bm25_top_k(r.request(inputs.SEARCH_REQUESTS), text, "facility_id", "facility_text")
    return search.show_facilities(found, text).drop("description")


@query("field_extract")
def _(r: Run) -> DataFrame:
    fields = extract.extract_fields(r.clean.select("facility_id", "description"), "description").drop("description")
    for label in rv.EXTRACT_LABELS:
        fields = fields.withColumn(label, F.array_join(label, "|"))
    return fields


@query("page_extract")
def _(r: Run) -> DataFrame:
    made = extract.extract_json(r.table("pages").select("page_id", "html"), "html")
    return made.select("page_id", "fields")


@query("document_extract")
def _(r: Run) -> DataFrame:
    made = extract.extract_json(r.documents.select("doc_id", "text"), "text")
    return made.select("doc_id", "fields")


# --- verification ---------------------------------------------------------------------

@query("needle_tokens")
def _(r: Run) -> DataFrame:
    return r.request(inputs.CLAIM_REQUESTS).select(
        "request_id", F.array_join(F.expr(tx.needles("claim")), "|").alias("needles")
    )


@query("cross_source")
def _(r: Run) -> DataFrame:
    checked = verify.cross_source(r.request(inputs.CLAIM_REQUESTS), r.clean)
    return checked.drop("claim").withColumn("sources_supporting", F.array_join("sources_supporting", "|"))


@query("cross_source_json")
def _(r: Run) -> DataFrame:
    return verify.cross_source_json(verify.cross_source(r.request(inputs.CLAIM_REQUESTS), r.clean))


@query("trust_report")
def _(r: Run) -> DataFrame:
    return verify.trust_report(r.request(inputs.CLAIM_REQUESTS), r.gold)


def _answers(r: Run) -> DataFrame:
    ids = F.when(F.col("allowed") != "", F.split("allowed", ",")).otherwise(tx.empty_list())
    return r.request(inputs.ANSWERS).withColumn("allowed_facility_ids", ids)


@query("citation_ids")
def _(r: Run) -> DataFrame:
    parsed = verify.with_citations_and_claims(_answers(r))
    return parsed.select("answer_id", F.array_join("ids", ",").alias("ids"))


@query("sentence_claims")
def _(r: Run) -> DataFrame:
    return r.documents.select("doc_id", F.to_json(tx.sentence_claims(F.col("text"))).alias("claims"))


@query("verify_answers")
def _(r: Run) -> DataFrame:
    return as_json(verify.verify_answers(_answers(r), r.gold), "disagreements", "high_flags")


@query("answer_checks")
def _(r: Run) -> DataFrame:
    return verify.check_answers(_answers(r))


def _messages(r: Run) -> DataFrame:
    turns = r.request(inputs.TRANSCRIPTS)
    part = lambda line: F.struct(F.when(line != "", line).alias("text"))
    parts = F.transform(F.split("text", "\n"), part)
    return turns.select(
        "conv_id", "turn", tx.message_role(F.col("role"), F.col("kind")).alias("role"),
        tx.flatten_parts(parts).alias("content"),
    )


@query("transcript_flatten")
def _(r: Run) -> DataFrame:
    return _messages(r)


@query("transcript_verdicts")
def _(r: Run) -> DataFrame:
    """The last assistant message of each conversation, verified."""
    return as_json(verify.verify_answers(verify.drafts(_messages(r)), r.gold), "disagreements", "high_flags")


# --- evaluation -----------------------------------------------------------------------

@query("metric_delta")
def _(r: Run) -> DataFrame:
    delta = evaluation.metric_delta(
        r.request(inputs.METRICS["baseline"]), r.request(inputs.METRICS["candidate"])
    )
    return delta.withColumn("baseline", F.round("baseline", 6)).withColumn("candidate", F.round("candidate", 6))


@query("golden_normalise")
def _(r: Run) -> DataFrame:
    rows = r.table("documents").select(
        "doc_id", F.when(F.col("lang") != "de", F.struct(F.col("text").alias("question"))).alias("inputs"),
        F.when(F.col("source").isNotNull(), F.array("source")).alias("expected_facts"),
    )
    shaped = evaluation.normalise_golden(rows)
    return shaped.withColumn("expected_facts", F.array_join("expected_facts", "|"))


@query("concat_frames")
def _(r: Run) -> DataFrame:
    places = r.clean.select("name", "city", "state", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    anchors = r.table("supplier").select(
        F.col("s_name").alias("name"), F.lit(1.0).alias("trust"), F.lit("Anchor").alias("tier")
    )
    return evaluation.concat_frames(places, anchors)


# --- streams, tables, functions -------------------------------------------------------

@query("index_incremental")
def _(r: Run) -> DataFrame:
    """Index all documents, then take in new versions of the labelled ones."""
    folder = r.scratch()
    documents = r.documents.select("doc_id", F.lit(1).alias("version"), "text")
    documents.write.mode("append").parquet(f"{folder}/feed")
    changes = r.spark.readStream.schema(documents.schema).parquet(f"{folder}/feed")
    sync.sync_index(changes, f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    newer = r.table("labels").join(r.table("documents"), "doc_id").select(
        "doc_id", F.lit(2).alias("version"),
        F.concat(F.lit("relabelled quality "), F.col("quality").cast("string"), F.lit(" "), F.col("text")).alias("text"),
    )
    newer.write.mode("append").parquet(f"{folder}/feed")
    sync.sync_index(changes, f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    return sync.live_postings(r.spark, f"{folder}/index").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"),
    )


def _fed(r: Run, *arrivals: DataFrame) -> str:
    """An index that took in the arrivals one batch after the other."""
    folder = r.scratch()
    for arrival in arrivals:
        arrival.write.mode("append").parquet(f"{folder}/feed")
        changes = r.spark.readStream.schema(arrivals[0].schema).parquet(f"{folder}/feed")
        sync.sync_index(changes, f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/index"


def _versions(r: Run, version: int) -> DataFrame:
    """Every document, or with version 1 an older form of the labelled ones."""
    docs = r.documents.select("doc_id", F.lit(version).alias("version"), "text", F.lit(False).alias("deleted"))
    if version == 1:
        docs = docs.join(r.table("labels"), "doc_id", "left_semi").withColumn("text", F.concat(F.lit("stale "), "text"))
    return docs


@query("index_late_versions")
def _(r: Run) -> DataFrame:
    """An older version that arrives after a newer one changes nothing."""
    index = _fed(r, _versions(r, 2), _versions(r, 1))
    return sync.live_postings(r.spark, index).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query("index_deletes")
def _(r: Run) -> DataFrame:
    """Labelled documents are deleted; a compacted index stays so when an old version arrives once more."""
    gone = r.table("labels").select("doc_id", F.lit(3).alias("version"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"))
    index = _fed(r, _versions(r, 2), gone)
    compact = r.scratch()
    sync.compact_index(r.spark, index, compact)
    sync.index_batch(_versions(r, 1), 0, compact, "late")
    return sync.live_keys(r.spark, compact).select("doc_id", F.col("length").cast("bigint").alias("length"))


@query("index_search")
def _(r: Run) -> DataFrame:
    """Keyword search over the stored index; the same hits as over the documents."""
    return sync.search_index(r.spark, _fed(r, _versions(r, 2)), r.request(inputs.SEARCH_REQUESTS))


def _vector_versions(r: Run, version: int) -> DataFrame:
    """Every embedding, each fourth in an older, reversed form; with version 2 those as they are."""
    rows = r.table("embeddings").select(
        F.col("vec_id").alias("doc_id"), F.lit(version).alias("version"), F.col("embedding").alias("vector"), F.lit(False).alias("deleted"))
    old = F.col("doc_id") % 4 == 0
    return rows.where(old) if version > 1 else rows.withColumn("vector", F.when(old, F.reverse("vector")).otherwise(F.col("vector")))


def _vector_index(r: Run) -> str:
    """An index that took in all vectors, some in an old form, then the new form of those."""
    folder = r.scratch()
    for version in (1, 2):
        arrival = _vector_versions(r, version)
        arrival.write.mode("append").parquet(f"{folder}/feed")
        changes = r.spark.readStream.schema(arrival.schema).parquet(f"{folder}/feed")
        vector_index.sync_vectors(changes, f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/index"


@query("vector_index_topk")
def _(r: Run) -> DataFrame:
    """Approximate search over the stored index, with each query's recall against the exact answer (0.9 or more overall)."""
    queries = r.request(inputs.VECTOR_REQUESTS)
    found = vector_index.search_vectors(queries, _vector_index(r))
    exact = search.vector_top_k(queries, _corpus(r)).select("query_id", "doc_id", F.lit(1).alias("_exact"))
    per_query = Window.partitionBy("query_id")  # k rows
    return found.join(exact, ["query_id", "doc_id"], "left").withColumn(
        "recall", F.count("_exact").over(per_query) / F.count(F.lit(1)).over(per_query)).drop("_exact")


@query("vector_index_exact")
def _(r: Run) -> DataFrame:
    """The same with every list visited and all of its codes re-ranked: the exact answer."""
    queries = r.request(inputs.VECTOR_REQUESTS)
    return vector_index.search_vectors(queries, _vector_index(r), probes=1.0, rerank=1 << 20)


@query("rules_stream")
def _(r: Run) -> DataFrame:
    folder = r.scratch()
    r.raw.write.mode("overwrite").parquet(f"{folder}/raw")
    arriving = r.spark.readStream.schema(r.raw.schema).parquet(f"{folder}/raw")
    flagged = sync.flag_stream(
        arriving, lookups.state_boxes(r.spark), lookups.state_aliases(r.spark), pipeline.AS_OF
    ).select("facility_id", "trust_score", "flags")
    sync.append_flagged(flagged, f"{folder}/flagged", f"{folder}/checkpoint").awaitTermination()
    return reports.rule_counts(trust.contradictions(r.spark.read.parquet(f"{folder}/flagged")))


@query("tools_smoke")
def _(r: Run) -> DataFrame:
    """The facility of lowest trust put through all four tools."""
    gold = r.stored_gold
    worst = gold.orderBy("trust_score", "facility_id").limit(1)
    claim = worst.select(
        F.lit(1).cast("bigint").alias("request_id"), "facility_id", F.lit("cardiac surgery icu").alias("claim")
    )
    place = claim.select(
        F.col("request_id").alias("query_id"), F.lit(25.59).alias("lat"), F.lit(85.13).alias("lon"),
        F.lit(25.0).alias("radius_km"), F.lit("cardiology").alias("specialty"), F.lit(5).alias("limit"),
    )
    score = verify.trust_report(claim, gold).select("request_id", F.col("json").alias("score"))
    cross = verify.cross_source(claim, gold).select("request_id", "agree")
    near = nearby.radius_search(place, gold).groupBy(F.col("query_id").alias("request_id")).agg(
        F.array_join(F.array_sort(F.collect_list("facility_id")), ",").alias("nearby")
    )
    fields = extract.extract_json(
        worst.select(F.lit(1).cast("bigint").alias("request_id"), "description"), "description"
    ).drop("description")
    return score.join(cross, "request_id").join(near, "request_id", "left").join(fields, "request_id")


@query("temp_functions")
def _(r: Run) -> DataFrame:
    sql_functions.register(r.spark)
    r.clean.createOrReplaceTempView("clean_facilities")
    return r.spark.sql(
        "SELECT facility_id, repair_pin(pin) AS pin, trust_tier(coalesce(capacity, 0) / 100D) AS tier,"
        " round(haversine_km(latitude, longitude, 25.59D, 85.13D), 4) AS km,"
        " array_join(claim_needles(description), '|') AS needles FROM clean_facilities"
    )


@query("sql_tools")
def _(r: Run) -> DataFrame:
    """The four tools called from SQL for every claim request."""
    r.stored_gold.createOrReplaceTempView("gold_facilities")
    sql_functions.register_tools(r.spark, "gold_facilities")
    r.request(inputs.CLAIM_REQUESTS).createOrReplaceTempView("claim_requests")
    return r.spark.sql(
        "SELECT request_id, score_claim_consistency(facility_id) AS score,"
        " cross_source_disagree(facility_id, claim) AS cross_source,"
        " parse_messy_field(claim) AS fields FROM claim_requests"
    )


@query("sql_radius")
def _(r: Run) -> DataFrame:
    r.stored_gold.createOrReplaceTempView("gold_facilities")
    sql_functions.register_tools(r.spark, "gold_facilities")
    found = r.spark.sql("SELECT geo_radius(25.59D, 85.13D, 50.0D, 'Cardio', 20) AS json")
    hits = F.from_json("json", "struct<specialty:string,results:array<struct<facility_id:string,distance_km:double>>>")
    return found.select(hits.alias("j")).select("j.specialty", F.posexplode("j.results").alias("pos", "hit")).select(
        "specialty", "pos", "hit.*"
    )


@query("sql_radius_requests")
def _(r: Run) -> DataFrame:
    """Radius search, score and cross-source check called from SQL for whole tables of requests."""
    r.stored_gold.createOrReplaceTempView("gold_facilities")
    r.request(inputs.RADIUS_REQUESTS).createOrReplaceTempView("radius_requests")
    r.request(inputs.CLAIM_REQUESTS).createOrReplaceTempView("claim_requests")
    sql_functions.register_request_views(r.spark, "gold_facilities", "radius_requests", "claim_requests")
    hits = "struct<specialty:string,results:array<struct<facility_id:string>>>"
    return r.spark.sql(
        f"SELECT r.query_id, r.lat, r.lon, j.specialty, array_join(transform(j.results, x -> x.facility_id), ',') AS ids"
        f" FROM radius_requests r JOIN (SELECT query_id, from_json(json, '{hits}') AS j FROM geo_radius_results) USING (query_id)"
    )


@query("sql_claim_requests")
def _(r: Run) -> DataFrame:
    r.stored_gold.createOrReplaceTempView("gold_facilities")
    r.request(inputs.RADIUS_REQUESTS).createOrReplaceTempView("radius_requests")
    r.request(inputs.CLAIM_REQUESTS).createOrReplaceTempView("claim_requests")
    sql_functions.register_request_views(r.spark, "gold_facilities", "radius_requests", "claim_requests")
    return r.spark.sql(
        "SELECT request_id, s.json AS score, c.json AS cross_source FROM claim_requests r"
        " JOIN score_claim_consistency_results s USING (request_id) JOIN cross_source_disagree_results c USING (request_id)"
    )


def _table_versions(r: Run) -> tuple[DataFrame, DataFrame]:
    """Documents, and a later version: poor ones rewritten, toxic ones gone, the benchmark's texts new."""
    old = r.documents.select("doc_id", "text", "source")
    labelled = old.join(r.table("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    new = labelled.where("coalesce(toxic, 0) = 0").select(
        "doc_id", F.when(F.col("quality") == 0, F.concat(F.lit("revised "), "text")).otherwise(F.col("text")).alias("text"), "source")
    items = r.table("benchmark").select((F.col("item_id") + 10**9).alias("doc_id"), "text", F.lit(None).cast("string").alias("source"))
    return old, new.unionByName(items)


@query("feed_from_versions")
def _(r: Run) -> DataFrame:
    return changes.feed_from_versions(*_table_versions(r), "doc_id", 2)


@query("feed_applied")
def _(r: Run) -> DataFrame:
    """The old version with the feed applied: the new version."""
    old, new = _table_versions(r)
    return changes.apply_feed(old, changes.feed_from_versions(old, new, "doc_id", 2), "doc_id")


@query("write_roundtrip")
def _(r: Run) -> DataFrame:
    stored = pipeline.store(r.tables, r.scratch())
    return stored.gold.select("facility_id", "trust_score", F.size("flags").alias("n_flags"))


@query("column_comments")
def _(r: Run) -> DataFrame:
    """Gold columns that carry a comment, with how often each is filled."""
    gold = tables.with_comments(r.gold, pipeline.COMMENTS)
    comments = tables.column_comments(gold)
    counted = gold.agg(*[F.count(c).alias(c) for c in comments])
    names = F.create_map(*[F.lit(x) for pair in comments.items() for x in pair])
    return counted.unpivot([], list(comments), "column_name", "n_filled").withColumn(
        "comment", names[F.col("column_name")]
    )


@query("rows_json")
def _(r: Run) -> DataFrame:
    return tables.rows_as_json(r.clean.select("facility_id", "name", "state", "capacity"))


@query("sample_documents")
def _(r: Run) -> DataFrame:
    return tables.sample_documents(r.tables.text)


@query("batch_read")
def _(r: Run) -> DataFrame:
    ids = r.request(inputs.CLAIM_REQUESTS).select("facility_id")
    return tables.batch_read(r.clean, ids).select("facility_id", "name", "state")
