"""Report queries over the clean, gold and contradiction tables.

All orderings end in a unique key, so a report's rows never depend on chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carecheck import rule_values as rv
from carecheck.functions import geo, stats
from carecheck.functions import text as tx


def _rows(alias: str = "n") -> Column:
    return F.count(F.lit(1)).alias(alias)


def _offers(keywords: list[str], *lists: str) -> Column:
    hits = [tx.any_element_contains(c, keywords) for c in lists]
    return reduce(lambda a, b: a | b, hits)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(_rows()).orderBy(F.desc("n"), *keys)


def states_ranked(gold: DataFrame) -> DataFrame:
    return count_by(gold.where(F.col("state").isNotNull()), "state")


def typo_count(gold: DataFrame) -> DataFrame:
    return gold.where(F.col("facility_type_raw") == "farmacy").groupBy("facility_type_raw").agg(_rows())


def typo_share(gold: DataFrame) -> DataFrame:
    """Typo rows and their share of all pharmacies."""
    typo = F.count_if(F.col("facility_type_raw") == "farmacy")
    pharmacies = F.count_if(F.col("facility_type") == "pharmacy")
    return gold.agg(typo.alias("n_typo"), pharmacies.alias("n_pharmacy")).withColumn(
        "typo_pct", stats.percent(F.col("n_typo"), F.col("n_pharmacy"))
    )


def typo_by_state(gold: DataFrame) -> DataFrame:
    """Pharmacies per state as listed and as corrected, most affected first."""
    listed = F.count_if(F.col("facility_type_raw") == "pharmacy")
    corrected = F.count_if(F.col("facility_type") == "pharmacy")
    return (
        gold.where(F.col("state").isNotNull())
        .groupBy("state")
        .agg(listed.alias("n_listed"), corrected.alias("n_corrected"))
        .withColumn("n_typo", F.col("n_corrected") - F.col("n_listed"))
        .withColumn("undercount_pct", stats.percent(F.col("n_typo"), F.col("n_corrected")))
        .orderBy(F.desc("n_typo"), "state")
    )


def typo_examples(gold: DataFrame, n: int = 5) -> DataFrame:
    return (
        gold.where(F.col("facility_type_raw") == "farmacy")
        .select("facility_id", "name", "facility_type_raw", "facility_type", "state")
        .orderBy("facility_id")
        .limit(n)
    )


def zero_coverage_cities(gold: DataFrame, state: str, fragment: str) -> DataFrame:
    """Cities of a state where no facility lists the specialty; rows without a city are left out.

    One pass: a city is covered if any of its facilities, in whatever state, offers it.
    """
    offers = tx.any_element_contains("specialties", [fragment])
    return (
        gold.where(F.col("city").isNotNull())
        .groupBy("city")
        .agg(F.bool_or(offers).alias("covered"), F.bool_or(F.col("state") == state).alias("here"))
        .where(F.col("here") & ~F.col("covered"))
        .select("city")
        .orderBy("city")
    )


def zero_coverage_by_anti_join(gold: DataFrame, state: str, fragment: str) -> DataFrame:
    """The same report as an anti-join against the covered cities."""
    covered = (
        gold.where(tx.any_element_contains("specialties", [fragment]))
        .select("city").where(F.col("city").isNotNull()).distinct()
    )
    cities = (
        gold.where((F.col("state") == state) & F.col("city").isNotNull()).select("city").distinct()
    )
    return cities.join(covered, "city", "left_anti").orderBy("city")


def lowest_trust(gold: DataFrame, facility_type: str = "hospital", n: int = 25) -> DataFrame:
    return (
        gold.where(F.col("facility_type") == facility_type)
        .select("facility_id", "name", "state", "city", "trust_score")
        .orderBy("trust_score", "facility_id")
        .limit(n)
    )


def rule_counts(contradictions: DataFrame) -> DataFrame:
    return contradictions.groupBy("rule_id", "severity").agg(_rows()).orderBy("rule_id", "severity")


def severity_counts(contradictions: DataFrame) -> DataFrame:
    return count_by(contradictions, "severity")


def trust_percentiles(trust: DataFrame) -> DataFrame:
    return trust.agg(
        F.percentile_approx("trust_score", F.lit(0.10)).alias("p10"),
        F.percentile_approx("trust_score", F.lit(0.50)).alias("p50"),
        F.percentile_approx("trust_score", F.lit(0.90)).alias("p90"),
        F.round(F.avg("trust_score"), 6).alias("mean_score"),
    )


def overview(gold: DataFrame) -> DataFrame:
    flags = F.size("flags")
    return gold.agg(
        _rows("n_facilities"),
        F.round(F.avg("trust_score") / 100, 6).alias("mean_trust"),
        F.count_if(flags > 0).alias("n_with_flags"),
        F.sum(flags).cast("bigint").alias("n_flags_total"),
    )


def desert_table(gold: DataFrame, specialty: str) -> DataFrame:
    """Coverage of a specialty per state and city with its Wilson interval, worst deficit first."""
    keywords = rv.DESERT_KEYWORDS.get(specialty, [specialty.lower()])
    offers = _offers(keywords, "specialties", "capability", "equipment")
    per_city = (
        gold.where(
            F.col("state").isNotNull() & F.col("city").isNotNull()
            & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        )
        .groupBy("state", F.col("city").alias("district"))
        .agg(
            _rows("n_facilities"),
            F.count_if(offers).alias("n_specialty"),
            F.round(F.avg("latitude"), 6).alias("lat"),
            F.round(F.avg("longitude"), 6).alias("lon"),
        )
    )
    k, n = F.col("n_specialty"), F.col("n_facilities")
    low, high = stats.wilson(k, n)
    return (
        per_city.withColumn("coverage_pct", stats.coverage_pct(k, n))
        .withColumn("ci_low", F.round(low * 100, 2))
        .withColumn("ci_high", F.round(high * 100, 2))
        .withColumn("deficit_score", stats.deficit(F.col("coverage_pct"), n))
    )


def worst_deserts(
    gold: DataFrame, specialty: str, min_facilities: int = 5, n: int | None = 10
) -> DataFrame:
    table = (
        desert_table(gold, specialty)
        .where(F.col("n_facilities") >= min_facilities)
        .orderBy(F.desc("deficit_score"), "state", "district")
    )
    return table if n is None else table.limit(n)


def desert_summary(gold: DataFrame, specialty: str, min_facilities: int = 5) -> DataFrame:
    """Headline figures of the filtered view: cities, totals, share and the worst city."""
    view = desert_table(gold, specialty).where(F.col("n_facilities") >= min_facilities)
    # of equal deficits the first place in order: the negated deficit makes it a minimum
    first = F.min(F.struct((-F.col("deficit_score")).alias("key"), "state", "district"))
    return view.agg(
        _rows("n_cities"),
        F.coalesce(F.sum("n_facilities"), F.lit(0)).alias("total_facilities"),
        F.coalesce(F.sum("n_specialty"), F.lit(0)).alias("total_specialty"),
        first.alias("worst"),
    ).select(
        "n_cities", "total_facilities", "total_specialty",
        stats.percent(F.col("total_specialty"), F.col("total_facilities"), 1).alias("coverage_pct"),
        F.col("worst.district").alias("worst_district"),
        (-F.col("worst.key")).alias("worst_deficit"),
    )


def audit_list(gold: DataFrame, n: int = 100) -> DataFrame:
    return (
        gold.where(F.size("flags") > 0)
        .select(
            "facility_id", "name", "facility_type_raw", "facility_type", "state", "city",
            "latitude", "longitude", "trust_score", F.size("flags").alias("n_flags"),
        )
        .orderBy("trust_score", "facility_id")
        .limit(n)
    )


def audit_kpis(gold: DataFrame) -> DataFrame:
    """Typo rows, flags per severity and the share of facilities with a coordinate flag."""
    def flags_of(severity: str) -> Column:
        return F.sum(F.size(F.filter("flags", lambda f: f["severity"] == severity))).cast("bigint")

    coord = F.exists("flags", lambda f: f["rule_id"] == "R3")
    return gold.agg(
        F.count_if(F.col("facility_type_raw") == "farmacy").alias("n_typo"),
        *[flags_of(s).alias(f"n_{s.lower()}") for s in rv.SEVERITY_POINTS],
        _rows("n_total"),
        F.count_if(coord).alias("n_coord_flags"),
    ).withColumn("coord_pct", stats.percent(F.col("n_coord_flags"), F.col("n_total")))


def fill_rate(clean: DataFrame) -> DataFrame:
    """Share of rows where a column holds a value, per column."""
    total = F.count(F.lit(1)).alias("_n")
    counted = clean.agg(total, *[F.count(c).alias(c) for c in clean.columns])
    stacked = counted.unpivot(["_n"], clean.columns, "column_name", "n_filled")
    return stacked.select(
        "column_name", "n_filled", stats.percent(F.col("n_filled"), F.col("_n")).alias("filled_pct")
    ).orderBy("column_name")


def unfilled_core(clean: DataFrame) -> DataFrame:
    """Rows with neither capacity nor doctors nor founding year."""
    nothing = (
        F.col("capacity").isNull() & F.col("number_doctors").isNull() & F.col("year_established").isNull()
    )
    return clean.agg(_rows("n_total"), F.count_if(nothing).alias("n_unfilled")).withColumn(
        "unfilled_pct", stats.percent(F.col("n_unfilled"), F.col("n_total"))
    )


def fully_staffed(gold: DataFrame) -> DataFrame:
    """Hospitals per city with doctors, capacity and equipment all listed."""
    staffed = (
        F.col("number_doctors").isNotNull() & F.col("capacity").isNotNull() & (F.size("equipment") > 0)
    )
    return (
        gold.where(F.col("facility_type") == "hospital")
        .groupBy("city")
        .agg(_rows("n_hospitals"), F.count_if(staffed).alias("n_staffed"))
        .withColumn("staffed_pct", stats.percent(F.col("n_staffed"), F.col("n_hospitals")))
        .orderBy("city")
    )


def claims_with_evidence(gold: DataFrame, specialty: str, evidence: list[str]) -> DataFrame:
    """Facilities claiming a specialty, with whether their equipment backs it."""
    return gold.where(tx.any_element_contains("specialties", [specialty])).select(
        "facility_id", "city", "state",
        tx.any_element_contains("equipment", evidence).alias("has_evidence"),
    )


def unsupported_capability(gold: DataFrame, claims: list[str], fragments: list[str]) -> DataFrame:
    """Facilities whose lists claim something no equipment of theirs backs."""
    return gold.where(
        _offers(claims, "specialties", "capability") & ~_offers(fragments, "equipment")
    ).select("facility_id", "state", "city", "trust_score")


def specialty_per_million(gold: DataFrame, population: DataFrame, fragment: str) -> DataFrame:
    """States ranked by facilities per million inhabitants; states with none are listed too."""
    offers = tx.any_element_contains("specialties", [fragment])
    per_state = gold.groupBy("state").agg(F.count_if(offers).alias("n_specialty"))
    people = F.col("population").cast("double")
    rated = population.join(per_state, "state", "left").select(
        "state", "population",
        F.coalesce("n_specialty", F.lit(0)).alias("n_specialty"),
        F.round(F.coalesce("n_specialty", F.lit(0)) / people * 1000000, 4).alias("per_million"),
    )
    ranked = rated.withColumn(
        "rank", F.rank().over(Window.orderBy(F.desc("per_million"))).cast("bigint")
    )
    return ranked.orderBy("rank", "state")


def below_one_per_five_million(per_million: DataFrame) -> DataFrame:
    return per_million.where(
        F.col("n_specialty").cast("double") * 5000000 < F.col("population").cast("double")
    ).select("state", "population", "n_specialty", "per_million")


def worst_districts(
    gold: DataFrame, districts: DataFrame, fragment: str, n: int = 10
) -> DataFrame:
    """Priority districts with the fewest facilities of a specialty, zero included.

    Facilities are counted per place first, so only one row per city meets the districts.
    """
    offers = tx.any_element_contains("specialties", [fragment])
    per_place = (
        gold.where(F.col("city").isNotNull())
        .groupBy(F.lower("city").alias("place"), "state")
        .agg(_rows("n_facilities"), F.count_if(offers).alias("n_specialty"))
    )
    return (
        districts.withColumn("place", F.lower("district"))
        .join(per_place, ["place", "state"], "left")
        .select(
            "district", "state",
            F.coalesce("n_facilities", F.lit(0)).alias("n_facilities"),
            F.coalesce("n_specialty", F.lit(0)).alias("n_specialty"),
        )
        .orderBy("n_specialty", "state", "district")
        .limit(n)
    )


def is_abroad(message: Column) -> Column:
    return F.contains(message, F.lit("outside India"))


def coordinate_audit(contradictions: DataFrame) -> DataFrame:
    """Coordinate flags split into outside the country and in the wrong state."""
    abroad = is_abroad(F.col("message"))
    return contradictions.where(F.col("rule_id") == "R3").agg(
        F.count_if(abroad).alias("n_outside_country"), F.count_if(~abroad).alias("n_wrong_state")
    )


def wrong_state(gold: DataFrame) -> DataFrame:
    """Facilities whose coordinates lie outside the claimed state."""
    hit = F.exists("flags", lambda f: (f["rule_id"] == "R3") & ~is_abroad(f["message"]))
    return gold.where(hit)


def wrong_state_in_districts(gold: DataFrame, districts: DataFrame) -> DataFrame:
    """Wrong-state facilities whose city carries a priority district's name."""
    named = districts.select(F.lower("district").alias("_place"), "state", "district")
    rows = wrong_state(gold).select("facility_id", "city", "state", F.lower("city").alias("_place"))
    return rows.join(named, ["_place", "state"]).select("facility_id", "city", "state", "district")


def states_of_point(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each point with every state whose box holds it, beside the state it claims.

    Boxes are cut into whole-degree tiles, so points meet them by equality on the tile.
    """
    tiles = boxes.select(
        F.col("state").alias("box_state"), "min_lat", "max_lat", "min_lon", "max_lon",
        F.explode(F.sequence(F.floor("min_lat"), F.floor("max_lat"))).alias("_tile_lat"),
    ).select(
        "*", F.explode(F.sequence(F.floor("min_lon"), F.floor("max_lon"))).alias("_tile_lon")
    )
    located = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "*", F.floor("latitude").alias("_tile_lat"), F.floor("longitude").alias("_tile_lon")
    )
    hits = located.join(tiles, ["_tile_lat", "_tile_lon"]).where(
        geo.in_box(F.col("latitude"), F.col("longitude"))
    )
    return hits.select("facility_id", "state", "latitude", "longitude", "box_state")


def landing_states(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per point in some box: the candidate states and whether the claim is among them."""
    return (
        states_of_point(points, boxes)
        .groupBy("facility_id", "state", "latitude", "longitude")
        .agg(F.array_sort(F.collect_set("box_state")).alias("candidates"))
        .withColumn(
            "claim_matches", F.coalesce(F.array_contains("candidates", F.col("state")), F.lit(False))
        )
    )


def cell_density(gold: DataFrame, cell: str = "cell_coarse") -> DataFrame:
    return (
        gold.where(F.col(cell).isNotNull())
        .groupBy(F.col(cell).alias("cell"))
        .agg(_rows(), F.round(F.avg("trust_score"), 6).alias("mean_trust"))
    )


def sample_facilities(gold: DataFrame, n: int = 50, seed: str = "") -> DataFrame:
    """A repeatable random sample: the n ids with the smallest hash."""
    return gold.orderBy(F.md5(F.concat(F.lit(seed), "facility_id")), "facility_id").limit(n)


def sample_distribution(gold: DataFrame, n: int = 50, seed: str = "") -> DataFrame:
    """Flags per severity and rule on a sample."""
    return (
        sample_facilities(gold, n, seed)
        .select(F.explode_outer("flags").alias("flag"))
        .where("flag IS NOT NULL")
        .groupBy("flag.severity", "flag.rule_id")
        .agg(_rows())
    )


def compound_high(contradictions: DataFrame, more_than: int = 3) -> DataFrame:
    """Facilities with HIGH flags of more than so many different rules, with the rules."""
    return (
        contradictions.where(F.col("severity") == "HIGH")
        .groupBy("facility_id")
        .agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
        .where(F.size("rules") > more_than)
    )


def zero_match_audit(contradictions: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with its flag and facility counts; a rule that never fired shows 0."""
    fired = contradictions.groupBy("rule_id", "facility_id").agg(_rows()).groupBy("rule_id").agg(
        F.sum("n").alias("n_flags"), F.count(F.lit(1)).alias("n_facilities")
    )
    return rules.join(fired, "rule_id", "left").select(
        "rule_id", "severity",
        F.coalesce("n_flags", F.lit(0)).alias("n_flags"),
        F.coalesce("n_facilities", F.lit(0)).alias("n_facilities"),
    )


REMEDIES = {
    "R1": "Ask for equipment and staffing lists before referring critical cases.",
    "R2": "Confirm emergency hours by phone before listing them.",
    "R3": "Correct the coordinates or the state against the postal code.",
    "R4": "Visit or call the hospital; hide it from referrals until something is listed.",
    "R5": "Replace the type with 'pharmacy'.",
    "R6": "Remove the award unless a certificate is shown.",
    "R7": "Ask for the equipment behind each listed specialty.",
    "R8": "Refresh the page and add a working contact link.",
}


def top_issues(contradictions: DataFrame, n: int = 3) -> DataFrame:
    """The rules that affect most facilities, with the next step for each."""
    remedy = F.create_map(*[F.lit(x) for pair in REMEDIES.items() for x in pair])
    return (
        contradictions.groupBy("rule_id", "facility_id").agg(_rows()).groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("n_facilities"))
        .orderBy(F.desc("n_facilities"), "rule_id")
        .limit(n)
        .withColumn("next_step", remedy[F.col("rule_id")])
    )


def rule_examples(contradictions: DataFrame, rule: str, n: int | None = 5) -> DataFrame:
    rows = contradictions.where(F.col("rule_id") == rule).orderBy("facility_id")
    return rows if n is None else rows.limit(n)


def facility_cards(gold: DataFrame, n: int | None = None) -> DataFrame:
    """Located facilities with score, tier and trust breakdown; all, or the ``n`` of highest trust."""
    top = gold.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if n is not None:
        top = top.orderBy(F.desc("trust_score"), "facility_id").limit(n)

    def shown(column: str, instead: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(instead)).alias(column)

    score = stats.trust01(F.col("trust_score"))
    parts = stats.trust_components(
        F.col("capability"), F.col("equipment"), F.col("flags"), [F.col(c) for c in rv.FILL_COLUMNS]
    )
    return top.select(
        "facility_id",
        shown("name", "—"), shown("city", "—"), shown("state", "—"), shown("pin", ""),
        shown("facility_type", "facility"),
        "latitude", "longitude", "specialties", "capability", "equipment", "flags",
        score.alias("trust"), stats.trust_tier(score).alias("tier"),
        *[c.alias(name) for name, c in parts.items()],
    )
