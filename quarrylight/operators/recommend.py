"""Recommendations: ordered gates, scores, ranks, priorities, and the rows of a briefing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import UNKNOWN, fold, known, ratio, slug

# Needs and programs that rules cover, thresholds of the gates.
COVERED_GAPS = ("model_serving", "llm_customization", "data_acceleration", "computer_vision")
COVERED_PROGRAMS = ("inception_program_fit", "partner_ecosystem")
LEAST_CONFIDENCE, TOO_MANY_UNKNOWN = 0.60, 3
# Connective words that a narrative may use beyond its prompt.
CONNECTIVES = (
    "a", "an", "and", "are", "as", "at", "based", "briefing", "but", "by", "claim", "claims", "evidence", "for", "from", "has",
    "have", "in", "is", "it", "next", "no", "of", "on", "or", "public", "recommend", "recommendation", "review", "risk",
    "should", "source", "startup", "that", "the", "this", "to", "unknown", "use", "validated", "with",
)


def severity_score(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def source_quality(kind: Column) -> Column:
    of = lambda w: F.contains(kind, F.lit(w))
    return F.when(of("documentation"), 1.0).when(of("developer"), 0.9).when(of("program"), 0.8).otherwise(0.5)


def technical_score(severity: Column, gap_confidence: Column, confidence: Column, source: Column, score: Column) -> Column:
    share = F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0)) / 10.0
    return severity_score(severity) * 100 + (gap_confidence + confidence) / 2 * 10 + source_quality(source) * 5 + share


def program_score(confidence: Column, source: Column, score: Column) -> Column:
    return confidence * 10 + source_quality(source) * 5 + F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0)) / 10.0


# Fixed value: a reason of the gap space that speaks for it.
GAP_SPACE_READY = "gap_space_ready_for_recommendation"


def blocking_reasons(
    ready: Column, assessed: Column, conflict: Column, high_risk: Column, unknown: Column, unknown_names: Column, gap_ready: Column,
    gap_reasons: Column | None = None,
) -> Column:
    """Reasons in order; unknown: how many field values are unknown, over the run as the default; the gap space's own reasons come
    last."""
    many, none = unknown >= TOO_MANY_UNKNOWN, F.array().cast("array<string>")
    first = F.array(
        F.when(~ready, "collection_quality_not_ready"),
        F.when(~assessed, "assessment_not_ready_for_recommendation"),
        F.when(conflict, "conflicting_startup_evidence"),
        F.when(high_risk, "high_wrapper_risk"),
        F.when(many, "excessive_unknown_fields"),
    )
    names = F.when(many, F.transform(unknown_names, lambda n: F.concat(F.lit("unknown_field:"), n))).otherwise(none)
    last = F.array(F.when(~gap_ready, "gap_space_not_ready_for_recommendation"))
    own = F.coalesce(F.filter(gap_reasons, lambda r: r != GAP_SPACE_READY), none) if gap_reasons is not None else none
    return F.array_compact(F.concat(first, names, last, F.when(~gap_ready, own).otherwise(none)))


def gate(blocked: Column, evidences: Column, gap_type: Column, official: Column, confidence: Column) -> Column:
    """struct(state, reason): the first gate that a gap does not pass, in order; supported if it passes all."""
    result = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).cast("string").alias("reason"))
    return (
        F.when(F.size(blocked) > 0, F.struct(F.lit("blocked").alias("state"), F.get(blocked, F.lit(0)).alias("reason")))
        .when(evidences == 0, result("blocked", "missing_startup_gap_evidence"))
        .when(~gap_type.isin(*COVERED_GAPS), result("hypothesis", "gap_type_not_covered_by_recommendation_rules"))
        .when(~F.coalesce(official, F.lit(False)), result("hypothesis", "missing_official_citation"))
        .when(confidence < LEAST_CONFIDENCE, result("hypothesis", "low_gap_confidence"))
        .otherwise(result("supported", None))
    )


def program_gate(blocked: Column, evidences: Column, opportunity_type: Column, official: Column, confidence: Column) -> Column:
    """struct(state, reason) of a program opportunity: as `gate`, by the rules for programs."""
    result = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).cast("string").alias("reason"))
    return (
        F.when(F.size(blocked) > 0, F.struct(F.lit("blocked").alias("state"), F.get(blocked, F.lit(0)).alias("reason")))
        .when(evidences == 0, result("blocked", "missing_startup_opportunity_evidence"))
        .when(~opportunity_type.isin(*COVERED_PROGRAMS), result("hypothesis", "opportunity_type_not_covered_by_program_rules"))
        .when(~F.coalesce(official, F.lit(False)), result("hypothesis", "missing_official_citation"))
        .when(confidence < LEAST_CONFIDENCE, result("hypothesis", "low_opportunity_confidence"))
        .otherwise(result("supported", None))
    )


def rank_recommendations(scored: DataFrame, by: str = "startup") -> DataFrame:
    """rank of each supported recommendation: by score, then gap type, document and chunk."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "gap_type", "document_id", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(order))


def top_per_gap(ranked: DataFrame, *by: str) -> DataFrame:
    """The first recommendation of each gap."""
    others = [c for c in ranked.columns if c not in by]
    return ranked.groupBy(*by).agg(F.min_by(F.struct(*others), "rank").alias("x")).select(*by, "x.*")


def priority(severity: Column, confidence: Column) -> Column:
    return F.when((severity == "high") & (confidence >= 0.75), "urgent").when(severity.isin("high", "medium"), "medium").otherwise("low")


def complexity(gap_type: Column) -> Column:
    return F.when(gap_type.isin("robotics_simulation", "healthcare_ai"), "high").when(gap_type == UNKNOWN, UNKNOWN).otherwise("medium")


def final_priority(recommendations: DataFrame, by: str = "startup") -> DataFrame:
    """by, final_priority, next_action over recommendations (state, kind: technical or program, priority)."""
    supported = F.col("state") == "supported"
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = recommendations.groupBy(by).agg(
        any_of(supported & (F.col("kind") == "technical")).alias("technical"),
        any_of(supported & (F.col("kind") == "program")).alias("program"),
        any_of(supported & (F.col("priority") == "urgent")).alias("urgent"),
        any_of(supported & (F.col("priority") == "medium")).alias("medium"),
        any_of(F.col("state") == "hypothesis").alias("guess"),
        any_of((F.col("state") == "hypothesis") & (F.col("kind") == "program")).alias("program_guess"),
        any_of(F.col("state") == "blocked").alias("blocked"),
    )
    c = F.col
    level = (
        F.when(~(c("technical") | c("program")), F.when(c("guess") | c("blocked"), "human_review").otherwise("low"))
        .when(c("urgent"), "urgent").when(c("medium"), "medium").otherwise("low")
    )
    out = seen.withColumn("final_priority", level)
    action = (
        F.when(c("technical") & c("final_priority").isin("urgent", "medium"), "prepare_technical_outreach")
        .when(c("program") & c("final_priority").isin("urgent", "medium", "low"), "prepare_program_outreach")
        .when(c("program_guess"), "validate_program_fit_with_human").when(c("guess"), "validate_fit_with_human")
        .when(c("blocked"), "resolve_blocking_evidence").otherwise("deprioritize_for_now")
    )
    return out.select(by, "final_priority", action.alias("next_action"))


def recommendation_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[known(slug(p)) for p in parts])


def metrics(recommendations: DataFrame) -> DataFrame:
    """One row: counts by state, with official citation, with evidence (state, official, evidences), and their shares."""
    n = recommendations.agg(
        F.count("*").alias("recommendations"),
        F.count_if(F.col("state") == "supported").alias("supported"),
        F.count_if(F.col("state") == "hypothesis").alias("hypotheses"),
        F.count_if(F.col("state") == "blocked").alias("blocked"),
        F.count_if("official").alias("official_cited"),
        F.count_if(F.col("evidences") > 0).alias("with_evidence"),
    )
    share = lambda c: ratio(F.col(c), F.col("recommendations")).alias(f"{c}_share")
    return n.select("*", *map(share, ("supported", "official_cited", "with_evidence")))


def outcome(startups: DataFrame) -> DataFrame:
    """outcome of a run (has_briefing, needs_review by startup): the best that any startup reached."""
    seen = startups.agg(F.bool_or("has_briefing").alias("b"), F.bool_or("needs_review").alias("r"))
    none = lambda c: F.coalesce(F.col(c), F.lit(False))
    return seen.select(F.when(none("b"), "briefing").when(none("r"), "human_review").otherwise("needs_more_collection").alias("outcome"))


def briefing_claims(*parts: DataFrame) -> DataFrame:
    """startup, claims, references: claims (startup, order, claim_type, text, source_url) of all parts in order, each text once
    (first wins)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy("startup", "claim_type", "text").agg(F.min("order").alias("order"), F.min_by("source_url", "order").alias("source_url"))
    claims = F.array_sort(F.collect_list(F.struct("order", "claim_type", "text", "source_url")))
    held = one.groupBy("startup").agg(claims.alias("claims"))
    return held.withColumn("references", F.array_distinct(F.array_compact(F.transform("claims", lambda c: c["source_url"]))))


def human_review(blocked: DataFrame, unknown: DataFrame, conflicts: DataFrame) -> DataFrame:
    """startup, reasons, unknowns, conflicts, questions: what a person has to look at (rows: startup, reason / field)."""
    sets = lambda df, c, name: df.groupBy("startup").agg(F.array_sort(F.collect_set(c)).alias(name))
    joined = sets(blocked, "reason", "reasons").join(sets(unknown, "field", "unknowns"), "startup", "full_outer").join(sets(conflicts, "field", "conflicts"), "startup", "full_outer")
    none = F.array().cast("array<string>")
    filled = joined.select("startup", *[F.coalesce(c, none).alias(c) for c in ("reasons", "unknowns", "conflicts")])
    ask = F.concat(
        F.transform("unknowns", lambda f: F.concat(F.lit("What is known about "), f, F.lit("?"))),
        F.transform("conflicts", lambda f: F.concat(F.lit("Which value of "), f, F.lit(" holds?"))),
    )
    return filled.withColumn("questions", ask)


def first_retrieval(asked: DataFrame, retrievals: DataFrame, key: str, kind: str, topics: str = "topics") -> DataFrame:
    """asked (key, kind, ...) with query_id of the earliest retrieval (key, query_id, pos, query, topics) that speaks of its kind: a
    result's topic is the kind, or the folded query holds it in words. Without one: null.

    A startup has few retrievals and few gaps: both sides meet on its key, and one is kept a gap.
    """
    words = F.replace(F.col(kind), F.lit("_"), F.lit(" "))
    held = retrievals.select(F.col(key), "query_id", F.col("pos").alias("r_pos"), fold(F.col("query")).alias("r_query"), F.col(topics).alias("r_topics"))
    said = F.contains("r_query", words) | F.coalesce(F.array_contains("r_topics", F.col(kind)), F.lit(False))
    best = asked.select(key, kind).distinct().join(held, key).where(said).groupBy(key, kind).agg(F.min_by("query_id", "r_pos").alias("query_id"))
    return asked.join(best, [key, kind], "left")


def program_opportunities(gaps: DataFrame, opportunities: DataFrame, retrievals: DataFrame, key: str = "startup") -> DataFrame:
    """key, opportunity_type, gap_type, description, confidence, is_hypothesis: a program opportunity for each sourced gap of a
    startup that has a retrieval on the program (has_program) and none of that opportunity's type yet."""
    kind = "inception_program_fit"
    ready = retrievals.where("has_program").select(key).distinct()
    already = opportunities.where(F.col("opportunity_type") == kind).select(key).distinct()
    able = gaps.where((F.col("gap_type") != UNKNOWN) & (F.col("evidences") > 0)).join(ready.hint("merge"), key, "left_semi").join(already.hint("merge"), key, "left_anti")
    text = F.concat(F.lit("Program support for "), "gap_type", F.lit(": "), "description")
    return able.select(key, F.lit(kind).alias("opportunity_type"), "gap_type", text.alias("description"), "confidence", "is_hypothesis")


def rank_programs(scored: DataFrame, by: str = "startup") -> DataFrame:
    """rank of each program recommendation: by score, then opportunity type, document and chunk; and whether it leads its type."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "opportunity_type", "document_id", "chunk_index")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    leads = F.row_number().over(Window.partitionBy(by, "opportunity_type").orderBy("rank")) == 1
    label = F.when(leads, "top_recommendation_for_opportunity").otherwise("alternative_recommendation_for_opportunity")
    return ranked.withColumn("selection", label)


def narrative_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0))


def unsupported_terms(content: Column, prompt: Column) -> Column:
    """Terms of a narrative that neither its prompt nor the connectives hold."""
    allowed = F.concat(narrative_terms(prompt), F.array(*map(F.lit, CONNECTIVES)))
    return F.array_except(narrative_terms(content), allowed)


def guarded_narrative(content: Column, prompt: Column, fallback: Column) -> Column:
    """The narrative if all its terms are supported and both its sections have text, else the fallback."""
    section = lambda name: F.trim(F.regexp_extract(content, rf"(?is)(?:^|\n)\s*{name}:(.*?)(?=\n\s*(?:technical_gap_narrative|commercial_approach_narrative):|\z)", 1))
    whole = (section("technical_gap_narrative") != "") & (section("commercial_approach_narrative") != "")
    return F.when(whole & (F.size(unsupported_terms(content, prompt)) == 0), content).otherwise(fallback)
