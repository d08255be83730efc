"""Briefings: what is known of a startup as typed claims in order, with their references, open questions and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import UNKNOWN

_NONE = "array<string>"
#: Claims in the order in which a briefing makes them.
TYPES = ("profile", "diagnosis", "opportunity", "risk", "recommendation", "unknown")


def claims(rows: DataFrame, kind: str, text: Column, pos: Column, evidences: Column | None = None, citations: Column | None = None) -> DataFrame:
    """Claims of one type: startup, order (type, then pos), claim_type, text, evidences and citations (URLs)."""
    held = lambda c: F.coalesce(c, F.array().cast(_NONE)) if c is not None else F.array().cast(_NONE)
    order = F.struct(F.lit(TYPES.index(kind)).alias("kind"), pos.cast("bigint").alias("pos"))
    return rows.select("startup", order.alias("order"), F.lit(kind).alias("claim_type"), text.alias("text"), held(evidences).alias("evidences"), held(citations).alias("citations"))


def profile_claims(fields: DataFrame) -> DataFrame:
    """fields: startup, field, pos, value, evidences. Known fields are claims, unknown ones are claims that they are not known."""
    known = fields.where(F.col("value") != UNKNOWN)
    lost = fields.where(F.col("value") == UNKNOWN)
    said = claims(known, "profile", F.concat("field", F.lit(": "), "value"), F.col("pos"), F.col("evidences"))
    return said.unionByName(claims(lost, "unknown", F.concat(F.lit("unknown: "), "field"), F.col("pos")))


def executive(all_claims: DataFrame, outcome: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a startup: status, claims in order (a text once, at its first place), references in the order of claims, open
    questions, priority and next action.

    outcome: startup, ready, classification, final_priority, next_action. questions: startup, pos, question.
    """
    once = all_claims.groupBy("startup", "claim_type", "text").agg(
        F.min("order").alias("order"), F.min_by("evidences", "order").alias("evidences"), F.min_by("citations", "order").alias("citations")
    )
    held = once.groupBy("startup").agg(F.array_sort(F.collect_list(F.struct("order", "claim_type", "text", "evidences", "citations"))).alias("claims"))
    refs = lambda f: F.array_distinct(F.flatten(F.transform("claims", lambda c: c[f])))
    asked = questions.groupBy("startup").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "question"))), lambda q: q["question"])).alias("questions"))
    joined = outcome.join(held.hint("merge"), "startup", "left").join(asked.hint("merge"), "startup", "left")
    summary = F.concat("startup", F.lit(": "), "classification", F.lit(", priority "), "final_priority", F.lit(", next "), "next_action")
    return joined.select(
        "startup", F.when(F.col("ready"), "ready_for_use").otherwise("ready_for_human_review").alias("status"), summary.alias("summary"),
        F.coalesce(F.transform("claims", lambda c: F.struct(c["claim_type"].alias("claim_type"), c["text"].alias("text"))), F.array()).alias("claims"),
        F.coalesce(refs("evidences"), F.array().cast(_NONE)).alias("evidence_references"), F.coalesce(refs("citations"), F.array().cast(_NONE)).alias("citation_references"),
        F.coalesce("questions", F.array().cast(_NONE)).alias("questions"), "next_action",
    )


def human_review(outcome: DataFrame, reasons: DataFrame, fields: DataFrame, groups: DataFrame, gaps: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row a startup: why it needs a person, what is unknown or in conflict, suspected gaps, recommendations by state, and what
    to ask, each list in a fixed order.

    reasons: startup, pos, reason; fields: startup, field, value; groups: startup, field, has_conflict; gaps: startup, gap_type;
    recommendations: startup, id, state.
    """
    ordered = lambda df, name, item, by=None: df.groupBy("startup").agg(
        (F.array_sort(F.collect_set(item)) if by is None else F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(by, item))), lambda x: x[item]))).alias(name)
    )
    of_state = lambda s: ordered(recommendations.where(F.col("state") == s), s, "id")
    parts = [
        ordered(reasons, "reasons", "reason", "pos"), ordered(fields.where(F.col("value") == UNKNOWN), "unknowns", "field"),
        ordered(groups.where("has_conflict"), "conflicts", "field"), ordered(gaps.where(F.col("gap_type") != UNKNOWN), "suspected_gaps", "gap_type"),
        of_state("supported"), of_state("hypothesis"), of_state("blocked"),
    ]
    out, names = outcome, ("reasons", "unknowns", "conflicts", "suspected_gaps", "supported", "hypothesis", "blocked")
    for p in parts:
        out = out.join(p.hint("merge"), "startup", "left")
    out = out.withColumns({n: F.coalesce(n, F.array().cast(_NONE)) for n in names})
    ask = F.concat(
        F.transform("unknowns", lambda f: F.concat(F.lit("What is known about "), f, F.lit("?"))),
        F.transform("conflicts", lambda f: F.concat(F.lit("Which value of "), f, F.lit(" holds?"))),
        F.transform("hypothesis", lambda r: F.concat(F.lit("Does "), r, F.lit(" fit?"))),
    )
    return out.select("startup", F.lit("ready_for_human_review").alias("status"), *names, ask.alias("questions"), "next_action")


def cited_chunks(results: DataFrame, citations: DataFrame) -> DataFrame:
    """The retrieved chunks that something cites, once each: only those go into a prompt."""
    return results.join(citations.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["query_id", "chunk_id"])
