"""The whole run as stages of DataFrames: search results and pages to ranked recommendations and their outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import UNKNOWN
from quarrylight.operators import assessment, corpus, entities, profiles, recommend, retrieval
from quarrylight.operators.assessment import Vocabulary
from quarrylight.operators.pages import extract
from quarrylight.operators.policy import OfficialSources, scrape_reason
from quarrylight.plans import downstream
from quarrylight.sources.connectors import fetch, http_get
from quarrylight.tables import written


def profile_pages(html: DataFrame) -> DataFrame:
    """Collected HTML (key, url, html, collected_at, name) as pages that profiles are read from, in order of their URLs."""
    order = Window.partitionBy("key").orderBy("url")
    return extract(html).withColumn("pos", F.row_number().over(order) - 1).select("key", "pos", "url", "title", "main_text", "collected_at", "name")


def controlled_run(spark: SparkSession, url: str, name: str = UNKNOWN, get: Callable[[str], tuple[str, int, str]] = http_get, blocked: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """One known site without a search: its candidate, pages, profile fields, evidence groups and quality. A site that the policy
    refuses, or that is not known, has no pages but an error."""
    site = spark.range(1).select(entities.known_site(F.lit(url), F.lit(name)).alias("c")).select(F.lit(0).cast("bigint").alias("pos"), "c.*")
    judged = site.select("primary_url", scrape_reason(F.col("primary_url"), blocked).alias("reason")).first()
    asked = site.where(F.lit(judged["reason"] == "allowed")).where(F.col("primary_url") != UNKNOWN)
    got = fetch(asked.select(F.lit(url).alias("url")), get)
    failed = got.where("is_error").select("url", "error_category")
    refused = site.select(F.col("primary_url").alias("url"), F.lit("missing_primary_url" if judged["primary_url"] == UNKNOWN else judged["reason"]).alias("error_category"))
    errors = failed if judged["reason"] == "allowed" and judged["primary_url"] != UNKNOWN else refused
    html = got.where("NOT is_error").select(F.lit(0).cast("bigint").alias("key"), "url", "html", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_at"), F.lit(name).alias("name"))
    read = profile_pages(html)
    fields = profiles.profile_fields(read)
    return {
        "candidates": site, "pages": read, "errors": errors, "profile_fields": fields, "evidence_groups": profiles.evidence_groups(fields.withColumn("pos", F.lit(0))),
        "quality": profiles.collection_quality(1, fields),
    }


def _stages(out: dict[str, DataFrame]) -> Callable[[str, Callable[[], DataFrame]], DataFrame]:
    """Makes a stage by name unless it is there, and writes it: later stages and readers share one pass."""

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in out:
            out[name] = written(make(), f"run-{name}")
        return out[name]

    return stage


def _assessed(stage: Callable[[str, Callable[[], DataFrame]], DataFrame], results: DataFrame, pages: DataFrame, words: Vocabulary) -> tuple[DataFrame, ...]:
    """Profile fields, evidence groups, texts, classified startups, wrapper risks and technical gaps of a run."""
    found = stage("candidates", lambda: entities.deduplicate(entities.candidates(results)))
    fields = stage("profile_fields", lambda: profiles.profile_fields(pages))
    n = found.agg(F.count("*").alias("candidates"))
    quality = stage("quality", lambda: profiles.collection_quality(n, fields))
    groups = stage("evidence_groups", lambda: profiles.evidence_groups(fields.withColumn("pos", F.lit(0))))
    said = F.concat(F.array("value"), F.transform("evidences", lambda e: e["snippet"]))
    texts = (
        fields.where(F.col("value") != UNKNOWN)
        .groupBy(F.col("key").alias("startup"))
        .agg(
            F.array_join(F.flatten(F.array_sort(F.collect_list(said))), " ").alias("text"),
            F.max(F.when(F.col("field") == "ai_signals", F.col("value"))).alias("signals"),
        )
    )
    ready = quality.select("ready")
    classified = stage(
        "assessments",
        lambda: assessment.classify(assessment.criteria(texts.crossJoin(F.broadcast(ready)).where("ready").drop("ready"), signals="signals", words=words)),
    )
    risks = stage("wrapper_risks", lambda: assessment.wrapper_risks(classified, "startup"))
    gaps = stage("technical_gaps", lambda: assessment.technical_gaps(classified, "startup", words=words))
    return fields, groups, texts, classified, risks, gaps


SOURCED = ("product", "sector", "technologies_used", "ai_signals")


def run_startups(
    results: DataFrame,
    pages: DataFrame,
    knowledge: downstream.Knowledge,
    words: Vocabulary = assessment.DEFAULT,
    stored: dict[str, DataFrame] | None = None,
    earlier: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """A whole run: upstream stages from search results and pages, then each startup through the downstream workflow. stored: upstream
    artifacts that are taken as they are; earlier: downstream tables of a run before, reused for startups whose inputs are the same.

    A startup that was not assessed (its run was not ready) does not go downstream.
    """
    out = dict(stored or {})
    stage = _stages(out)
    fields, groups, texts, classified, risks, gaps = _assessed(stage, results, pages, words)
    conflicts = groups.where("has_conflict").select(F.col("key").alias("startup"), "field")
    judged = stage("diagnosis", lambda: assessment.diagnosis(classified, gaps, risks, conflicts, "startup"))
    high = risks.groupBy("startup").agg(F.bool_or(F.col("severity") == "high").alias("high_risk"))
    sourced = fields.where(F.col("field").isin(*SOURCED)).groupBy(F.col("key").alias("startup")).agg(F.sum(F.size("evidences")).cast("bigint").alias("evidences"))
    run_quality = F.broadcast(out["quality"].select(F.col("ready").alias("collection_ready"), F.col("reasons").alias("collection_reasons")))  # one row
    told = judged.select("startup", "classification", "confidence", F.col("ready").alias("diagnosis_ready"), F.col("reasons").alias("diagnosis_reasons"))
    states = told.join(high, "startup", "left").join(texts.select("startup", F.coalesce("signals", F.lit("")).alias("signals")), "startup", "left").crossJoin(run_quality)
    sold = assessment.opportunities(classified.join(judged.select("startup", F.col("ready").alias("is_ready")), "startup"), "startup", "is_ready", words)
    held = {
        "profiles": states,
        "gaps": gaps.join(sourced, "startup", "left").withColumns({"evidences": F.coalesce("evidences", F.lit(0)), "description": F.col("gap_type")}),
        "opportunities": sold.join(sourced, "startup", "left").withColumn("evidences", F.coalesce("evidences", F.lit(0))),
        "fields": fields.select(F.col("key").alias("startup"), "field", F.row_number().over(Window.partitionBy("key").orderBy("field")).alias("pos"), "value", F.transform("evidences", lambda e: e["url"]).alias("evidences")),
        "groups": groups.select(F.col("key").alias("startup"), "field", "has_conflict"),
    }
    assessed = judged.select("startup")
    inputs = downstream.Inputs(**{k: written(v.join(assessed, "startup", "left_semi"), f"inputs-{k}") for k, v in held.items()})
    out |= downstream.run(inputs, knowledge, earlier)
    out["events"], out["outcome"] = downstream.events(out["states"]), downstream.outcome(out["states"])
    return out


def run_intelligence(
    results: DataFrame,
    pages: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    official: OfficialSources,
    words: Vocabulary = assessment.DEFAULT,
    k: int = 3,
    stored: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All artifacts of a run by name. `stored` ones are taken as they are and not computed again.

    results: see entities.candidates; pages: see profiles.profile_fields (key: the candidate's pos); documents, chunks: see
    corpus.read_corpus. Assessments need a run that is ready; otherwise they have no rows.
    """
    out = dict(stored or {})
    stage = _stages(out)
    fields, groups, texts, classified, risks, gaps = _assessed(stage, results, pages, words)
    conflicts = groups.where("has_conflict").select(F.col("key").alias("startup"), "field")
    diagnosis = stage("diagnosis", lambda: assessment.diagnosis(classified, gaps, risks, conflicts, "startup"))
    sourced = fields.where(F.col("field").isin("product", "sector", "technologies_used", "ai_signals")).groupBy(F.col("key").alias("startup")).agg(F.sum(F.size("evidences")).alias("evidences"))
    gaps = gaps.join(sourced, "startup", "left").withColumn("evidences", F.coalesce("evidences", F.lit(0)))
    stacks = corpus.stack_profiles(documents, chunks)
    targets = corpus.stack_targets(gaps.select("gap_type").distinct(), stacks)
    reasons = diagnosis.where("NOT ready").select("startup", F.array(F.lit("assessment_not_ready_for_recommendation")).alias("reasons"))
    space = stage("gap_space", lambda: assessment.gap_space(gaps, targets, reasons, "startup"))
    none = F.lit("")
    asked = gaps.where(F.col("gap_type") != UNKNOWN).join(texts.select("startup", "signals"), "startup").select(
        F.concat_ws("/", F.col("startup").cast("string"), "gap_type").alias("query_id"), "startup", "gap_type", "severity", "confidence", "evidences",
        retrieval.query_text(F.col("gap_type"), none, none, F.coalesce("signals", none), none).alias("query"),
    )
    hits = stage("retrievals", lambda: corpus.citations(retrieval.bm25(chunks, asked, k), chunks, documents))
    best = hits.withColumn("is_official", official.accepts(F.col("source_url"))).withColumnRenamed("score", "hit")
    blocked = space.where("support_status = 'unsupported'").groupBy("startup", "gap_type").agg(F.array_distinct(F.flatten(F.collect_list("review_reasons"))).alias("blocked"))
    joined = asked.join(best.drop("query"), "query_id", "left").join(diagnosis.select("startup", "ready", F.col("confidence").alias("sure")), "startup")
    joined = joined.join(blocked, ["startup", "gap_type"], "left")
    stop = F.when(~F.col("ready"), F.array(F.lit("assessment_not_ready_for_recommendation"))).otherwise(F.coalesce("blocked", F.array().cast("array<string>")))
    gate = recommend.gate(stop, F.col("evidences"), F.col("gap_type"), F.col("is_official"), F.col("confidence"))
    score = recommend.technical_score(F.col("severity"), F.col("confidence"), F.col("sure"), F.coalesce("source_type", none), F.coalesce("hit", F.lit(0.0)))
    scored = joined.select(
        "startup", "gap_type", "document_id", "chunk_index", F.lit("technical").alias("kind"), gate["state"].alias("state"), gate["reason"].alias("reason"),
        score.alias("score"), recommend.priority(F.col("severity"), F.col("confidence")).alias("priority"),
    )
    recommended = stage("recommendations", lambda: recommend.rank_recommendations(scored))
    final = stage("priorities", lambda: recommend.final_priority(recommended))
    stage("outcome", lambda: recommend.outcome(final.select((F.col("final_priority") != "human_review").alias("has_briefing"), (F.col("final_priority") == "human_review").alias("needs_review"))))
    return out
