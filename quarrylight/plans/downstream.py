"""The downstream workflow, startup by startup, as one state table: readiness, gap space, retrieval, recommendations, briefing, outcome.

A node is a transform of the rows that are routed to it; what a startup went through is its branches and errors, in order. All startups go
through a node together, each node's result is written once, and no node is run for rows that took another branch. Joins by startup or
query are merges: a table of startups that is small as Parquet is many times that as a broadcast, in the driver too.

  ready_for_recommendation                 gap space and retrieval, then recommendations
  needs_more_collection_or_human_review    recommendations without retrievals (all of them blocked), then a review
  ready_for_briefing / human_review_requested    an executive briefing or one for a person
  briefing_generated                       after an executive briefing

A startup's inputs have a fingerprint. `run` takes the tables of an earlier run and goes only through startups that are new or whose
fingerprint has changed; the others' rows are taken as they are, and startups that are gone go.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import UNKNOWN
from quarrylight.operators import assessment, briefing, corpus, recommend, retrieval
from quarrylight.operators.policy import OfficialSources
from quarrylight.sources.store import fingerprint, row_fingerprint
from quarrylight.tables import written

_STRINGS = "array<string>"
BRANCH = "array<struct<branch:string,next_action:string,audit_reason:string>>"
ERROR = "array<struct<step:string,error_type:string,audit_reason:string>>"
#: Tables of a run. All have the column startup.
TABLES = ("states", "gap_space", "retrievals", "recommendations", "executive_briefings", "review_briefings")


@dataclass(frozen=True)
class Inputs:
    """What upstream has found, each with a column startup.

    profiles: collection_ready, collection_reasons, classification, confidence, diagnosis_ready, diagnosis_reasons, high_risk, signals
    (text); gaps: gap_type, severity, confidence, is_hypothesis, evidences (n), description; opportunities: opportunity_type, confidence,
    is_hypothesis, evidences (n); fields: field, pos, value, evidences (URLs); groups: field, has_conflict.
    """

    profiles: DataFrame
    gaps: DataFrame
    opportunities: DataFrame
    fields: DataFrame
    groups: DataFrame

    def only(self, startups: DataFrame) -> Inputs:
        return replace(self, **{n: getattr(self, n).join(startups.hint("merge"), "startup", "left_semi") for n in self.__dataclass_fields__})

    def fingerprints(self, knowledge_version: str) -> DataFrame:
        """startup, fingerprint over all its rows, whatever their order, and the version of what is asked."""
        rows = None
        for name in self.__dataclass_fields__:
            df = getattr(self, name)
            part = df.select("startup", F.lit(f"{knowledge_version}/{name}").alias("kind"), row_fingerprint(*sorted(c for c in df.columns if c != "startup")).alias("row"))
            rows = part if rows is None else rows.unionByName(part)
        return fingerprint(rows, ["startup"], "kind", "row")


@dataclass(frozen=True)
class Knowledge:
    """What recommendations cite. documents and chunks (as of corpus.read_corpus) or none; a retriever other than the default;
    retrievals that were given for all startups' queries (preset)."""

    official: OfficialSources
    version: str = ""
    documents: DataFrame | None = None
    chunks: DataFrame | None = None
    retriever: retrieval.Retriever | None = None
    preset: DataFrame | None = None
    k: int = 1
    program_topics: tuple[str, ...] = ("inception",)


def _branch(name: str, action: str, reason: Column) -> Column:
    return F.array(F.struct(F.lit(name).alias("branch"), F.lit(action).alias("next_action"), reason.alias("audit_reason")))


def readiness(profiles: DataFrame) -> DataFrame:
    """profiles with their first branch."""
    ready = F.col("collection_ready") & F.col("diagnosis_ready")
    reasons = F.array_join(F.concat(*[F.coalesce(c, F.array().cast(_STRINGS)) for c in ("collection_reasons", "diagnosis_reasons")]), ";")
    on = _branch("ready_for_recommendation", "retrieve_knowledge", F.lit("collection_and_assessment_ready_for_recommendation"))
    off = _branch("needs_more_collection_or_human_review", "generate_human_review_briefing", F.coalesce(F.nullif(reasons, F.lit("")), F.lit("upstream_not_ready_for_recommendation")))
    return profiles.withColumns({"route": F.when(ready, "ready").otherwise("review"), "branches": F.when(ready, on).otherwise(off).cast(BRANCH), "errors": F.array().cast(ERROR)})


def gap_spaces(states: DataFrame, inputs: Inputs, knowledge: Knowledge) -> DataFrame:
    """Gap spaces of the startups on the ready route; none where there is nothing to map to."""
    gaps = inputs.gaps.join(states.where("route = 'ready'").select("startup").hint("merge"), "startup", "left_semi")
    if knowledge.documents is None or knowledge.chunks is None:
        return assessment.gap_space(gaps.limit(0), gaps.limit(0).select("gap_type", F.lit("").alias("document_id")), gaps.limit(0).select("startup", F.array().cast(_STRINGS).alias("reasons")), "startup")
    targets = corpus.stack_targets(gaps.select("gap_type").distinct(), corpus.stack_profiles(knowledge.documents, knowledge.chunks))
    none = states.limit(0).select("startup", F.array().cast(_STRINGS).alias("reasons"))
    return assessment.gap_space(gaps, targets, none, "startup")


def queries(states: DataFrame, space: DataFrame, inputs: Inputs, knowledge: Knowledge) -> DataFrame:
    """query_id, startup, gap_type, query of the ready route: what gap spaces ask; without knowledge to map to, each known gap."""
    signals = states.select("startup", "signals")
    if knowledge.documents is not None:
        asked = assessment.retrieval_requests(space, signals, "startup")
    else:
        gaps = inputs.gaps.where(F.col("gap_type") != UNKNOWN).join(states.where("route = 'ready'").select("startup").hint("merge"), "startup", "left_semi")
        none = F.lit("")
        asked = gaps.join(signals.hint("merge"), "startup").select("startup", "gap_type", retrieval.query_text(F.col("gap_type"), none, none, F.coalesce("signals", none), none).alias("query"))
    return asked.select(F.concat_ws("/", F.col("startup").cast("string"), "gap_type").alias("query_id"), "startup", "gap_type", "query")


CITED = ("query_id", "startup", "gap_type", "rank", "score", "document_id", "chunk_id", "chunk_index", "source_url", "source_type", "topics")


def retrieve(asked: DataFrame, knowledge: Knowledge) -> tuple[DataFrame, DataFrame]:
    """Cited results of the queries, and errors (startup, step, error_type, audit_reason) of those that nothing can answer."""
    retriever = knowledge.retriever or (retrieval.Lexical(knowledge.chunks) if knowledge.chunks is not None else None)
    none = asked.limit(0).select("query_id", *[F.lit(None).cast(t).alias(c) for c, t in (("chunk_id", "string"), ("document_id", "string"), ("chunk_index", "int"), ("score", "double"), ("rank", "int"))])
    marked = asked.select("query_id", "query", F.lit(False).alias("skip"))
    found, missing = retrieval.routed(marked, none, knowledge.preset if knowledge.preset is not None else none, retriever, knowledge.k)
    errors = asked.join(missing.hint("merge"), "query_id").select("startup", F.lit("retrieve_knowledge").alias("step"), "error_type", F.col("reason").alias("audit_reason")).distinct()
    found = found.select("query_id", "chunk_id", "score", "rank").join(asked.select("query_id", "startup", "gap_type").hint("merge"), "query_id")
    if knowledge.documents is None or knowledge.chunks is None:
        blank = {c: F.lit(None).cast("string") for c in ("document_id", "source_url", "source_type")} | {"chunk_index": F.lit(None).cast("int"), "topics": F.array().cast(_STRINGS)}
        return found.withColumns(blank).select(*CITED), errors
    about = knowledge.documents.select("document_id", "source_url", "source_type")
    placed = knowledge.chunks.select(F.col("chunk_id"), "document_id", "chunk_index", F.array("topic").alias("topics"))
    return found.join(placed, "chunk_id").join(about, "document_id").select(*CITED), errors


def recommendations(states: DataFrame, inputs: Inputs, space: DataFrame, hits: DataFrame, knowledge: Knowledge) -> DataFrame:
    """startup, kind (technical, program), subject (gap or opportunity type), state, reason, score, priority, rank, and the citation."""
    unknown = inputs.fields.groupBy("startup").agg(F.count_if(F.col("value") == UNKNOWN).alias("unknown"), F.array_sort(F.collect_set(F.when(F.col("value") == UNKNOWN, F.col("field")))).alias("unknown_names"))
    conflict = inputs.groups.groupBy("startup").agg(F.bool_or("has_conflict").alias("conflict"))
    facts = states.select("startup", "collection_ready", "diagnosis_ready", "high_risk", F.col("confidence").alias("sure"), "route")
    facts = facts.join(unknown.hint("merge"), "startup", "left").join(conflict.hint("merge"), "startup", "left").hint("merge")
    mapped = space.select("startup", "gap_type", "support_status", "review_reasons")
    cited = hits.withColumn("official", knowledge.official.accepts(F.col("source_url"))).drop("query_id")
    no, none = F.lit(False), F.array().cast(_STRINGS)
    gaps = inputs.gaps.where(F.col("gap_type") != UNKNOWN).join(facts, "startup").join(mapped.hint("merge"), ["startup", "gap_type"], "left").join(cited.hint("merge"), ["startup", "gap_type"], "left")
    unready = (F.col("support_status") == "unsupported") if knowledge.documents is not None else no
    blocked = recommend.blocking_reasons(
        F.col("collection_ready"), F.col("diagnosis_ready"), F.coalesce("conflict", no), F.coalesce("high_risk", no), F.coalesce("unknown", F.lit(0)),
        F.coalesce("unknown_names", none), ~F.coalesce(unready, no), F.col("review_reasons"),
    )
    gate = recommend.gate(blocked, F.coalesce("evidences", F.lit(0)), F.col("gap_type"), F.col("official"), F.col("confidence"))
    hit, kind = F.coalesce("score", F.lit(0.0)), F.coalesce("source_type", F.lit(""))
    technical = gaps.select(
        "startup", F.lit("technical").alias("kind"), F.col("gap_type").alias("subject"), gate["state"].alias("state"), gate["reason"].alias("reason"),
        F.bround(recommend.technical_score(F.col("severity"), F.col("confidence"), F.col("sure"), kind, hit), 6).alias("score"),
        recommend.priority(F.col("severity"), F.col("confidence")).alias("priority"), "document_id", "chunk_index", "source_url", F.coalesce("official", no).alias("official"), "evidences",
    )
    about_program = F.exists(F.coalesce("topics", none), lambda t: t.isin(*knowledge.program_topics))
    programs = cited.withColumn("has_program", about_program)
    more = recommend.program_opportunities(inputs.gaps, inputs.opportunities, programs)
    sold = inputs.opportunities.select("startup", "opportunity_type", "confidence", "is_hypothesis", "evidences").unionByName(
        more.groupBy("startup", "opportunity_type").agg(F.max("confidence").alias("confidence"), F.bool_and("is_hypothesis").alias("is_hypothesis")).withColumn("evidences", F.lit(1).cast("bigint"))
    )
    best = F.min_by(F.struct("document_id", "chunk_index", "source_url", "source_type", "official", "score"), F.struct("rank", "document_id", "chunk_index"))
    offered = programs.where("has_program").groupBy("startup").agg(best.alias("p")).select("startup", "p.*")
    sold = sold.join(facts, "startup").join(offered.hint("merge"), "startup", "left")
    base = recommend.blocking_reasons(F.col("collection_ready"), F.col("diagnosis_ready"), F.coalesce("conflict", no), F.coalesce("high_risk", no), F.coalesce("unknown", F.lit(0)), F.coalesce("unknown_names", none), F.lit(True))
    gate = recommend.program_gate(base, F.coalesce("evidences", F.lit(0)), F.col("opportunity_type"), F.col("official"), F.col("confidence"))
    program = sold.select(
        "startup", F.lit("program").alias("kind"), F.col("opportunity_type").alias("subject"), gate["state"].alias("state"), gate["reason"].alias("reason"),
        F.bround(recommend.program_score(F.col("confidence"), kind, hit), 6).alias("score"), F.lit("low").alias("priority"), "document_id", "chunk_index", "source_url",
        F.coalesce("official", no).alias("official"), "evidences",
    )
    return recommend.rank_recommendations(technical.unionByName(program).withColumn("gap_type", F.col("subject"))).drop("gap_type")


def briefing_readiness(states: DataFrame, recommended: DataFrame) -> DataFrame:
    """states with the branch that their recommendations lead to: a briefing if all are supported, else a person."""
    has = lambda s: F.coalesce(F.bool_or(F.col("state") == s), F.lit(False))
    gates = F.array_sort(F.collect_set(F.when(F.col("reason").rlike("^(missing_|low_)|_not_covered_by_"), F.col("reason"))))
    seen = recommended.groupBy("startup").agg(has("supported").alias("s"), has("hypothesis").alias("h"), has("blocked").alias("b"), gates.alias("gates"))
    out = states.join(seen.hint("merge"), "startup", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("s", "h", "b")})
    why = F.array_compact(F.array(
        F.when(F.col("h"), "recommendation_hypothesis_requires_human_review"), F.when(F.col("b"), "blocked_recommendation_requires_human_review"),
        F.when(~(F.col("s") | F.col("h") | F.col("b")), "no_recommendation_candidate"),
    ))
    why = F.concat(why, F.coalesce("gates", F.array().cast(_STRINGS)))
    ready = F.col("s") & ~F.col("h") & ~F.col("b")
    on = F.concat(_branch("ready_for_briefing", "generate_executive_briefing", F.lit("supported_recommendation_ready")), _branch("briefing_generated", "prepare_technical_outreach", F.lit("executive_briefing_ready_for_use")))
    off = _branch("human_review_requested", "generate_human_review_briefing", F.array_join(why, ";"))
    kept = out.withColumns({"briefing_ready": ready, "review_reasons": why, "branches": F.concat("branches", F.when(ready, on).otherwise(off).cast(BRANCH))})
    return kept.drop("s", "h", "b", "gates")


def briefings(states: DataFrame, inputs: Inputs, space: DataFrame, recommended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Executive briefings of the startups that are ready for one, review briefings of the others."""
    action = states.select("startup", F.col("briefing_ready").alias("ready"), "classification", "final_priority", "next_action")
    is_ready = action.where("ready").select("startup")
    of = lambda df: df.join(is_ready.hint("merge"), "startup", "left_semi")
    made = of(recommended)
    url = F.array_compact(F.array("source_url"))
    claims = briefing.profile_claims(of(inputs.fields))
    claims = claims.unionByName(briefing.claims(action.where("ready"), "diagnosis", F.concat("startup", F.lit(": "), "classification"), F.lit(0)))
    claims = claims.unionByName(briefing.claims(made.where("kind = 'program'"), "opportunity", F.col("subject"), F.col("rank"), citations=url))
    claims = claims.unionByName(briefing.claims(made.where("kind = 'technical'"), "recommendation", F.col("subject"), F.col("rank"), citations=url))
    executive = briefing.executive(claims, action.where("ready"), made.limit(0).select("startup", F.lit(0).alias("pos"), F.lit("").alias("question")))
    others = action.where("NOT ready")
    reasons = states.where("NOT briefing_ready").select("startup", F.posexplode("review_reasons").alias("pos", "reason"))
    named = recommended.select("startup", recommend.recommendation_id(F.col("kind"), F.col("subject"), F.coalesce(F.col("document_id").cast("string"), F.lit(""))).alias("id"), "state")
    review = briefing.human_review(others, reasons, inputs.fields, inputs.groups, space.select("startup", "gap_type"), named)
    return executive, review


def _through(inputs: Inputs, knowledge: Knowledge) -> dict[str, DataFrame]:
    """All nodes for all startups of the inputs."""
    states = written(readiness(inputs.profiles), "states-readiness")
    space = written(gap_spaces(states, inputs, knowledge), "gap-space")
    hits, errors = retrieve(written(queries(states, space, inputs, knowledge), "queries"), knowledge)
    hits = written(hits, "retrievals")
    failed = errors.groupBy("startup").agg(F.array_sort(F.collect_list(F.struct("step", "error_type", "audit_reason"))).alias("failed"))
    made = written(recommendations(states, inputs, space, hits, knowledge), "recommendations")
    states = states.join(failed.hint("merge"), "startup", "left").withColumn("errors", F.coalesce(F.col("failed").cast(ERROR), F.col("errors"))).drop("failed")
    states = briefing_readiness(states, made).join(recommend.final_priority(made).hint("merge"), "startup", "left")
    late = F.when(F.col("briefing_ready"), "briefing_generated").when(F.col("route") == "review", "needs_more_collection_or_human_review").otherwise("human_review_requested")
    states = states.withColumns({"final_priority": F.coalesce("final_priority", F.lit("low")), "next_action": F.coalesce("next_action", F.lit("deprioritize_for_now")), "outcome": late})
    states = written(states, "states")
    executive, review = briefings(states, inputs, space, made)
    return {"states": states, "gap_space": space, "retrievals": hits, "recommendations": made, "executive_briefings": written(executive, "executive"), "review_briefings": written(review, "review")}


def run(inputs: Inputs, knowledge: Knowledge, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of a run (TABLES). stored: those of an earlier one, whose rows are kept for startups with the same fingerprint;
    states say of each startup whether it was `reused`."""
    prints = written(inputs.fingerprints(knowledge.version), "fingerprints").join(inputs.profiles.select("startup").hint("merge"), "startup", "left_semi")
    if stored is None:
        todo, kept = prints, None
    else:
        before = stored["states"].select("startup", F.col("fingerprint").alias("had"))
        todo = prints.join(before.hint("merge"), "startup", "left").where(~F.col("fingerprint").eqNullSafe(F.col("had"))).drop("had")
        todo = written(todo, "changed")
        kept = prints.join(todo.select("startup").hint("merge"), "startup", "left_anti").select("startup")
    out = _through(inputs.only(todo.select("startup")), knowledge)
    out["states"] = out["states"].join(todo.hint("merge"), "startup").withColumn("reused", F.lit(False))
    if kept is not None:
        for name in TABLES:
            old = stored[name].join(kept.hint("merge"), "startup", "left_semi")
            old = old.withColumn("reused", F.lit(True)) if name == "states" else old
            out[name] = out[name].unionByName(old.select(*out[name].columns))
    return out


def events(states: DataFrame) -> DataFrame:
    """startup, kind (branch, error), pos, name, audit_reason: what each startup went through, in order."""
    branches = states.select("startup", F.lit("branch").alias("kind"), F.posexplode("branches").alias("pos", "x")).select("startup", "kind", "pos", F.col("x.branch").alias("name"), "x.audit_reason")
    errors = states.select("startup", F.lit("error").alias("kind"), F.posexplode("errors").alias("pos", "x")).select("startup", "kind", "pos", F.col("x.error_type").alias("name"), "x.audit_reason")
    return branches.unionByName(errors)


def outcome(states: DataFrame) -> DataFrame:
    """One row: the best outcome of any startup, or that nothing came of the run."""
    any_of = lambda o: F.coalesce(F.bool_or(F.col("outcome") == o), F.lit(False))
    seen = states.agg(any_of("briefing_generated").alias("b"), any_of("human_review_requested").alias("r"))
    return seen.select(F.when(F.col("b"), "briefing_generated").when(F.col("r"), "human_review_requested").otherwise("needs_more_collection_or_human_review").alias("outcome"))


def save(tables: dict[str, DataFrame], write: Callable[[str, DataFrame], None]) -> dict[str, DataFrame]:
    """Writes each table by `write` (name, frame); a table that can't be written is an error of every startup, the others stay."""
    states, failed = tables["states"], []
    for name in TABLES[1:]:
        try:
            write(name, tables[name])
        except Exception as e:  # noqa: BLE001 - whatever a store raises is recorded
            failed.append((type(e).__name__, name))
    for kind, name in failed:
        error = F.array(F.struct(F.lit(f"persist_downstream_artifacts:{name}").alias("step"), F.lit(kind).alias("error_type"), F.lit("storage_failed_structured_error").alias("audit_reason")))
        states = states.withColumn("errors", F.concat("errors", error.cast(ERROR)))
    write("states", states)
    return tables | {"states": states}
