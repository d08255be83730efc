"""Registered queries over the downstream workflow, beside its states in SQL. Documents play startups: their texts are classified, their
sources are runs, labelled toxic ones hold conflicting evidence, and the benchmark's passages are what recommendations cite."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quarrylight.operators import assessment, recommend
from quarrylight.operators.policy import OfficialSources
from quarrylight.plans import downstream, oracles, queries
from quarrylight.plans.queries import WORDS
from quarrylight.plans.registry import query
from quarrylight.tables import table, written

GAPS = tuple(WORDS.gaps)
PROGRAM = "data_acceleration"


class _ByTopic:
    """Finds the passages on a query's subject, by its words: the first by id."""

    def __init__(self, chunks):
        self.topics = chunks.select(F.replace("topic", F.lit("_"), F.lit(" ")).alias("subject"), "chunk_id", "document_id", "chunk_index")

    def retrieve(self, asked, k):
        subject = F.element_at(F.filter(F.array(*[F.lit(g.replace("_", " ")) for g in GAPS]), lambda g: F.startswith(F.col("query"), g)), 1)
        best = self.topics.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("document_id", "chunk_index", "chunk_id"))).alias("cs"))  # a row a subject
        first = F.posexplode(F.slice("cs", 1, k)).alias("pos", "c")
        found = asked.withColumn("subject", subject).join(best, "subject").select("query_id", first)
        return found.select("query_id", "c.*", F.lit(1.0).alias("score"), (F.col("pos") + 1).alias("rank"), F.lit("topic").alias("strategy"))


def _knowledge(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, GAPS)), (F.col("item_id") % len(GAPS) + 1).cast("int"))
    item = table(spark, sf, "benchmark").select(F.col("item_id"), F.lpad(F.col("item_id").cast("string"), 9, "0").alias("document_id"), kind.alias("topic"), "text")
    url = F.concat(F.when(F.col("item_id") % 2 == 0, "https://docs.example.com/").otherwise("https://other.org/"), "document_id")
    documents = item.select(
        F.lit("c1").alias("corpus_version"), "document_id", F.col("document_id").alias("title"), url.alias("source_url"), F.lit("documentation").alias("source_type"),
        F.struct(F.col("document_id").alias("stack_id"), F.col("document_id").alias("stack_name"), "topic", F.array("topic").alias("supported_gap_types")).alias("metadata"),
    )
    chunks = item.select(F.col("item_id").alias("pos"), F.col("document_id").alias("chunk_id"), "document_id", F.lit(0).alias("chunk_index"), "topic", "text")
    return downstream.Knowledge(OfficialSources(("docs.example.com",)), "c1", documents, chunks, _ByTopic(chunks), program_topics=(PROGRAM,))


def _inputs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("startup"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.coalesce("n_chars", F.lit(0)).alias("n"))
    classified = written(assessment.classify(assessment.criteria(docs, words=WORDS)), "classified")
    gaps = written(assessment.technical_gaps(classified, "startup", words=WORDS), "gaps")  # three steps read them; terms are searched for once
    risks = assessment.wrapper_risks(classified, "startup")
    toxic = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("startup")).agg(F.max("toxic").alias("toxic")).where("toxic = 1")
    groups = toxic.join(docs.select("startup").hint("merge"), "startup", "left_semi").select("startup", F.lit("product").alias("field"), F.lit(True).alias("has_conflict"))
    judged = written(assessment.diagnosis(classified, gaps, risks, groups.select("startup", "field"), "startup"), "judged")
    mean = docs.agg(F.avg("n").alias("mean"))  # one row
    runs = docs.groupBy("source").agg(F.avg("n").alias("own")).crossJoin(F.broadcast(mean)).select(F.col("source").alias("run"), (F.col("own") >= F.col("mean")).alias("collection_ready"))
    runs = written(runs, "runs")  # so that the join knows it is small, and does not broadcast the startups
    per = classified.select("startup", "source", F.lit("").alias("signals")).join(runs, F.col("source").eqNullSafe(F.col("run")))
    high = risks.groupBy("startup").agg(F.bool_or(F.col("severity") == "high").alias("high_risk"))
    reasons = F.when(F.col("collection_ready"), F.array().cast("array<string>")).otherwise(F.array(F.lit("average_evidence_below_threshold")))
    told = judged.select("startup", "classification", "confidence", F.col("ready").alias("diagnosis_ready"), F.col("reasons").alias("diagnosis_reasons"))
    profiles = per.join(told.hint("merge"), "startup").join(high.hint("merge"), "startup", "left").select(
        "startup", "collection_ready", reasons.alias("collection_reasons"), "classification", "confidence", "diagnosis_ready", "diagnosis_reasons", "high_risk", "signals"
    )
    seen = docs.select("startup", F.floor(F.col("n") / 500).alias("evidences"))
    gaps = gaps.join(seen.hint("merge"), "startup").withColumn("description", F.col("gap_type"))
    sold = assessment.opportunities(classified.join(judged.select("startup", F.col("ready").alias("is_ready")).hint("merge"), "startup"), "startup", "is_ready", WORDS).withColumn("evidences", F.lit(1).cast("bigint"))
    value = lambda c: F.coalesce(c, F.lit("unknown"))
    fields = docs.select("startup", F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(c).alias("field"), value(c).alias("value")) for p, c in enumerate(("lang", "source"))])).alias("x"))
    fields = fields.select("startup", "x.*", F.array().cast("array<string>").alias("evidences"))
    held = {"profiles": profiles, "gaps": gaps, "opportunities": sold, "fields": fields, "groups": groups}
    return downstream.Inputs(**{k: written(v, f"inputs-{k}") for k, v in held.items()})


def _shown(out):
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    made = out["recommendations"].groupBy("startup").agg(count("supported"), count("hypothesis"), count("blocked"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("supported", "hypothesis", "blocked")]
    path = F.array_join(F.transform("branches", lambda b: b["branch"]), ">").alias("path")
    return out["states"].join(made.hint("merge"), "startup", "left").select("startup", path, F.get("branches", F.lit(0))["audit_reason"].alias("reason"), "outcome", "final_priority", "next_action", *counts, "reused")


def _states(evidences: str, reused: str) -> str:
    covered = ", ".join(f"'{g}'" for g in recommend.COVERED_GAPS)
    kinds = ", ".join(f"({i}, '{g}')" for i, g in enumerate(GAPS))
    return f"""WITH {oracles.GAPS}, {oracles.RISKS}, n AS (SELECT doc_id AS startup, source, coalesce(n_chars, 0) AS n FROM documents),
  runs AS (SELECT source, avg(n) >= (SELECT avg(n) FROM n) AS cr FROM n GROUP BY 1),
  toxic AS (SELECT DISTINCT doc_id AS startup FROM labels WHERE toxic = 1),
  g AS (SELECT startup, bool_and(gap_type = 'unknown') AS no_gap FROM gaps GROUP BY 1),
  r AS (SELECT startup, bool_or(severity = 'high') AS high FROM risks GROUP BY 1),
  fa AS (SELECT cl.startup, n.n, runs.cr, r.high, toxic.startup IS NOT NULL AS conflict, classification, confidence, no_gap, cl.t,
          concat_ws(',', CASE WHEN toxic.startup IS NOT NULL THEN 'conflicting_product' END, CASE WHEN classification = 'non_ai' THEN 'not_a_recommendation_candidate' END,
            CASE WHEN confidence < 0.75 THEN 'classification_confidence_below_threshold' END, CASE WHEN no_gap THEN 'no_specific_gap' END, CASE WHEN high THEN 'high_wrapper_dependency_risk' END) AS why
        FROM cl JOIN n USING (startup) JOIN runs ON runs.source IS NOT DISTINCT FROM n.source JOIN g USING (startup) JOIN r USING (startup) LEFT JOIN toxic USING (startup)),
  s AS (SELECT *, why = '' AND classification = 'ai_native' AS dr, {evidences} AS ev FROM fa),
  rt AS (SELECT *, cr AND dr AS ready FROM s),
  kinds(i, gap_type) AS (VALUES {kinds}),
  cites AS (SELECT gap_type, min(item_id) % 2 = 0 AS official FROM benchmark JOIN kinds ON item_id % {len(GAPS)} = i GROUP BY 1),
  tech AS (SELECT startup, gap_type, CASE WHEN NOT cr OR NOT dr OR conflict OR high OR ev = 0 THEN 'blocked' WHEN gap_type NOT IN ({covered}) OR NOT coalesce(official, false) THEN 'hypothesis' ELSE 'supported' END AS state,
             CASE WHEN NOT cr OR NOT dr OR conflict OR high THEN NULL WHEN ev = 0 THEN 'missing_startup_gap_evidence' WHEN gap_type NOT IN ({covered}) THEN 'gap_type_not_covered_by_recommendation_rules'
               WHEN NOT coalesce(official, false) THEN 'missing_official_citation' END AS gate, severity
           FROM gaps JOIN rt USING (startup) LEFT JOIN cites USING (gap_type) WHERE gap_type <> 'unknown'),
  offered AS (SELECT startup, official FROM gaps JOIN rt USING (startup) JOIN cites USING (gap_type) WHERE ready AND gap_type = '{PROGRAM}'),
  own AS (SELECT startup FROM rt WHERE {oracles._any("t", WORDS.program)}),
  sold AS (SELECT startup FROM own UNION SELECT startup FROM offered JOIN rt USING (startup) WHERE ev > 0),
  prog AS (SELECT startup, CASE WHEN NOT cr OR NOT dr OR conflict OR high THEN 'blocked' WHEN NOT coalesce(official, false) THEN 'hypothesis' ELSE 'supported' END AS state,
             CASE WHEN NOT cr OR NOT dr OR conflict OR high OR coalesce(official, false) THEN NULL ELSE 'missing_official_citation' END AS gate
           FROM sold JOIN rt USING (startup) LEFT JOIN offered USING (startup)),
  rec AS (SELECT startup, 'technical' AS kind, state, gate, severity FROM tech UNION ALL SELECT startup, 'program', state, gate, 'none' FROM prog),
  per AS (SELECT startup, count(*) FILTER (state = 'supported') AS supported, count(*) FILTER (state = 'hypothesis') AS hypothesis, count(*) FILTER (state = 'blocked') AS blocked,
            count(*) FILTER (state = 'supported' AND kind = 'technical') AS st, count(*) FILTER (state = 'supported' AND severity IN ('high', 'medium')) AS sm, count(*) FILTER (state = 'hypothesis' AND kind = 'program') AS hp FROM rec GROUP BY 1),
  al AS (SELECT rt.*, coalesce(supported, 0) AS supported, coalesce(hypothesis, 0) AS hypothesis, coalesce(blocked, 0) AS blocked, coalesce(st, 0) AS st, coalesce(sm, 0) AS sm, coalesce(hp, 0) AS hp FROM rt LEFT JOIN per USING (startup)),
  br AS (SELECT *, supported > 0 AND hypothesis = 0 AND blocked = 0 AS ok,
           CASE WHEN supported > 0 THEN CASE WHEN sm > 0 THEN 'medium' ELSE 'low' END WHEN hypothesis + blocked > 0 THEN 'human_review' ELSE 'low' END AS final_priority FROM al)
  SELECT startup, CASE WHEN ready THEN 'ready_for_recommendation' ELSE 'needs_more_collection_or_human_review' END || CASE WHEN ok THEN '>ready_for_briefing>briefing_generated' ELSE '>human_review_requested' END AS path,
    CASE WHEN ready THEN 'collection_and_assessment_ready_for_recommendation' ELSE coalesce(nullif(concat_ws(';', CASE WHEN NOT cr THEN 'average_evidence_below_threshold' END, nullif(replace(why, ',', ';'), '')), ''), 'upstream_not_ready_for_recommendation') END AS reason,
    CASE WHEN ok THEN 'briefing_generated' WHEN ready THEN 'human_review_requested' ELSE 'needs_more_collection_or_human_review' END AS outcome, final_priority,
    CASE WHEN st > 0 AND final_priority = 'medium' THEN 'prepare_technical_outreach' WHEN supported > st THEN 'prepare_program_outreach' WHEN hp > 0 THEN 'validate_program_fit_with_human' WHEN hypothesis > 0 THEN 'validate_fit_with_human'
      WHEN blocked > 0 THEN 'resolve_blocking_evidence' ELSE 'deprioritize_for_now' END AS next_action, supported, hypothesis, blocked, {reused} AS reused FROM br"""


@query(_states("n // 500", "false"))
def workflow_states(spark, sf):
    return _shown(downstream.run(_inputs(spark, sf), _knowledge(spark, sf)))


@query(_states("CASE WHEN startup % 10 = 3 THEN 0 ELSE n // 500 END", "NOT (startup % 10 = 3 AND n // 500 > 0)"))
def workflow_resume(spark, sf):
    """A second run in which a tenth of the startups have lost their evidence: only those that changed go through the nodes again."""
    inputs, knowledge = _inputs(spark, sf), _knowledge(spark, sf)
    first = downstream.run(inputs, knowledge)
    lost = inputs.gaps.withColumn("evidences", F.when(F.col("startup") % 10 == 3, F.lit(0)).otherwise(F.col("evidences")))
    return _shown(downstream.run(replace(inputs, gaps=lost), knowledge, first))


_BRIEFS = "('briefing_generated')"


@query(f"SELECT outcome, count(*) AS startups, count(*) FILTER (outcome IN {_BRIEFS}) AS executive, count(*) FILTER (outcome NOT IN {_BRIEFS}) AS review FROM ({_states('n // 500', 'false')}) GROUP BY 1")
def workflow_outcomes(spark, sf):
    """How many startups ended how, and how many briefings of either kind stand beside them."""
    out = downstream.run(_inputs(spark, sf), _knowledge(spark, sf))
    executive = out["executive_briefings"].select("startup", F.lit(1).alias("e"))
    review = out["review_briefings"].select("startup", F.lit(1).alias("r"))
    return out["states"].join(executive.hint("merge"), "startup", "left").join(review.hint("merge"), "startup", "left").groupBy("outcome").agg(F.count("*").alias("startups"), F.count("e").alias("executive"), F.count("r").alias("review"))
