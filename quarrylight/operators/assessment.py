"""Rule-based assessment of profile texts: criteria, class, wrapper risks, technical gaps, readiness, gap space."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import UNKNOWN, fold, has_any, ratio


@dataclass(frozen=True)
class Vocabulary:
    """Terms are data: each rule looks for substrings of the folded text."""

    # Terms by what they speak of.
    ai: tuple[str, ...] = (
        "ai-native", "ai native", "agente de ia", "agentes autonomos", "automacao com ia", "computer vision", "fine-tuning",
        "ia generativa", "inferencia", "inteligencia artificial", "machine learning", "mlops", "modelos proprietarios",
        "modelo proprietario", "nlp", "visao computacional",
    )
    generic: tuple[str, ...] = ("chatbot", "chatgpt", "gpt api", "ia generativa", "openai api", "usa ia")
    deep: tuple[str, ...] = (
        "avaliacao de modelos", "dados proprietarios", "feedback loop", "fine-tuning", "inferencia em producao", "mlops",
        "model serving", "modelos proprietarios", "modelo proprietario",
    )
    production: tuple[str, ...] = ("inferencia em producao", "model serving", "mlops", "producao", "latencia")
    external: tuple[str, ...] = ("api externa", "chatgpt", "gpt api", "openai api")
    data: tuple[str, ...] = ("dados proprietarios", "dataset proprietario", "feedback loop")
    scale: tuple[str, ...] = ("escala", "latencia", "custo", "governanca", "seguranca")
    negative: tuple[str, ...] = ("nenhum", "nenhum uso", "no ai", "no artificial intelligence", "none", "sem ia", "sem uso")
    program: tuple[str, ...] = (
        "community", "credits", "go to market", "go-to-market", "startup program", "suporte tecnico", "technical enablement", "technical support",
    )
    # Gap type -> (terms, severity).
    gaps: dict[str, tuple[tuple[str, ...], str]] = field(
        default_factory=lambda: {
            "model_serving": (("inferencia", "latencia", "model serving", "producao", "escala"), "high"),
            "llm_customization": (("llm", "gpt", "ia generativa", "nlp", "fine-tuning"), "medium"),
            "data_acceleration": (("dados proprietarios", "grandes volumes de dados", "dataset", "feedback loop"), "medium"),
            "voice_ai": (("audio", "fala", "speech", "voz"), "medium"),
            "computer_vision": (("computer vision", "visao computacional"), "high"),
            "robotics_simulation": (("robotica", "robotics", "simulacao", "simulation"), "high"),
            "healthcare_ai": (("clinica", "clinico", "healthtech", "hospitais", "saude"), "medium"),
            "cybersecurity_ai": (("ciberseguranca", "cybersecurity", "seguranca"), "medium"),
        }
    )


DEFAULT = Vocabulary()
GAP_CONFIDENCE = 0.72
INSUFFICIENT = "insufficient_evidence"
CRITERIA = ("ai_product_centrality", "ai_architecture_depth", "proprietary_data_loop", "production_readiness", "scale_governance_need")
# Fields whose conflicts block, and unknown fields that call for review.
CRITICAL_FIELDS = ("ai_signals", "product", "technologies_used")
STACK_FIELDS = ("ai_signals", "company_summary", "product", "technologies_used")


def positive_signal(value: Column, words: Vocabulary = DEFAULT) -> Column:
    """Whether an AI field says yes: it is known and holds no word of denial."""
    return (value != UNKNOWN) & ~has_any(fold(value), words.negative)


def criteria(profiles: DataFrame, text: str = "text", signals: str | None = None, words: Vocabulary = DEFAULT) -> DataFrame:
    """profiles with one status column a criterion: positive, negative or unknown; every rule reads the folded text once."""
    plain = profiles.withColumn("_t", fold(F.coalesce(F.col(text), F.lit(""))))
    ai = has_any(F.col("_t"), words.ai) | has_any(F.col("_t"), words.generic)
    if signals:
        ai = ai | positive_signal(F.coalesce(F.col(signals), F.lit(UNKNOWN)), words)
    seen = plain.select(
        "*", ai.alias("_ai"), has_any(F.col("_t"), words.generic).alias("_generic"), has_any(F.col("_t"), words.deep).alias("_deep"),
        has_any(F.col("_t"), words.data).alias("_data"), has_any(F.col("_t"), words.production).alias("_production"),
        has_any(F.col("_t"), words.scale).alias("_scale"), has_any(F.col("_t"), words.external).alias("_external"),
    )
    holds = dict(zip(CRITERIA, (~(F.col("_generic") & ~F.col("_deep")), F.col("_deep"), F.col("_data"), F.col("_production"), F.col("_scale")), strict=True))
    status = lambda ok: F.when(~F.col("_ai"), UNKNOWN).when(ok, "positive").otherwise("negative")
    return seen.select("*", *[status(ok).alias(c) for c, ok in holds.items()])


def classify(found: DataFrame, ready: Column | None = None) -> DataFrame:
    """classification and confidence from the criteria. ready: whether the run's collection is good enough; where it is not,
    nothing is judged (insufficient_evidence, confidence 0)."""
    enough = F.lit(True) if ready is None else F.coalesce(ready, F.lit(False))
    positives = sum((F.when(F.col(c) == "positive", 1).otherwise(0) for c in CRITERIA), F.lit(0))
    depth = sum((F.when(F.col(c) == "positive", 1).otherwise(0) for c in CRITERIA[1:4]), F.lit(0))
    central, native = F.col(CRITERIA[0]) == "positive", depth >= 2
    silent = F.col(CRITERIA[0]) == UNKNOWN
    kind = F.when(~enough, INSUFFICIENT).when(silent, "non_ai").when(central & native, "ai_native").otherwise("ai_enabled")
    sure = F.when(~enough, 0.0).when(silent, 0.72).when(~central, 0.58).when(native, F.least(F.bround(0.72 + 0.04 * positives, 2), F.lit(0.92))).otherwise(0.64)
    return found.withColumn("classification", kind).withColumn("confidence", sure)


def criterion_rows(found: DataFrame, *keys: str) -> DataFrame:
    """One row a criterion: status and confidence; the quality of the evidence counts as positive."""
    sure = lambda s: F.when(s == "positive", 0.8).when(s == "negative", 0.55).otherwise(0.0)
    rows = [F.struct(F.lit(c).alias("criterion"), F.col(c).alias("status"), sure(F.col(c)).alias("confidence")) for c in CRITERIA]
    rows.append(F.struct(F.lit("evidence_quality").alias("criterion"), F.lit("positive").alias("status"), F.lit(0.8).alias("confidence")))
    return found.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def positive_signals(found: DataFrame, *keys: str) -> DataFrame:
    """keys, signal_type, confidence: a signal for each criterion that speaks for AI."""
    rows = criterion_rows(found, *keys).where((F.col("status") == "positive") & (F.col("criterion") != "evidence_quality"))
    return rows.select(*keys, F.col("criterion").alias("signal_type"), "confidence")


def wrapper_risks(classified: DataFrame, *keys: str) -> DataFrame:
    """Risks of a product that only wraps others' models: one row each, or an unknown one where there is no AI."""
    row = lambda name, severity, sure, guess: F.struct(F.lit(name).alias("risk_type"), severity.alias("severity"), sure.alias("confidence"), guess.alias("is_hypothesis"))
    e, d, p, deep = (F.col(c) for c in ("_external", "_data", "_production", "_deep"))
    risks = F.array(
        row("external_api_only", F.when(e & ~deep, "high").otherwise("low"), F.when(e, 0.82).otherwise(0.62), ~e),
        row("no_proprietary_data_evidence", F.when(d, "low").otherwise("medium"), F.when(d, 0.8).otherwise(0.55), ~d),
        row("no_production_inference_evidence", F.when(p, "low").otherwise("medium"), F.when(p, 0.78).otherwise(0.55), ~p),
    )
    none = F.array(row(UNKNOWN, F.lit(UNKNOWN), F.lit(0.0), F.lit(True)))
    return classified.select(*keys, F.explode(F.when(F.col("classification").isin("non_ai", INSUFFICIENT), none).otherwise(risks)).alias("x")).select(*keys, "x.*")


def technical_gaps(classified: DataFrame, *keys: str, words: Vocabulary = DEFAULT) -> DataFrame:
    """Needs that the text speaks of, by term sets; one unknown row where it speaks of none."""
    row = lambda name, severity, sure, guess: F.struct(F.lit(name).alias("gap_type"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"), F.lit(guess).alias("is_hypothesis"))
    found = F.array_compact(F.array(*[F.when(has_any(F.col("_t"), terms), row(g, s, GAP_CONFIDENCE, False)) for g, (terms, s) in words.gaps.items()]))
    none = F.array(row(UNKNOWN, UNKNOWN, 0.0, True))
    gaps = F.when(F.col("classification").isin("non_ai", INSUFFICIENT) | (F.size(found) == 0), none).otherwise(found)
    return classified.select(*keys, F.explode(gaps).alias("x")).select(*keys, "x.*")


def diagnosis(classified: DataFrame, gaps: DataFrame, risks: DataFrame, conflicts: DataFrame, key: str) -> DataFrame:
    """key, reasons, ready, human_review, urgency. conflicts: key, field of evidence groups that conflict."""
    g = gaps.groupBy(key).agg(
        F.bool_and(F.col("gap_type") == UNKNOWN).alias("no_gap"),
        F.bool_or((F.col("gap_type") != UNKNOWN) & F.col("severity").isin("high", "medium")).alias("specific"),
    )
    r = risks.groupBy(key).agg(F.bool_or(F.col("severity") == "high").alias("high_risk"))
    c = conflicts.where(F.col("field").isin(*CRITICAL_FIELDS)).groupBy(key).agg(F.array_sort(F.collect_set(F.concat(F.lit("conflicting_"), "field"))).alias("cs"))
    joined = classified.join(g.hint("merge"), key, "left").join(r.hint("merge"), key, "left").join(c.hint("merge"), key, "left")
    kind, sure = F.col("classification"), F.col("confidence")
    unsure = F.exists(F.array(*CRITERIA), lambda s: s == UNKNOWN) & (kind != "non_ai")
    rules = F.array_compact(F.array(
        F.when(kind.isin("non_ai", INSUFFICIENT), "not_a_recommendation_candidate"),
        F.when(sure < 0.75, "classification_confidence_below_threshold"),
        F.when(F.coalesce("no_gap", F.lit(True)), "no_specific_gap"),
        F.when(F.coalesce("high_risk", F.lit(False)), "high_wrapper_dependency_risk"),
        F.when(unsure, "unknown_assessment_criteria"),
    ))
    reasons = F.concat(F.coalesce("cs", F.array().cast("array<string>")), rules)
    out = joined.withColumn("reasons", reasons)
    review = (kind == INSUFFICIENT) | F.col("cs").isNotNull() | F.array_contains("reasons", "unknown_assessment_criteria")
    urgency = (
        F.when(review, "human_review").when(kind == "non_ai", "low").when(kind == "ai_enabled", "medium")
        .when((kind == "ai_native") & (sure >= 0.8) & F.coalesce("specific", F.lit(False)), "urgent").otherwise("medium")
    )
    return out.select(key, "classification", "confidence", "reasons", ((F.size("reasons") == 0) & (kind == "ai_native")).alias("ready"), review.alias("human_review"), urgency.alias("urgency"))


def gap_space_metrics(mappings: DataFrame, commercial: DataFrame, key: str = "startup") -> DataFrame:
    """One row a startup over its gap mappings (key, targets, review_reasons, support_status) and commercial ones (key, targets):
    how many there are, how many the taxonomy covers, and how often each review reason occurs (a map)."""
    gaps = mappings.groupBy(key).agg(
        F.count("*").alias("gaps"), F.count_if(F.size("targets") > 0).alias("covered_gaps"),
        F.count_if(F.col("support_status") == "unsupported").alias("unsupported_gaps"),
    )
    why = mappings.select(key, F.explode("review_reasons").alias("reason")).groupBy(key, "reason").agg(F.count("*").alias("n"))
    why = why.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))
    sold = commercial.groupBy(key).agg(F.count("*").alias("opportunities"), F.count_if(F.size("targets") > 0).alias("covered_opportunities"))
    joined = gaps.join(sold, key, "full_outer").join(why, key, "left")
    counts = ("gaps", "covered_gaps", "unsupported_gaps", "opportunities", "covered_opportunities")
    zero = joined.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("reason_counts", F.create_map().cast("map<string,bigint>")).alias("reason_counts"))
    return zero.withColumn("gap_coverage", ratio(F.col("covered_gaps"), F.col("gaps")))


def opportunities(profiles: DataFrame, key: str, ready: str, words: Vocabulary = DEFAULT) -> DataFrame:
    """Program opportunities that the folded text (_t) speaks of; surer where the assessment is ready."""
    return profiles.where(has_any(F.col("_t"), words.program)).select(
        key, F.lit("inception_program_fit").alias("opportunity_type"), F.when(F.col(ready), 0.78).otherwise(0.62).alias("confidence"), (~F.col(ready)).alias("is_hypothesis")
    )


def gap_space(gaps: DataFrame, targets: DataFrame, context: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """key, gap_type, targets, review_reasons, support_status. gaps: with evidences (n); targets: gap_type, document_id;
    context: key, reasons that hold for all of a key's gaps."""
    held = targets.groupBy("gap_type").agg(F.array_sort(F.collect_set("document_id")).alias("targets"))
    joined = gaps.where(F.col("gap_type") != UNKNOWN).join(held, "gap_type", "left").join(context.hint("merge"), key, "left")
    own = F.array_compact(F.array(
        F.when(F.col("targets").isNull(), "unsupported_gap_type"),
        F.when(F.col("evidences") == 0, "missing_observed_gap_evidence"),
        F.when(F.col("confidence") < least, "low_gap_confidence"),
        F.when(F.col("is_hypothesis"), "upstream_gap_is_hypothesis"),
    ))
    empty = F.array().cast("array<string>")
    reasons = F.array_distinct(F.concat(own, F.coalesce("reasons", empty)))
    out = joined.select(key, "gap_type", F.coalesce("targets", empty).alias("targets"), "confidence", reasons.alias("review_reasons"))
    status = F.when(F.array_contains("review_reasons", "unsupported_gap_type"), "unsupported").when(F.size("review_reasons") > 0, "hypothesis").otherwise("supported")
    return out.withColumn("support_status", status)


def retrieval_requests(mappings: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """key, gap_type, query: what to ask the knowledge base for each gap that the taxonomy covers; signals: key, signals (text).
    Gaps that are not supported ask nothing."""
    words = F.replace(F.col("gap_type"), F.lit("_"), F.lit(" "))
    asked = mappings.where((F.col("support_status") != "unsupported") & (F.size("targets") > 0)).join(signals.hint("merge"), key, "left")
    return asked.select(key, "gap_type", F.concat_ws(" ", words, F.nullif("signals", F.lit(""))).alias("query"))
