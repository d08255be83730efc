"""The downstream workflow: routes, errors, saving and resume, on small inputs."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarrylight.operators.policy import OfficialSources
from quarrylight.plans import downstream
from quarrylight.plans.workflow import run_startups
from tests.test_workflow import META, OFFICIAL, corpus_path  # noqa: F401 - fixture

PROFILE = "startup int, collection_ready boolean, collection_reasons array<string>, classification string, confidence double, diagnosis_ready boolean, diagnosis_reasons array<string>, high_risk boolean, signals string"


@pytest.fixture(scope="module")
def inputs(spark):
    good = lambda k: (k, True, [], "ai_native", 0.9, True, [], False, "ml")
    return downstream.Inputs(
        spark.createDataFrame([good(1), good(2), (3, True, [], "ai_enabled", 0.6, False, ["no_specific_gap"], False, ""), (4, False, ["not_enough_candidates"], "ai_native", 0.9, True, [], False, ""), good(5)], PROFILE),
        spark.createDataFrame([(k, g, "high", 0.8, False, e, "d") for k, g, e in [(1, "model_serving", 2), (2, "voice_ai", 1), (3, "unknown", 0), (4, "model_serving", 1), (5, "model_serving", 0)]],
                              "startup int, gap_type string, severity string, confidence double, is_hypothesis boolean, evidences bigint, description string"),
        spark.createDataFrame([(3, "inception_program_fit", 0.62, True, 1)], "startup int, opportunity_type string, confidence double, is_hypothesis boolean, evidences bigint"),
        spark.createDataFrame([(k, f, p, v, ["u"]) for k in range(1, 6) for p, (f, v) in enumerate([("product", "x"), ("sector", "unknown")])], "startup int, field string, pos int, value string, evidences array<string>"),
        spark.createDataFrame([(2, "product", False), (5, "product", False)], "startup int, field string, has_conflict boolean"),
    )


@pytest.fixture(scope="module")
def knowledge(spark):
    types = ["model_serving", "voice_ai"]
    documents = spark.createDataFrame([("c1", f"d{i}", "t", f"https://v.com/{i}", "documentation", {"stack_id": "s", "stack_name": "n", "topic": g, "supported_gap_types": [g]}) for i, g in enumerate(types)],
                                      "corpus_version string, document_id string, title string, source_url string, source_type string, metadata struct<stack_id:string,stack_name:string,topic:string,supported_gap_types:array<string>>")
    chunks = spark.createDataFrame([(i, f"d{i}:0", f"d{i}", 0, g, g.replace("_", " ")) for i, g in enumerate(types)], "pos int, chunk_id string, document_id string, chunk_index int, topic string, text string")
    return downstream.Knowledge(OfficialSources(("v.com",)), "c1", documents, chunks)


def test_routes(spark, inputs, knowledge):
    out = downstream.run(inputs, knowledge)
    got = {r["startup"]: ([b["branch"] for b in r["branches"]], r["outcome"], r["next_action"]) for r in out["states"].collect()}
    ready, review, human = "ready_for_recommendation", "needs_more_collection_or_human_review", "human_review_requested"
    assert got == {
        1: ([ready, "ready_for_briefing", "briefing_generated"], "briefing_generated", "prepare_technical_outreach"),
        2: ([ready, human], human, "validate_fit_with_human"),
        3: ([review, human], review, "resolve_blocking_evidence"),
        4: ([review, human], review, "resolve_blocking_evidence"),
        5: ([ready, human], human, "resolve_blocking_evidence"),
    }
    made = {(r["startup"], r["kind"]): (r["state"], r["reason"], r["document_id"]) for r in out["recommendations"].collect()}
    assert made == {
        (1, "technical"): ("supported", None, "d0"), (2, "technical"): ("hypothesis", "gap_type_not_covered_by_recommendation_rules", "d1"),
        (3, "program"): ("blocked", "assessment_not_ready_for_recommendation", None), (4, "technical"): ("blocked", "collection_quality_not_ready", None),
        (5, "technical"): ("blocked", "missing_startup_gap_evidence", "d0"),
    }
    assert [r["startup"] for r in out["executive_briefings"].collect()] == [1] and sorted(r["startup"] for r in out["review_briefings"].collect()) == [2, 3, 4, 5]
    assert {r["startup"] for r in out["gap_space"].collect()} == {1, 2, 5}
    assert downstream.outcome(out["states"]).first()["outcome"] == "briefing_generated"
    seen = [(r["pos"], r["name"], r["audit_reason"]) for r in downstream.events(out["states"]).where("startup = 4").orderBy("pos").collect()]
    assert seen[0] == (0, review, "not_enough_candidates") and seen[1][2] == "blocked_recommendation_requires_human_review"


def test_without_knowledge_retrieval_is_an_error_and_presets_are_used(spark, inputs, knowledge):
    bare = downstream.Knowledge(knowledge.official)
    out = downstream.run(inputs, bare)
    errors = {r["startup"]: [e["audit_reason"] for e in r["errors"]] for r in out["states"].collect()}
    assert errors == {1: ["retrieval_skipped_missing_corpus_or_fixture"], 2: ["retrieval_skipped_missing_corpus_or_fixture"], 3: [], 4: [], 5: ["retrieval_skipped_missing_corpus_or_fixture"]}
    assert out["recommendations"].where("startup = 1").first()["reason"] == "missing_official_citation"
    preset = spark.createDataFrame([("1/model_serving", "d1:0", "d1", 0, 3.0, 1)], "query_id string, chunk_id string, document_id string, chunk_index int, score double, rank int")
    with_preset = downstream.run(inputs, replace(knowledge, preset=preset))
    assert with_preset["recommendations"].where("startup = 1").first()["document_id"] == "d1"


def test_resume_goes_through_what_changed(spark, inputs, knowledge, monkeypatch):
    first = downstream.run(inputs, knowledge)
    gone = inputs.profiles.where("startup <> 4")
    new = inputs.profiles.where("startup = 1").withColumn("startup", F.lit(6))
    changed = replace(inputs, profiles=gone.union(new), gaps=inputs.gaps.withColumn("evidences", F.when(F.col("startup") == 5, F.lit(3)).otherwise(F.col("evidences"))))
    went = []
    through = downstream._through
    monkeypatch.setattr(downstream, "_through", lambda i, k: went.extend(sorted(r["startup"] for r in i.profiles.collect())) or through(i, k))
    second = downstream.run(changed, knowledge, first)
    assert went == [5, 6]
    whole = downstream.run(changed, knowledge)
    assert {r["startup"]: r["reused"] for r in second["states"].collect()} == {1: True, 2: True, 3: True, 5: False, 6: False}
    for name in downstream.TABLES:
        a, b = (sorted(map(str, t[name].drop("reused").collect())) for t in (second, whole))
        assert a == b, name
    went.clear()
    downstream.run(changed, replace(knowledge, version="c2"), first)
    assert went == [1, 2, 3, 5, 6]


def test_a_store_that_fails_is_recorded(inputs, knowledge):
    kept = {}

    def write(name, df):
        if name == "retrievals":
            raise OSError("full")
        kept[name] = df.count()

    out = downstream.save(downstream.run(inputs, knowledge), write)
    assert set(kept) == set(downstream.TABLES) - {"retrievals"} and kept["states"] == 5
    assert {(e["step"], e["error_type"]) for r in out["states"].collect() for e in r["errors"]} == {("persist_downstream_artifacts:retrievals", "OSError")}


def test_whole_run(spark, corpus_path):  # noqa: F811
    from quarrylight.operators.corpus import read_corpus

    _, documents, chunks = read_corpus(spark, corpus_path)
    results = spark.createDataFrame([(0, "Acme", "https://acme.ai", "s", "web", "Acme")], "pos bigint, title string, url string, snippet string, source_name string, discovered_name string")
    text = "Setor: fintech. Produto: MLOps com inferencia em producao. Sobre: plataforma de dados proprietarios. Tecnologias: model serving. Sinais de IA: machine learning"
    pages = spark.createDataFrame([(0, 0, "https://acme.ai", "Acme | home", text, "t", "Acme")], "key bigint, pos int, url string, title string, main_text string, collected_at string, name string")
    knowledge = downstream.Knowledge(OFFICIAL, "c1", documents, chunks)
    out = run_startups(results, pages, knowledge)
    state = out["states"].first()
    assert state["branches"][0]["branch"] == "ready_for_recommendation" and not state["reused"]
    assert {(r["subject"], r["state"]) for r in out["recommendations"].where("kind = 'technical' AND subject = 'model_serving'").collect()} <= {("model_serving", "supported"), ("model_serving", "blocked")}
    again = run_startups(results, pages, knowledge, earlier=out)
    assert again["states"].first()["reused"] and again["outcome"].first() == out["outcome"].first()
    unready = run_startups(results, pages, knowledge, stored={"profile_fields": out["profile_fields"].limit(0)})
    assert unready["states"].count() == 0 and unready["outcome"].first()["outcome"] == "needs_more_collection_or_human_review"
