"""The run end to end, and the connectors, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.operators.policy import OfficialSources
from quarrylight.plans import workflow
from quarrylight.plans.workflow import run_intelligence
from quarrylight.sources import connectors
from quarrylight.sources.store import RunStore

OFFICIAL = OfficialSources(("v.com",), types=("documentation",))
META = {"stack_id": "s", "stack_name": "n", "topic": "model_serving", "brief_description": "b", "technical_description": "t", "categories": ["c"], "use_cases": ["u"], "supported_gap_types": ["model_serving"]}


@pytest.fixture(scope="module")
def corpus_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "c.json"
    v = {"schema_version": "v1", "corpus_version": "c1"}
    doc = v | {"document_id": "d", "title": "t", "source_url": "https://v.com/x", "source_type": "documentation", "ingested_at": "2024", "metadata": META}
    chunk = v | {"chunk_id": "d:0", "document_id": "d", "chunk_index": 0, "topic": "model_serving", "text": "serving of models in production"}
    path.write_text(json.dumps(v | {"documents": [doc], "chunks": [chunk]}))
    return f"file://{path}"


def test_run(spark, corpus_path):
    from quarrylight.operators.corpus import read_corpus

    _, documents, chunks = read_corpus(spark, corpus_path)
    results = spark.createDataFrame([(0, "Acme", "https://acme.ai", "s", "web", "Acme")], "pos bigint, title string, url string, snippet string, source_name string, discovered_name string")
    text = "Setor: fintech. Produto: MLOps com inferencia em producao. Sobre: plataforma de dados proprietarios. Tecnologias: model serving. Sinais de IA: machine learning"
    pages = spark.createDataFrame([(0, 0, "https://acme.ai", "Acme | home", text, "t", "Acme")], "key bigint, pos int, url string, title string, main_text string, collected_at string, name string")
    out = run_intelligence(results, pages, documents, chunks, OFFICIAL)
    assert out["quality"].first()["ready"]
    assert out["assessments"].first()["classification"] == "ai_native"
    got = {r["gap_type"]: (r["state"], r["document_id"]) for r in out["recommendations"].collect()}
    assert got["model_serving"] == ("supported", "d")
    assert out["priorities"].first()["next_action"] == "prepare_technical_outreach"
    assert out["outcome"].first()["outcome"] == "briefing"
    again = run_intelligence(results, pages, documents, chunks, OFFICIAL, stored={"profile_fields": out["profile_fields"].limit(0)})
    assert not again["quality"].first()["ready"] and again["assessments"].count() == 0


def test_fetch(spark):
    def get(url):
        import urllib.error

        if "gone" in url:
            raise urllib.error.HTTPError(url, 404, "gone", None, None)
        if "slow" in url:
            raise TimeoutError("slow")
        return url, 200, "<p>x</p>"

    urls = spark.createDataFrame([("https://a.io/x",), ("https://a.io/gone",), ("https://b.io/slow",)], "url string")
    got = {r["url"]: (r["status_code"], r["error_category"], r["is_error"]) for r in connectors.fetch(urls, get).collect()}
    assert got == {"https://a.io/x": (200, None, False), "https://a.io/gone": (404, "unavailable", True), "https://b.io/slow": (None, "timeout", True)}


def test_search_source(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"web":{"results":[{"title":"t","url":"u","description":"d"}]}}')
    spark.dataSource.register(connectors.SearchSource)
    read = spark.read.format("search").option("endpoint", f"file://{tmp_path}/r.json").option("terms", '["a", "b"]').load()
    assert read.where(F.col("body").contains('"t"') & F.col("error").isNull()).count() == 2


def test_ingest(spark, corpus_path, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/kb")
    assert connectors.ingest(spark, store, corpus_path, OFFICIAL) == {"documents": 1, "chunks": 1}
    connectors.ingest(spark, store, corpus_path, OFFICIAL)
    assert store.read("kb_documents").count() == store.read("kb_chunks").count() == 1
    with pytest.raises(ValueError, match="source_url_not_official"):
        connectors.ingest(spark, store, corpus_path, OfficialSources(("other.com",)))


def test_controlled_run(spark):
    html = "<title>Acme Labs | home</title><p>Setor: fintech. Produto: motor de risco.</p>"

    def get(url):
        if "down" in url:
            raise TimeoutError(url)
        return url, 200, html

    found = workflow.controlled_run(spark, "https://www.acme-labs.io/", get=get)
    assert tuple(found["candidates"].first())[1:4] == ("Acme Labs", "acme labs", "https://acme-labs.io")
    values = {r["field"]: r["value"] for r in found["profile_fields"].collect()}
    assert (values["company_name"], values["sector"], values["product"]) == ("Acme Labs", "fintech", "motor de risco")
    assert found["errors"].count() == 0 and found["quality"].first()["profiles"] == 1
    for url, why in (("https://down.io", "timeout"), ("unknown", "missing_primary_url"), ("https://x.io", "blocked_domain")):
        lost = workflow.controlled_run(spark, url, get=get, blocked=("x.io",))
        assert [r["error_category"] for r in lost["errors"].collect()] == [why] and lost["pages"].count() == 0


def test_folders_in_between(spark):
    from quarrylight import tables

    kept = tables.written(spark.range(5), "kept")
    gone = tables.written(spark.range(5), "gone")
    assert {"kept", "gone"} <= {f.rsplit("/", 1)[1].split("-")[0] for f in tables.made()}
    tables.remove([f for f in tables.made() if "/gone-" in f])
    assert kept.count() == 5 and not any("/gone-" in f for f in tables.made())
    with pytest.raises(Exception, match="(?i)not.*exist|FileNotFound"):
        gone.collect()
    assert spark.conf.get(tables.CLEANUP) in ("false", None)
