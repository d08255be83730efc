"""Queries over stored records: runs, corpora, vector stores, retrievals, recommendations, briefings, collected pages."""

from __future__ import annotations

import urllib.error

from pyspark.sql import functions as F

from quarrylight.functions.embedding import Metadata, embed
from quarrylight.operators import assessment, briefing, corpus, entities, profiles, recommend, retrieval, search
from quarrylight.plans import queries as q
from quarrylight.plans.oracles import BM25, COSINE, DOCS, HYBRID
from quarrylight.plans.registry import query
from quarrylight.plans.rules import _docs, _id, _pick
from quarrylight.sources import adapters, connectors, language, store
from quarrylight.tables import fresh_path, table


def _store(spark):
    return store.RunStore(spark, fresh_path(spark, "store"))


# runs


@query("""SELECT 'orders' AS part, o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_custkey % 10 = 3
  UNION ALL SELECT 'lines', l_orderkey * 10 + l_linenumber, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 20 = 13
  UNION ALL SELECT DISTINCT 'lines', l_orderkey * 10 + l_linenumber, 0 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 20 = 3""")
def run_load(spark, sf):
    """A run is a tenth of the customers: all tables are stored in one commit, some rows of one run are replaced in another, and that
    run's partitions are read back."""
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("run_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("amount"))
    lines = lines.join(orders.select(F.col("id").alias("l_orderkey"), "run_id", "o_custkey"), "l_orderkey").select("run_id", "id", "amount", "o_custkey")
    runs = _store(spark)
    with runs.transaction() as t:
        t.create("orders", orders, "run_id")
        t.create("lines", lines, "run_id")
    runs.upsert("lines", lines.where("o_custkey % 20 = 3").withColumn("amount", F.lit(0.0)), "run_id", "id", partitions=("run_id",))
    found = store.fetch_run(runs, ("orders", "lines"), 3, {"orders": ("id",), "lines": ("id",)})
    part = lambda name: found[name].select(F.lit(name).alias("part"), "id", F.col("amount").cast("double").alias("amount"))
    return part("orders").unionByName(part("lines"))


@query("""SELECT startup, kind, corpus_version, payload FROM (SELECT doc_id AS startup, 'retrieval' AS kind, 'c1' AS corpus_version, '{"corpus_version":"c1","query":"' || lang || '","startup":' || doc_id || '}' AS payload FROM documents
  UNION ALL SELECT doc_id, 'metrics', 'unknown', '{"covered":' || (doc_id % 3) || ',"startup":' || doc_id || '}' FROM documents) WHERE startup % 7 = 2 AND NOT (kind = 'metrics' AND startup % 2 = 0)
  UNION ALL SELECT doc_id, 'metrics', 'unknown', '{"covered":9,"startup":' || doc_id || '}' FROM documents WHERE doc_id % 14 = 2""")
def downstream_load(spark, sf):
    """Artifacts of runs as snapshots, replaced by run, startup and kind; those of one run are loaded."""
    docs = _docs(spark, sf)
    made = store.snapshot(
        "r", "s", retrieval=docs.select(_id().alias("startup"), F.lit("c1").alias("corpus_version"), F.col("lang").alias("query")),
        metrics=docs.select(_id().alias("startup"), (_id() % 3).alias("covered")),
    )
    key = F.get_json_object("payload", "$.startup").cast("bigint")
    made = made.withColumn("startup", key).withColumn("run_id", F.concat(F.lit("run-"), (key % 7).cast("string")))
    again = store.snapshot("r", "s", metrics=docs.where("doc_id % 2 = 0").select(_id().alias("startup"), F.lit(9).alias("covered")))
    again = again.withColumn("startup", key).withColumn("run_id", F.concat(F.lit("run-"), (key % 7).cast("string")))
    runs = _store(spark)
    runs.replace("artifacts", made, "run_id", "startup", "kind", partitions=("run_id",))
    runs.replace("artifacts", again, "run_id", "startup", "kind", partitions=("run_id",))
    return store.fetch_run(runs, ("artifacts",), "run-2")["artifacts"].select("startup", "kind", "corpus_version", "payload")


@query("""SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS title, i AS chunk_index, 'text ' || i AS text FROM documents, (VALUES (0), (1)) x(i) WHERE doc_id % 2 = 0""")
def corpus_load(spark, sf):
    """Two versions of a corpus, documents and chunks of each upserted in one commit; one version is read."""
    name = _id().cast("string")
    docs = _docs(spark, sf).select(F.concat(F.lit("c"), (_id() % 2).cast("string")).alias("corpus_version"), name.alias("document_id"), F.lit("old").alias("title"))
    pieces = docs.select("corpus_version", "document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    pieces = pieces.withColumns({"chunk_id": F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")), "text": F.concat(F.lit("text "), F.col("chunk_index").cast("string"))})
    from quarrylight.sources.connectors import load_corpus

    held = _store(spark)
    with held.transaction() as t:
        t.upsert("kb_documents", docs, "corpus_version", "document_id", partitions=("corpus_version",))
        t.upsert("kb_chunks", pieces, "corpus_version", "chunk_id", partitions=("corpus_version",))
    held.upsert("kb_documents", docs.where("document_id % 3 = 0").withColumn("title", F.lit("new")), "corpus_version", "document_id", partitions=("corpus_version",))
    documents, chunks = load_corpus(held, "c0")
    return chunks.join(documents.select("document_id", "title"), "document_id").select("document_id", "title", "chunk_index", "text")


@query("""SELECT doc_id, lang, n_chars FROM documents""")
def json_reload(spark, sf):
    path = store.save_json(_docs(spark, sf).select("doc_id", "lang", "n_chars"), fresh_path(spark, "run"), "documents")
    return store.load_json(spark, path, "doc_id bigint, lang string, n_chars bigint")


# retrieval


@query(f"""WITH {DOCS}, d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS ts FROM docs), n AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM d),
  q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL),
  tf AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS token FROM d) GROUP BY ALL),
  df AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS odds FROM tf, n GROUP BY token, n), idf AS (SELECT token, CASE WHEN odds < 0 THEN 0.25 * (SELECT avg(odds) FROM df) ELSE odds END AS idf FROM df),
  s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 9) AS score FROM tf JOIN idf USING (token) JOIN q USING (token), n GROUP BY ALL)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, round(score, 6) AS score FROM s WHERE score > 0 QUALIFY rank <= 3""")
def okapi_topk(spark, sf):
    return q._hits(retrieval.Okapi(q._chunks(spark, sf)).retrieve(q._asked(spark, sf), 3))


ABOUT = Metadata("table", "invented", "1", 64)


def _vector_store(spark, sf):
    """Vectors of an index beside others that differ in version or model, their chunks and documents (some are missing)."""
    vectors = q._vectors(spark, sf)
    rows = retrieval.index_rows(vectors.select("chunk_id", "embedding"), ABOUT.index("c1"))
    other = rows.where("chunk_id % 4 = 0").withColumn("model", F.lit("older")).unionByName(rows.where("chunk_id % 4 = 1").withColumn("corpus_version", F.lit("c0")))
    kept = rows.where("chunk_id % 9 <> 5").unionByName(other)
    chunks = vectors.where("chunk_id % 11 <> 7").select(F.lit("c1").alias("corpus_version"), "chunk_id", F.col("chunk_id").alias("document_id"), F.lit(0).alias("chunk_index"))
    documents = vectors.where("chunk_id % 13 <> 2").select(F.lit("c1").alias("corpus_version"), F.col("chunk_id").alias("document_id"))
    return kept, chunks, documents


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), near AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({COSINE}, 9) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0
  AND b.vec_id % 9 <> 5 AND b.vec_id % 11 <> 7 AND b.vec_id % 13 <> 2), nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score > 0.2 QUALIFY rank <= 5)
  SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM nn WHERE round(score, 6) > 0.2""")
def vector_store_topk(spark, sf):
    kept, chunks, documents = _vector_store(spark, sf)
    return q._hits(retrieval.vector_store(kept, chunks, documents, q._vector_queries(spark, sf), ABOUT.index("c1"), 5, 0.2))


@query(f"""WITH {HYBRID} SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id * 7919 + query_id) % 101 DESC, rank, chunk_id) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM both_)) WHERE rank <= 3""")
def pooled_rerank(spark, sf):
    """A pool of thirty candidates (here: all that both sides found), cut to three by the reranker."""
    hybrid = retrieval.Hybrid(q._lexical(spark, sf), q._ById(spark, sf))
    found = retrieval.pooled(hybrid, q._asked(spark, sf), q._rerank_scores, 3)
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {DOCS}, {BM25} SELECT item_id AS query_id, 'skipped' AS route, NULL::BIGINT AS chunk_id FROM benchmark WHERE item_id % 4 = 0 AND false
  UNION ALL SELECT item_id, 'kept', item_id FROM benchmark WHERE item_id % 4 = 1 UNION ALL SELECT item_id, 'preset', -1 FROM benchmark WHERE item_id % 4 = 2
  UNION ALL SELECT query_id, 'retrieved', chunk_id FROM ll WHERE query_id % 4 = 3""")
def routed_retrieval(spark, sf):
    n = F.col("query_id")
    asked = q._asked(spark, sf).withColumn("skip", n % 4 == 0)
    kept = asked.where("query_id % 4 < 2").select("query_id", n.alias("chunk_id"))
    preset = asked.where("query_id % 4 <> 3").select("query_id", F.lit(-1).cast("bigint").alias("chunk_id"))
    retriever = retrieval.choose_retriever(q._chunks(spark, sf))
    return retrieval.routed(asked, kept, preset, retriever, 3)[0].select("query_id", "route", "chunk_id")


@query("""SELECT item_id AS query_id, 'missing_knowledge_input' AS error_type, 'retrieval_skipped_missing_corpus_or_fixture' AS reason FROM benchmark WHERE item_id % 4 = 3""")
def retrieval_errors(spark, sf):
    n = F.col("query_id")
    asked = q._asked(spark, sf).withColumn("skip", n % 4 == 0)
    kept = asked.where("query_id % 4 = 1").select("query_id", n.alias("chunk_id"))
    preset = asked.where("query_id % 4 = 2").select("query_id", n.alias("chunk_id"))
    return retrieval.routed(asked, kept, preset, retrieval.choose_retriever(None), 3)[1]


@query(f"""WITH {DOCS}, {BM25} SELECT query_id, chunk_id, lang AS document_title FROM ll JOIN documents ON chunk_id = doc_id WHERE chunk_id % 3 <> 0""")
def citations(spark, sf):
    """Citations of results; a result whose document is missing goes after the cut, so a query may have fewer."""
    found = retrieval.bm25(q._chunks(spark, sf), q._asked(spark, sf))
    docs = _docs(spark, sf).where("doc_id % 3 <> 0").select(_id().alias("document_id"), F.col("lang").alias("title"), F.lit("u").alias("source_url"), F.lit("page").alias("source_type"), F.lit("now").alias("ingested_at"))
    return corpus.citations(found, q._chunks(spark, sf), docs).select("query_id", "chunk_id", "document_title")


@query(f"""WITH {DOCS}, {BM25} SELECT query_id, chunk_id FROM ll WHERE chunk_id % 2 = 0""")
def cited_chunks(spark, sf):
    found = retrieval.bm25(q._chunks(spark, sf), q._asked(spark, sf))
    cited = _docs(spark, sf).where("doc_id % 2 = 0").select(_id().alias("chunk_id"))
    return briefing.cited_chunks(found.union(found), cited).select("query_id", "chunk_id")


@query("""SELECT doc_id, [1.0::DOUBLE, length(lang)::DOUBLE, 0.5::DOUBLE] AS embedding FROM documents""")
def embedded(spark, sf):
    """Texts through a model that each worker loads once; vectors of another size fail."""
    load = lambda: lambda texts: [[1.0, float(len(t)), 0.5] for t in texts]
    return embed(_docs(spark, sf).select("doc_id", "lang"), "lang", load, Metadata("p", "m", "1", 3)).select("doc_id", "embedding")


# recommendations


def _retrievals(spark, sf):
    """Each document is a startup with three retrievals, by position: a topic, a query text, and a program's page."""
    topics = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    rows = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("about Model  Serving").alias("query"), topics("other").alias("topics"), F.lit(False).alias("has_program")),
        F.struct(F.lit(1).alias("pos"), F.lit("needs voice ai").alias("query"), F.when(_id() % 2 == 0, topics("model_serving")).otherwise(topics("vision")).alias("topics"), (_id() % 5 == 0).alias("has_program")),
        F.struct(F.lit(2).alias("pos"), F.lit("programs: inception program fit").alias("query"), topics("computer_vision").alias("topics"), F.lit(False).alias("has_program")),
    )
    held = _docs(spark, sf).select(_id().alias("startup"), F.explode(rows).alias("r")).select("startup", "r.*")
    return held.withColumn("query_id", F.col("startup") * 10 + F.col("pos"))


def _gaps(spark, sf):
    kind = _pick(_id(), "model_serving", "voice_ai", "computer_vision", "data_acceleration", "unknown")
    return _docs(spark, sf).select(_id().alias("startup"), kind.alias("gap_type"), (_id() % 3).cast("int").alias("evidences"), F.lit("d").alias("description"), ((_id() % 10) / 10).alias("confidence"), (_id() % 4 == 0).alias("is_hypothesis"))


@query("""SELECT doc_id AS startup, CASE doc_id % 5 WHEN 0 THEN 'model_serving' WHEN 1 THEN 'voice_ai' WHEN 2 THEN 'computer_vision' WHEN 3 THEN 'data_acceleration' ELSE 'unknown' END AS gap_type,
  CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 + 1 END WHEN 1 THEN doc_id * 10 + 1 WHEN 2 THEN doc_id * 10 + 2 END AS query_id FROM documents""")
def gap_retrievals(spark, sf):
    return recommend.first_retrieval(_gaps(spark, sf), _retrievals(spark, sf), "startup", "gap_type").select("startup", "gap_type", "query_id")


@query("""SELECT doc_id AS startup, CASE WHEN doc_id % 2 = 0 THEN 'inception_program_fit' ELSE 'partner_ecosystem' END AS opportunity_type, CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 + 2 END AS query_id FROM documents""")
def opportunity_retrievals(spark, sf):
    asked = _docs(spark, sf).select(_id().alias("startup"), _pick(_id(), "inception_program_fit", "partner_ecosystem").alias("opportunity_type"))
    return recommend.first_retrieval(asked, _retrievals(spark, sf), "startup", "opportunity_type").select("startup", "opportunity_type", "query_id")


@query("""SELECT doc_id AS startup, 'inception_program_fit' AS opportunity_type, 'model_serving' AS gap_type, 'Program support for model_serving: d' AS description, (doc_id % 10) / 10 AS confidence, doc_id % 4 = 0 AS is_hypothesis
  FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 > 0 AND doc_id % 7 <> 1""")
def program_opportunities(spark, sf):
    have = _docs(spark, sf).select(_id().alias("startup"), F.when(_id() % 7 == 1, "inception_program_fit").otherwise("partner_ecosystem").alias("opportunity_type"))
    return recommend.program_opportunities(_gaps(spark, sf), have, _retrievals(spark, sf))


@query("""WITH r AS (SELECT user_id AS startup, CASE WHEN event_id % 2 = 0 THEN 'inception_program_fit' ELSE 'partner_ecosystem' END AS opportunity_type, event_id AS document_id, (event_id % 5)::DOUBLE AS score FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY startup ORDER BY score DESC, opportunity_type, document_id) AS rank FROM r)
  SELECT startup, opportunity_type, document_id, rank, CASE WHEN row_number() OVER (PARTITION BY startup, opportunity_type ORDER BY rank) = 1 THEN 'top' ELSE 'alternative' END || '_recommendation_for_opportunity' AS selection FROM k""")
def program_ranks(spark, sf):
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("startup"), _pick(n, "inception_program_fit", "partner_ecosystem").alias("opportunity_type"), n.alias("document_id"), F.lit(0).alias("chunk_index"), (n % 5).cast("double").alias("score"))
    return recommend.rank_programs(rows).select("startup", "opportunity_type", "document_id", F.col("rank").cast("bigint").alias("rank"), "selection")


@query("""SELECT source AS startup, count(*) AS gaps, count(*) FILTER (WHERE doc_id % 2 = 0) AS covered_gaps, count(*) FILTER (WHERE doc_id % 5 = 1) AS unsupported_gaps, count(*) FILTER (WHERE doc_id % 3 = 0) AS opportunities,
  count(*) FILTER (WHERE doc_id % 6 = 0) AS covered_opportunities, count(*) FILTER (WHERE doc_id % 4 = 0) AS low, count(*) FILTER (WHERE doc_id % 2 = 0) / count(*) AS gap_coverage FROM documents GROUP BY 1""")
def gap_space_metrics(spark, sf):
    targets = F.when(_id() % 2 == 0, F.array(F.lit("d"))).otherwise(F.array().cast("array<string>"))
    rows = _docs(spark, sf).select(
        F.col("source").alias("startup"), _id(), targets.alias("targets"), F.array_compact(F.array(F.when(_id() % 4 == 0, "low"), F.lit("x"))).alias("review_reasons"),
        F.when(_id() % 5 == 1, "unsupported").otherwise("supported").alias("support_status"),
    )
    found = assessment.gap_space_metrics(rows, rows.where("doc_id % 3 = 0"))
    return found.select("startup", "gaps", "covered_gaps", "unsupported_gaps", "opportunities", "covered_opportunities", F.coalesce(F.col("reason_counts")["low"], F.lit(0)).alias("low"), "gap_coverage")


@query("""SELECT recommendations, supported, hypotheses, blocked, official_cited, with_evidence, supported / recommendations AS supported_share, official_cited / recommendations AS official_cited_share, with_evidence / recommendations AS with_evidence_share
  FROM (SELECT count(*) AS recommendations, count(*) FILTER (WHERE doc_id % 3 = 0) AS supported, count(*) FILTER (WHERE doc_id % 3 = 1) AS hypotheses, count(*) FILTER (WHERE doc_id % 3 = 2) AS blocked,
  count(*) FILTER (WHERE doc_id % 2 = 0) AS official_cited, count(*) FILTER (WHERE doc_id % 5 > 0) AS with_evidence FROM documents)""")
def recommendation_metrics(spark, sf):
    return recommend.metrics(_docs(spark, sf).select(_pick(_id(), "supported", "hypothesis", "blocked").alias("state"), (_id() % 2 == 0).alias("official"), (_id() % 5).alias("evidences")))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'collection_quality_not_ready' END, CASE WHEN doc_id % 3 = 0 THEN 'assessment_not_ready_for_recommendation' END, CASE WHEN doc_id % 5 = 0 THEN 'conflicting_startup_evidence' END,
  CASE WHEN doc_id % 7 = 0 THEN 'high_wrapper_risk' END, CASE WHEN doc_id % 6 >= 3 THEN 'excessive_unknown_fields,unknown_field:a,unknown_field:b' END, CASE WHEN doc_id % 4 = 0 THEN 'gap_space_not_ready_for_recommendation,low' END) AS reasons FROM documents""")
def blocking_reasons(spark, sf):
    of = lambda k: _id() % k == 0
    names = F.array(F.lit("a"), F.lit("b"))
    own = F.array(F.lit("low"), F.lit(recommend.GAP_SPACE_READY))
    why = recommend.blocking_reasons(~of(2), ~of(3), of(5), of(7), _id() % 6, names, ~of(4), own)
    return _docs(spark, sf).select("doc_id", F.array_join(why, ",").alias("reasons"))


@query("""SELECT doc_id AS startup, CASE WHEN doc_id % 2 = 1 THEN 'insufficient_evidence' WHEN doc_id % 3 = 0 THEN 'ai_enabled' ELSE 'non_ai' END AS classification,
  CASE WHEN doc_id % 2 = 1 THEN 0 WHEN doc_id % 3 = 0 THEN 0.64 ELSE 0.72 END::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 1 OR doc_id % 3 <> 0 THEN 'unknown' ELSE 'computer_vision' END AS gap_type FROM documents""")
def unready_runs(spark, sf):
    """Profiles of a run whose collection is not good enough are not judged."""
    said = _docs(spark, sf).select(_id().alias("startup"), F.when(_id() % 3 == 0, "usa computer vision").otherwise("padaria").alias("text"))
    found = assessment.classify(assessment.criteria(said), ready=F.col("startup") % 2 == 0)
    gaps = assessment.technical_gaps(found, "startup").select("startup", "gap_type")
    return found.select("startup", "classification", "confidence").join(gaps, "startup")


@query("""SELECT doc_id AS startup, signal_type, 0.8::DOUBLE AS confidence FROM documents, (VALUES ('ai_product_centrality', 1), ('ai_architecture_depth', 2), ('production_readiness', 2)) s(signal_type, k) WHERE doc_id % 3 >= k""")
def positive_signals(spark, sf):
    said = _docs(spark, sf).select(_id().alias("startup"), _pick(_id(), "padaria", "visao computacional", "mlops").alias("text"))
    return assessment.positive_signals(assessment.classify(assessment.criteria(said)), "startup")


@query("""SELECT source AS startup, CASE WHEN count(*) % 2 = 0 THEN 'ready_for_use' ELSE 'ready_for_human_review' END AS status, 'profile:lang: ' || min(lang) || ';diagnosis:' || source || ' is x;unknown:unknown: site' AS claims,
  'u-' || source AS evidences, 'What is the site?' AS questions FROM documents GROUP BY source""")
def executive_briefings(spark, sf):
    per = _docs(spark, sf).groupBy(F.col("source").alias("startup")).agg(F.min("lang").alias("value"), F.count("*").alias("n"))
    url = F.array(F.concat(F.lit("u-"), "startup"))
    known = per.select("startup", F.lit("lang").alias("field"), F.lit(0).alias("pos"), "value", url.alias("evidences"))
    lost = per.select("startup", F.lit("site").alias("field"), F.lit(1).alias("pos"), F.lit("unknown").alias("value"), F.array().cast("array<string>").alias("evidences"))
    judged = briefing.claims(per, "diagnosis", F.concat("startup", F.lit(" is x")), F.lit(0), url)
    outcome = per.select("startup", (F.col("n") % 2 == 0).alias("ready"), F.lit("x").alias("classification"), F.lit("low").alias("final_priority"), F.lit("wait").alias("next_action"))
    asked = per.select("startup", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), F.lit("What is the site?").alias("question"))
    made = briefing.executive(briefing.profile_claims(known.union(lost)).unionByName(judged).unionByName(judged), outcome, asked)
    said = F.array_join(F.transform("claims", lambda c: F.concat(c["claim_type"], F.lit(":"), c["text"])), ";")
    return made.select("startup", "status", said.alias("claims"), F.array_join("evidence_references", ",").alias("evidences"), F.array_join("questions", ",").alias("questions"))


@query("""SELECT source AS startup, 'late,early' AS reasons, CASE WHEN bool_or(doc_id % 2 = 0) THEN 'lang' ELSE '' END AS unknowns, CASE WHEN bool_or(doc_id % 5 = 0) THEN 'size' ELSE '' END AS conflicts,
  count(DISTINCT doc_id) FILTER (WHERE doc_id % 3 = 1) AS hypotheses, (bool_or(doc_id % 2 = 0)::INT + bool_or(doc_id % 5 = 0)::INT + count(DISTINCT doc_id) FILTER (WHERE doc_id % 3 = 1))::INT AS questions FROM documents GROUP BY 1""")
def review_briefings(spark, sf):
    docs = _docs(spark, sf).withColumnRenamed("source", "startup")
    outcome = docs.select("startup").distinct().withColumn("next_action", F.lit("ask"))
    reasons = docs.select("startup", F.lit(2).alias("pos"), F.lit("early").alias("reason")).union(docs.select("startup", F.lit(1), F.lit("late")))
    fields = docs.select("startup", F.lit("lang").alias("field"), F.when(_id() % 2 == 0, "unknown").otherwise("x").alias("value"))
    groups = docs.select("startup", F.lit("size").alias("field"), (_id() % 5 == 0).alias("has_conflict"))
    gaps = docs.select("startup", F.lit("g").alias("gap_type"))
    made = docs.select("startup", _id().cast("string").alias("id"), _pick(_id(), "supported", "hypothesis", "blocked").alias("state"))
    found = briefing.human_review(outcome, reasons, fields, groups, gaps, made)
    joined = [F.array_join(c, ",").alias(c) for c in ("reasons", "unknowns", "conflicts")]
    return found.select("startup", *joined, F.size("hypothesis").cast("bigint").alias("hypotheses"), F.size("questions").alias("questions"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'technical_gap_narrative: fast\ncommercial_approach_narrative: model' ELSE 'fallback' END AS narrative, CASE WHEN doc_id % 3 = 2 THEN 'ValueError' END AS error FROM documents""")
def narratives(spark, sf):
    def answer(prompt):
        if "fail" in prompt:
            raise ValueError(prompt)
        return "technical_gap_narrative: fast\ncommercial_approach_narrative: " + ("model" if "model" in prompt else "wonder")

    story = "technical_gap_narrative: fast\ncommercial_approach_narrative: model"
    asked = _docs(spark, sf).select("doc_id", _pick(_id(), story, "fast", "fail").alias("prompt"), F.lit("fallback").alias("fallback"))
    return language.narratives(asked, language.Scripted(answer)).select("doc_id", "narrative", "error")


# candidates and pages


@query("""SELECT name, rank FROM (SELECT s_name AS name, row_number() OVER (ORDER BY round(s_acctbal / 1000) DESC, s_name) AS rank FROM supplier) WHERE rank <= 7""")
def candidate_order(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.round(F.col("s_acctbal") / 1000).alias("score"))
    return entities.best_candidates(rows, 7).select("name", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'by key' WHEN 1 THEN 'by name' END AS pages FROM documents""")
def candidate_pages(spark, sf):
    key, name = F.concat(F.lit("k"), _id().cast("string")), F.concat(F.lit("n"), _id().cast("string"))
    docs = _docs(spark, sf)
    stored = docs.where("doc_id % 3 = 0").select(key.alias("key"), F.lit("by key").alias("pages"))
    stored = stored.union(docs.where("doc_id % 3 < 2").select(name, F.lit("by name")))
    return entities.with_pages(docs.select("doc_id", key.alias("key"), name.alias("name")), stored).select("doc_id", "pages")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Acme Labs' WHEN 1 THEN 'Given' ELSE 'unknown' END AS name, CASE doc_id % 3 WHEN 2 THEN 'unknown' ELSE 'https://acme-labs.io' END AS primary_url, 0.9::DOUBLE AS score, 'company' AS source_type FROM documents""")
def controlled_sites(spark, sf):
    one = entities.known_site(_pick(_id(), "https://www.acme-labs.io/about", "https://acme-labs.io", "unknown"), _pick(_id(), "unknown", " Given ", "unknown"))
    return _docs(spark, sf).select("doc_id", one.alias("x")).select("doc_id", "x.name", "x.primary_url", "x.score", "x.source_type")


@query("""SELECT page_id AS key, CASE WHEN page_id % 4 = 0 THEN 'unknown' ELSE url END AS url, CASE WHEN page_id % 4 = 0 THEN 'missing_primary_url' END AS error_category FROM pages""")
def collected(spark, sf):
    pages = table(spark, sf, "pages")
    wanted = pages.select(F.col("page_id").alias("key"), F.when(F.col("page_id") % 4 == 0, "unknown").otherwise(F.concat(F.lit("s"), F.col("page_id").cast("string"))).alias("primary_url"))
    found = pages.select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("site"), "url", F.lit("t").alias("main_text"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_category"))
    return adapters.collect(wanted, found).select("key", "url", "error_category")


def _sites(spark, sf):
    """One site a page, by number: allowed, allowed but empty, one that fails, and one behind a login."""
    n = F.col("page_id")
    return table(spark, sf, "pages").select(F.concat(F.lit("https://s"), n.cast("string"), F.lit(".com/"), _pick(n, "ok", "empty", "fail", "login")).alias("site"))


@query("""SELECT 'https://s' || page_id || '.com/' || CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'fail' ELSE 'login' END AS url, CASE page_id % 4 WHEN 0 THEN 'the text' END AS main_text,
  CASE page_id % 4 WHEN 1 THEN 'service_empty_content' WHEN 2 THEN 'service_failed' WHEN 3 THEN 'login_required' END AS error_category FROM pages""")
def scraped_pages(spark, sf):
    def service(site):
        if site.endswith("fail"):
            raise ConnectionError(site)
        return {"data": [{"markdown": "", "text": " the  text" if site.endswith("ok") else None, "metadata": {"title": "T", "statusCode": 200, "sourceURL": site + "?x=1"}}]}

    return adapters.scraped(_sites(spark, sf), service).select("url", "main_text", "error_category")


@query("""SELECT 'https://s' || page_id || '.com/' || CASE WHEN page_id % 4 = 3 THEN 'login' WHEN page_id % 4 = 2 THEN 'fail' ELSE 'p' || k END AS url, CASE WHEN page_id % 4 < 2 AND k <> 1 THEN 'body ' || k END AS main_text,
  CASE WHEN page_id % 4 = 3 THEN 'login_required' WHEN page_id % 4 = 2 THEN 'crawl_failed' WHEN k = 1 THEN 'crawl_empty_content' END AS error_category FROM pages, (VALUES (0), (1), (2)) x(k) WHERE k = 0 OR page_id % 4 < 2""")
def crawled_items(spark, sf):
    def crawl(site, max_pages, max_depth):
        if site.endswith("fail"):
            raise ConnectionError(site)
        root = site.rsplit("/", 1)[0]
        for k in range(9):
            yield {"url": f"{root}/p{k}", "body": "" if k == 1 else f"body  {k}", "title": "t"}

    return adapters.crawled(_sites(spark, sf), crawl, 3).select("url", "main_text", "error_category")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'one+two' ELSE 'stdlib_html' END AS strategy, CASE page_id % 3 WHEN 0 THEN 'from one' WHEN 1 THEN 'from one' ELSE 'from page' END AS main_text,
  CASE page_id % 3 WHEN 1 THEN 'title two' ELSE 'T' END AS title, page_id % 3 = 2 AS needs_js FROM pages""")
def best_extraction(spark, sf):
    """Extractors in order of precedence, the standard parser last: each field from the first that has it."""
    n = F.col("page_id")
    html = F.concat(_pick(n, "A", "B", "C"), F.lit("<title>T</title><div id=\"root\">from page</div>"))
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_replace(html, "^([ABC])", "<!--$1-->").alias("html"))

    def one(html):
        return "", ("from one" + " " * 3) if "A--" in html or "B--" in html else "", []

    def two(html):
        if "A--" in html:
            raise ValueError(html)
        return ("title two", "from two", ["/x"]) if "B--" in html else ("", "", [])

    found = adapters.extract_best(pages, {"one": one, "two": two})
    return found.select("page_id", "strategy", "main_text", "title", (F.col("needs_js") & (n % 3 == 2)).alias("needs_js"))


@query("""SELECT page_id, 'https://s' || page_id || '.com' AS url, CASE page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS status_code, CASE page_id % 3 WHEN 1 THEN 'unavailable' WHEN 2 THEN 'timeout' END AS error_category FROM pages""")
def fetched_pages(spark, sf):
    """Pages through an injected fetcher: what fails is a row with its category."""

    def get(url):
        n = int(url.removeprefix("https://s").removesuffix(".com"))
        if n % 3 == 1:
            raise urllib.error.HTTPError(url, 404, "gone", None, None)
        if n % 3 == 2:
            raise TimeoutError(url)
        return url, 200, "<p>x</p>"

    urls = table(spark, sf, "pages").select(F.concat(F.lit("https://s"), F.col("page_id").cast("string"), F.lit(".com")).alias("url"))
    found = connectors.fetch(urls, get)
    return found.select(F.regexp_extract("url", r"s(\d+)", 1).cast("bigint").alias("page_id"), "url", "status_code", "error_category")


@query("""SELECT page_id AS run_id, 'found [search_term=t' || page_id || '; source=web; position=1]' AS snippet, NULL AS error_type, NULL AS message FROM pages WHERE page_id % 3 > 0
  UNION ALL SELECT page_id, NULL, 'URLError', 'no route: host' FROM pages WHERE page_id % 3 = 0""")
def search_runs(spark, sf):
    """Executed plans: results say where they come from, searches that failed are rows of their own."""
    n = F.col("page_id")
    items = table(spark, sf, "pages").select(n.alias("run_id"), F.concat(F.lit("t"), n.cast("string")).alias("term"), F.lit("web").alias("target_source"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("found").alias("description"))).alias("results")).alias("web")))
    answers = items.select("run_id", "term", F.when(F.col("run_id") % 3 > 0, body).alias("body"), F.when(F.col("run_id") % 3 == 0, "URLError: no route: host").alias("error"))
    found = search.response_results(answers.where("body IS NOT NULL"), 5).join(items, ["run_id", "term"])
    none = F.lit(None).cast("string")
    good = search.traced(found).select("run_id", "snippet", none.alias("error_type"), none.alias("message"))
    return good.unionByName(search.search_errors(items, answers).select("run_id", none.alias("snippet"), "error_type", "message"))


@query("""SELECT doc_id AS startup, 'model_serving' AS gap_type, 'model serving' || CASE WHEN doc_id % 2 = 0 THEN ' ' || lang ELSE '' END AS query FROM documents WHERE doc_id % 3 > 0""")
def retrieval_requests(spark, sf):
    status = _pick(_id(), "unsupported", "hypothesis", "supported")
    mapped = _docs(spark, sf).select(_id().alias("startup"), F.lit("model_serving").alias("gap_type"), F.array(F.lit("d")).alias("targets"), status.alias("support_status"))
    signals = _docs(spark, sf).where("doc_id % 4 <> 1").select(_id().alias("startup"), F.when(_id() % 2 == 0, F.col("lang")).otherwise("").alias("signals"))
    return assessment.retrieval_requests(mapped, signals, "startup")


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN 'unknown_chunk' ELSE 'changed_chunk' END AS reason FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 3""")
def rerank_checks(spark, sf):
    rows = _docs(spark, sf).select((_id() % 5).alias("query_id"), _id().alias("chunk_id"), F.col("lang").alias("document_id"))
    changed = rows.withColumn("document_id", F.when(F.col("chunk_id") % 7 == 3, "other").otherwise(F.col("document_id")))
    return retrieval.invented(rows.where("chunk_id % 10 <> 0"), changed).select("chunk_id", "reason")


@query("""WITH r AS (SELECT doc_id, sha256(concat_ws(chr(0), 'c' || doc_id, 'd' || doc_id, doc_id % 3, source, lang)) AS h FROM documents), a AS (SELECT doc_id // 4096 AS p, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM r GROUP BY 1)
  SELECT CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS fingerprint FROM a""")
def chunking_fingerprint(spark, sf):
    chunks = _docs(spark, sf).select(
        _id().alias("pos"), F.concat(F.lit("c"), _id().cast("string")).alias("chunk_id"), F.concat(F.lit("d"), _id().cast("string")).alias("document_id"), (_id() % 3).alias("chunk_index"),
        F.col("source").alias("topic"), F.col("lang").alias("text"),
    )
    return retrieval.chunking_fingerprint(chunks)


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 'f0=' || lang || ',f1=x' ELSE '' END AS groups, CASE WHEN doc_id % 5 < 3 THEN 'last' END AS classification FROM documents""")
def profile_records(spark, sf):
    docs = _docs(spark, sf)
    rows = docs.select(_id().alias("key"), (_id() % 5).alias("company_name"))
    groups = docs.where("doc_id % 2 = 0").select(_id().alias("key"), F.explode(F.array(F.struct(F.lit("f1").alias("field"), F.lit("x").alias("value")), F.struct(F.lit("f0").alias("field"), F.col("lang").alias("value")))).alias("g"))
    groups = groups.select("key", "g.*", F.lit(False).alias("has_conflict"))
    judged = spark.range(6).select((F.col("id") % 3).alias("company_name"), F.col("id").alias("pos"), F.when(F.col("id") < 3, "first").otherwise("last").alias("classification"))
    said = F.array_join(F.transform("groups", lambda g: F.concat(g["field"], F.lit("="), g["value"])), ",")
    return profiles.with_records(rows, groups, judged).select("key", F.coalesce(said, F.lit("")).alias("groups"), "classification")


@query("""SELECT 'raw_pages' AS artifact, page_id AS id, url AS said FROM pages UNION ALL SELECT 'quality', doc_id, lang FROM documents WHERE doc_id % 2 = 0""")
def run_folder(spark, sf):
    """A run's artifacts as a folder with a manifest, read back by it."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("said"))
    half = _docs(spark, sf).where("doc_id % 2 = 0").select(_id().alias("id"), F.col("lang").alias("said"))
    folder = store.save_run(spark, fresh_path(spark, "runs"), "run-1", {"raw_pages": pages}, {"downstream/a/quality": half})
    found = store.load_run(spark, folder, dict.fromkeys(("raw_pages", "downstream/a/quality"), "id bigint, said string"))
    part = lambda name, label: found[name].select(F.lit(label).alias("artifact"), "id", "said")
    return part("raw_pages", "raw_pages").unionByName(part("downstream/a/quality", "quality"))


@query("""SELECT source AS kind, count(*) + 1 AS runs, count(*) AS given FROM (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY 1""")
def run_rows(spark, sf):
    """Runs are appended under ids of their own: one for each source and language, all in one commit, and one for each source whose id
    the store gives; an id that is there is refused."""
    runs = _store(spark)
    made = _docs(spark, sf).where("source IS NOT NULL AND lang IS NOT NULL").select(F.concat_ws("/", "source", "lang").alias("run_id"), F.col("source").alias("kind")).distinct()
    with runs.transaction() as t:
        t.insert("runs", made.withColumn("created_at", F.current_timestamp()).select("run_id", "created_at", "kind"), "run_id")
    fresh = made.select("kind").distinct().select(F.expr("uuid()").alias("run_id"), F.current_timestamp().alias("created_at"), "kind")
    with runs.transaction() as t:
        t.insert("runs", fresh, "run_id")
    given = F.count_if(F.startswith("run_id", F.concat("kind", F.lit("/")))).alias("given")
    return runs.read("runs").groupBy("kind").agg(F.count("*").alias("runs"), given)
