"""Queries over rules about names, URLs, sources, evidence and scores; inputs are made of the driver tables so that every branch
is reached."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import maps, secrets
from quarrylight.functions import text as tx
from quarrylight.operators import assessment, corpus, metrics, operations, policy, profiles, recommend, retrieval, search
from quarrylight.plans.registry import query
from quarrylight.tables import table

def _id():
    return F.col("doc_id")


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")


def _pick(column, *values):
    """A value by the number's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


def _case(number: str, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN {number} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


NAMES = ("Acme Ltda", "Ação & Cia", "Beta Tecnologia S.A.", "startup", "  Gama-One Inc. ", "10 startups para acompanhar", "a b c d e f g h", "Top fintechs", "unknown", "Zed")
KEYS = ("acme", "acao cia", "beta", "unknown", "gama-one", "10 startups para acompanhar", "a b c d e f g h", "top fintechs", "unknown", "zed")
URLS = (
    "https://www.acme.com.br/a/?x=1", "http://exame.com/news", "https://startse.com/x", "https://br.linkedin.com/in/p", "acme.io", "unknown", "https://x.com/in/y",
    "https://valor.globo.com/y", "", "https://gov.org.br/",
)
DOMAINS = ("acme.com.br", "exame.com", "startse.com", "linkedin.com", "acme.io", "unknown", "x.com", "globo.com", "unknown", "gov.org.br")
TYPES = ("company", "news", "directory", "personal_profile", "company", "unknown", "personal_profile", "news", "unknown", "company")


@query(f"SELECT doc_id, {_case('doc_id', *KEYS)} AS key, doc_id % 10 NOT IN (5, 6, 7, 8) AS plausible FROM documents")
def startup_names(spark, sf):
    name = _pick(_id(), *NAMES)
    return _docs(spark, sf).select("doc_id", tx.startup_name(name).alias("key"), policy.plausible_name(name).alias("plausible"))


@query(f"SELECT doc_id, {_case('doc_id', *DOMAINS)} AS domain, {_case('doc_id', *TYPES)} AS source_type FROM documents")
def source_types(spark, sf):
    url = _pick(_id(), *URLS)
    return _docs(spark, sf).select("doc_id", tx.domain(url).alias("domain"), policy.source_type(url).alias("source_type"))


@query("""SELECT source_type, n, least(round(base + 0.05 * (n - 1), 2), 0.98)::DOUBLE AS score FROM (SELECT * FROM
  (VALUES ('company', 0.9), ('directory', 0.75), ('news', 0.65), ('personal_profile', 0.45), ('unknown', 0.2)) s(source_type, base),
  (SELECT DISTINCT l_linenumber::BIGINT AS n FROM lineitem))""")
def source_scores(spark, sf):
    n = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("n")).distinct()
    kinds = n.withColumn("source_type", F.explode(F.array(*map(F.lit, policy.SOURCE_SCORES))))
    return kinds.select("source_type", "n", policy.source_score(F.col("source_type"), F.col("n")).alias("score"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS agrees FROM documents""")
def company_names(spark, sf):
    name, site = _pick(_id(), "acme", "acme ai", "acmeai", "beta", "unknown"), _pick(_id(), "acme", "acme", "acme", "acme", "unknown")
    return _docs(spark, sf).select("doc_id", policy.company_name_matches(name, site).alias("agrees"))


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'blocked_domain' ELSE 'allowed' END AS pol, doc_id % 3 <> 0 AS ok, (doc_id % 5)::DOUBLE AS rate, CASE WHEN doc_id % 2 = 0 THEN 2.5::DOUBLE END AS delay FROM documents),
  r AS (SELECT *, CASE WHEN pol <> 'allowed' THEN pol WHEN NOT ok THEN 'robots_disallowed' ELSE 'allowed' END AS reason FROM p)
  SELECT doc_id, reason = 'allowed' AS allowed, reason, CASE WHEN reason = 'allowed' THEN greatest(rate, coalesce(delay, 0)) ELSE 0 END AS delay FROM r""")
def collection_decisions(spark, sf):
    judged = policy.collection_decision(
        F.when(_id() % 4 == 0, "blocked_domain").otherwise("allowed"), _id() % 3 != 0, F.lit("robots_disallowed"), (_id() % 5).cast("double"), F.when(_id() % 2 == 0, 2.5)
    )
    return _docs(spark, sf).select("doc_id", judged.alias("x")).select("doc_id", "x.*")


@query("""SELECT code, kind, CASE kind WHEN 'timeout' THEN 'timeout' WHEN 'url' THEN 'network_error' WHEN 'http' THEN CASE WHEN code IN (401, 403, 429) THEN 'blocked'
  WHEN code IN (404, 410, 500, 502, 503, 504) THEN 'unavailable' ELSE 'network_error' END ELSE 'unknown' END AS category, count(*) AS n
  FROM (SELECT 400 + (event_id % 110)::INT AS code, CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http' WHEN 2 THEN 'url' ELSE 'other' END AS kind FROM events) GROUP BY ALL""")
def error_categories(spark, sf):
    rows = table(spark, sf, "events").select((F.lit(400) + F.col("event_id") % 110).cast("int").alias("code"), _pick(F.col("event_id"), "timeout", "http", "url", "other").alias("kind"))
    return rows.groupBy("code", "kind", policy.error_category(F.col("code"), F.col("kind")).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, page_id % 3 <> 0 OR page_id % 4 <> 1 AS allowed, CASE WHEN page_id % 3 = 0 AND page_id % 4 = 1 THEN 'robots_disallowed' ELSE 'allowed' END AS reason,
  CASE WHEN page_id % 3 = 0 THEN 2.0::DOUBLE END AS delay FROM pages WHERE page_id % 3 <> 2
  UNION ALL SELECT page_id, false, 'robots_unavailable', NULL FROM pages WHERE page_id % 3 = 2""")
def robots_rules(spark, sf):
    n = F.col("page_id")
    site = F.concat(F.lit("https://s"), (n % 3).cast("string"), F.lit(".io"))
    urls = table(spark, sf, "pages").select(F.concat(site, F.when(n % 4 == 1, "/private/").otherwise("/open/"), n.cast("string")).alias("url"))
    bodies = [("https://s0.io", "User-agent: *\nDisallow: /private/\nCrawl-delay: 2"), ("https://s1.io", ""), ("https://s2.io", None)]
    found = policy.robots_decisions(urls, spark.createDataFrame(bodies, "origin string, body string"))
    return found.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("page_id"), "allowed", "reason", F.col("crawl_delay").alias("delay"))


@query("""SELECT doc_id, doc_id % 4 = 0 AS positive, CASE doc_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'none_official' ELSE 'no_results' END AS quality FROM documents""")
def signals_and_quality(spark, sf):
    docs = _docs(spark, sf)
    value = _pick(_id(), "usa modelos", "nenhum uso de ia", "unknown", "No AI here")
    results = docs.where("doc_id % 3 < 2").select(_id().alias("query_id"), (_id() % 3 == 0).alias("is_official"))
    quality = retrieval.official_quality(results, docs.select(_id().alias("query_id")))
    return docs.select("doc_id", assessment.positive_signal(value).alias("positive")).join(quality.withColumnRenamed("query_id", "doc_id"), "doc_id")


@query("""SELECT source, count(*) AS attempts, count(*) FILTER (WHERE doc_id % 7 <> 0) AS successes, count(*) FILTER (WHERE doc_id % 7 <> 0) / count(*) AS success_rate FROM documents GROUP BY 1""")
def source_success(spark, sf):
    return profiles.source_success(_docs(spark, sf).select("source", (_id() % 7 == 0).alias("is_error")))


@query("""SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def ordered_distinct(spark, sf):
    return metrics.ordered_distinct(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1""")
def reason_counts(spark, sf):
    return metrics.ordered_counts(table(spark, sf, "events"), "event_type", "event_id")


@query("""SELECT k, CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'mixed' END AS label FROM
  (SELECT 'all' AS k, source AS s FROM documents UNION ALL SELECT 'one', 'bm25' FROM documents) GROUP BY 1 UNION ALL SELECT 'none', 'unknown'""")
def strategy_labels(spark, sf):
    docs = _docs(spark, sf).select(F.col("source").alias("strategy"))
    out = metrics.strategy_label(docs).withColumn("k", F.lit("all"))
    out = out.union(metrics.strategy_label(docs.select(F.lit("bm25").alias("strategy"))).withColumn("k", F.lit("one")))
    return out.union(metrics.strategy_label(docs.where("false")).withColumn("k", F.lit("none")))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
  SELECT o_custkey, o_orderkey, rank FROM (SELECT *, max(score) OVER (PARTITION BY o_custkey) AS best FROM r) WHERE rank > 1 AND (best - score) / greatest(abs(best), 1) <= 0.15""")
def close_alternatives(spark, sf):
    from pyspark.sql.window import Window

    order = Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey")
    ranked = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return metrics.close_alternatives(ranked, "o_custkey").select("o_custkey", "o_orderkey", "rank")


@query("""SELECT doc_id, trim(replace(CASE doc_id % 3 WHEN 0 THEN 'model_serving' WHEN 1 THEN 'voice_ai' ELSE '' END, '_', ' ') || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'inception fit' ELSE '' END
  || ' ' || lang || ' ' || CASE WHEN doc_id % 5 = 0 THEN 'a b' ELSE '' END || ' ' || source) AS query FROM documents""")
def query_texts(spark, sf):
    built = retrieval.query_text(_pick(_id(), "model_serving", "voice_ai", ""), _pick(_id(), "inception_fit", ""), F.col("lang"), F.when(_id() % 5 == 0, "a b").otherwise(""), F.col("source"))
    return _docs(spark, sf).select("doc_id", built.alias("query"))


@query("""SELECT doc_id AS startup, 'inception_program_fit' AS opportunity_type, CASE WHEN doc_id % 2 = 0 THEN 0.78 ELSE 0.62 END::DOUBLE AS confidence, doc_id % 2 <> 0 AS is_hypothesis
  FROM documents WHERE doc_id % 3 = 0""")
def program_needs(spark, sf):
    said = _docs(spark, sf).select(_id().alias("startup"), F.when(_id() % 3 == 0, "quer credits e suporte tecnico").otherwise("nada").alias("_t"), (_id() % 2 == 0).alias("ready"))
    return assessment.opportunities(said, "startup", "ready")


@query("""SELECT doc_id, round(c * 10 + CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.5 END * 5 + least(greatest(doc_id % 17 - 3, 0), 10) / 10, 6) AS score
  FROM (SELECT doc_id, (doc_id % 100)::DOUBLE / 100 AS c FROM documents)""")
def program_scores(spark, sf):
    kind = _pick(_id(), "official_documentation", "developer_page", "program_page", "blog")
    score = recommend.program_score((_id() % 100).cast("double") / 100, kind, (_id() % 17 - 3).cast("double"))
    return _docs(spark, sf).select("doc_id", F.round(score, 6).alias("score"))


@query("""SELECT 'all' AS run, 'briefing' AS outcome UNION ALL SELECT 'review', 'human_review' UNION ALL SELECT 'little', 'needs_more_collection'""")
def run_outcomes(spark, sf):
    rows = _docs(spark, sf).select((_id() % 5 == 0).alias("has_briefing"), (_id() % 2 == 0).alias("needs_review"))
    name = lambda df, run: recommend.outcome(df).withColumn("run", F.lit(run))
    out = name(rows, "all").union(name(rows.where("NOT has_briefing"), "review"))
    return out.union(name(rows.where("NOT has_briefing AND NOT needs_review"), "little"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'corpus_version_changed' END, CASE WHEN doc_id % 3 = 0 THEN 'model_changed' END, CASE WHEN doc_id % 5 = 0 THEN 'dimension_changed' END,
  CASE WHEN doc_id % 7 = 0 THEN 'chunking_fingerprint_changed' END) AS reasons FROM documents""")
def index_rebuilds(spark, sf):
    built = _docs(spark, sf).select(
        "doc_id", F.when(_id() % 2 == 0, "v1").otherwise("v2").alias("corpus_version"), F.lit("p").alias("provider"), F.when(_id() % 3 == 0, "m1").otherwise("m2").alias("model"), F.lit("1").alias("version"),
        F.when(_id() % 5 == 0, 8).otherwise(16).alias("dimension"), F.lit("cosine").alias("metric"), F.when(_id() % 7 == 0, F.lit(None).cast("string")).otherwise("f").alias("chunking_fingerprint"),
    )
    now = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"corpus_version": "v2", "provider": "p", "model": "m2", "version": "1", "dimension": 16, "metric": "cosine", "chunking_fingerprint": "f"}.items()])
    return retrieval.index_changes(built, now).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT doc_id, CASE WHEN i > 0 THEN trim(substr(t, greatest(i - 80, 1), least(i - 1 + length(v) + 80, length(t)) - greatest(i - 81, 0))) ELSE trim(substr(t, 1, 160)) END AS snippet
  FROM (SELECT doc_id, t, v, strpos(strip_accents(lower(t)), strip_accents(lower(v))) AS i FROM
  (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', 'x', 'g') AS t, CASE WHEN doc_id % 2 = 0 THEN 'onth' ELSE 'zzzq' END AS v FROM documents))""")
def snippets(spark, sf):
    plain = _docs(spark, sf).select("doc_id", F.regexp_replace("text", "[^ -~]", "x").alias("t"), _pick(_id(), "onth", "zzzq").alias("v"))
    return plain.select("doc_id", tx.snippet(F.col("t"), F.col("v")).alias("snippet"))


@query("""WITH s(pos, name, domain) AS (VALUES (0, 'Base', 'base.com'), (1, 'News', NULL), (2, 'base', 'base.com')), p AS (SELECT item_id AS run_id, 'startups ' || (item_id % 7) AS term, 'startup ai ' || (item_id % 7) AS english FROM benchmark),
  r AS (SELECT run_id, 0 AS p, term, 'web' AS target_source, 'broad_web' AS scope FROM p UNION ALL SELECT run_id, 1, english, 'web', 'broad_web' FROM p
    UNION ALL SELECT run_id, pos + 2, CASE WHEN domain IS NULL THEN term || ' ' || name ELSE 'site:' || domain || ' ' || term END, name, 'specific_source' FROM p, s),
  k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id, lower(term), lower(target_source) ORDER BY p) = 1)
  SELECT run_id, term, target_source, scope, row_number() OVER (PARTITION BY run_id ORDER BY p)::INT AS priority FROM k""")
def search_plans(spark, sf):
    n = F.col("item_id")
    params = table(spark, sf, "benchmark").select(n.alias("run_id"), F.concat(F.lit("startups "), (n % 7).cast("string")).alias("term"), F.concat(F.lit("startup ai "), (n % 7).cast("string")).alias("english_term"))
    sources = spark.createDataFrame([("Base", "base.com", 0), ("News", None, 1), ("base", "base.com", 2)], "name string, domain string, pos int")
    return search.plan(params, sources)


@query("""SELECT page_id AS run_id, k + 1 AS position, CASE WHEN k = 0 THEN 'first' ELSE 'unknown' END AS title, CASE WHEN k = 0 THEN url ELSE 'unknown' END AS url, CASE k WHEN 0 THEN 'said' WHEN 1 THEN 'short' ELSE 'unknown' END AS snippet
  FROM pages, (VALUES (0), (1), (2)) x(k) WHERE page_id % 2 = 0 OR k < 1""")
def search_responses(spark, sf):
    n = F.col("page_id")
    hit = lambda t, u, d, s: F.struct(F.lit(t).alias("title"), u.alias("url"), F.lit(d).alias("description"), F.lit(s).alias("snippet"))
    hits = F.array(hit("first", F.col("url"), "said", "no"), hit("", F.lit(None).cast("string"), "", "short"), hit(None, F.lit(""), None, None), hit("x", F.lit("cut"), "c", "c"))
    body = F.to_json(F.struct(F.struct(F.when(n % 2 == 0, hits).otherwise(F.slice(hits, 1, 1)).alias("results")).alias("web")))
    rows = table(spark, sf, "pages").select(n.alias("run_id"), F.lit("t").alias("term"), body.alias("body"))
    return search.response_results(rows, 3).select("run_id", F.col("position").cast("int").alias("position"), "title", "url", "snippet")


@query("""SELECT doc_id AS query_id, CASE doc_id % 5 WHEN 0 THEN 'artificial_intelligence' WHEN 1 THEN 'generative_ai' WHEN 2 THEN 'fintech' WHEN 3 THEN 'unknown' ELSE 'artificial_intelligence' END AS theme,
  CASE doc_id % 5 WHEN 2 THEN 'growth' ELSE 'unknown' END AS stage, CASE doc_id % 5 WHEN 0 THEN 'SP' WHEN 1 THEN 'BR' WHEN 2 THEN 'SP' ELSE 'unknown' END AS region, CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 3 END AS "limit" FROM documents""")
def parsed_queries(spark, sf):
    said = _pick(_id(), "startups de IA em São Paulo", "ia generativa no Brasil", "fintech growth em São Paulo, Brasil", "padaria", "AI companies")
    asked = _docs(spark, sf).select(_id().alias("query_id"), said.alias("query"), F.when(_id() % 2 == 1, 3).alias("limit"))
    regions = spark.createDataFrame([("sao paulo", "SP", "city", 1), ("brasil", "BR", "country", 9)], "alias string, region string, region_type string, priority int")
    return search.parse_queries(asked, regions).select("query_id", "theme", "stage", "region", "limit")


@query("""SELECT doc_id, 'run-' || (doc_id % 9) || ':' || trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') || ':unknown' AS id FROM documents""")
def recommendation_ids(spark, sf):
    return _docs(spark, sf).select("doc_id", recommend.recommendation_id(F.concat(F.lit("Run "), (_id() % 9).cast("string")), F.col("source"), F.lit("")).alias("id"))


@query("""SELECT event_id, replace(replace(replace(props, 'k', '[REDACTED]'), chr(123), '<'), chr(125), '>') AS props, contains(props, 'k') AS leaked FROM
  (SELECT event_id, coalesce(props, '') AS props FROM events)""")
def redacted(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.coalesce("props", F.lit("")).alias("props"))
    where = secrets.leaks(rows, "event_id", ("props",), ("k",)).select("event_id", F.lit(True).alias("leaked"))
    clean = F.translate(secrets.redact(F.col("props"), ("k",)), "{}", "<>")
    return rows.join(where, "event_id", "left").select("event_id", clean.alias("props"), F.coalesce("leaked", F.lit(False)).alias("leaked"))


@query("""SELECT k, passed, failed, skipped, CASE WHEN failed > 0 THEN 'failed' WHEN passed > 0 THEN 'passed' ELSE 'skipped' END AS status FROM (SELECT user_id AS k, count(*) FILTER (WHERE s = 'passed') AS passed,
  count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'skipped') AS skipped FROM (SELECT user_id, CASE WHEN event_id % 29 = 0 THEN 'failed' WHEN user_id % 3 = 0 THEN 'skipped' ELSE 'passed' END AS s FROM events) GROUP BY 1)""")
def check_roll_up(spark, sf):
    steps = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_id") % 29 == 0, "failed").when(F.col("user_id") % 3 == 0, "skipped").otherwise("passed").alias("status"))
    return operations.roll_up(steps, "k")


@query("""SELECT 'i' || p_partkey AS integration, CASE WHEN p_partkey % 2 = 1 THEN 'skipped' WHEN p_partkey % 4 = 0 THEN 'failed' WHEN p_partkey % 3 = 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN p_partkey % 2 = 1 THEN 'flag_not_set' WHEN p_partkey % 4 = 0 THEN 'missing:KEY,URL' WHEN p_partkey % 3 = 0 THEN 'credential_leak' ELSE 'result' END AS reason,
  CASE WHEN p_partkey % 3 = 0 THEN 'saw [REDACTED]' ELSE 'fine' END AS message, p_partkey % 3 = 0 AS leaked FROM part""")
def check_matrix(spark, sf):
    n = F.col("p_partkey")
    parts = table(spark, sf, "part").select(n, F.concat(F.lit("i"), n.cast("string")).alias("integration"))
    wanted = parts.select("integration", _pick(n, "ON", "OFF").alias("flag"), F.when(n % 4 == 0, F.array(F.lit("URL"), F.lit("KEY"), F.lit("ON"))).otherwise(F.array(F.lit("ON"))).alias("required"))
    results = parts.select("integration", F.lit("passed").alias("status"), F.when(n % 3 == 0, "saw s3cr3t").otherwise("fine").alias("message"))
    return operations.check_matrix(wanted, spark.createDataFrame([("ON", "1"), ("OFF", " ")], "name string, value string"), results, ("s3cr3t",))


@query("""SELECT source, count(*) FILTER (WHERE NOT e) AS pages, count(*) FILTER (WHERE e) AS errors, count(*) FILTER (WHERE NOT e AND length(t) < 80) AS low_texts, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE NOT e), '') AS strategies
  FROM (SELECT source, lang, coalesce(text, '') AS t, doc_id % 9 = 0 AS e FROM documents) GROUP BY 1""")
def page_figures(spark, sf):
    rows = _docs(spark, sf).select("source", F.col("text").alias("main_text"), (_id() % 9 == 0).alias("is_error"), F.col("lang").alias("strategy"))
    return operations.page_figures(rows, "source").withColumn("strategies", F.array_join("strategies", ","))


@query("""SELECT source, fields, unknown, unknown / fields AS unknown_rate, 1 - unknown / fields AS completeness FROM (SELECT source, count(*) AS fields, count(*) FILTER (WHERE doc_id % 4 = 0 OR doc_id % 6 = 1) AS unknown FROM documents GROUP BY 1)""")
def field_figures(spark, sf):
    rows = _docs(spark, sf).select("source", F.when(_id() % 4 == 0, "unknown").otherwise("x").alias("value"), F.when(_id() % 6 == 1, "unknown").otherwise("observed").alias("claim_source"))
    return operations.field_figures(rows, "source")


@query("""SELECT key, fields, unknown, unknown / fields AS unknown_rate, 1 - unknown / fields AS completeness, conflicts FROM (SELECT source AS key, count(*) AS fields, count(*) FILTER (WHERE doc_id % 4 = 0) AS unknown,
  count(*) FILTER (WHERE doc_id % 5 = 0) AS conflicts FROM documents GROUP BY 1)""")
def profile_figures(spark, sf):
    docs = _docs(spark, sf)
    fields = docs.select(F.col("source").alias("key"), F.when(_id() % 4 == 0, "unknown").otherwise("x").alias("value"), F.lit("observed").alias("claim_source"))
    return operations.profile_figures(fields, docs.select(F.col("source").alias("key"), F.lit("f").alias("field"), (_id() % 5 == 0).alias("has_conflict")))


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def first_events(spark, sf):
    return operations.first_by(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""WITH p AS (SELECT source AS site, doc_id, coalesce(text, '') AS t, lang FROM documents), x AS (SELECT site, count(*) AS pages, count(*) FILTER (WHERE length(t) < 80) AS low_texts,
  count(*) FILTER (WHERE doc_id % 2 = 0) / count(*) AS completeness FROM p GROUP BY 1)
  SELECT site, pages, low_texts, completeness, 'collected' AS verdict FROM x UNION ALL SELECT 'blocked', 0, 0, 0, 'blocked_domain' UNION ALL SELECT 'robots', 0, 0, 0, 'robots_disallowed' UNION ALL SELECT 'empty', 0, 0, 0, 'no_pages'""")
def scraping_report(spark, sf):
    docs = _docs(spark, sf)
    extra = spark.createDataFrame([("blocked", "blocked_domain", "allowed"), ("robots", "allowed", "robots_disallowed"), ("empty", "allowed", "allowed")], "site string, policy_reason string, robots_reason string")
    sites = docs.select(F.col("source").alias("site")).distinct().select("site", F.lit("allowed").alias("policy_reason"), F.lit("allowed").alias("robots_reason")).union(extra)
    seen = docs.select(F.col("source").alias("site"), _id().cast("string").alias("url"), F.col("text").alias("main_text"), F.lit(False).alias("is_error"), F.col("lang").alias("strategy"))
    fields = docs.select(F.col("source").alias("site"), F.when(_id() % 2 == 0, "x").otherwise("unknown").alias("value"), F.lit("observed").alias("claim_source"))
    return operations.scraping_report(sites, seen, fields).select("site", "pages", "low_texts", "completeness", "verdict")


@query("""SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || event_type AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events""")
def run_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", maps.run_id(F.col("ts"), F.col("event_type")).alias("run_id"), maps.iso_time(F.col("ts")).alias("at"))


@query("""SELECT doc_id, 'a=' || CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END || ',k' || (doc_id % 5) || '=' || lang || ',z=1' AS entries FROM documents""")
def map_updates(spark, sf):
    base = F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("old"))
    new = F.when(_id() % 2 == 0, F.create_map(F.concat(F.lit("k"), (_id() % 5).cast("string")), F.col("lang"), F.lit("a"), F.lit("new"))).otherwise(F.create_map(F.concat(F.lit("k"), (_id() % 5).cast("string")), F.col("lang")))
    pairs = F.transform(maps.sorted_entries(maps.updated(base, new)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _docs(spark, sf).select("doc_id", F.array_join(pairs, ",").alias("entries"))


@query("""SELECT item_id AS expectation_id, CASE item_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS query_id FROM benchmark""")
def expectation_matches(spark, sf):
    n = F.col("item_id")
    none = F.array().cast("array<string>")
    wanted = table(spark, sf, "benchmark").select(
        n.alias("expectation_id"), F.when(n % 4 == 1, "voice_ai").otherwise("zzz").alias("target"), F.when(n % 4 == 2, F.array(F.lit("c3"))).otherwise(none).alias("expected_chunk_ids"),
        none.alias("expected_document_ids"), F.when(n % 4 == 0, F.array(F.lit("Model"), F.lit("sérving"))).otherwise(none).alias("retrieval_query_terms"),
    )
    kind = "query_id int, pos int, query string, chunk_ids array<string>, document_ids array<string>, topics array<string>"
    runs = [(1, 1, "model serving now", ["c1"], ["d"], ["t"]), (2, 0, "voice ai", ["c2"], ["d"], ["t"]), (3, 2, "more", ["c3"], ["d"], ["t"])]
    return metrics.match_retrievals(wanted, spark.createDataFrame(runs, kind))


@query("""SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'main' WHEN doc_id % 3 = 0 THEN 'side' ELSE '' END AS topic, CASE WHEN doc_id % 3 = 0 THEN doc_id || ':0,' || doc_id || ':1' ELSE '' END AS chunks FROM documents""")
def stack_profiles(spark, sf):
    docs = _docs(spark, sf)
    name = _id().cast("string")
    documents = docs.select(F.lit("c1").alias("corpus_version"), name.alias("document_id"), F.lit("t").alias("title"), F.lit("u").alias("source_url"), F.lit("page").alias("source_type"), F.struct(
        F.lit(None).cast("string").alias("stack_id"), F.lit(None).cast("string").alias("stack_name"), F.when(_id() % 2 == 0, "main").alias("topic"), F.lit(None).cast("array<string>").alias("supported_gap_types"),
    ).alias("metadata"))
    pieces = docs.where("doc_id % 3 = 0").select(name.alias("document_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    pieces = pieces.select("document_id", "pos", F.concat_ws(":", "document_id", F.col("pos").cast("string")).alias("chunk_id"), F.when(F.col("pos") == 0, "side").otherwise("other").alias("topic"))
    return corpus.stack_profiles(documents, pieces).select("document_id", "topic", F.array_join("citation_chunk_ids", ",").alias("chunks"))


@query("""SELECT CASE WHEN bool_or(x) THEN 1 ELSE 0 END::INT AS unknown, count(*) FILTER (WHERE r) AS repeated FROM (SELECT doc_id % 10 = 0 AS x, false AS r FROM documents UNION ALL SELECT false, true FROM documents WHERE doc_id % 7 = 0)""")
def rerank_inventions(spark, sf):
    docs = _docs(spark, sf)
    candidates = docs.where("doc_id % 10 <> 0").select((_id() % 5).alias("query_id"), _id().alias("chunk_id"))
    again = docs.select((_id() % 5).alias("query_id"), _id().alias("chunk_id"))
    found = retrieval.invented(candidates, again.union(again.where("chunk_id % 7 = 0")))
    return found.agg(F.max((F.col("reason") == "unknown_chunk").cast("int")).alias("unknown"), F.count_if(F.col("reason") == "repeated_chunk").alias("repeated"))
