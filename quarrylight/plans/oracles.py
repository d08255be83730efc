"""DuckDB SQL for the registered queries. Parsers, crawls and folds in order have none; tests hold those to brute force."""

from __future__ import annotations

from quarrylight.operators import pages, policy, profiles, recommend
from quarrylight.plans.queries import WORDS

SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)', 1)"
DOMAIN = rf"""CASE WHEN regexp_matches({HOST}, '[^.]+\.(com|net|org|gov)\.br$') THEN regexp_extract({HOST}, '([^.]+\.[^.]+\.[^.]+)$', 1)
  WHEN contains({HOST}, '.') THEN regexp_extract({HOST}, '([^.]+\.[^.]+)$', 1) ELSE {HOST} END"""
DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"
STOP = "['need','needs','support','supported','supporting','supports','workflow','workflows']"


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(strip_accents(lower({column})), '[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t))"


def _any(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
VECTORS = f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({COSINE}, 9) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score > 0
       QUALIFY rank <= 3)"""
BM25 = f"""d AS (SELECT doc_id, {_tokens("text")} AS ts FROM docs), n AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM d),
  q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({_tokens("text")}) AS token FROM benchmark) GROUP BY ALL),
  tf AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS token FROM d) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE /
    (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 9) AS score FROM tf JOIN df USING (token) JOIN q USING (token), n GROUP BY ALL),
  ll AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM s WHERE score > 0 QUALIFY rank <= 3)"""
HYBRID = f"""{DOCS}, {BM25}, v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({COSINE}, 9) AS score FROM v a JOIN benchmark ON item_id = a.vec_id, v b),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score > 0 QUALIFY rank <= 3),
both_ AS (SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.chunk_id, n.chunk_id) AS chunk_id, l.rank AS lexical_rank,
          n.rank AS vector_rank, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + n.rank), 0), 12) AS score
          FROM ll l FULL JOIN nn n ON l.query_id = n.query_id AND l.chunk_id = n.chunk_id),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM both_ QUALIFY rank <= 3),
rr AS (SELECT query_id, chunk_id, rank AS original_rank, ((chunk_id * 7919 + query_id) % 101)::DOUBLE AS rerank_score,
       row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id * 7919 + query_id) % 101 DESC, rank, chunk_id) AS rank FROM hy
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id * 7919 + query_id) % 101 DESC, rank, chunk_id) <= 2)"""


def _cases(results: str, name: str) -> str:
    return f"""{name} AS (
  SELECT e.query_id, e.expected, coalesce(r.retrieved, 0) AS retrieved, coalesce(len(list_filter(e.ids, lambda x: list_contains(r.ids, x))), 0) AS matched,
         coalesce(list_contains(e.ids, r.first), false) AS top_1
  FROM (SELECT query_id, list(chunk_id) AS ids, count(*) AS expected FROM ll GROUP BY 1) e
  LEFT JOIN (SELECT query_id, list(chunk_id) AS ids, count(*) AS retrieved, arg_min(chunk_id, rank) AS first FROM {results} GROUP BY 1) r USING (query_id))"""


def _summary(cases: str) -> str:
    return f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, covered / cases AS coverage FROM (
  SELECT count(*) AS cases, sum(expected)::BIGINT AS expected, sum(retrieved)::BIGINT AS retrieved, sum(matched)::BIGINT AS matched,
         count(*) FILTER (WHERE matched = expected) AS covered, count(*) FILTER (WHERE top_1) AS top_1,
         sum(matched) / sum(expected) AS recall, CASE WHEN sum(retrieved) = 0 THEN 0 ELSE sum(matched) / sum(retrieved) END AS precision FROM {cases})"""


PROFILE = r"""pg AS (
  SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS title,
         CASE WHEN doc_id % 3 = 0 THEN 'Setor: ' || lang || '.' || chr(10) || 'Produto: ' || regexp_replace(substr(text, 1, 40), '[.;:\n|]', ' ', 'g') || '.' || chr(10) ELSE '' END || text AS t, source FROM docs)"""
FIELDS = f"""WITH {DOCS}, {PROFILE}
      SELECT key, field, value, claim_source, n AS evidences FROM (
        SELECT key, 'company_name' AS field, title AS value, CASE WHEN title = 'unknown' THEN 'unknown' ELSE 'observed' END AS claim_source, (title <> 'unknown')::BIGINT AS n FROM pg
        UNION ALL SELECT key, 'official_site', 'https://' || source || '.example.com', 'observed', 1 FROM pg
        UNION ALL SELECT key, 'sector', CASE WHEN key % 3 = 0 THEN regexp_extract(t, '^Setor: ([^.]*)', 1) WHEN w <> '' THEN w ELSE 'unknown' END,
          CASE WHEN key % 3 = 0 THEN 'observed' WHEN w <> '' THEN 'inferred' ELSE 'unknown' END, (key % 3 = 0 OR w <> '')::BIGINT
          FROM (SELECT *, CASE WHEN contains(strip_accents(lower(t)), 'healthtech') THEN 'healthtech' WHEN contains(strip_accents(lower(t)), 'fintech') THEN 'fintech'
            WHEN contains(strip_accents(lower(t)), 'cybersecurity') THEN 'cybersecurity' WHEN contains(strip_accents(lower(t)), 'industria') THEN 'industry'
            WHEN contains(strip_accents(lower(t)), 'dados') OR contains(strip_accents(lower(t)), 'data') THEN 'data' ELSE '' END AS w FROM pg)
        UNION ALL SELECT key, 'product', CASE WHEN p <> '' THEN p ELSE 'unknown' END, CASE WHEN p <> '' THEN 'observed' ELSE 'unknown' END, (p <> '')::BIGINT
          FROM (SELECT key, CASE WHEN key % 3 = 0 THEN trim(regexp_extract(t, '\\nProduto: ([^.;\\n]*)', 1)) ELSE '' END AS p FROM pg)
        UNION ALL SELECT key, f, 'unknown', 'unknown', 0 FROM pg, (VALUES ('company_summary'), ('customers'), ('funding'), ('founders'), ('technologies_used'), ('ai_signals'), ('location')) x(f))"""
GAPS = f"""{DOCS}, t AS (SELECT *, strip_accents(lower(text)) AS t FROM docs),
f AS (SELECT *, {_any("t", WORDS.generic)} AS g, {_any("t", WORDS.deep)} AS d, {_any("t", WORDS.data)} AS pd, {_any("t", WORDS.production)} AS pr,
      {_any("t", WORDS.scale)} AS sc, {_any("t", WORDS.external)} AS ex, {_any("t", WORDS.ai)} OR {_any("t", WORDS.generic)} AS ai FROM t),
cr AS (SELECT doc_id AS startup, t, ai, g, d, pd, pr, sc, ex, CASE WHEN NOT ai THEN 'unknown' WHEN NOT (g AND NOT d) THEN 'positive' ELSE 'negative' END AS ai_product_centrality,
       CASE WHEN NOT ai THEN 'unknown' WHEN d THEN 'positive' ELSE 'negative' END AS ai_architecture_depth,
       CASE WHEN NOT ai THEN 'unknown' WHEN pd THEN 'positive' ELSE 'negative' END AS proprietary_data_loop,
       CASE WHEN NOT ai THEN 'unknown' WHEN pr THEN 'positive' ELSE 'negative' END AS production_readiness,
       CASE WHEN NOT ai THEN 'unknown' WHEN sc THEN 'positive' ELSE 'negative' END AS scale_governance_need FROM f),
cl AS (SELECT *, CASE WHEN NOT ai THEN 'non_ai' WHEN ai_product_centrality = 'positive' AND d::INT + pd::INT + pr::INT >= 2 THEN 'ai_native' ELSE 'ai_enabled' END AS classification,
       CASE WHEN NOT ai THEN 0.72 WHEN ai_product_centrality <> 'positive' THEN 0.58 WHEN d::INT + pd::INT + pr::INT >= 2
         THEN least(round(0.72 + 0.04 * (1 + d::INT + pd::INT + pr::INT + sc::INT), 2), 0.92) ELSE 0.64 END::DOUBLE AS confidence FROM cr),
specs(gap_type, severity, terms) AS (VALUES {", ".join(f"('{g}', '{s}', {list(t)!r})" for g, (t, s) in WORDS.gaps.items())}),
hit AS (SELECT startup, gap_type, severity FROM cl, specs WHERE classification <> 'non_ai' AND len(list_filter(terms, lambda x: contains(t, x))) > 0),
gaps AS (SELECT startup, gap_type, severity, 0.72::DOUBLE AS confidence, false AS is_hypothesis FROM hit
         UNION ALL SELECT startup, 'unknown', 'unknown', 0.0::DOUBLE, true FROM cl WHERE startup NOT IN (SELECT startup FROM hit))"""
RISKS = """risks AS (
  SELECT startup, 'unknown' AS risk_type, 'unknown' AS severity, 0.0::DOUBLE AS confidence, true AS is_hypothesis FROM cl WHERE classification = 'non_ai'
  UNION ALL SELECT startup, 'external_api_only', CASE WHEN ex AND NOT d THEN 'high' ELSE 'low' END, CASE WHEN ex THEN 0.82 ELSE 0.62 END, NOT ex FROM cl WHERE classification <> 'non_ai'
  UNION ALL SELECT startup, 'no_proprietary_data_evidence', CASE WHEN pd THEN 'low' ELSE 'medium' END, CASE WHEN pd THEN 0.8 ELSE 0.55 END, NOT pd FROM cl WHERE classification <> 'non_ai'
  UNION ALL SELECT startup, 'no_production_inference_evidence', CASE WHEN pr THEN 'low' ELSE 'medium' END, CASE WHEN pr THEN 0.78 ELSE 0.55 END, NOT pr FROM cl WHERE classification <> 'non_ai')"""
STACKS = """stacks(document_id, stack_name, gap_type) AS (VALUES ('d1','one','model_serving'), ('d1','one','llm_customization'), ('d2','two','computer_vision'),
  ('d2','two','data_acceleration'), ('d3','three','other'), ('d3','three','computer_vision'), ('d3','three','llm_customization'))"""
RECOMMENDED = f"""{GAPS}, {STACKS}, rec AS (
  SELECT startup, gap_type, document_id, severity, confidence,
    CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END * 100 + (confidence + 0.8::DOUBLE) / 2 * 10
    + CASE document_id WHEN 'd1' THEN 1.0 WHEN 'd2' THEN 0.9 ELSE 0.5 END::DOUBLE * 5 + least(startup % 13, 10)::DOUBLE / 10 AS score,
    CASE WHEN startup % 4 = 0 THEN 'blocked' WHEN gap_type NOT IN ({_in(recommend.COVERED_GAPS)}) THEN 'hypothesis' WHEN document_id = 'd3' THEN 'hypothesis' ELSE 'supported' END AS state
  FROM gaps JOIN stacks USING (gap_type))"""

TITLED = "array_to_string(list_transform(string_split(d, '-'), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
#: A page's text by patterns: enough for pages whose elements are closed or cut off at the end.
TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<title>.*?</title>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*(>|$)', ' ', 'g'),
  '&amp;?', chr(1), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), chr(1), '&'), '\s+', ' ', 'g'))"""
WORDS_OF_PATHS = "[" + ", ".join(f"'{w}'" for w in pages.PATH_WORDS) + "]"
LINKS = f"""own AS (SELECT url, {SCHEME} || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages),
  made AS (SELECT url, 'https://' || {HOST} || '/' || unnest([{", ".join(f"{WORDS_OF_PATHS}[1 + (page_id + {k}) % {len(pages.PATH_WORDS)}]" for k in (0, 5, 11))}]) AS link FROM pages),
  named AS (SELECT DISTINCT {SCHEME} || '://' || {HOST} || regexp_replace({PATH}, '/+$', '') AS url, regexp_replace(replace(link, '://www.', '://'), '/+$', '') AS link FROM (FROM own UNION ALL FROM made) WHERE link IS NOT NULL),
  front AS (SELECT url, link, list_position(list_transform({WORDS_OF_PATHS}, lambda w: contains(strip_accents(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#;]*)', 1))), w)), true) AS priority FROM named)"""

ORACLES = {
    "page_extract": f"""SELECT page_id, title, md5(main_text) AS text_md5, length(main_text) AS length, len(regexp_extract_all(html, '<a href="[^"]+"'))::INT AS links, false AS needs_js
      FROM (SELECT page_id, html, trim(regexp_replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&amp;', '&'), '&quot;', '"'), '\\s+', ' ', 'g')) AS title, {TEXT} AS main_text FROM pages)""",
    "link_frontier": f"WITH {LINKS} SELECT url, link, priority FROM front WHERE priority > 0",
    "crawl_bfs": f"""WITH {LINKS}, site AS (SELECT DISTINCT {SCHEME} || '://' || {HOST} || regexp_replace({PATH}, '/+$', '') AS url FROM pages),
      child AS (SELECT url, link, row_number() OVER (PARTITION BY url ORDER BY priority, link) AS pos FROM front WHERE priority > 0 AND link <> url)
      SELECT url AS site, url, 0 AS depth, 0::BIGINT AS pos, NULL::VARCHAR AS error FROM site UNION ALL SELECT url, link, 1, pos, NULL FROM child WHERE pos <= 2""",
    "norm_url_domain": f"""SELECT page_id, {SCHEME} || '://' || {HOST} || regexp_replace({PATH}, '/+$', '') AS normalized, {DOMAIN} AS domain,
      {SCHEME} || '://' || {HOST} AS origin FROM pages""",
    "source_type_counts": f"""SELECT CASE WHEN {DOMAIN} IN ({_in(policy.PERSONAL_DOMAINS)}) OR contains(lower({PATH}), '/in/') THEN 'personal_profile'
      WHEN {DOMAIN} IN ({_in(policy.DIRECTORY_DOMAINS)}) THEN 'directory' WHEN {DOMAIN} IN ({_in(policy.NEWS_DOMAINS)}) THEN 'news' ELSE 'company' END AS source_type,
      count(*) AS pages FROM pages GROUP BY 1""",
    "policy_decisions": f"""SELECT page_id, reason, reason = 'allowed' AS allowed FROM (SELECT page_id, CASE WHEN {DOMAIN} = 'example.org' THEN 'blocked_domain'
      WHEN list_has_any(string_split(replace(lower({PATH}), '_', '-'), '/'), [{_in(policy.LOGIN_SEGMENTS)}]) THEN 'login_required' ELSE 'allowed' END AS reason FROM pages)""",
    "doc_chunks": r"""SELECT doc_id || ':' || (i - 1) AS chunk_id, doc_id AS document_id, (i - 1)::INT AS chunk_index, b[i] AS text FROM (
      SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, b FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
        lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents))""",
    "corpus_issues": """WITH d AS (SELECT doc_id, doc_id::VARCHAR AS document_id, CASE doc_id % 10 WHEN 0 THEN 'missing_source_url' WHEN 1 THEN 'source_url_not_official'
        WHEN 2 THEN 'unsupported_source_type' END AS bad FROM documents),
      ok AS (SELECT * FROM d WHERE bad IS NULL),
      c AS (SELECT doc_id, doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS i,
        doc_id || ':' || CASE WHEN doc_id % 3 = 0 THEN '9' WHEN doc_id % 4 = 0 THEN '1' ELSE '0' END AS chunk_id,
        CASE WHEN doc_id % 7 = 1 THEN 'other' ELSE 't' END AS topic FROM documents WHERE doc_id % 17 <> 6),
      own AS (SELECT c.* FROM c JOIN ok USING (doc_id))
      SELECT document_id, bad AS reason FROM d WHERE bad IS NOT NULL
      UNION ALL SELECT c.document_id, 'chunk_document_id_not_found:' || chunk_id FROM c JOIN d USING (doc_id) WHERE bad IS NOT NULL
      UNION ALL SELECT document_id, 'unstable_chunk_id:' || chunk_id || ':expected:' || document_id || ':' || i FROM own WHERE chunk_id <> document_id || ':' || i
      UNION ALL SELECT document_id, 'document_corpus_version_mismatch' FROM ok WHERE doc_id % 11 = 5
      UNION ALL SELECT document_id, 'missing_citable_chunk' FROM ok WHERE doc_id % 17 = 6
      UNION ALL SELECT document_id, 'non_consecutive_chunk_indices:expected:0:actual:1' FROM own WHERE i = 1
      UNION ALL SELECT document_id, 'missing_stack_metadata:topic' FROM ok WHERE doc_id % 5 = 3
      UNION ALL SELECT document_id, 'chunk_topic_mismatch:' || chunk_id FROM own WHERE doc_id % 5 <> 3 AND topic <> 't'
      UNION ALL SELECT document_id, 'unsupported_gap_type:weather' FROM ok WHERE doc_id % 13 = 4""",
    "index_stats": f"""WITH {DOCS} SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens("text")})) AS token FROM docs) GROUP BY 1""",
    "bm25_topk": f"WITH {DOCS}, {BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ll",
    "bm25_no_match": "SELECT 0::BIGINT AS query_id, 0::BIGINT AS chunk_id, 0::BIGINT AS rank, 0::DOUBLE AS score WHERE false",
    "vector_topk": f"WITH {VECTORS} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM nn",
    "zero_vector": "SELECT vec_id AS chunk_id, 0.0::DOUBLE AS score FROM embeddings",
    "hybrid_rrf": f"WITH {HYBRID} SELECT query_id, chunk_id, rank, lexical_rank, vector_rank, round(score, 9) AS score FROM hy",
    "rerank_topk": f"WITH {HYBRID} SELECT query_id, chunk_id, rank, original_rank, rerank_score FROM rr",
    "retrieval_cases": f"""WITH {HYBRID}, {_cases("hy", "c")} SELECT query_id AS expectation_id, expected, retrieved, matched, top_1, matched = expected AS covered,
      concat_ws(',', CASE WHEN retrieved = 0 THEN 'no_retrieved_citation' END, CASE WHEN matched < expected THEN 'expected_citation_not_retrieved' END,
      CASE WHEN retrieved > 0 AND matched < retrieved THEN 'unexpected_retrieved_citation' END) AS failure_reasons,
      coalesce((SELECT string_agg(l.chunk_id, ',' ORDER BY l.chunk_id) FROM ll l JOIN hy h ON l.query_id = h.query_id AND l.chunk_id = h.chunk_id WHERE l.query_id = c.query_id), '') AS matched_ids FROM c""",
    "retrieval_summary": f"WITH {HYBRID}, {_cases('hy', 'c')} {_summary('c')}",
    "strategy_comparison": f"""WITH {HYBRID}, l1 AS (SELECT * FROM hy WHERE rank = 1), {_cases("nn", "a")}, {_cases("l1", "b")}, {_cases("hy", "h")},
      sm AS (SELECT 'vector' AS strategy, 0 AS pos, * FROM ({_summary("a")}) UNION ALL SELECT 'first', 1, * FROM ({_summary("b")}) UNION ALL SELECT 'hybrid', 2, * FROM ({_summary("h")}))
      SELECT (SELECT strategy FROM sm ORDER BY f1 DESC, coverage DESC, precision DESC, top_1 DESC, pos LIMIT 1) AS best_f1,
             (SELECT strategy FROM sm ORDER BY top_1 DESC, f1 DESC, coverage DESC, precision DESC, pos LIMIT 1) AS best_top_1""",
    "rerank_delta": f"""WITH {HYBRID}, {_cases("hy", "a")}, {_cases("rr", "b")}, x AS ({_summary("a")}), y AS ({_summary("b")})
      SELECT {", ".join(f"x.{m} AS {m}_before, y.{m} AS {m}_after, y.{m} - x.{m} AS {m}_delta" for m in ("top_1", "recall", "precision", "f1", "coverage"))} FROM x, y""",
    "evidence_conflicts": """WITH v AS (SELECT source AS key, upper(lang) AS value, min(doc_id) AS pos FROM documents GROUP BY ALL)
      SELECT key, arg_min(value, pos) AS value, string_agg(value, ',' ORDER BY pos) AS values, count(*) > 1 AS has_conflict FROM v GROUP BY 1""",
    "strategy_quality": f"""WITH {DOCS}, r AS (SELECT source AS strategy, doc_id % 9 = 0 AS e, lang, CASE WHEN text = 'unknown' THEN 0 ELSE length(text) END AS l, text = 'unknown' AS u FROM docs),
      c AS (SELECT strategy, count(*) AS attempts, count(*) FILTER (WHERE e) AS errors, count(*) FILTER (WHERE NOT e AND u) AS unknown_texts,
        count(*) FILTER (WHERE NOT e AND l < 80) AS low_texts, coalesce(sum(l) FILTER (WHERE NOT e), 0)::BIGINT AS characters,
        string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE NOT e) AS extractions FROM r GROUP BY 1)
      SELECT *, errors / attempts AS failure_rate, unknown_texts / (attempts - errors) AS unknown_rate, low_texts / (attempts - errors) AS low_rate, characters / (attempts - errors) AS average_length FROM c""",
    "profile_fields": FIELDS,
    "unknown_field_counts": f"SELECT field, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, field) AS rank FROM ({FIELDS}) WHERE value = 'unknown' GROUP BY 1",
    "collection_quality": f"""WITH f AS ({FIELDS}), p AS (SELECT key, bool_and(value <> 'unknown') FILTER (WHERE field IN ({_in(profiles.REQUIRED)})) AS complete,
        bool_or(field = 'official_site' AND value <> 'unknown') AS site, sum(evidences) AS evidences FROM f GROUP BY 1),
      t AS (SELECT count(*) AS candidates, count(*) AS profiles, count(*) FILTER (WHERE site) AS official_sites, count(*) FILTER (WHERE complete) AS complete_profiles,
        sum(evidences)::BIGINT AS evidences FROM p),
      r AS (SELECT *, round_even(official_sites / candidates, 2) AS official_site_rate, round_even(complete_profiles / candidates, 2) AS complete_profile_rate, round_even(evidences / profiles, 2) AS average_evidences FROM t),
      x AS (SELECT *, concat_ws(',', CASE WHEN official_site_rate < 0.695 THEN 'official_site_coverage_below_threshold' END,
        CASE WHEN complete_profile_rate < 0.595 THEN 'minimum_profile_coverage_below_threshold' END, CASE WHEN average_evidences < 2.995 THEN 'average_evidence_below_threshold' END) AS reasons FROM r)
      SELECT *, reasons = '' AS ready FROM x""",
    "maturity_class": f"WITH {GAPS} SELECT startup, ai_product_centrality, ai_architecture_depth, proprietary_data_loop, production_readiness, scale_governance_need, classification, confidence FROM cl",
    "term_gaps": f"WITH {GAPS} SELECT * FROM gaps",
    "wrapper_risks": f"WITH {GAPS}, {RISKS} SELECT * FROM risks",
    "diagnosis": f"""WITH {GAPS}, {RISKS}, g AS (SELECT startup, bool_and(gap_type = 'unknown') AS no_gap, bool_or(gap_type <> 'unknown') AS has_gap FROM gaps GROUP BY 1),
      r AS (SELECT startup, bool_or(severity = 'high') AS high FROM risks GROUP BY 1),
      x AS (SELECT cl.*, no_gap, has_gap, high, startup % 8 = 1 AS conflict FROM cl JOIN g USING (startup) JOIN r USING (startup)),
      y AS (SELECT *, concat_ws(',', CASE WHEN conflict THEN 'conflicting_product' END, CASE WHEN classification = 'non_ai' THEN 'not_a_recommendation_candidate' END,
        CASE WHEN confidence < 0.75 THEN 'classification_confidence_below_threshold' END, CASE WHEN no_gap THEN 'no_specific_gap' END,
        CASE WHEN high THEN 'high_wrapper_dependency_risk' END) AS reasons FROM x)
      SELECT startup, classification, confidence, reasons, reasons = '' AND classification = 'ai_native' AS ready, conflict AS human_review,
        CASE WHEN conflict THEN 'human_review' WHEN classification = 'non_ai' THEN 'low' WHEN classification = 'ai_enabled' THEN 'medium'
             WHEN confidence >= 0.8 AND has_gap THEN 'urgent' ELSE 'medium' END AS urgency FROM y""",
    "gap_taxonomy": f"WITH {GAPS}, {STACKS} SELECT gap_type, startups, document_id, stack_name FROM (SELECT gap_type, count(*) AS startups FROM gaps WHERE gap_type <> 'unknown' GROUP BY 1) JOIN stacks USING (gap_type)",
    "gap_space": f"""WITH {GAPS}, {STACKS}, tg AS (SELECT gap_type, string_agg(document_id, ',' ORDER BY document_id) AS targets FROM stacks GROUP BY 1),
      x AS (SELECT startup, gap_type, coalesce(targets, '') AS targets, concat_ws(',', CASE WHEN targets IS NULL THEN 'unsupported_gap_type' END,
        CASE WHEN startup % 4 = 0 THEN 'missing_observed_gap_evidence' END, CASE WHEN startup % 6 = 2 THEN 'high_wrapper_risk' END) AS review_reasons
        FROM gaps LEFT JOIN tg USING (gap_type) WHERE gap_type <> 'unknown')
      SELECT *, CASE WHEN targets = '' THEN 'unsupported' WHEN review_reasons <> '' THEN 'hypothesis' ELSE 'supported' END AS support_status FROM x""",
    "recommend_rank": f"""WITH {RECOMMENDED}, r AS (SELECT *, row_number() OVER (PARTITION BY startup ORDER BY score DESC, gap_type, document_id) AS rank FROM rec WHERE state = 'supported')
      SELECT startup, gap_type, document_id, rank, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY startup, gap_type ORDER BY rank) = 1""",
    "final_priority": f"""WITH {RECOMMENDED}, s AS (SELECT startup, bool_or(state = 'supported') AS ok, bool_or(state = 'supported' AND severity IN ('high', 'medium')) AS medium,
        bool_or(state = 'hypothesis') AS guess, bool_or(state = 'blocked') AS blocked FROM rec GROUP BY 1),
      p AS (SELECT *, CASE WHEN NOT ok THEN CASE WHEN guess OR blocked THEN 'human_review' ELSE 'low' END WHEN medium THEN 'medium' ELSE 'low' END AS final_priority FROM s)
      SELECT startup, final_priority, CASE WHEN ok AND final_priority = 'medium' THEN 'prepare_technical_outreach' WHEN guess THEN 'validate_fit_with_human'
        WHEN blocked THEN 'resolve_blocking_evidence' ELSE 'deprioritize_for_now' END AS next_action FROM p""",
    "recommendation_gates": f"""WITH {RECOMMENDED} SELECT state, CASE state WHEN 'blocked' THEN 'missing_startup_gap_evidence' WHEN 'hypothesis' THEN
      CASE WHEN gap_type NOT IN ({_in(recommend.COVERED_GAPS)}) THEN 'gap_type_not_covered_by_recommendation_rules' ELSE 'missing_official_citation' END END AS reason, count(*) AS n FROM rec GROUP BY ALL""",
    "narrative_guard": f"""WITH c AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn) AS p, string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn) AS a FROM conversations GROUP BY 1)
      SELECT conv_id, len(list_filter(list_distinct(regexp_extract_all(lower(coalesce(a, '')), '[a-z0-9_]+')), lambda t: NOT list_contains(regexp_extract_all(lower(coalesce(p, '')), '[a-z0-9_]+'), t)
        AND NOT list_contains([{_in(tuple(recommend.CONNECTIVES))}], t))) AS unsupported FROM c""",
    "replace_by_key": """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 5 <> 0
      UNION ALL SELECT o_custkey, max(o_orderkey), 0.0::DOUBLE FROM orders WHERE o_custkey % 5 = 0 GROUP BY 1""",
    "latest_version": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels",
    "input_fingerprint": """SELECT run, sha256(string_agg(h, '' ORDER BY part)) AS fingerprint FROM (SELECT run, substr(h, 1, 3) AS part, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT doc_id % 10 AS run,
      sha256('=' || doc_id || chr(1) || '=' || quality || chr(1) || '=' || toxic) AS h FROM labels) GROUP BY ALL) GROUP BY 1""",
    "json_payload_overlay": "SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM events",
    "three_way_join_filter": """SELECT c_nationkey, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 30 GROUP BY 1""",
    "events_stream": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "candidate_scores": f"""SELECT page_id AS pos, CASE WHEN page_id % 4 = 0 THEN 'company' ELSE 'directory' END AS source_type,
      CASE WHEN page_id % 4 = 0 THEN {TITLED} ELSE 'Acme ' || d END AS name, CASE WHEN page_id % 4 = 0 THEN 'https://' || d || '.com' ELSE 'https://startse.com/' || page_id END AS primary_url,
      CASE WHEN page_id % 4 = 0 THEN 0.9 ELSE 0.75 END::DOUBLE AS score FROM (SELECT *, string_split({HOST}, '.')[1] AS d FROM pages) WHERE page_id % 4 < 2""",
    "entity_dedup": f"""WITH c AS (SELECT page_id, string_split({HOST}, '.')[1] AS d FROM pages WHERE page_id % 4 = 0),
      g AS (SELECT d, min(page_id) AS pos, count(*) AS n FROM c GROUP BY 1),
      a AS (SELECT page_id, d FROM (SELECT page_id, string_split({HOST}, '.')[1] AS d FROM pages WHERE page_id % 4 = 1)), x AS (SELECT d, min(page_id) AS pos, count(*) AS n FROM a GROUP BY 1)
      SELECT pos, {TITLED} AS name, 'https://' || d || '.com' AS primary_url, CASE WHEN n = 1 THEN 0.9 WHEN n = 2 THEN 0.95 ELSE 0.99 END::DOUBLE AS score, 'company' AS source_types, n AS evidences, n::INT AS members FROM g
      UNION ALL SELECT pos, 'Acme ' || d, 'https://startse.com/' || pos, CASE WHEN n = 1 THEN 0.75 WHEN n = 2 THEN 0.8 ELSE 0.85 END::DOUBLE, 'directory', n, n::INT FROM x""",
    "search_budget": """WITH RECURSIVE p AS (SELECT page_id % 7 AS run_id, page_id % 5 + 1 AS priority, least(count(*), 4) AS n FROM pages GROUP BY ALL),
      t AS (SELECT total, run_id, 0::BIGINT AS priority, 0::BIGINT AS take, 0::BIGINT AS used FROM (SELECT DISTINCT run_id FROM p), (VALUES (12), (4)) x(total)
        UNION ALL SELECT total, p.run_id, p.priority, CASE WHEN total > used THEN least(p.n, greatest(total - used - least(5 - p.priority, total - used - 1), 1)) ELSE 0 END,
          used + CASE WHEN total > used THEN least(p.n, greatest(total - used - least(5 - p.priority, total - used - 1), 1)) ELSE 0 END FROM t JOIN p ON p.run_id = t.run_id AND p.priority = t.priority + 1)
      SELECT total, run_id, priority, page FROM (SELECT page_id % 7 AS run_id, page_id % 5 + 1 AS priority, page_id AS page, row_number() OVER (PARTITION BY page_id % 7, page_id % 5 ORDER BY page_id) AS nth FROM pages) JOIN t USING (run_id, priority) WHERE nth <= take""",
}
