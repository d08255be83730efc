"""Golden cases of the operators, from the written rules."""

import json
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quarrylight import service
from quarrylight.functions import embedding, secrets
from quarrylight.functions import text as tx
from quarrylight.functions import vectors as vec
from quarrylight.operators import assessment, corpus, entities, metrics, pages, policy, profiles, recommend, retrieval, search
from quarrylight.operators.graph import components
from quarrylight.sources import language
from quarrylight.sources.store import RunStore, load_run, new_run, reusable, save_run


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "normal", "domain", "origin"),
    [
        ("https://www.Example.com/a/?q=1#f", "https://example.com/a", "example.com", "https://example.com"),
        ("example.com/", "https://example.com", "example.com", "https://example.com"),
        ("http://a.b.com.br/x/", "http://a.b.com.br/x", "b.com.br", "http://a.b.com.br"),
        ("unknown", "unknown", "unknown", "unknown"),
        ("  ", "unknown", "unknown", "unknown"),
        ("http://host", "http://host", "host", "http://host"),
    ],
)
def test_urls(spark, url, normal, domain, origin):
    u = F.col("u")
    assert one(spark, F.array(tx.normalize_url(u), tx.domain(u), tx.origin(u)), u=url) == [normal, domain, origin]


@pytest.mark.parametrize(
    ("name", "want"),
    [("Ação Tecnologia Ltda", "acao"), ("Foo S.A.", "foo"), ("Startup Brasil", "unknown"), ("Bar-Baz  Inc Company", "bar-baz"), ("Nova", "nova")],
)
def test_names(spark, name, want):
    assert one(spark, tx.startup_name(F.col("n")), n=name) == want


def test_fold(spark):
    assert one(spark, tx.fold(F.col("t")), t="  ÀÉÎõü ²Ⅷx́ ") == "aeiou 2ⅷx".replace("ⅷ", "ⅷ")


def test_policy(spark):
    urls = {"https://x.com/a": "personal_profile", "https://a.br/in/b": "personal_profile", "https://exame.com/x": "news", "https://distrito.me": "directory", "https://acme.io": "company", "unknown": "unknown"}
    assert {u: one(spark, policy.source_type(F.col("u")), u=u) for u in urls} == urls
    assert one(spark, policy.scrape_reason(F.col("u"), ("acme.io",)), u="https://acme.io/x") == "blocked_domain"
    assert one(spark, policy.scrape_reason(F.col("u")), u="https://a.io/sign_in/x") == "login_required"
    assert [one(spark, policy.error_category(F.col("c"), F.lit("http")), c=c) for c in (429, 503, 418)] == ["blocked", "unavailable", "network_error"]
    official = policy.OfficialSources(("vendor.com",), (("code.com", "/Vendor/"),), ("https://v.io/1",), ("page",))
    accepted = {"https://docs.vendor.com/x": True, "https://notvendor.com": False, "https://code.com/Vendor/a": True, "https://code.com/vendor/a": False, "https://v.io/1": True, "https://v.io/2": False}
    assert {u: one(spark, official.accepts(F.col("u")), u=u) for u in accepted} == accepted
    assert [one(spark, official.issue(F.col("u"), F.lit(k)), u=u) for u, k in (("", "page"), ("https://x.y", "page"), ("https://vendor.com", "no"), ("https://vendor.com", "page"))] == [
        "missing_source_url", "source_url_not_official", "unsupported_source_type", None,
    ]


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.io/x",), ("https://a.io/private/x",), ("https://b.io/x",)], "url string")
    robots = spark.createDataFrame([("https://a.io", "User-agent: *\nDisallow: /private\nCrawl-delay: 3")], "origin string, body string")
    got = {r["url"]: (r["allowed"], r["reason"], r["crawl_delay"]) for r in policy.robots_decisions(urls, robots).collect()}
    assert got == {"https://a.io/x": (True, "allowed", 3.0), "https://a.io/private/x": (False, "robots_disallowed", 3.0), "https://b.io/x": (False, "robots_unavailable", None)}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, topic string, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")


def test_bm25_ties_duplicates_and_partitions(spark):
    rows = [("b:0", "b", 0, "", "model serving"), ("a:0", "a", 0, "", "model serving"), ("c:0", "c", 0, "", "else words"), ("c:0", "c", 0, "", "else words")]
    found = retrieval.bm25(chunks(spark, rows), queries(spark, "model needs", "else", "nothing here")).collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in sorted(found, key=lambda r: (r["query_id"], r["rank"]))] == [(0, "a:0", 1), (0, "b:0", 2), (1, "c:0", 1)]
    again = retrieval.bm25(chunks(spark, rows).repartition(7), queries(spark, "model needs", "else")).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["score"]) for r in found) == sorted((r["query_id"], r["chunk_id"], r["score"]) for r in again)


def test_vectors(spark):
    kind = "chunk_id string, document_id string, chunk_index int, embedding array<double>"
    held = spark.createDataFrame([("b", "b", 0, [1.0, 0.0]), ("a", "a", 0, [2.0, 0.0]), ("z", "z", 0, [0.0, 0.0]), ("n", "n", 0, [-1.0, 0.0])], kind)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in retrieval.nearest(held, asked).orderBy("rank").collect()] == [(1, "a", 1.0), (1, "b", 1.0)]
    with pytest.raises(Exception, match="embedding_dimension_mismatch:b:expected_3:actual_2"):
        retrieval.check_dimension(held.limit(1), 3).collect()
    assert one(spark, vec.feature_embedding(F.col("t")), t="LLM models for inference, inference") == [0.447214, 0.894427, 0, 0, 0, 0, 0, 0]


def test_fusion_and_rerank(spark):
    kind = "query_id bigint, chunk_id string, document_id string, chunk_index int, rank int, score double"
    lexical = spark.createDataFrame([(1, "a", "a", 0, 1, 9.0), (1, "b", "b", 0, 2, 3.0)], kind)
    vector = spark.createDataFrame([(1, "a", "a", 0, 1, 0.9)], kind)
    fused = retrieval.fuse(lexical, vector, rrf_k=0)
    assert [(r["chunk_id"], r["score"]) for r in fused.orderBy("rank").collect()] == [("a", 2.0), ("b", 0.5)]
    scores = spark.createDataFrame([(1, "b", 9.0), (1, "a", 1.0), (1, "x", 99.0)], "query_id bigint, chunk_id string, rerank_score double")
    got = retrieval.rerank(fused, scores)
    assert [(r["chunk_id"], r["original_rank"]) for r in got.orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    assert [tuple(r) for r in retrieval.invented(fused, scores).collect()] == [(1, "x", "unknown_chunk")]
    with pytest.raises(Exception, match="rerank_requires_hybrid_candidates"):
        retrieval.rerank(fused.withColumn("strategy", F.lit("bm25_lexical")), scores).collect()


def test_index_metadata(spark):
    kind = "corpus_version string, provider string, model string, version string, dimension int, metric string, chunking_fingerprint string"
    a, b = (spark.createDataFrame([r], kind) for r in (("1", "p", "m", "1", 8, "cos", "f"), ("2", "p", "m", "1", 9, "cos", "f")))
    assert retrieval.index_changes(a, b).first()["reasons"] == ["corpus_version_changed", "dimension_changed"]
    assert retrieval.index_changes(a, a).first()["reasons"] == []


def test_retrieval_metrics(spark):
    kind = "expectation_id string, query_id bigint, expected_chunk_ids array<string>, expected_document_ids array<string>"
    expected = spark.createDataFrame([("e", 1, ["a:0"], []), ("f", None, ["x:0"], [])], kind)
    results = spark.createDataFrame([(1, "a:0", "a", 1, "s"), (1, "b:0", "b", 2, "s")], "query_id bigint, chunk_id string, document_id string, rank int, strategy string")
    cases = metrics.cases(expected, results)
    got = {r["expectation_id"]: r for r in cases.collect()}
    assert (got["e"]["matched"], got["e"]["top_1"], got["e"]["covered"], got["e"]["failure_reasons"]) == (1, True, True, ["unexpected_retrieved_citation"])
    assert got["f"]["failure_reasons"] == ["no_matching_retrieval", "no_retrieved_citation", "expected_citation_not_retrieved"]
    s = metrics.summary(cases.where("expectation_id = 'e'")).first()
    assert (s["recall"], s["precision"], round(s["f1"], 6), s["coverage"]) == (1.0, 0.5, 0.666667, 1.0)
    kind = "expectation_id string, target string, expected_chunk_ids array<string>, expected_document_ids array<string>, retrieval_query_terms array<string>"
    wanted = spark.createDataFrame([("t", "x", [], [], ["Model", "sérving"]), ("g", "voice_ai", [], [], []), ("n", "zzz", [], [], [])], kind)
    runs = spark.createDataFrame([(1, 0, "voice ai", ["c"], ["d"], ["t"]), (2, 1, "model serving now", ["c"], ["d"], ["t"])], "query_id bigint, pos int, query string, chunk_ids array<string>, document_ids array<string>, topics array<string>")
    assert {r["expectation_id"]: r["query_id"] for r in metrics.match_retrievals(wanted, runs).collect()} == {"t": 2, "g": 1, "n": None}


def test_html():
    html = "<title>T &amp; u</title><script>var x='<p>no</p>'</script><style>p{}</style><p>Hello <b>world</b><noscript>js</noscript><a href='/x'>l</a><a>n</a>"
    assert pages.read_html(html) == ("T & u", "Hello world l n", ["/x"])
    assert pages.read_html(None) == ("unknown", "unknown", [])
    odd = "<title>a</title><script><b>x</b></script></script>kept<style>p<noscript>q</style>r</noscript>s<a href=''>e</a><a href='/1' href='/2'>f</a></title>t"
    assert pages.read_html(odd) == ("a", "kept r s e f t", ["/2"])  # a style holds text only


def test_crawl(spark):
    u = "https://s.io"
    links = spark.createDataFrame([(u, f"{u}/blog", 2), (u, f"{u}/about", 1), (u, f"{u}/login", 3), (u, f"{u}/docs", 9), (f"{u}/about", f"{u}/case", 5)], "url string, link string, priority int")
    have = spark.createDataFrame([(u,), (f"{u}/blog",), (f"{u}/about",), (f"{u}/docs",), (f"{u}/case",)], "url string")
    start = spark.createDataFrame([("s", u)], "site string, url string")
    rows = lambda **k: [(r["url"].removeprefix(u), r["depth"], r["error"]) for r in pages.crawl(start, have, links, **k).orderBy("depth", "pos").collect()]
    assert rows(max_pages=3) == [("", 0, None), ("/about", 1, None), ("/blog", 1, None)]
    assert rows(max_pages=9, max_depth=2) == [("", 0, None), ("/about", 1, None), ("/blog", 1, None), ("/login", 1, "login_required"), ("/docs", 1, None), ("/case", 2, None)]
    assert rows(max_pages=9, max_depth=0) == [("", 0, None)]


def fold_all(rows):
    """The sequential rules, stated once more: each newcomer is held against what all members so far make of an entity."""

    def view(members):
        names, urls, company, score, seen = [], "unknown", False, 0.0, []
        for _, name, key, url, domain, kind, s, e in members:
            names.append((len(name), len(names), name, key))
            if urls == "unknown" or (kind == "company" and not company and url != "unknown"):
                urls = url
            bonus = 0.05 if seen and e not in seen and len(seen) < 3 else 0.0
            score = min(round(max(score, s) + bonus, 2), 0.99) if seen else s
            seen += [e] if e not in seen else []
            company = company or kind == "company"
        _, _, name, key = min(names)
        return name, key, urls, company, score

    entities_so_far = []
    for row in rows:
        _, _, key, url, _, kind, _, _ = row
        for members in entities_so_far:
            _, have_key, have_url, have_company, _ = view(members)
            sites_known = kind == "company" and have_company and "unknown" not in (url, have_url)
            words, have = key.split(), have_key.split()
            n = min(len(words), len(have))
            same_name = key == have_key and not (sites_known and url != have_url)
            beginning = url == have_url == "unknown" and n >= 2 and words[:n] == have[:n]
            if (sites_known and url == have_url) or same_name or beginning:
                members.append(row)
                break
        else:
            entities_so_far.append([row])
    out = []
    for members in entities_so_far:
        name, _, url, _, score = view(members)
        out.append((members[0][0], sorted(m[0] for m in members), name, url, round(score, 2)))
    return sorted(out)


def test_dedup_in_blocks_is_the_sequential_fold(spark):
    rng = random.Random(6)
    names, hosts, kinds = ["Acme", "Acme AI", "Acme AI Labs", "Beta", "Beta One"], ["acme.com", "beta.io", "unknown"], ["company", "news", "directory"]
    for _ in range(4):
        rows = []
        for pos in range(30):
            name, kind, host = rng.choice(names), rng.choice(kinds), rng.choice(hosts)
            url = "unknown" if host == "unknown" else f"https://{host}"
            rows.append((pos, name, name.lower(), url, host, kind, {"company": 0.9, "news": 0.65, "directory": 0.75}[kind], (f"https://e.io/{pos % 7}", "s")))
        found = spark.createDataFrame([(p, n, u, s, k, e[0], e[1]) for p, n, _, u, _, k, s, e in rows], "pos bigint, name string, primary_url string, score double, source_type string, url string, snippet string")
        got = sorted((r["pos"], sorted(r["members"]), r["name"], r["primary_url"], round(r["score"], 2)) for r in entities.deduplicate(found).collect())
        assert got == fold_all(rows)
        cut = rng.randint(0, 29)
        members = entities.extend(entities.resolve(found.where(f"pos < {cut}")), found.where(f"pos >= {cut}"))
        assert sorted((r["pos"], sorted(r["members"]), r["name"], r["primary_url"], round(r["score"], 2)) for r in entities.merged(members).collect()) == fold_all(rows)
        assert members.count() == 30 and members.select("pos").distinct().count() == 30


def test_new_results_fold_only_what_they_reach(spark):
    row = "pos bigint, name string, primary_url string, score double, source_type string, url string, snippet string"
    old = spark.createDataFrame([(k, f"Name{k} Co{k % 50}", f"https://s{k}.com", 0.9, "company", "https://e.io", str(k)) for k in range(100)], row)
    members = entities.resolve(old)
    more = spark.createDataFrame([(100, "Name3", "https://s3.com", 0.9, "company", "https://e.io", "new"), (101, "Other", "https://o.com", 0.9, "company", "https://e.io", "o")], row)
    now = {r["pos"]: r["entity"] for r in entities.extend(members, more).collect()}
    assert now == {k: k for k in range(100)} | {100: 3, 101: 101}


def test_many_articles_of_one_domain_are_no_all_pairs():
    """What a hundred thousand newcomers that share a site, and few names, take is no square of their number."""
    import time

    roster, rng, began = entities.Roster(), random.Random(3), time.process_time()
    for k in range(100_000):
        name = f"name{rng.randint(0, 60_000)} of {rng.randint(0, 9)}"
        row = (name, name, name, "news.com" if k % 3 else "unknown", k % 5 == 0)
        roster.admit(roster.find(*row[1:]), row)
    assert len(roster.facts) > 1000 and time.process_time() - began < 20


def test_rank_without_one_task(spark):
    rows = spark.range(500).select((F.col("id") % 9 / 10).alias("score"), (F.col("id") % 4).cast("string").alias("name"), F.col("id").alias("pos"))
    got = {r["pos"]: r["rank"] for r in entities.best_candidates(rows).collect()}
    assert got == {p: k + 1 for k, p in enumerate(sorted(range(500), key=lambda p: (-(p % 9), str(p % 4), p)))}
    assert {r["pos"]: r["rank"] for r in entities.best_candidates(rows, 7).collect()} == {p: k for p, k in got.items() if k <= 7}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (4, 4), (8, 7), (7, 6), (6, 5)], "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components(links, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
    assert components(links.where("a > 99"), "a", "b").count() == 0


def test_profile_and_evidence(spark):
    kind = "key bigint, pos int, url string, title string, main_text string, collected_at string, name string"
    rows = [(1, 0, "https://a.io/x", "Acme | home", "Setor: fintech. Produto: motor\nnothing", "t", "n"), (1, 1, "https://a.io/y", "unknown", "usa IA generativa e Machine Learning", "t", "n"), (2, 0, "https://b.io", "unknown", "dados", "t", "Bee")]
    got = {(r["key"], r["field"]): (r["value"], r["claim_source"], len(r["evidences"])) for r in profiles.profile_fields(spark.createDataFrame(rows, kind)).collect()}
    assert got[1, "company_name"] == ("Acme", "observed", 1) and got[2, "company_name"] == ("Bee", "inferred", 0)
    assert got[1, "sector"] == ("fintech", "observed", 1) and got[2, "sector"] == ("data", "inferred", 1)
    assert got[1, "product"] == ("motor", "observed", 1) and got[1, "official_site"] == ("https://a.io", "observed", 1)
    assert got[1, "ai_signals"] == ("ia generativa, machine learning", "inferred", 2) and got[2, "funding"] == ("unknown", "unknown", 0)
    claims = spark.createDataFrame([(1, "f", 0, "São Paulo", [1]), (1, "f", 1, "sao  paulo", [1]), (1, "g", 0, "a", [1]), (1, "g", 1, "b", [2]), (1, "h", 0, "unknown", [1])], "key bigint, field string, pos int, value string, evidences array<int>")
    assert {r["field"]: (r["value"], r["has_conflict"]) for r in profiles.evidence_groups(claims).collect()} == {"f": ("São Paulo", False), "g": ("a", True)}


def test_assessment(spark):
    rows = [(1, "plataforma com MLOps, inferência em produção e dados proprietários"), (2, "um chatbot"), (3, "padaria"), (4, "visão computacional")]
    found = assessment.classify(assessment.criteria(spark.createDataFrame(rows, "startup bigint, text string")))
    assert {r["startup"]: (r["classification"], r["confidence"]) for r in found.collect()} == {1: ("ai_native", 0.88), 2: ("ai_enabled", 0.58), 3: ("non_ai", 0.72), 4: ("ai_enabled", 0.64)}
    gaps = {(r["startup"], r["gap_type"]) for r in assessment.technical_gaps(found, "startup").collect()}
    assert gaps == {(1, "model_serving"), (1, "data_acceleration"), (2, "llm_customization"), (2, "unknown"), (3, "unknown"), (4, "computer_vision")} - {(2, "llm_customization")}


def test_recommendation_rules(spark):
    score = recommend.technical_score(F.lit("high"), F.lit(0.72), F.lit(0.88), F.lit("documentation"), F.col("s"))
    assert one(spark, score, s=25.0) == pytest.approx(300 + 8 + 5 + 1)
    state = lambda blocked, n, gap, ok, sure: tuple(one(spark, recommend.gate(F.array(*map(F.lit, blocked)).cast("array<string>"), F.lit(n), F.lit(gap), F.lit(ok), F.lit(sure)), x=1))
    assert state(["b"], 1, "model_serving", True, 0.9) == ("blocked", "b")
    assert state([], 0, "model_serving", True, 0.9) == ("blocked", "missing_startup_gap_evidence")
    assert state([], 1, "voice_ai", True, 0.9)[0] == "hypothesis"
    assert state([], 1, "model_serving", True, 0.5) == ("hypothesis", "low_gap_confidence")
    assert state([], 1, "model_serving", True, 0.6) == ("supported", None)
    rows = [("a", "supported", "technical", "urgent"), ("b", "hypothesis", "program", "low"), ("c", "blocked", "technical", "low"), ("d", "supported", "program", "low")]
    got = recommend.final_priority(spark.createDataFrame(rows, "startup string, state string, kind string, priority string"))
    assert {r["startup"]: (r["final_priority"], r["next_action"]) for r in got.collect()} == {
        "a": ("urgent", "prepare_technical_outreach"), "b": ("human_review", "validate_program_fit_with_human"),
        "c": ("human_review", "resolve_blocking_evidence"), "d": ("low", "prepare_program_outreach"),
    }
    assert one(spark, recommend.unsupported_terms(F.col("c"), F.lit("fast model")), c="The fast model is amazing") == ["amazing"]
    story = "technical_gap_narrative: fast model\ncommercial_approach_narrative: the model"
    assert one(spark, recommend.guarded_narrative(F.col("c"), F.lit(story), F.lit("-")), c=story) == story
    assert one(spark, recommend.guarded_narrative(F.col("c"), F.lit(story), F.lit("-")), c="fast model") == "-"
    assert one(spark, recommend.recommendation_id(F.lit("Run 1"), F.lit("Ação!"), F.lit("")), x=1) == "run-1:acao:unknown"


def test_search(spark):
    rows = [(1, p, 3, k) for p in (1, 2, 3) for k in range(1, 6)]
    found = search.budgeted(spark.createDataFrame(rows, "run_id int, priority int, items int, position int"), 4, 6)
    assert sorted((r["priority"], r["position"]) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 1)]
    body = '{"web":{"results":[{"title":"t","url":"u","description":"","snippet":"s"},{"title":""}]}}'
    got = search.response_results(spark.createDataFrame([(1, "x", body)], "run_id int, term string, body string"), 5).collect()
    assert [(r["position"], r["title"], r["url"], r["snippet"]) for r in got] == [(1, "t", "u", "s"), (2, "unknown", "unknown", "unknown")]
    regions = spark.createDataFrame([("sao paulo", "SP", "city", 1), ("brasil", "BR", "country", 9)], "alias string, region string, region_type string, priority int")
    asked = spark.createDataFrame([(1, "startups de IA generativa em São Paulo, Brasil, early stage"), (2, "nada")], "query_id int, query string")
    assert {r["query_id"]: (r["region"], r["theme"], r["stage"]) for r in search.parse_queries(asked, regions).collect()} == {1: ("SP", "generative_ai", "early_stage"), 2: ("unknown", "unknown", "unknown")}


def test_places_by_kind_and_qualifier(spark):
    kind = "alias string, region string, region_type string, priority int"
    some = [("sao paulo", "SP-city", "city", 1), ("rio de janeiro", "RJ-city", "city", 2), ("sao paulo", "SP", "state", 1), ("bahia", "BA", "state", 2), ("ba", "BA", "state_code", 1),
            ("nordeste", "NE", "macro_region", 1), ("brasil", "BR", "country", 1), ("c++ (vila)", "odd", "city", 3), ("a.b", "dot", "city", 4)]
    regions = spark.createDataFrame([*some, *((f"lugar {k}", f"L{k}", "city", 100 + k) for k in range(5000))], kind)
    said = {
        "fintechs em São Paulo": "SP-city", "fintechs no estado de São Paulo": "SP", "estado São Paulo, cidade do Rio de Janeiro": "RJ-city", "uf BA e nordeste": "BA",
        "no nordeste do Brasil": "NE", "Brasil": "BR", "bar na praia": None, "Bahia ou São  Paulo": "SP-city", "lugar 4321 da bahia": "L4321", "lugar 43": "L43", "a.b": "dot", "axb": None, "": None, None: None,
    }
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(said)], "query_id int, query string")
    got = {r["query_id"]: r["region"] for r in search.place_of(asked, regions).collect()}
    assert {q: got.get(i) for i, q in enumerate(said)} == said
    plan = search.parse_queries(asked, regions)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_expectations_meet_retrievals_without_all_pairs(spark):
    import unicodedata

    def plain(t):
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().strip()

    rng = random.Random(4)
    words = ["model", "serving", "voz", "ai", "é", "data lake", "x"]
    runs = [(k, k, " ".join(rng.choices(words, k=rng.randint(0, 4))), [f"c{rng.randint(0, 9)}"], [f"d{rng.randint(0, 30)}"], [rng.choice(["model_serving", "voz"])]) for k in range(40)]
    wanted = [(f"e{k}", rng.choice(["model_serving", "data_lake", "zzz", "", "voz"]), rng.sample(["c3", "c99"], k % 2), rng.sample(["d7", "d99"], k % 3 // 2), rng.choices([*words, "Serving ", "", "nope"], k=k % 4)) for k in range(60)]

    def best(e):
        _, target, chunks, documents, terms = e
        w = plain(target.replace("_", " "))
        tiers = [(1 if terms and all(plain(t) in plain(q) for t in terms) else 2 if (w and w in plain(q)) or target in topics or set(cs) & set(chunks) or set(ds) & set(documents) else 9, p, i) for i, p, q, cs, ds, topics in runs]
        return min(tiers)[2] if min(tiers)[0] < 9 else None

    e = spark.createDataFrame(wanted, "expectation_id string, target string, expected_chunk_ids array<string>, expected_document_ids array<string>, retrieval_query_terms array<string>")
    r = spark.createDataFrame(runs, "query_id bigint, pos int, query string, chunk_ids array<string>, document_ids array<string>, topics array<string>")
    assert {x["expectation_id"]: x["query_id"] for x in metrics.match_retrievals(e, r).collect()} == {x[0]: best(x) for x in wanted}
    assert {x["query_id"] for x in metrics.match_retrievals(e, r.where("query_id = 0")).collect()} == {0}


def test_secrets():
    env = {"X_API_KEY": " abcd ", "DATABASE_URL": "postgres://u:pass@h/db", "PLAIN": "zzzz", "MY_TOKEN": "abc", "NAMED": "other1"}
    assert secrets.secret_values(env, ("NAMED",)) == ("abcd", "postgres://u:pass@h/db", "pass", "other1")


def test_service():
    runs = service.Runs(lambda options: {"seen": options["query"]} if options["limit"] else 1 / 0)
    server = service.serve(runs, port=0, matrix=lambda only: {"only": list(only)})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(base + path, json.dumps(body).encode() if body is not None else None, timeout=10) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/health") == (200, {"status": "ok"})
        code, made = call("/api/runs", {"query": "q", "render_js": "yes"})
        assert (code, made["status"], made["result"], made["options"]["render_js"]) == (201, "completed", {"seen": "q"}, True)
        assert call(f"/api/runs/{made['run_id']}")[1]["run_id"] == made["run_id"]
        assert call("/api/runs", {"startup_url": "u", "limit": 0})[1]["status"] == "failed"
        for bad, why in (({}, "provide_exactly_one_of_startup_url_or_query"), ({"query": "q", "limit": "x"}, "limit_must_be_integer"), ({"query": "q", "render_js": 7}, "render_js_must_be_boolean"), ({"query": "q", "robots_policy": "x"}, "robots_policy_must_be_one_of:conservative,permissive-on-error,off")):
            assert call("/api/runs", bad) == (400, {"detail": why})
        assert call("/api/runs/none") == (404, {"detail": "run_not_found"})
        assert call("/api/check-matrix?only=a,%20b,a") == (200, {"only": ["a", "b"]})
    finally:
        server.shutdown()


def test_language_models():
    with pytest.raises(ValueError, match="unsupported"):
        language.Settings("none", "m")
    settings = language.Settings.of({"P_PROVIDER": "LiteLLM", "P_MODEL": "m", "P_TEMPERATURE": "0.5"}, "P_")
    seen = {}

    def call(**kwargs):
        seen.update(kwargs)
        return {"choices": [{"message": {"content": "said"}}]}

    assert language.Provided(settings, call).complete("p") == "said" and seen == {"messages": [{"role": "user", "content": "p"}], "model": "m", "temperature": 0.5}
    with pytest.raises(RuntimeError):
        language.Provided(settings).complete("p")


def test_embedding_dimension(spark):
    rows = spark.createDataFrame([("a",)], "t string")
    about = embedding.Metadata("p", "m", "1", 3)
    with pytest.raises(Exception, match="embedding_dimension_mismatch"):
        embedding.embed(rows, "t", lambda: lambda texts: [[1.0] for _ in texts], about).collect()
    index = about.index("c1")
    with pytest.raises(Exception, match="embedding_dimension_mismatch"):
        retrieval.index_rows(rows.select(F.col("t").alias("chunk_id"), F.array(F.lit(1.0)).alias("embedding")), index).collect()
    meta = lambda **k: spark.createDataFrame([k], ", ".join(f"{f} string" for f in k))
    fields = {"corpus_version": "v", "provider": "p", "model": "m", "version": "1", "dimension": "3", "metric": "cosine", "chunking_fingerprint": "f"}
    assert retrieval.check_index(meta(**fields), meta(**fields)).count() == 1
    with pytest.raises(Exception, match="embedding_index_incompatible:model_changed"):
        retrieval.check_index(meta(**fields), meta(**(fields | {"model": "x"}))).collect()


def test_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/store")
    rows = lambda *r: spark.createDataFrame(list(r), "run string, k int, v string")
    store.create("t", rows(("a", 1, "x"), ("b", 1, "y")))
    with pytest.raises(FileExistsError):
        store.create("t", rows(("c", 1, "z")))
    store.replace("t", rows(("a", 2, "new")), "run")
    store.upsert("t", rows(("b", 1, "changed"), ("b", 2, "more")), "run", "k")
    assert sorted(map(tuple, store.read("t").select("run", "k", "v").collect())) == [("a", 2, "new"), ("b", 1, "changed"), ("b", 2, "more")]
    with pytest.raises(KeyError):
        store.read("none")
    before = store.read("t")
    with pytest.raises(RuntimeError, match="half way"), store.transaction() as t:
        t.replace("t", rows(("a", 9, "lost")), "run")
        raise RuntimeError("half way")
    assert sorted(map(tuple, store.read("t").collect())) == sorted(map(tuple, before.collect()))
    with store.transaction() as t:  # another writer commits in between: this one tries again on what it left
        t.replace("t", rows(("a", 3, "later")), "run")
        t.create("u", rows(("a", 1, "x")))
        store.replace("t", rows(("c", 1, "first")), "run")
    assert {r["run"] for r in store.read("t").collect()} == {"a", "b", "c"} and store.read("t", run="a").first()["v"] == "later"
    assert store.tables() == ["t", "u"] and store.vacuum() > 0 and store.read("t").count() == 4
    store.create("p", rows(("a", 1, "x"), ("b", 1, "y"), ("c/d", 1, "z")), "run")
    store.replace("p", rows(("c/d", 2, "new"), ("e", 1, "w")), "run", partitions=("run",))
    store.upsert("p", rows(("b", 1, "up"), ("b", 2, "more")), "run", "k", partitions=("run",))
    assert sorted((r["run"], r["k"], r["v"]) for r in store.read("p").collect()) == [("a", 1, "x"), ("b", 1, "up"), ("b", 2, "more"), ("c/d", 2, "new"), ("e", 1, "w")]
    left = len(list((tmp_path / "store" / "p").glob("*/run=a")))
    assert left == 1  # an untouched partition is not written again
    held = spark.createDataFrame([("1", "f"), ("1", "f")], "corpus_version string, fingerprint string")
    assert [reusable(held, v, f).count() for v, f in (("1", None), ("1", "f"), ("2", None), ("1", "g"))] == [2, 2, 0, 0]
    assert reusable(held.where("false"), "1").count() == 0


def test_run_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "x int")
    folder = save_run(spark, f"file://{tmp_path}/runs", "r", {"a": rows}, {"b": rows})
    assert sorted(load_run(spark, folder)) == ["a", "b"]
    with pytest.raises(FileExistsError):
        save_run(spark, f"file://{tmp_path}/runs", "r", {}, {})
    with pytest.raises(Exception, match="broken"):
        save_run(spark, f"file://{tmp_path}/runs", "s", {"a": rows, "b": rows.select(F.raise_error(F.lit("broken")).alias("x"))}, {})
    assert not (tmp_path / "runs" / "s").exists()
    kept = RunStore(spark, f"file://{tmp_path}/store")
    assert new_run(kept, "x") == "x" and new_run(kept) != new_run(kept)
    with pytest.raises(FileExistsError):
        new_run(kept, "x")


def test_hybrid_sides_must_fit(spark):
    side = lambda v: spark.createDataFrame([(1, "c", "d", 0, 1, 0.5, v)], "query_id int, chunk_id string, document_id string, chunk_index int, rank int, score double, corpus_version string")
    assert retrieval.fuse(side("v1"), side("v1")).count() == 1
    with pytest.raises(Exception, match="hybrid_corpus_version_mismatch"):
        retrieval.fuse(side("v1"), side("v2")).collect()
    docs = spark.createDataFrame([("d", "t", "u", "p", "n"), ("e", "t", "u", "p", "n")], "document_id string, title string, source_url string, source_type string, ingested_at string")
    pieces = spark.createDataFrame([("c", "d", "x")], "chunk_id string, document_id string, text string")
    hit = lambda d: spark.createDataFrame([(1, "c", d)], "query_id int, chunk_id string, document_id string")
    assert corpus.citations(hit("d"), pieces, docs).count() == 1
    with pytest.raises(Exception, match="citation_document_mismatch:c"):
        corpus.citations(hit("e"), pieces, docs).collect()


def test_corpus_file(spark, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text('{"schema_version":"v1","corpus_version":"c1","documents":[{"schema_version":"v1","corpus_version":"c1","document_id":"d","title":"t","source_url":"https://v.com/x","source_type":"page","ingested_at":"2024","metadata":{"stack_id":"s","stack_name":"n","topic":"model_serving","brief_description":"b","technical_description":"t","categories":["c"],"use_cases":["u"],"supported_gap_types":["model_serving"]}}],"chunks":[{"schema_version":"v1","corpus_version":"c1","chunk_id":"d:0","document_id":"d","chunk_index":0,"topic":"model_serving","text":"x"}]}')
    head, documents, pieces = corpus.read_corpus(spark, f"file://{path}")
    official = policy.OfficialSources(("v.com",), types=("page",))
    assert corpus.corpus_issues(head, documents, pieces, official).count() == 0
    profile = corpus.stack_profiles(documents, pieces).first()
    assert (profile["stack_name"], profile["citation_chunk_ids"]) == ("n", ["d:0"])
    broken = pieces.union(pieces)
    assert {r["reason"] for r in corpus.corpus_issues(head, documents, broken, official).collect()} == {"duplicate_chunk_id:d:0", "non_consecutive_chunk_indices:expected:0,1:actual:0,0"}


def test_store_is_one_scan_and_one_of_two_writers_wins(spark, tmp_path):
    import threading

    store = RunStore(spark, f"file://{tmp_path}/runs")
    rows = lambda run, n: spark.createDataFrame([(run, k, f"{run}{n}") for k in range(2)], "run_id string, k int, v string")
    for n in range(12):
        store.replace("t", rows(f"r{n % 8}", n), "run_id", partitions=("run_id",))
    plan = store.read("t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert {(r["run_id"], r["v"]) for r in store.read("t").collect()} == {(f"r{n % 8}", f"r{n % 8}{n}") for n in range(4, 12)}
    assert {r["v"] for r in store.read("t", run_id="r3").collect()} == {"r311"}
    wider = rows("r0", 99).withColumn("more", F.lit(1))
    store.replace("t", wider, "run_id", partitions=("run_id",))
    assert {(r["v"], r["more"]) for r in store.read("t").where("run_id in ('r0', 'r1')").collect()} == {("r099", 1), ("r19", None)}
    done = []

    def write():
        try:
            done.append(new_run(store, "same"))
        except FileExistsError:
            done.append(None)

    writers = [threading.Thread(target=write) for _ in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(done, key=str) == [None, None, None, "same"] and store.read("runs").where("run_id = 'same'").count() == 1
    others = [threading.Thread(target=lambda k=k: new_run(store, f"n{k}", kind=str(k))) for k in range(4)]
    [w.start() for w in others]
    [w.join() for w in others]
    assert {r["run_id"]: r["kind"] for r in store.read("runs").collect()} == {"same": None} | {f"n{k}": str(k) for k in range(4)}


def test_a_dead_claim_holds_nobody_up(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/runs")
    store.PATIENCE = 0.2
    (tmp_path / "runs" / "_commits").mkdir(parents=True)
    (tmp_path / "runs" / "_commits" / "1.claim").touch()
    assert new_run(store, "a") == "a" and store.read("runs").count() == 1
