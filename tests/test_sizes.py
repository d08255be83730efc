"""What only shows on larger or odder tables: several files, cut entities, many equal rows, what goes to a task."""

import re

import duckdb
import numpy as np
import pyarrow as pa

from pyspark import cloudpickle

from quarrylight import tables
from quarrylight.operators import lexical_index, pages, retrieval
from quarrylight.operators.vector_index import VectorIndex
from quarrylight.plans import downstream, indexes, oracles, queries, registry, states
from quarrylight.streaming import events as stream


def test_stream_of_several_files_drops_nothing(spark, tmp_path):
    rows = [(i, 86400 * (i % 5) + i, None if i % 7 == 0 else "ab"[i % 2], i / 4) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id bigint, s bigint, event_type string, value double")
    events = events.selectExpr("event_id", "timestamp_seconds(s) AS ts", "event_id AS user_id", "event_type", "value", "'{}' AS props")
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(str, stream.stream_hourly(spark, str(tmp_path)).collect()))
    assert got == sorted(map(str, stream.hourly(events).collect()))


def test_cut_references_of_titles(spark, tmp_path):
    html = ["<title>a &amp; b&amp</title><p>c &amp d", "<title>&quot;x&quot; &am</title>", "<title>&#65;&#66 &copy</title>"]
    given = spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string").selectExpr("page_id", "'https://a.io' AS url", "html")
    given.write.parquet(f"{tmp_path}/pages.parquet")
    assert [r["title"] for r in queries.page_extract(spark, str(tmp_path)).orderBy("page_id").collect()] == ["a & b&amp", '"x" &am', "A&#66 &copy"]
    assert [r["title"] for r in pages.extract(given).orderBy("page_id").collect()] == ["a & b&", '"x" &am', "AB ©"]
    assert pages.read_html(pages.whole_references(html[0]))[1] == "c & d"


def test_cut_references_of_texts(spark, tmp_path):
    """Outside titles the SQL reads `&amp` without its semicolon, and no other reference."""
    html = ["<title>x</title><h1>a = &quot</h1><p>&quot;b&quot; &amp c&ampd &middot &copy;&middot; &#38 & e", "<title>&quot</title><p>&copyright; &am <a href=\"/y?a=1&copy=2\">z</a> &amp;quot; &quot"]
    given = spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string").selectExpr("page_id", "'https://a.io' AS url", "html")
    given.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.page_extract(spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted(con.execute(oracles.ORACLES["page_extract"]).fetchall())
    assert pages.read_html(html[0])[1] == 'a = " "b" & c&d · ©· & & e'


def test_equal_texts_score_alike_beside_any_others():
    """Scores at the limit between two ninth places: what else is in a tile may not decide."""
    rng, n, trials = np.random.default_rng(1), 90, 200
    asked = pa.table({"query_id": [0] * 60, "id": list(range(60)), "qtf": [1] * 60})
    for _ in range(trials):
        tf = rng.integers(1, 5, n)
        make = lambda ids, tfs: {"ids": ids.astype(np.int32), "tfs": tfs.astype(np.int32), "length": 200}
        rows = [make(np.arange(n), tf)] + [make(np.sort(rng.choice(n, 40, False)), rng.integers(1, 5, 40)) for _ in range(40)]
        keys = {k: list(range(len(rows))) for k in ("chunk_id", "document_id", "chunk_index")}
        part = pa.record_batch(keys | {c: [r[c] for r in rows] for c in ("length", "ids", "tfs")})
        idf = rng.random(n) * 5
        weight = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 200 / 150.0))
        raw = float((weight[:60] * idf[:60]).sum())
        idf *= (np.floor(raw * 1e9) + 0.5) / 1e9 / raw
        score = lambda p: next(b["score"][b["chunk_id"].to_pylist().index(0)].as_py() for b in retrieval._Scores(asked, idf, 150.0, 50, True)._tile(p))
        assert score(part) == score(part.slice(0, 1)) == score(part.slice(0, 3))


def test_queries_go_to_a_task_once(spark, tmp_path, monkeypatch):
    """What a search sends to a task is about the block's vectors, however many clusters each query reads."""
    rng = np.random.default_rng(2)
    rows = [(i, i, 0, rng.normal(size=16).tolist()) for i in range(600)]
    vectors = spark.createDataFrame(rows, "chunk_id bigint, document_id bigint, chunk_index int, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    index.build(vectors, {"dimension": 16}, pivots=24)
    sent, real = [], type(vectors).mapInArrow
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda df, f, *a, **kw: (sent.append(len(cloudpickle.dumps(f))), real(df, f, *a, **kw))[1])
    asked = vectors.selectExpr("chunk_id AS query_id", "embedding")
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect())
    found = key(index.search(asked))
    assert max(sent) < 4 * 600 * 16 * 8
    assert found == key(retrieval.nearest(vectors, asked))


def test_texts_without_a_direction_are_first_as_in_sql(spark, tmp_path):
    """A text, or a passage, without any letter of the model has a zero vector: in SQL its cosine is NaN, which is above all numbers."""
    texts = ["the house of reeds", "çé", "a red tent", "7567 | 55", "the house", "other lands", None, "a red tent", "und", "çé"]
    asked = ["the red house", "éç", "lands", "", "tent of reeds"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = indexes.hybrid_store(spark, str(tmp_path)).collect()
    want = con.execute(registry.ORACLES["hybrid_store"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert [r["chunk_id"] for r in got if r["query_id"] == 0 and r["vector_rank"] == 1] == [1]


def test_pages_come_in_bounded_batches(spark):
    key, given = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([("https://a.io", "<p>x")], "url string, html string")
    before = spark.conf.get(key)
    try:
        for read in (pages.extract, lambda df: pages.resolve_links(df.selectExpr("url", "array('/x') AS links"))):
            spark.conf.unset(key)
            read(given)
            assert int(spark.conf.get(key)) <= 2000
    finally:
        spark.conf.set(key, before)


def test_postings_are_made_of_bounded_groups():
    """A task that turns rows into postings holds a few MB of them, however many rows it gets."""
    names = [f"w{i}" for i in range(400)]
    row = {"terms": [names] * 100, "tfs": pa.array([[1] * 400] * 100, pa.list_(pa.int32())), "length": pa.array([400] * 100, pa.int64())}
    given, taken = 60, []

    def batches():
        for b in range(given):
            taken.append(b)
            yield pa.record_batch({"span": pa.array([b] * 100, pa.int64()), "place": pa.array(range(100), pa.int32())} | row)

    first = next(iter(lexical_index._inverted(batches())))
    assert len(taken) < given / 2 and first.num_rows == 400 * len(taken)


def test_a_larger_index_is_more_tasks_not_larger_ones(spark, tmp_path, monkeypatch):
    """Tasks that sort postings and score spans follow the size of what is stored, whatever the session's number of partitions."""
    monkeypatch.setattr(lexical_index, "TASK_MB", 0.002, raising=False)
    chunks = spark.range(1500).selectExpr("id AS chunk_id", "id AS document_id", "0 AS chunk_index", "'' AS topic", "concat('w', id % 7, ' x', id, ' y', id % 100) AS text")
    index, asked = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index"), spark.createDataFrame([(1, "w3 y17"), (2, "x40 w5")], "query_id bigint, query string")
    index.upsert(chunks)
    assert len(list((tmp_path / "index/gen=0/postings").glob("*.parquet"))) > 8
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    assert key(index.search(asked)) == key(retrieval.bm25(chunks, asked))


def test_workflow_searches_texts_for_gaps_once(spark, small, monkeypatch):
    """Of the workflow's inputs only classes, gaps and opportunities read texts; what is derived from gaps does not search again."""
    plans, real = {}, states.written
    monkeypatch.setattr(states, "written", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().optimizedPlan().toString()), real(df, name))[1])
    states._inputs(spark, small)
    assert {"gaps", "judged"} <= set(plans)  # each is written once, before what reads it
    assert not [n for n in ("inputs-gaps", "inputs-profiles") if "contains(" in plans[n].lower()]


def test_workflow_broadcasts_no_table_of_startups(spark, small, monkeypatch):
    """A broadcast of startups is built in the driver; small tables would get one by their size on disk, so joins by startup are merges."""
    plans = []
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (states, downstream):
        monkeypatch.setattr(module, "written", lambda df, name: (note(df), tables.written(df, name))[1])
    note(states.workflow_resume(spark, small))
    joins = [line for p in plans for line in p.splitlines() if "Join [" in line]
    assert [j for j in joins if "SortMergeJoin [startup#" in j]
    assert not [j for j in joins if re.search(r"Broadcast\w*Join \[(startup|query_id)#|Broadcast\w*Join \[coalesce\(source.*BuildLeft", j)]
