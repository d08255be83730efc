"""Stored indexes: the same results as a pass over everything, after upserts and with parts skipped."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import lexical_index, retrieval
from quarrylight.operators.lexical_index import LexicalIndex
from quarrylight.operators.vector_index import VectorIndex, fitted

CHUNKS = "chunk_id string, document_id string, chunk_index int, topic string, text string"
META = {"corpus_version": "c", "provider": "p", "model": "m", "version": "1", "dimension": 8, "metric": "cosine"}


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/index"


def chunks(spark, rows):
    return spark.createDataFrame([(f"{d}:{i}", d, i, "model_serving" if d == "d3" else None, t) for d, i, t in rows], CHUNKS)


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["document_id"], r["chunk_index"], round(r["score"], 7)) for r in df.collect())


def texts(rng, n, words=40):
    vocabulary = [f"w{i}" for i in range(60)]
    return [(f"d{k}", 0, " ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=rng.randint(0, words)))) for k in range(n)]


def test_lexical_index_follows_upserts(spark, folder, monkeypatch):
    monkeypatch.setattr(lexical_index, "SPAN_BITS", 4)
    monkeypatch.setattr(lexical_index, "SPAN", 16)
    rng = random.Random(1)
    rows = [*texts(rng, 200), ("d3", 1, "Ação needs w1"), ("empty", 0, ""), ("null", 0, None), ("long", 0, "w2 " * 3000), ("d5", 1, "w1 w2 w3"), ("d5", 2, "w1 w2 w3")]
    asked = spark.createDataFrame([("a", "w1 w1 w50"), ("b", "model serving acao"), ("c", "nothing here"), ("d", ""), ("e", "w2"), ("f", None)], "query_id string, query string")
    index = LexicalIndex(spark, folder)
    with pytest.raises(ValueError, match="no index"):
        index.search(asked)
    index.upsert(chunks(spark, rows).repartition(3))
    for k in (1, 3, 500):
        assert found(index.search(asked, k)) == found(retrieval.bm25(chunks(spark, rows), asked, k))
    before = spark.read.parquet(f"{folder}/gen=0/forward").inputFiles()
    changed = {"d7": "w1 w50 w50", "d8": None, "d5": "only one chunk now w3", "new": "w50"}
    index.upsert(chunks(spark, [(d, 0, t) for d, t in changed.items()]), removed=spark.createDataFrame([("d9",), ("absent",)], "document_id string"))
    live = [r for r in rows if r[0] not in {*changed, "d9"}] + [(d, 0, t) for d, t in changed.items()]
    assert spark.read.parquet(f"{folder}/gen=0/forward").inputFiles() == before and spark.read.parquet(f"{folder}/gen=1/forward").count() == 4
    index.upsert(chunks(spark, [("d7", 0, "w50 again"), ("d10", 0, "w1")]))
    live = [r for r in live if r[0] not in ("d7", "d10")] + [("d7", 0, "w50 again"), ("d10", 0, "w1")]
    want = found(retrieval.bm25(chunks(spark, live), asked, 5))
    assert found(index.search(asked, 5)) == want
    assert index.compact() == 3 and index.generations() == [3]
    assert found(index.search(asked, 5)) == want
    stats = {r["token"]: r["df"] for r in spark.read.parquet(f"{folder}/gen=3/stats").collect()}
    assert stats == {r["token"]: r["df"] for r in retrieval.index_stats(chunks(spark, live)).collect()}


def test_lexical_index_skips_spans(spark, folder):
    """A rare token and a frequent one: spans without the rare token can't reach the threshold."""
    rows = [(f"d{k:05d}", 0, "common " * 3 + ("rare " * 5 if k == 4000 else "other word ")) for k in range(6000)]
    index = LexicalIndex(spark, folder)
    index.upsert(chunks(spark, rows).coalesce(1).sortWithinPartitions("chunk_id"))
    asked, report = spark.createDataFrame([("a", "rare common")], "query_id string, query string"), {}
    assert found(index.search(asked, 1, report)) == found(retrieval.bm25(chunks(spark, rows), asked, 1))
    assert report["pairs"] == 12 and report["pairs_scored"] == lexical_index.FIRST and report["rows_scored"] < report["rows"] / 2


def test_lexical_index_refuses_repeats_and_ignores_what_is_unfinished(spark, folder):
    index = LexicalIndex(spark, folder)
    index.upsert(chunks(spark, [("a", 0, "x y")]))
    with pytest.raises(ValueError, match="repeat"):
        index.upsert(chunks(spark, [("b", 0, "x"), ("b", 0, "x")]))
    assert index.generations() == [0] and index.upsert(chunks(spark, [("c", 0, "x")])) == 2
    asked = spark.createDataFrame([(1, "x")], "query_id int, query string")
    assert {r["document_id"] for r in index.search(asked, 9).collect()} == {"a", "c"}


def test_bm25_sends_k_rows_a_task(spark):
    """Tiles are merged before anything moves, and ties fall as ids say."""
    rows = chunks(spark, [(f"d{k:04d}", 0, "same text") for k in range(3000)]).repartition(2)
    asked = spark.createDataFrame([("q", "same")], "query_id string, query string")
    hits = retrieval._ranked(rows, asked, 3, (), lambda df, n: np.ones(len(df)), True)
    assert hits.count() <= 3 * hits.rdd.getNumPartitions()
    assert [r["chunk_id"] for r in retrieval.bm25(rows, asked, 3).orderBy("rank").collect()] == ["d0000:0", "d0001:0", "d0002:0"]


def vectors(spark, rows):
    return spark.createDataFrame([(i, i, 0, v) for i, v in rows], "chunk_id int, document_id int, chunk_index int, embedding array<double>")


def clustered(rng, n, spread=0.05):
    centres = rng.normal(size=(12, 8))
    return [(k, (centres[k % 12] + spread * rng.normal(size=8)).tolist()) for k in range(n)]


def test_vector_index_reads_few_clusters_and_follows_upserts(spark, folder):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 600)
    rows += [(1000 + k, rows[5][1]) for k in range(40)] + [(2000, [0.0] * 8), (2001, [float("nan")] * 8), (2002, None)]
    index, held = VectorIndex(spark, folder), vectors(spark, rows)
    index.build(held, META, pivots=12)
    asked = held.where("chunk_id % 20 = 0 OR chunk_id > 1990").select(F.col("chunk_id").alias("query_id"), "embedding")
    report = {}
    assert found(index.search(asked, 4, report=report)) == found(retrieval.nearest(held, asked, 4))
    assert report["pairs_read"] < report["pairs"] / 2
    for k, least in ((1, 0.0), (3, 0.9), (700, -2.0)):
        assert found(index.search(asked, k, least)) == found(retrieval.nearest(held, asked, k, least))
    moved = {k: (-np.array(rows[k][1])).tolist() for k in range(0, 600, 100)} | {5000: rows[3][1]}
    assert index.upsert(vectors(spark, list(moved.items())), removed=spark.createDataFrame([(1003,), (7,)], "chunk_id int")) == 1
    index.upsert(vectors(spark, [(0, rows[0][1])]))
    moved[0] = rows[0][1]
    live = vectors(spark, [r for r in rows if r[0] not in {*moved, 1003, 7}] + list(moved.items()))
    assert found(index.search(asked, 4)) == found(retrieval.nearest(live, asked, 4))


def test_vector_index_checks_what_it_is_given(spark, folder):
    index = VectorIndex(spark, folder)
    with pytest.raises(ValueError, match="no index"):
        index.search(spark.createDataFrame([(1, [1.0] * 8)], "query_id int, embedding array<double>"))
    with pytest.raises(Exception, match="embedding_dimension_mismatch"):
        VectorIndex(spark, folder + "2").build(vectors(spark, [(1, [1.0, 2.0])]), META)
    index.build(vectors(spark, [(1, [1.0] * 8)]), META)
    index.check(META)
    with pytest.raises(Exception, match="embedding_index_incompatible:model_changed,version_changed"):
        index.check(META | {"model": "other", "version": "2"})


def test_vector_index_of_nothing_and_of_zero_vectors(spark, folder):
    asked = spark.createDataFrame([(1, [1.0] * 8), (2, [0.0] * 8)], "query_id int, embedding array<double>")
    none = VectorIndex(spark, folder)
    none.build(vectors(spark, []), META)
    assert none.search(asked).count() == 0
    zeros = VectorIndex(spark, folder + "0")
    zeros.build(vectors(spark, [(7, [0.0] * 8), (8, [0.0] * 8)]), META)
    assert zeros.search(asked).count() == 0
    assert found(zeros.search(asked, 1, -1.0)) == [(1, 1, 7, 7, 0, 0.0), (2, 1, 7, 7, 0, 0.0)]


def test_pivots_of_copies_are_one():
    assert len(fitted(np.ones((50, 3)), 8)) == 1 and fitted(np.zeros((5, 3)), 4).shape == (0, 3)
