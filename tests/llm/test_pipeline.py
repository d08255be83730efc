"""The pipeline on the smallest table: each stage against what its operator says, and planted cases."""

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import near_duplicates, quality_classifier, substrings
from quarrylight.llm.queries import ORACLES, QUERIES
from quarrylight.tables import table, written
from verify import canon


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = table(spark, small, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), f"test-{name}")
        out.append(docs)
    return out


def test_columns(spark, small, stages):
    columns = table(spark, small, "documents").columns
    assert all(s.columns == columns for s in stages[:-1])
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(stages[-1].columns)


def test_stages_follow_their_operators(spark, small, stages):
    docs = table(spark, small, "documents")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    kept = quality_classifier.score(docs, table(spark, small, "labels")).where("kept")
    assert ids(stages[0]) == ids(kept)
    assert ids(stages[1]) == ids(near_duplicates.near_duplicates(stages[0]).where("kept"))
    cut = substrings.dedup_substrings(stages[1])
    assert ids(stages[2]) == ids(cut.where("n_removed = 0 OR n_removed < n_words"))
    again = substrings.dedup_substrings(stages[2])
    changed = cut.where("n_removed > 0 AND n_removed < n_words").select("doc_id", "kept_text")
    assert changed.join(stages[2], "doc_id").where("text <> kept_text").count() == 0
    assert again.agg(F.sum("n_removed")).first()[0] <= cut.agg(F.sum("n_removed")).first()[0]


def test_good_documents_stay(spark, small, stages):
    labels = table(spark, small, "labels")
    good = labels.where("quality = 1")
    assert good.join(stages[0], "doc_id", "left_anti").count() <= 0.02 * good.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small).toPandas(), con.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `has text` int, row_id string, z string"


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None, None, None)], "mixed"])
def test_stages_on_awkward_tables(spark, small, rows):
    """Nulls, ties, repeated rows, clashing names and an empty table go through every stage, with their columns."""
    if rows == "mixed":
        same = (2, "one two three four five six", "en", "a", 27, 1, "x", "z")
        rows = [same, same, (None, "null id " * 60, "en", None, None, 1, "x", "z"), (3, None, None, "a", None, 1, "x", "z"), (4, "", "en", "b", 0, 1, "x", "z"), (2, "tie", "en", "b", 3, 1, "x", "z"), (9, "w " * 30_000, "en", "a", 60_000, 1, "x", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, small), "awkward")
        if name != "packing":
            assert out.columns == docs.columns
            if name != "source_mix":
                assert out.count() <= n
        docs, n = out, out.count()
    assert (n > 0) == (len(rows) > 1)


def test_every_query_has_a_callable_and_oracles_have_queries():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert set(ORACLES) <= set(QUERIES)
