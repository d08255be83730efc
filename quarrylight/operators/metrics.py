"""Retrieval metrics: cases, summaries, comparisons of strategies, effects of reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import fold, ratio


def match_retrievals(expectations: DataFrame, retrievals: DataFrame) -> DataFrame:
    """expectation_id, query_id: the retrieval that answers an expectation.

    First by all query terms in the query, then by target in the query or among the results (chunk_ids, document_ids,
    topics), then the only retrieval there is; earlier retrievals (pos) first. retrievals: query_id, pos, query, chunk_ids,
    document_ids, topics.
    """
    asked = retrievals.select("query_id", "pos", fold(F.col("query")).alias("said"), "chunk_ids", "document_ids", "topics")
    said = asked.select("query_id", "pos", "said", F.explode(F.array_distinct(grams(F.col("said")))).alias("gram"))
    # (1) by terms, and (2) by target in the query: a term's first letters meet the query's, then the text is read. Ids and topics are equal.
    terms = F.transform("retrieval_query_terms", lambda t: fold(t))
    wanted = expectations.select("expectation_id", terms.alias("terms"), fold(F.replace(F.col("target"), F.lit("_"), F.lit(" "))).alias("words"))
    longest = F.element_at(F.array_sort(F.transform("terms", lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), 1)["t"]
    by_terms = _read(wanted.where(F.size("terms") > 0).withColumn("key", longest), said, F.forall("terms", lambda t: F.contains("said", t)))
    by_words = _read(wanted.where(F.col("words") != "").withColumn("key", F.col("words")), said, F.contains("said", F.col("words")))
    equal = None
    for mine, theirs in ((F.array("target"), "topics"), (F.col("expected_chunk_ids"), "chunk_ids"), (F.col("expected_document_ids"), "document_ids")):
        a = expectations.select("expectation_id", F.explode(mine).alias("x"))
        part = a.join(asked.select("query_id", "pos", F.explode(theirs).alias("x")), "x").select("expectation_id", "query_id", "pos")
        equal = part if equal is None else equal.unionByName(part)
    tier = lambda df, n: df.groupBy("expectation_id").agg(F.min(F.struct(F.lit(n).alias("tier"), "pos", "query_id")).alias("best"))
    found = tier(by_terms, 1).union(tier(by_words.unionByName(equal), 2)).groupBy("expectation_id").agg(F.min("best").alias("best"))
    only = F.broadcast(retrievals.agg(F.count("*").alias("retrievals"), F.min("query_id").alias("only")))  # one row
    out = expectations.select("expectation_id").join(found, "expectation_id", "left").crossJoin(only)
    return out.select("expectation_id", F.coalesce(F.col("best.query_id"), F.when(F.col("retrievals") == 1, F.col("only"))).alias("query_id"))


#: Letters of a term that bring it together with texts that may hold it.
GRAM = 4


def grams(text: Column) -> Column:
    """Runs of GRAM characters of a text, those of its end shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))


def _read(wanted: DataFrame, said: DataFrame, holds: Column) -> DataFrame:
    """expectation_id, query_id, pos where `holds`: candidates share the first letters of the expectation's key. A key shorter than a gram
    meets the grams that begin with it: all its lengths are keys of a text too."""
    short = said.select("query_id", "pos", "said", F.explode(F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.substring("gram", F.lit(1), n))).alias("gram")).distinct()
    return wanted.withColumn("gram", F.substring("key", 1, GRAM)).join(short, "gram").where(holds).select("expectation_id", "query_id", "pos")


def cases(expectations: DataFrame, results: DataFrame) -> DataFrame:
    """Per expectation (expectation_id, query_id, expected_chunk_ids, expected_document_ids): counts and verdicts.

    Precision divides by retrieved chunks alone, though matches count chunks and documents.
    """
    held = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id"))).alias("rs"),
        F.count("*").alias("retrieved"),
        F.max("strategy").alias("strategy"),
    )
    joined = expectations.join(held, "query_id", "left")
    of = lambda f: F.coalesce(F.transform("rs", lambda r: r[f]), F.array())
    chunk = F.size(F.filter("expected_chunk_ids", lambda c: F.array_contains(of("chunk_id"), c)))
    document = F.size(F.filter("expected_document_ids", lambda d: F.array_contains(of("document_id"), d)))
    first = F.get("rs", F.lit(0))
    top = F.array_contains("expected_chunk_ids", first["chunk_id"]) | F.array_contains("expected_document_ids", first["document_id"])
    found = F.concat(F.array_intersect("expected_chunk_ids", of("chunk_id")), F.array_intersect("expected_document_ids", of("document_id")))
    out = joined.select(
        F.array_sort(found).alias("matched_ids"),
        "expectation_id",
        "query_id",
        F.coalesce("strategy", F.lit("no_results")).alias("strategy"),
        (F.size("expected_chunk_ids") + F.size("expected_document_ids")).cast("bigint").alias("expected"),
        F.coalesce("retrieved", F.lit(0)).cast("bigint").alias("retrieved"),
        (chunk + document).cast("bigint").alias("matched"),
        F.coalesce(top, F.lit(False)).alias("top_1"),
    )
    return out.withColumn("covered", (F.col("expected") > 0) & (F.col("matched") == F.col("expected"))).withColumn(
        "failure_reasons",
        F.array_compact(F.array(
            F.when(F.col("query_id").isNull(), "no_matching_retrieval"),
            F.when((F.col("expected") > 0) & (F.col("retrieved") == 0), "no_retrieved_citation"),
            F.when((F.col("expected") > 0) & (F.col("matched") < F.col("expected")), "expected_citation_not_retrieved"),
            F.when((F.col("retrieved") > 0) & (F.col("matched") < F.col("retrieved")), "unexpected_retrieved_citation"),
        )),
    )


def f1(precision, recall):  # noqa: ANN001, ANN201
    return ratio(2 * precision * recall, precision + recall)


def summary(found: DataFrame, *by: str) -> DataFrame:
    """Micro-averages over cases, one row a group."""
    total = found.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.sum("expected").alias("expected"),
        F.sum("retrieved").alias("retrieved"),
        F.sum("matched").alias("matched"),
        F.count_if("covered").alias("covered"),
        F.count_if("top_1").alias("top_1"),
    )
    total = total.withColumn("recall", ratio(F.col("matched"), F.col("expected"))).withColumn("precision", ratio(F.col("matched"), F.col("retrieved")))
    return total.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("coverage", ratio(F.col("covered"), F.col("cases")))


def best_strategies(summaries: DataFrame) -> DataFrame:
    """best_f1, best_top_1: the strategies (strategy, pos) that lead, earlier ones on ties. One row."""
    late = -F.col("pos")
    return summaries.agg(
        F.max_by("strategy", F.struct("f1", "coverage", "precision", "top_1", late)).alias("best_f1"),
        F.max_by("strategy", F.struct("top_1", "f1", "coverage", "precision", late)).alias("best_top_1"),
    )


def rerank_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Summaries of one row each, side by side, with what reranking changed."""
    measures = ("top_1", "recall", "precision", "f1", "coverage")
    a = before.select(*[F.col(m).alias(f"{m}_before") for m in measures])
    b = after.select(*[F.col(m).alias(f"{m}_after") for m in measures])
    both = a.crossJoin(F.broadcast(b))
    return both.select("*", *[(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta") for m in measures])


def strategy_label(found: DataFrame) -> DataFrame:
    """label: unknown, the only strategy of all cases, or mixed."""
    seen = found.agg(F.array_sort(F.collect_set("strategy")).alias("s"))
    return seen.select(F.when(F.size("s") == 0, "unknown").when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise("mixed").alias("label"))


def ordered_counts(rows: DataFrame, reason: str, pos: str) -> DataFrame:
    """reason, n, first: how often each occurs, in order of first place."""
    return rows.groupBy(reason).agg(F.count("*").alias("n"), F.min(pos).alias("first"))


def ordered_distinct(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Each key once: at its first place, with the values of its last."""
    others = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(F.min(pos).alias("first"), F.max_by(F.struct(*others), F.col(pos)).alias("last"))
    return kept.select(*key, F.col("first").alias(pos), *[F.col(f"last.{c}").alias(c) for c in others if c != pos])


def close_alternatives(ranked: DataFrame, by: str, delta: float = 0.15) -> DataFrame:
    """Results after the first whose score is within a relative delta of it (of 1 at least)."""
    first = F.first_value("score").over(Window.partitionBy(by).orderBy("rank"))
    near = (F.col("best") - F.col("score")) / F.greatest(F.abs("best"), F.lit(1.0)) <= delta
    return ranked.withColumn("best", first).where((F.col("rank") > 1) & near).drop("best")
