"""Quality classifier by importance resampling with hashed n-gram models.

Two generative bag-of-n-grams models are counted: of target text (a bounded sample of labelled good documents) and of the
raw text (all documents). n-grams are byte triples and words, each hashed to 65,536 buckets. A document's log ratio is the
mean over its n-grams of log p_target - log p_raw, its log weight that times EFFECTIVE: as if each document had as many
n-grams, so that length alone neither keeps nor rejects. Adding Gumbel noise (a function of seed and id) and keeping the k
largest keys draws k documents without replacement, in proportion to their weights.

k is the number of documents whose weight reaches a threshold set on labelled documents that the target model has not
seen, unless a share is given. The k-th key is found by narrowing to ever finer slots of key values: a few grouped counts, no sort.

Defined results: null and empty texts have no n-grams and weight 0; repeated rows get equal keys and share their fate; if
no labelled good document is found every document is kept with weight 0; if the labelled documents held out for the threshold
are all good, all bad or none, nothing tells what a cut would cost, and every document is kept (a share still draws); an
empty table gives no rows. A document labelled more than once counts by its lowest label. Extra columns are ignored by `score`; `keep` returns the input's columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.words import Texts, chunks, tidy
from quarrylight.tables import bounded_batches, written

#: Labelled documents used at most; half of the good ones fit the target model, the rest set the threshold.
MAX_LABELLED = 6000
#: n-grams that count in a log weight, whatever the document's length.
EFFECTIVE = 100
BITS = 16
BLOCK = 2048
SEED = 8


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte triple at each byte (those that reach over a text's end are for the caller to leave out), and
    the bucket of each word."""
    b = texts.bytes.astype(np.uint32)
    triple = np.zeros(len(b), np.uint32)
    if len(b) > 2:
        triple[:-2] = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return triple, (texts.word_hashes() >> np.uint64(64 - BITS)).astype(np.uint32)


def counts_of(texts: Texts) -> np.ndarray:
    triple, word = grams(texts)
    whole = np.ones(len(triple), bool)
    for back in (1, 2):
        at = texts.offsets[1:] - back
        whole[at[at >= 0]] = False
    return np.concatenate([np.bincount(triple[whole], minlength=1 << BITS), np.bincount(word, minlength=1 << BITS)])


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """n-gram counts of all texts: each task sends its counts in blocks, each block is summed as a stream by one task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << BITS, np.int64)
        for batch in batches:
            for part in chunks(batch, 0):
                total += counts_of(Texts(part.column(0)))
        rows = total.reshape(-1, BLOCK)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([rows[i].tobytes() for i in used], pa.binary())],
            names=["block", "counts"],
        )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())],
            names=["block", "counts"],
        )

    kind = "block int, counts binary"
    sums = docs.select(F.col("text").cast("string")).mapInArrow(tidy(local), kind).repartition("block").mapInArrow(tidy(summed), kind)
    out = np.zeros((2 << BITS) // BLOCK * BLOCK, np.int64).reshape(-1, BLOCK)
    for row in sums.collect():  # at most 64 rows of 16 KB, whatever the corpus
        out[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    both = counts.reshape(2, -1) + 1.0
    return np.log(both / both.sum(axis=1, keepdims=True)).reshape(-1)


@dataclass
class Model:
    weights: np.ndarray  # log p_target - log p_raw of each bucket: triples, then words
    threshold: float


def weigh(texts: Texts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and log weight of each text."""
    triple, word = grams(texts)
    sums = np.concatenate([[0.0], np.cumsum(weights[triple], dtype=np.float64)])
    lo, hi = texts.offsets[:-1], np.maximum(texts.offsets[1:] - 2, texts.offsets[:-1])
    by_word = np.concatenate([[0.0], np.cumsum(weights[(1 << BITS) + word], dtype=np.float64)])
    at = texts.word_offsets
    n = hi - lo + np.diff(at)
    total = sums[hi] - sums[lo] + by_word[at[1:]] - by_word[at[:-1]]
    return n, EFFECTIVE * total / np.maximum(n, 1)


def _weights(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight."""
    held = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                n, w = weigh(Texts(part.column(1)), held)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array(np.round(w, 6))], names=["doc_id", "n_grams", "log_weight"]
                )

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(tidy(run), "doc_id bigint, n_grams bigint, log_weight double")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """doc_id, text, good, fits: at most `rows` labelled documents, chosen by a hash of the id."""
    lot = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.min("quality") > 0).alias("good"))
        .withColumn("lot", lot)
        .orderBy("lot")
        .limit(rows)
        .withColumn("fits", F.col("good") & (F.col("lot") % 2 == 0))
        .select(F.col("doc_id").alias("l_id"), "good", "fits")
    )
    # `rows` bounds the side that is broadcast
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("l_id")
    ).drop("l_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_LABELLED, seed: int = SEED) -> Model | None:
    sample = written(labelled_sample(docs, labels, rows, seed), "labelled")
    target = corpus_counts(sample.where("fits"))
    if not target.sum():
        return None
    raw = corpus_counts(docs)
    weights = log_probabilities(target) - log_probabilities(raw)
    held = sample.where("NOT fits").select("doc_id", "good").dropDuplicates(["doc_id"])
    scored = _weights(sample.where("NOT fits"), weights).join(F.broadcast(held), "doc_id").select("log_weight", "good").collect()
    return Model(weights, best_threshold([r[0] for r in scored if r[1]], [r[0] for r in scored if not r[1]]))


def best_threshold(good: list[float], bad: list[float], loss_of_good: float = 20.0) -> float:
    """The cut with the least cost of rejected good and kept bad documents; halfway in the gap where the least is.
    Without documents of both kinds there is no cut: all are kept."""
    if not bad or not good:
        return -math.inf
    cuts = sorted({*good, *bad})
    cuts = [cuts[0] - 1.0, *cuts, cuts[-1] + 1.0]
    good_a, bad_a = np.sort(good), np.sort(bad)
    cost = [loss_of_good * np.searchsorted(good_a, c) / len(good) + 1 - np.searchsorted(bad_a, c) / len(bad) for c in cuts]
    at = int(np.argmin(cost))
    return (cuts[at] + cuts[max(at - 1, 0)]) / 2


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column by narrowing: 4096 equal slots a pass, one grouped count each, no sort."""
    rows = values.select(F.col(column).alias("v"))
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return None
    slots = 4096
    while True:
        if lo == hi:
            return lo
        width = (hi - lo) / slots
        slot = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(slots - 1)).cast("int")
        inside = rows.where((F.col("v") >= lo) & (F.col("v") <= hi))
        found = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["slot"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
        else:
            return min(r["lo"] for r in found)


@dataclass
class Draw:
    """What decides about a document: the model, the seed of the noise, and the k-th largest key (None keeps none)."""

    model: Model
    seed: int
    cut: float | None

    def key(self, weight: str) -> Column:
        lot = F.pmod(F.xxhash64(F.lit(self.seed), F.lit("gumbel"), F.col("doc_id")), F.lit(1 << 40))
        return F.col(weight) - F.log(-F.log((lot.cast("double") + 0.5) / float(1 << 40)))

    def kept(self, key: Column) -> Column:
        return F.lit(False) if self.cut is None else key >= F.lit(self.cut)


def draw(docs: DataFrame, labels: DataFrame, share: float | None, rows: int, seed: int) -> tuple[Draw, DataFrame] | None:
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, rows, seed)
    if model is None:
        return None
    out = Draw(model, seed, None)
    scored = written(_weights(docs, model.weights).withColumn("key", out.key("log_weight")), "weights")
    total, reached = scored.agg(F.count("*"), F.count_if(F.col("log_weight") >= F.lit(float(model.threshold)))).first()
    k = reached if share is None else round(share * total)
    out.cut = kth_largest(scored, "key", k) if k else None
    return out, scored


def score(docs: DataFrame, labels: DataFrame, share: float | None = None, rows: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept: one row a document."""
    drawn = draw(docs, labels, share, rows, seed)
    if drawn is None:
        return docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.lit(0).cast("bigint").alias("n_grams"),
            F.lit(0.0).alias("log_weight"),
            F.lit(0.0).alias("key"),
            F.lit(True).alias("kept"),
        )
    out, scored = drawn
    return scored.withColumn("kept", out.kept(F.col("key")))


def keep(docs: DataFrame, labels: DataFrame, share: float | None = None, rows: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, with all their columns. Texts are weighed again where they are, not shuffled."""
    drawn = draw(docs, labels, share, rows, seed)
    if drawn is None:
        return docs
    out, _ = drawn
    weights = out.model.weights.astype(np.float32)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                _, w = weigh(Texts(part.column("text")), weights)
                yield part.drop_columns(["text"]).append_column("weight", pa.array(np.round(w, 6)))

    kind = T.StructType([*source.drop("text").schema.fields, T.StructField("weight", T.DoubleType())])
    return source.mapInArrow(tidy(run), kind).where(out.kept(out.key("weight"))).select("doc.*")
