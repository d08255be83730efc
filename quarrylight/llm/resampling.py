r"""Importance resampling towards a target distribution: hashed n-gram models, scores with Gumbel noise, the best drawn.

Features of a text are its runs of 1 to `longest` consecutive words; a feature's bucket is the crc32 of its bytes modulo `buckets`.
A bucket's gain is the log ratio of the target's and the corpus's smoothed counts, in whole thousandths; a text's weight is
the floored mean of its features' gains, its score the weight plus Gumbel noise that its id gives.

Texts of a batch are one sequence of word ids. Its suffixes are sorted to a depth of `longest` words (a suffix ends with its
text), neighbours' common prefixes are measured, and each stretch of neighbours that share k words is one n-gram with all its
occurrences: it is hashed once, from the hash of its first k - 1 words, and counted by the stretch's length; for scoring, its
bucket is scattered back to the places it starts at. Counts of all tasks are summed block by block; the ranking is a range
sort of small rows, written once, with a running count over its partitions, so no task sees all rows.

Defined results: null and empty texts have no features and weight 0, but a score, and are never drawn if a least number of words is
asked for; null ids count as the empty string in the noise and come last among ties; repeated rows are rows of their own (ties
of equal ids go by features, then weight); an empty table gives no rows; an empty target gives a model of its own, all of
smoothing; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import running, tallies
from quarrylight.llm.words import Texts, chunks, tidy
from quarrylight.tables import bounded_batches, written

BUCKETS, LONGEST = 10_000, 2
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text whose suffixes are sorted together; a longer text stands alone.
TOGETHER = 2 << 20
#: Rows of a partition of the ranking.
RANKED = 1_000_000
#: Bytes of words as they are, all others as spaces.
_LETTERS = np.full(256, 0x20, np.uint8)
for _run in (slice(0x30, 0x3A), slice(0x61, 0x7B), slice(0x80, 0x100)):
    _LETTERS[_run] = np.arange(256, dtype=np.uint8)[_run]


class LetterTexts(Texts):
    """Words are runs of digits, a-z (after A-Z are lower-cased) and anything beyond ASCII."""

    def __init__(self, column: pa.Array):
        super().__init__(column, lower=True)
        self.bytes = _LETTERS[self.bytes]

    def word_ids(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word among the distinct words, and these."""
        kept = self.bytes[self.bytes != 0x20]
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))])
        coded = words.dictionary_encode()
        return np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()


@dataclass
class Suffixes:
    """Suffixes of word ids in order of their first `depth` words. common[j]: words that order[j] shares with order[j - 1];
    room[i]: words from i to its text's end."""

    order: np.ndarray
    common: np.ndarray
    room: np.ndarray


def suffixes(ids: np.ndarray, offsets: np.ndarray, depth: int) -> Suffixes:
    """offsets: where texts begin in ids, and the end. Ranks of k words and the next word's id give the ranks of k + 1."""
    n = len(ids)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    rank, order = ids, np.argsort(ids, kind="stable")
    base = int(ids.max(initial=0)) + 2
    for k in range(1, depth):
        following = np.zeros(n, np.int64)  # 0: the text has ended
        following[: max(n - k, 0)] = ids[k:] + 1
        following[room <= k] = 0
        key = rank * base + following
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
    common = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    going = np.arange(len(a))  # neighbours that have shared every word so far
    for k in range(depth):
        going = going[(room[a[going]] > k) & (room[b[going]] > k)]
        going = going[ids[a[going] + k] == ids[b[going] + k]]
        common[going + 1] = k + 1
    return Suffixes(order, common, room)


def repeated_grams(texts: LetterTexts, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1 to longest: the bucket and the occurrences of each distinct n-gram of k words, and the places of all
    occurrences, those of one n-gram after another."""
    ids, words = texts.word_ids()
    if not len(ids):
        return
    found = suffixes(ids, texts.word_offsets, longest)
    spaced = [b" " + w for w in words]
    crcs = np.empty(len(ids), np.int64)  # of the n-gram that starts at each place, so far
    for k in range(1, longest + 1):
        starts = np.flatnonzero(found.common < k)
        sizes = np.diff(starts, append=len(ids))
        whole = found.room[found.order[starts]] >= k
        firsts = found.order[starts[whole]]
        ends = ids[firsts + k - 1].tolist()
        if k == 1:
            hashed = [zlib.crc32(words[w]) for w in ends]
        else:
            hashed = [zlib.crc32(spaced[w], c) for w, c in zip(ends, crcs[firsts].tolist(), strict=True)]
        hashed = np.array(hashed, np.int64)
        places = found.order[np.repeat(whole, sizes)]
        crcs[places] = np.repeat(hashed, sizes[whole])
        yield hashed % buckets, sizes[whole], places


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Occurrences of features in each bucket, over all rows of (text)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch, 0, TOGETHER):
                for bucket, sizes, _ in repeated_grams(LetterTexts(part.column(0)), longest, buckets):
                    counts += np.bincount(bucket, sizes, buckets).astype(np.int64)
        yield tallies.sent(counts)

    return tallies.total(texts.mapInArrow(tidy(local), tallies.KIND), buckets)


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, bucket by bucket."""
    n = len(corpus)
    all_corpus, all_target = float(corpus.sum() + n), float(target.sum() + n)
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in pairs], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, TOGETHER):
                texts = LetterTexts(part.column(1))
                at = texts.word_offsets
                n_words = np.diff(at)
                n_features = sum(np.maximum(n_words - k, 0) for k in range(longest))
                sums = np.zeros(at[-1] + 1, np.int64)
                for bucket, sizes, places in repeated_grams(texts, longest, len(gains)):
                    sums[places + 1] += np.repeat(gains[bucket], sizes)
                np.cumsum(sums, out=sums)
                weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n_features, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"]
                )

    return docs.mapInArrow(tidy(run), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, a function of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, drawn: int, n: int) -> DataFrame:
    """rows with rank 1, 2, 3... of the `drawn` best by (score, ties to smaller ids), null beyond. n: number of rows."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / RANKED))
    placed = written(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resampling-order"
    )
    part = F.shiftright("place", 33)  # the number of the partition; the rest counts its rows
    starts = running.starts(placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows")), "part", "rows")
    starts = F.broadcast(starts.withColumnRenamed("part", "of"))  # one row for each of `parts` partitions at most
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(starts, part == F.col("of")).withColumn("rank", F.when(rank <= drawn, rank)).drop("place", "of", "start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document: of those with min_words words at least, `percent` of a
    hundred are drawn towards the texts of `target`, and have a rank."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = gains_of(bucket_counts(texts.select("text"), longest, buckets), bucket_counts(target.select(F.col("text").cast("string").alias("text")), longest, buckets))
    scored = written(weighed(texts, gains, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    enough = F.col("n_words") >= min_words
    n = scored.where(enough).count()
    best = ranked(scored.where(enough), percent * n // 100, n)
    return best.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))


#: crc32 from its definition: a table of 256 from eight steps a value, then a byte at a time over the feature's hex digits.
ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
features AS MATERIALIZED (
  SELECT side, id, w[i] AS f FROM (SELECT side, id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
  UNION ALL
  SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM words)),
counted AS MATERIALIZED (
  SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL),
bytes AS (
  SELECT f, lower(hex(encode(f))) AS h FROM (SELECT DISTINCT f FROM counted)),
bucketed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i:
              16 * (strpos('0123456789abcdef', h[2 * i - 1]) - 1) + strpos('0123456789abcdef', h[2 * i]) - 1)),
            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
placed AS MATERIALIZED (SELECT side, id, bucket, n FROM counted JOIN bucketed USING (f)),
per AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
  FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((sum(s) OVER ()) + 10000) / ((s + 1) * ((sum(t) OVER ()) + 10000))))::BIGINT AS gain FROM per),
sums AS (SELECT id, sum(gain * n)::BIGINT AS gain FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) AS n_features,
         CASE WHEN len(w) = 0 THEN 0 ELSE floor(gain::DOUBLE / (2 * len(w) - 1))::BIGINT END AS weight,
         ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
  FROM (SELECT id AS doc_id, w FROM words WHERE side = 'd') LEFT JOIN sums ON id = doc_id),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
best AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM noisy WHERE n_words >= 20)
SELECT noisy.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM noisy LEFT JOIN best USING (doc_id)
"""
