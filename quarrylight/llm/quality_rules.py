"""Quality rules as a short-circuit cascade.

Base counts are taken for every document. The further rules are costed on a bounded sample: seconds a document and share
rejected; they then run in order of rejection per second, each only on documents that all earlier ones passed. The order
changes the time, never the verdict.

Rules (a document is kept if the base rule and all of these pass):
  symbols     at most one symbol of #*$%&|<> for ten words
  capitals    at most half of the ASCII letters are capitals
  line_copies at most 70 % of lines with a word copy an earlier line
  letters     at least 60 % of words hold a letter or a byte beyond ASCII
  word_length 2 to 16 code points a word on average

Defined results: null and empty texts have no words, zero counts, and fail the base rule; ties and repeated rows are
judged each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.words import Texts, chunks, mixed, tidy, windows, within
from quarrylight.tables import bounded_batches

#: Rows that the cost sample holds at most.
SAMPLE_ROWS = 2000


def _table(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


CONTINUES = _table(lambda b: b & 0xC0 == 0x80)
SPACES = _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
SYMBOLS = _table(lambda b: chr(b) in "#*$%&|<>")
CAPITALS = _table(lambda b: chr(b).isascii() and chr(b).isupper())
LETTERS = _table(lambda b: chr(b).isascii() and chr(b).isalpha())
WORDLIKE = _table(lambda b: b >= 0x80 or chr(b).isalpha())


@dataclass
class Counts:
    """Base counts of a chunk of documents; `texts` gives rules what the counts don't hold."""

    texts: Texts
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)


def repeat_words(texts: Texts, hashes: np.ndarray) -> np.ndarray:
    """For each document, words in 3-word windows that the text has twice or more."""
    at = texts.word_offsets
    ok = within(at, 3, len(hashes))
    doc = np.repeat(np.arange(texts.n, dtype=np.uint64), np.diff(at))
    keys = windows(hashes, 3)
    keys = mixed(keys ^ (doc[: len(keys)] * np.uint64(0x9E3779B97F4A7C15)))
    places = np.flatnonzero(ok)
    keys = keys[places]
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice = places[order[same[1:] | same[:-1]]]
    marked = np.zeros(len(hashes) + 1, np.int64)
    for k in range(3):
        marked[twice + k + 1] = 1
    sums = np.cumsum(marked)
    return sums[at[1:]] - sums[at[:-1]]


def count(texts: Texts) -> Counts:
    n = texts.n
    doc, _, _, line = texts.lines()
    keys = mixed(line ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    firsts = doc[np.unique(keys, return_index=True)[1]]
    n_lines = np.bincount(doc, minlength=n)
    return Counts(
        texts,
        np.diff(texts.word_offsets),
        texts.count(~(CONTINUES | SPACES)),
        texts.count(SYMBOLS),
        n_lines,
        n_lines - np.bincount(firsts, minlength=n),
        repeat_words(texts, texts.word_hashes()),
    )


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _some(texts: Texts, docs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bytes with table[b] in each of some documents only."""
    at = texts.offsets
    return np.array([np.count_nonzero(table[texts.bytes[at[d] : at[d + 1]]]) for d in docs], np.int64)


def _symbols(c: Counts, docs: np.ndarray) -> np.ndarray:
    return 10 * c.n_symbols[docs] <= c.n_words[docs]


def _capitals(c: Counts, docs: np.ndarray) -> np.ndarray:
    return 2 * _some(c.texts, docs, CAPITALS) <= np.maximum(_some(c.texts, docs, LETTERS), 1)


def _line_copies(c: Counts, docs: np.ndarray) -> np.ndarray:
    return _ratio(c.n_dup_lines[docs], c.n_lines[docs]) <= 0.7


def _letters(c: Counts, docs: np.ndarray) -> np.ndarray:
    t, out = c.texts, np.ones(len(docs), bool)
    for k, d in enumerate(docs):
        lo, hi = t.word_offsets[d], t.word_offsets[d + 1]
        if hi > lo:
            base = t.offsets[d]
            sums = np.concatenate([[0], np.cumsum(WORDLIKE[t.bytes[base : t.offsets[d + 1]]])])
            out[k] = np.mean(sums[t.ends[lo:hi] - base] > sums[t.starts[lo:hi] - base]) >= 0.6
    return out


def _word_length(c: Counts, docs: np.ndarray) -> np.ndarray:
    mean = _ratio(c.word_chars[docs], c.n_words[docs])
    return (mean >= 2) & (mean <= 16)


RULES: dict[str, Callable[[Counts, np.ndarray], np.ndarray]] = {
    "symbols": _symbols,
    "capitals": _capitals,
    "line_copies": _line_copies,
    "letters": _letters,
    "word_length": _word_length,
}


def cost_order(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) in the order to run: most rejection per second first.

    The sample is at most `rows` documents: whole texts, from the first rows of a random tenth of the table, measured by one task.
    """
    names = list(RULES)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = np.zeros(len(names)), np.zeros(len(names), np.int64), 0
        for batch in batches:
            for part in chunks(batch, 0):
                c = count(Texts(part.column(0)))
                todo = np.flatnonzero(~c.base_failed)
                n += len(todo)
                for k, name in enumerate(names):
                    began = time.perf_counter()
                    rejected[k] += int((~RULES[name](c, todo)).sum())
                    seconds[k] += time.perf_counter() - began
        columns = [pa.array(names), pa.array(seconds), pa.array(rejected), pa.array(np.full(len(names), n))]
        yield pa.RecordBatch.from_arrays(columns, names=["rule", "seconds", "rejected", "n"])

    sample = docs.select(F.col("text").cast("string").alias("text")).sample(0.1, seed=5).limit(rows)
    totals = sample.mapInArrow(tidy(measured), "rule string, seconds double, rejected bigint, n bigint").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("n"))
    held = {r[0]: (r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in totals.collect()}  # a row a rule; texts stay where they are
    found = [(name, *held.get(name, (0.0, 0.0))) for name in names]
    return sorted(found, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0]))


RESULT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, kept boolean"
)


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Counts and verdict for each document."""
    bounded_batches(docs.sparkSession)
    order = order or [name for name, _, _ in cost_order(docs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                c = count(Texts(part.column(1)))
                left = np.flatnonzero(~c.base_failed)
                for name in order:
                    left = left[RULES[name](c, left)]
                kept = np.zeros(c.texts.n, bool)
                kept[left] = True
                numbers = (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *[pa.array(x.astype(np.int64)) for x in numbers],
                        pa.array(c.base_failed),
                        pa.array(kept),
                    ],
                    names=[x.split()[0] for x in RESULT.split(",")],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), RESULT)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
hit AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY rid),
c AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS capitals, len(regexp_extract_all(t, '[A-Za-z]')) AS letters,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS wordlike
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN again USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 2 * capitals <= greatest(letters, 1)
       AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.7::DOUBLE AND wordlike::DOUBLE / greatest(n_words, 1) >= 0.6::DOUBLE
       AND word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2 AND 16 AS kept
FROM f
"""
