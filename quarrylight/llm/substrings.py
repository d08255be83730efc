"""Substring dedup by seed and extend: words covered by a window of WINDOW words that occurs anywhere else go.

1. Seeds: each document's winnowed anchors (see anchors.py), joined by hash across documents.
2. Extend: each anchor occurrence is extended both ways to its span, the farthest that windows electing it reach. Occurrences
   with equal spans are maximal repeats in full: all their windows are repeats. They are counted by (anchor, span), combined
   inside a task first, so a passage that a third of all documents share is one row a task.
3. Where one anchor has several spans (the ends of a repeat, edited copies), one occurrence of each span is extended word
   by word: its windows are hashed (128 bits) and counted. Nothing is ever listed in pairs.
4. Documents get their repeated spans and windows by row, and the words these cover are cut.

Defined results: null and empty texts have no words and nothing removed; texts shorter than a window are left as they are;
repeated rows repeat each other, so both lose all windows; an empty table gives no rows; null ids are kept as they are;
extra columns are ignored (`cut` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.anchors import Anchors, elect
from quarrylight.llm.rows import opened, pressed, unpacked
from quarrylight.llm.words import CHUNK_BYTES, Texts, tidy
from quarrylight.tables import made, made_since, remove, written

WINDOW, SEED = 35, 8
FLUSH = 1_000_000


def word_anchors(texts: Texts, length: int = WINDOW, k: int = SEED) -> Anchors:
    return elect(texts.word_hashes(), texts.word_offsets, length, k)


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def seeds(rows: DataFrame, find: Callable[[Texts], Anchors], rank: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """a, c, n, r: anchor, class, occurrences and least `rank` of them, combined inside each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def combined() -> pa.RecordBatch:
            a, c, r = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.lexsort((r, c, a))
            a, c, r = a[order], c[order], r[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate([at, [len(a)]]))
            held.clear()
            return pa.RecordBatch.from_arrays([as_signed(a[at]), as_signed(c[at]), pa.array(n), pa.array(r[at])], names=["a", "c", "n", "r"])

        for batch, texts in opened(batches, limit=limit):
            found = find(Texts(texts))
            ranks = batch.column(0).to_numpy()
            held.append((found.anchor, found.kind, ranks[found.doc]))
            size += len(found.doc)
            if size >= FLUSH:
                yield combined()
                size = 0
        if size:
            yield combined()

    return rows.select(rank, "z").mapInArrow(tidy(run), "a bigint, c bigint, n bigint, r bigint")


def repeated_classes(occurrences: DataFrame) -> DataFrame:
    """a, c, n, r, several: classes that repeat, or whose anchor has several classes.

    Classes are dealt by anchor and class, and anchors with several classes come from partial counts, so an anchor that stands
    in very many contexts is split like any other; the join that brings both together is one that AQE splits where it is skewed.
    """
    by_class = written(occurrences.groupBy("a", "c").agg(F.sum("n").alias("n"), F.min("r").alias("r")), "by-class")
    several = by_class.groupBy("a").agg(F.count("*").alias("classes")).where("classes > 1").select("a", F.lit(True).alias("several"))
    found = by_class.join(several.hint("merge"), "a", "left").where("n > 1 OR several")
    return found.select("a", "c", "n", "r", F.coalesce("several", F.lit(False)).alias("several"))


def matching(found: Anchors, wanted: list[dict], doc: int) -> np.ndarray:
    """Indices of a document's occurrences whose (anchor, class) is wanted."""
    lo, hi = np.searchsorted(found.doc, [doc, doc + 1])
    keys = {(w["a"], w["c"]) for w in wanted}
    a, c = found.anchor[lo:hi].view(np.int64).tolist(), found.kind[lo:hi].view(np.int64).tolist()
    return np.array([lo + i for i, pair in enumerate(zip(a, c, strict=True)) if pair in keys], np.int64)


def unclear_windows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """w1, w2, row, start, alone: windows of one occurrence of each class whose anchor has several classes."""
    wanted = (
        classes.where("several")
        .groupBy(F.col("r").alias("row"))
        .agg(F.collect_list(F.struct("a", "c", (F.col("n") == 1).alias("alone"))).alias("wanted"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in opened(batches):
            t = Texts(texts)
            found = word_anchors(t)
            which, alone = [], []
            for d, wants in enumerate(batch.column("wanted").to_pylist()):
                todo = {(w["a"], w["c"]): w["alone"] for w in wants}
                for i in matching(found, wants, d).tolist():
                    single = todo.pop((int(found.anchor[i].view(np.int64)), int(found.kind[i].view(np.int64))), None)
                    if single is not None:  # one occurrence of each class
                        which.append(i)
                        alone.append(single)
            which = np.array(which, np.int64)
            starts, of = found.starts_of(which)
            w1, w2 = found.window_hashes(starts)
            doc = found.doc[of]
            yield pa.RecordBatch.from_arrays(
                [
                    as_signed(w1),
                    as_signed(w2),
                    pa.array(batch.column("row").to_numpy()[doc]),
                    pa.array(starts - t.word_offsets[doc]),
                    pa.array(np.repeat(np.array(alone, bool), found.last[which] - found.first[which] + 1)),
                ],
                names=["w1", "w2", "row", "start", "alone"],
            )

    joined = rows.join(wanted, "row").select("row", "z", "wanted")
    return joined.mapInArrow(tidy(run), "w1 bigint, w2 bigint, row bigint, start bigint, alone boolean")


def repeats_by_row(rows: DataFrame) -> DataFrame:
    """row, spans (array of a, c), starts (array): what repeats in each document that has a repeat."""
    spark = rows.sparkSession
    others = made()
    classes = written(repeated_classes(seeds(rows, word_anchors, "row")), "classes")
    windows = written(unclear_windows(rows, classes), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    starts = windows.where("alone").join(twice, ["w1", "w2"]).groupBy("row").agg(F.collect_list("start").alias("starts"))
    in_rows = seeds_by_row(rows).join(classes.where("n > 1").select("a", "c"), ["a", "c"])
    spans = in_rows.groupBy("row").agg(F.collect_list(F.struct("a", "c")).alias("spans"))
    done = made_since(others)
    out = written(spans.join(starts, "row", "full_outer"), "repeats")
    remove(done)
    return out


def seeds_by_row(rows: DataFrame) -> DataFrame:
    """a, c, row: each document's classes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in opened(batches):
            found = word_anchors(Texts(texts))
            order = np.lexsort((found.kind, found.anchor, found.doc))
            a, c, d = found.anchor[order], found.kind[order], found.doc[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
            yield pa.RecordBatch.from_arrays(
                [as_signed(a[new]), as_signed(c[new]), pa.array(batch.column(0).to_numpy()[d[new]])], names=["a", "c", "row"]
            )

    return rows.select("row", "z").mapInArrow(tidy(run), "a bigint, c bigint, row bigint")


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _cut(docs: DataFrame, joined_always: bool) -> DataFrame:
    """rest, n_words, n_removed, spans, text: kept words joined by a space, or the text itself where nothing is removed and
    `joined_always` is not set."""
    rows = written(pressed(docs), "texts")
    found = repeats_by_row(rows)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in opened(batches):
            spans, starts = (batch.column(c).to_pylist() for c in ("spans", "starts"))
            t = Texts(texts)
            anchors = word_anchors(t) if any(spans) else None
            n_words, n_removed, cuts, kept = [], [], [], []
            for d in range(t.n):
                words, runs = texts[d].as_py().split(), []
                if spans[d] or starts[d]:
                    cover = np.zeros(len(words) + 1, np.int64)
                    if spans[d]:
                        which = matching(anchors, spans[d], d)
                        base = t.word_offsets[d]
                        np.add.at(cover, anchors.first[which] - base, 1)
                        np.add.at(cover, anchors.last[which] - base + WINDOW, -1)
                    if starts[d]:
                        np.add.at(cover, np.array(starts[d]), 1)
                        np.add.at(cover, np.array(starts[d]) + WINDOW, -1)
                    out = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                    edges = np.flatnonzero(out[1:] != out[:-1]).reshape(-1, 2).tolist()
                    runs = [{"start": a, "end": b} for a, b in edges]
                    ends = [0, *[x for e in edges for x in e], len(words)]
                    left = [w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b]]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                cuts.append(runs)
                whole = len(left) == len(words) and not joined_always
                kept.append(texts[d].as_py() if whole else b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rest"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(cuts, kind),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["rest", "n_words", "n_removed", "spans", "text"],
            )

    joined = rows.join(found, "row", "left").select("rest", "z", "spans", "starts")
    counts = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    out = [joined.schema["rest"], *counts, T.StructField("spans", SPANS), T.StructField("text", T.StringType())]
    return joined.mapInArrow(tidy(run), T.StructType(out))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed runs of words), kept_text (kept words joined by one space)."""
    return _cut(docs, joined_always=True).select(
        F.col("rest.doc.doc_id").cast("bigint").alias("doc_id"), "n_words", "n_removed", "spans", F.col("text").alias("kept_text")
    )


def cut(docs: DataFrame) -> DataFrame:
    """The documents with repeats cut out of their texts (n_chars follows); one that loses all its words goes.

    A text that loses nothing stays as it is; another is its kept words joined by one space.
    """
    found = _cut(docs, joined_always=False).where("n_removed = 0 OR n_removed < n_words")
    out = unpacked(found, docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT rid, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
step AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 35, true) AS fresh FROM hit),
run AS (
  SELECT rid, min(i) AS a, max(i) + 35 AS b
  FROM (SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM step) GROUP BY rid, k),
piece AS (
  SELECT rid, a AS pos, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 1) AS lo, a AS hi FROM run
  UNION ALL SELECT d.rid, len(w) + 1, coalesce(e, 1), len(w) + 1 FROM d LEFT JOIN (SELECT rid, max(b) AS e FROM run GROUP BY rid) USING (rid)),
kept AS (
  SELECT rid, string_agg(array_to_string(w[lo:hi - 1], ' '), ' ' ORDER BY pos) FILTER (WHERE hi > lo) AS t FROM piece JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN (SELECT rid, sum(b - a) AS n FROM run GROUP BY rid) USING (rid)
"""
