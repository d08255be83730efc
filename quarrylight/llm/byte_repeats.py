"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts in a document with a smaller id go.

The corpus is far larger than any memory, so suffixes are dealt to shards by content, and each shard is sorted by external
induced sorting (induced.py). Dealing all suffixes would move LENGTH bytes for each byte; so first

1. each document elects winnowed byte anchors (anchors.py): equal strings elect equal anchors at the same place;
2. occurrences are dealt by anchor, in packed arrays, after a task has dropped those it sees to repeat a smaller id.
   Occurrences with equal spans are copies of one string, and go on as one string with the least id: all windows of the others
   start in a smaller id too;
3. strings of one anchor that agree in what lies before or behind it (17 bytes each, and an equal window holds one of both)
   may have a window in common: those parts of them are dealt to shards by that context, so an anchor that stands in very many
   contexts is split. A shard's suffixes are sorted, runs with a common prefix of LENGTH bytes are grouped, and suffixes whose
   id is not the least of their run are marked;
4. documents meet their marks by the partition they were written from, and the covered bytes are cut.

Nothing is listed in pairs and nothing is collected; a sorting task holds SORT_BUDGET bytes, whatever its shard's size.

Defined results: null and empty texts have no bytes; documents with a null id neither lose bytes nor count as earlier ones;
rows with one id do not count as earlier than each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.anchors import Anchors, elect
from quarrylight.llm.induced import END, Budget, Queue, Symbols, equal_runs, sorted_suffixes
from quarrylight.llm.rows import opened, pressed
from quarrylight.llm.words import Texts, tidy
from quarrylight.tables import partitions_for, written

LENGTH, SEED = 50, 16
CHUNK = 64 << 10
SHARD_MB = 6
FLUSH = 500_000
SORT_BUDGET = 64 << 20
#: Shards of step 2 to one of step 3: what is left to sort is a part of the text.
SEEDS_A_SORT = 3
#: monotonically_increasing_id holds the partition above this bit
ROW_BITS = 33


def byte_anchors(texts: Texts) -> Anchors:
    return elect(texts.bytes.astype(np.uint64) + np.uint64(1), texts.offsets, LENGTH, SEED)


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, without the high planes that are all zero; they compress well."""
    out = [np.array([len(columns[0]), len(columns)], "<i8").tobytes()]
    for x in columns:
        planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)
        used = 8
        while used and not planes[used - 1].any():
            used -= 1
        out += [bytes([used]), planes[:used].tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(data, "<i8", 2)
    at, out = 16, []
    for _ in range(k):
        planes = np.zeros((8, n), np.uint8)
        used = data[at]
        planes[:used] = np.frombuffer(data, np.uint8, used * n, at + 1).reshape(used, n)
        out.append(np.ascontiguousarray(planes.T).view("<i8").reshape(-1))
        at += 1 + used * n
    return out


def _gathered(parts: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpacked, parts), strict=True)]


def _by(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The columns packed apart for each value of the key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    values, at = np.unique(key[order], return_index=True)
    for v, part in zip(values.tolist(), np.split(order, at[1:]), strict=True):
        yield v, packed(*[c[part] for c in columns])


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, to, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(to, pa.int32()), pa.array(data, pa.binary())], names=["kind", "to", "data"])


PARCEL = "kind string, to int, data binary"


def _classes(c, left, right, r, row, i):  # noqa: ANN001, ANN202
    """The columns with classes one behind another, where classes start, each row's class, and each class's least id. Equal spans
    agree in 64 bits of the span and in 32 bits of each context; only if the former ever agree alone is there a longer sort."""
    context = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    order = np.argsort(c)
    if ((np.diff(c[order]) == 0) & (np.diff(context[order]) != 0)).any():
        order = np.lexsort((context, c))
    c, context, left, right, r, row, i = (x[order] for x in (c, context, left, right, r, row, i))
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (context[1:] != context[:-1])
    at = np.flatnonzero(new)
    return c, left, right, r, row, i, at, np.cumsum(new) - 1, np.minimum.reduceat(r, at)


def seeds(rows: DataFrame, shards: int) -> DataFrame:
    """Parcels "seed" for the shard of an anchor (c, left, right, r, row, i) and "whole" for the partition of a row (row, i): an
    occurrence that repeats a smaller id inside this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            shard, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(shard, kind="stable")
            shard, columns = shard[order], [x[order] for x in columns]
            out, later = [], []
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                c, left, right, r, row, i, _, of, least = _classes(*(x[lo:hi] for x in columns))
                first = r == least[of]
                later.append((row[~first], i[~first]))
                out.append(("seed", int(shard[lo]), packed(*(x[first] for x in (c, left, right, r, row, i)))))
            row, i = (np.concatenate(x) for x in zip(*later, strict=True))
            return _batch(out + [("whole", to, d) for to, d in _by(row >> ROW_BITS, row, i)])

        for batch, texts in opened(batches, CHUNK):
            found = byte_anchors(Texts(texts))
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())[found.doc]
            doc = found.doc[known]
            place = np.arange(len(found.doc)) - np.searchsorted(found.doc, found.doc)
            rank, row = ids.fill_null(0).to_numpy()[doc], batch.column("row").to_numpy()[doc]
            left, right, _ = found.contexts(SEED)
            shard = (found.anchor[known] % np.uint64(shards)).astype(np.int32)
            held.append((shard, found.kind[known].view(np.int64), left[known], right[known], rank, row, place[known]))
            size += len(doc)
            if size >= FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    return rows.select("row", "doc_id", "z").mapInArrow(tidy(run), PARCEL)


def _meeting(context: np.ndarray, least: np.ndarray, shards: int) -> np.ndarray:
    """For each class the shard (from 1) where it meets classes of its context with other least ids, or 0."""
    order = np.argsort(context)
    start = np.flatnonzero(np.append(True, np.diff(context[order]) != 0))
    spread = np.minimum.reduceat(least[order], start) < np.maximum.reduceat(least[order], start)
    out = np.zeros(len(context), np.int64)
    out[order] = np.repeat(spread, np.diff(np.append(start, len(order))))
    return out * (context != 0) * (1 + context * 0x9E3779B1 % (1 << 40) // 64 % shards)


def judged(parcels: DataFrame, shards: int, sorts: int) -> DataFrame:
    """From all parcels of `seeds`: "whole" as they were and for what repeats across tasks, and "ask" (row, i, left, right) for
    the least occurrences of classes that share a context with a class of another least id: the shards to meet in, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for batch in batches:
            parts += batch.column("data").to_pylist()
        if not parts:
            return
        _, left, right, r, row, i, at, of, least = _classes(*_gathered(parts))
        parts.clear()
        first = r == least[of]
        yield _batch([("whole", to, d) for to, d in _by(row[~first] >> ROW_BITS, row[~first], i[~first])])
        to_left, to_right = (_meeting(x[at], least, sorts)[of] for x in (left, right))
        ask = first & ((to_left > 0) | (to_right > 0))
        yield _batch([("ask", to, d) for to, d in _by(row[ask] >> ROW_BITS, row[ask], i[ask], to_left[ask], to_right[ask])])

    whole = parcels.where("kind = 'whole'")
    moved = parcels.where("kind = 'seed'").repartitionById(shards, F.col("to")).mapInArrow(tidy(run), PARCEL)
    return whole.union(moved)


def _beside(rows: DataFrame, parcels: DataFrame) -> DataFrame:
    """to, data, row, doc_id, z: each partition that rows were written from, its parcels first, then its rows in order."""
    source = rows.select(F.shiftright("row", ROW_BITS).cast("int").alias("to"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("binary").alias("data"), "row", "doc_id", "z")
    marks = parcels.select("to", "kind", "data", F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("z"))
    n = (rows.agg(F.max(F.shiftright("row", ROW_BITS))).first()[0] or 0) + 1
    return source.union(marks).repartitionById(int(n), F.col("to")).sortWithinPartitions(F.col("row").asc_nulls_first())


class Marks:
    """The parcels of a partition, looked up by row."""

    def __init__(self) -> None:
        self.parts: dict[str, list[bytes]] = {}
        self.columns: dict[str, list[np.ndarray]] | None = None

    def add(self, kind: str, data: bytes) -> None:
        self.parts.setdefault(kind, []).append(data)

    def of(self, kind: str, row: int) -> list[np.ndarray]:
        """The columns behind `row` of this row's marks."""
        if self.columns is None:
            self.columns = {}
            for k, parts in self.parts.items():
                columns = _gathered(parts)
                order = np.argsort(columns[0], kind="stable")
                self.columns[k] = [x[order] for x in columns]
            self.parts = {}
        if kind not in self.columns:
            return []
        found = self.columns[kind]
        lo, hi = np.searchsorted(found[0], [row, row + 1])
        return [x[lo:hi] for x in found[1:]] if hi > lo else []


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Marks, pa.RecordBatch, pa.Array]]:
    marks = Marks()
    for batch in batches:
        is_row = np.asarray(batch.column("row").is_valid())
        n = len(is_row) - int(is_row.sum())
        for kind, data in zip(batch.column("kind").slice(0, n).to_pylist(), batch.column("data").slice(0, n).to_pylist(), strict=True):
            marks.add(kind, data)
        if n < batch.num_rows:
            for part, texts in opened(iter([batch.slice(n)]), CHUNK):
                yield marks, part, texts


def asked_spans(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Parcels "span" for a shard: numbers (r, row, start, size) and the spans' bytes. Windows that reach far before the anchor
    go to the shard of the left context, the others to that of the right one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows_out = []
            for to, spans in out.items():
                numbers = packed(*np.array([s[:4] for s in spans], np.int64).T)
                rows_out.append(("span", to, len(numbers).to_bytes(8, "little") + numbers + b"".join(s[4] for s in spans)))
            out.clear()
            return _batch(rows_out)

        for marks, batch, texts in _with_marks(batches):
            wanted = [marks.of("ask", r) for r in batch.column("row").to_pylist()]
            todo = [d for d, w in enumerate(wanted) if w]
            if not todo:
                continue
            some = texts.take(pa.array(todo))
            t = Texts(some)
            found = byte_anchors(t)
            firsts = np.searchsorted(found.doc, np.arange(t.n))
            ids, row_numbers = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            half = (LENGTH - SEED + 1) // 2
            for k, d in enumerate(todo):
                places, to_left, to_right = wanted[d]
                at = firsts[k] + places
                begin, middle, end = found.first[at], found.at[at] - half, found.last[at]
                for to, start, stop in ((to_left, begin, np.minimum(end, middle)), (to_right, np.maximum(begin, middle + 1), end)):
                    for x in np.flatnonzero(to).tolist():
                        s, e = int(start[x]), int(stop[x]) + LENGTH
                        out.setdefault(int(to[x]) - 1, []).append((ids[d], row_numbers[d], s - int(t.offsets[k]), e - s, t.bytes[s:e].tobytes()))
                        size += e - s
            if size > 8 << 20:
                yield flush()
                size = 0
        if out:
            yield flush()

    return _beside(rows, asks).mapInArrow(tidy(run), PARCEL)


SPAN = np.dtype([("r", "<i8"), ("row", "<i8"), ("start", "<i8"), ("end", "<i8")])


def repeated(spans: Iterator[tuple[np.ndarray, np.ndarray]], budget: Budget, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """row and start of the strings of `length` bytes that a span of a smaller rank holds too.

    spans: pieces of (numbers r, row, start, size as columns; the spans' bytes one behind another). All go through the budget:
    texts and numbers lie on disk where they pass it.
    """
    text, numbers, total = Queue(budget, np.uint8), Queue(budget, SPAN), 0
    for (r, row, start, size), raw in spans:
        x = np.full(len(raw) + len(size), END, np.uint8)
        x[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw  # one END behind each span
        text.append(x)
        n = np.zeros(len(size), SPAN)
        n["r"], n["row"] = r, row
        n["end"] = total + np.cumsum(size + 1) - 1
        n["start"] = start - (n["end"] - size)  # the document's place of a byte less its place in the shard
        total += len(x)
        numbers.append(n)
    if not total:
        return
    symbols, known = Symbols(budget, total, 8), budget.array(numbers.size, SPAN)
    for queue, to in ((text, symbols.data), (numbers, known)):
        at = 0
        for x in queue.chunks():
            to[at : at + len(x)] = x
            at += len(x)
        queue.drop()
    ends = budget.array(len(known), np.int64)
    ends[:] = known["end"]
    for pos, run in equal_runs(sorted_suffixes(symbols, budget, length), length):
        of = np.searchsorted(ends, pos)
        whole = ends[of] - pos >= length
        pos, run, of = pos[whole], run[whole], of[whole]
        if len(pos):
            start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            r = known["r"][of]
            later = r > np.repeat(np.minimum.reduceat(r, start), np.diff(np.append(start, len(r))))
            yield known["row"][of[later]], known["start"][of[later]] + pos[later]


def sorted_shards(spans: DataFrame, shards: int) -> DataFrame:
    """Parcels "window" (row, start) for the partition of a row: strings of LENGTH bytes that a smaller id has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for batch in batches:
                for data in batch.column("data"):
                    held = memoryview(data.as_buffer())
                    n = int.from_bytes(held[:8], "little")
                    yield unpacked(bytes(held[8 : 8 + n])), np.frombuffer(held, np.uint8, offset=8 + n)

        held, size = [], 0
        for found in repeated(pieces(), Budget(SORT_BUDGET)):
            held.append(found)
            size += len(found[0])
            if size >= FLUSH:
                yield _windows(held)
                held, size = [], 0
        if size:
            yield _windows(held)

    return spans.repartitionById(shards, F.col("to")).mapInArrow(tidy(run), PARCEL)


def _windows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    row, start = (np.concatenate(x) for x in zip(*held, strict=True))
    return _batch([("window", to, d) for to, d in _by(row >> ROW_BITS, row, start)])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", SPANS),
        T.StructField("kept", T.BinaryType()),
    ]
)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (the bytes that stay)."""
    spark = docs.sparkSession
    shards = partitions_for(docs, SHARD_MB)
    sorts = max(spark.sparkContext.defaultParallelism, -(-shards // SEEDS_A_SORT))
    rows = written(pressed(docs).select("row", "doc_id", "z"), "texts")
    marks = written(judged(seeds(rows, shards), shards, sorts), "marks")
    windows = written(sorted_shards(asked_spans(rows, marks.where("kind = 'ask'")), sorts), "windows")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, batch, texts in _with_marks(batches):
            numbers = batch.column("row").to_pylist()
            whole = [found.of("whole", r) for r in numbers]
            todo = [d for d, w in enumerate(whole) if w]
            again = byte_anchors(t := Texts(texts.take(pa.array(todo)))) if todo else None
            n_bytes, n_removed, spans, kept = [], [], [], []
            for d, row in enumerate(numbers):
                data = np.frombuffer(texts[d].as_buffer(), np.uint8) if len(texts[d].as_py()) else np.zeros(0, np.uint8)
                cover = np.zeros(len(data) + 1, np.int64)
                if whole[d]:
                    k = todo.index(d) if len(todo) < 8 else int(np.searchsorted(todo, d))
                    at = np.searchsorted(again.doc, k) + whole[d][0]
                    np.add.at(cover, again.first[at] - t.offsets[k], 1)
                    np.add.at(cover, again.last[at] - t.offsets[k] + LENGTH, -1)
                starts = found.of("window", row)
                if starts:
                    np.add.at(cover, starts[0], 1)
                    np.add.at(cover, starts[0] + LENGTH, -1)
                out = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                edges = np.flatnonzero(out[1:] != out[:-1]).reshape(-1, 2)
                n_bytes.append(len(data))
                n_removed.append(int(out.sum()))
                spans.append([{"start": a, "end": b} for a, b in edges.tolist()])
                kept.append(data[~out[1:-1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(spans, kind),
                    pa.array(kept, pa.binary()),
                ],
                names=RESULT.fieldNames(),
            )

    return _beside(rows, marks.where("kind = 'whole'").union(windows)).mapInArrow(tidy(run), RESULT)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (
  SELECT rid, doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS h
  FROM (SELECT rid, doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100 AND doc_id IS NOT NULL)),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, i FROM win JOIN least USING (h) WHERE doc_id > first),
step AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50, true) AS fresh FROM hit),
run AS (
  SELECT rid, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM step) GROUP BY rid, k),
piece AS (
  SELECT rid, a AS pos, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS lo, a AS hi FROM run
  UNION ALL SELECT d.rid, length(x) // 2, coalesce(e, 0), length(x) // 2 FROM d LEFT JOIN (SELECT rid, max(b) AS e FROM run GROUP BY rid) USING (rid)),
kept AS (SELECT rid, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY pos) AS t FROM piece JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN (SELECT rid, sum(b - a) AS n, count(*) AS spans FROM run GROUP BY rid) USING (rid)
"""
