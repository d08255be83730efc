"""Packing tokenised documents into sequences: shortest pack first over the length histogram.

Each document's ids are cut every `length` ids; full pieces and rests are the pieces to pack. Only the histogram of piece
lengths (at most `length` rows, whatever the corpus) goes to the driver. There lengths are placed longest first, each
into the shortest packs with room for them, and the counts of pack patterns are updated. A pattern's then own ranges of ranks among the pieces of their length, and pieces find their sequence by rank.

Ranks need no sort and no task that sees all pieces of a length: a piece counts its own length inside its partition, and
the counts of earlier partitions are added.

Defined results: null text is empty (the end id alone); repeated rows are packed as often as they occur; an empty table
gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.llm.tokens import encoder, tokenizer_path
from quarrylight.llm.words import tidy
from quarrylight.tables import bounded_batches, written

SEQUENCE = 1024
END_ID = 0
#: Pattern slots are broadcast up to this many rows (about 40 bytes each); beyond, Spark chooses the join.
BROADCAST_SLOTS = 200_000
PIECES = (
    "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, part int, place bigint"
)


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, piece lengths) for each pattern. counts: pieces by length."""
    by_used: dict[int, list[list]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        used = size if size <= length // 2 else length + 1  # a pack holds at least one piece that is no shorter
        while left:
            while used + size <= length and not by_used.get(used):
                used += 1
            if used + size > length:
                by_used[size].append([left, (size,)])
                break
            pack = by_used[used][-1]
            n = min(left, pack[0])
            pack[0] -= n
            if not pack[0]:
                by_used[used].pop()
            by_used[used + size].append([n, (*pack[1], size)])
            left -= n
    return [(n, pack) for packs in by_used.values() for n, pack in packs]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for each slot of each pattern."""
    out, next_rank, sequence = [], defaultdict(int), 0
    for n, pack in patterns:
        offset = 0
        for size in pack:
            lo = next_rank[size]
            out.append((size, lo, lo + n, sequence, offset))
            next_rank[size], offset = lo + n, offset + size
        sequence += n
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE) -> DataFrame:
    """A row for each piece of each document, with its place among the pieces of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, coded in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1)), strict=True):
                ids = memoryview(b"".join((coded, end)))
                total = len(ids) // 4
                for start in range(0, total, length):
                    size = min(length, total - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    for column, v in zip(rows, (doc_id, start, size, crc, total, part, seen[size]), strict=True):
                        column.append(v)
                    seen[size] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer or tokenizer_path(), length), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(pack_histogram(histogram, length))
    slot = spark.createDataFrame(table, "length int, lo bigint, hi bigint, sequence bigint, offset bigint")
    if len(table) <= BROADCAST_SLOTS:
        slot = F.broadcast(slot)
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("place"))
    ranked, slot = ranked.alias("r"), slot.alias("s")
    found = ranked.join(
        slot,
        (F.col("r.length") == F.col("s.length")) & (F.col("r.rank") >= F.col("s.lo")) & (F.col("r.rank") < F.col("s.hi")),
    )
    return found.select(
        "r.doc_id",
        "r.start",
        F.col("r.length").cast("bigint").alias("length"),
        "r.ids_crc32",
        "r.doc_tokens",
        (F.col("s.sequence") + F.col("r.rank") - F.col("s.lo")).alias("sequence_id"),
        F.col("s.offset").alias("offset"),
    )
