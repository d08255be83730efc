r"""Token ids as binary shards of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id, encoded, and each partition writes one shard file, so shard order is
document order. Files go through Spark's writers (committed once, in any store Spark reaches): each row is a frame of raw
bytes, and a newline ends it.

A shard is a row of frames, little-endian:
  frame      4s "PFR1", u32 bytes that follow the header, u32 number of the frame, u32 ids, u32 blocks
  body       u32 starts[blocks], u32 minima[blocks], u8 widths[blocks], u16 outliers[blocks], then the blocks
  block      1024 values (ids - minimum) of `width` bits in 32 lanes of u32 words, then u16 places and u32 values of outliers
  index      4s "PFRD", u32 bytes that follow, u32 0, u32 0, u32 documents; i64 doc_ids, u8 has_id, i64 ids a document
A block's width is that of the percentile of its values, out of PERCENTILES, that makes block and outlier list smallest.
`starts` gives each block's place in the body, so one block can be read without the rest.
Beside the shards, kind=totals holds a line "documents ids" for each shard.

Defined results: null text is empty (the end id alone); null ids come first; equal ids are ordered by text; an empty
table gives no shards and no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import running
from quarrylight.llm.tokens import encoder, tokenizer_path
from quarrylight.llm.words import tidy
from quarrylight.tables import bounded_batches, fresh_path, partitions_for

BLOCK, LANES = 1024, 32
PERCENTILES = (50, 75, 90, 95, 98, 100)
FRAME_IDS = 1 << 20
HEADER = struct.Struct("<4sIIII")
END_ID = 0


def pack_width(values: np.ndarray, w: int) -> np.ndarray:
    """(k, 1024) values below 2**w to (k, w * 32) words: lane by lane, 32 values of w bits in w words."""
    x = values.reshape(-1, BLOCK // LANES, LANES)
    out = np.zeros((len(x), max(w, 1), LANES), dtype="<u4")
    for r in range(BLOCK // LANES if w else 0):
        word, shift = divmod(r * w, 32)
        out[:, word] |= x[:, r] << np.uint32(shift)
        if shift + w > 32:
            out[:, word + 1] |= x[:, r] >> np.uint32(32 - shift)
    return out[:, :w].reshape(len(x), w * LANES)


def unpack_width(words: np.ndarray, w: int) -> np.ndarray:
    k = len(words)
    out = np.zeros((k, BLOCK // LANES, LANES), dtype="<u4")
    x = words.reshape(k, w, LANES)
    mask = np.uint32((1 << w) - 1)
    for r in range(BLOCK // LANES if w else 0):
        word, shift = divmod(r * w, 32)
        v = x[:, word] >> np.uint32(shift)
        if shift + w > 32:
            v = v | (x[:, word + 1] << np.uint32(32 - shift))
        out[:, r] = v & mask
    return out.reshape(k, BLOCK)


def choose_widths(values: np.ndarray) -> np.ndarray:
    """For each block the bits of the percentile that makes packed values plus outliers (6 bytes each) smallest."""
    ranked = np.sort(values, axis=1)
    places = np.array([max(0, BLOCK * p // 100 - 1) for p in PERCENTILES])
    widths = np.frexp(ranked[:, places].astype(np.float64))[1]
    cost = widths * (BLOCK // 8) + 6 * (BLOCK - 1 - places)
    return widths[np.arange(len(values)), cost.argmin(axis=1)].astype(np.uint8)


def encode_frame(ids: np.ndarray, number: int) -> bytes:
    n = len(ids)
    blocks = np.full(-(-n // BLOCK) * BLOCK, ids[-1] if n else 0, dtype="<u4")
    blocks[:n] = ids
    blocks = blocks.reshape(-1, BLOCK)
    minima = blocks.min(axis=1) if n else np.zeros(0, "<u4")
    values = blocks - minima[:, None]
    widths = choose_widths(values) if n else np.zeros(0, np.uint8)
    over = (values >> widths[:, None].astype("<u4") != 0) & (widths[:, None] < 32)
    outliers = over.sum(axis=1).astype("<u2")
    packed: list[bytes] = [b""] * len(blocks)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        rows = pack_width(values[at] & np.uint32((1 << int(w)) - 1), int(w))
        for k, i in enumerate(at):
            packed[i] = rows[k].tobytes()
    for i in np.flatnonzero(outliers):
        places = np.flatnonzero(over[i])
        packed[i] += places.astype("<u2").tobytes() + values[i, places].tobytes()
    fixed = 11 * len(blocks)
    starts = fixed + np.concatenate([[0], np.cumsum([len(p) for p in packed])])[:-1] if len(blocks) else np.zeros(0)
    body = b"".join(
        [starts.astype("<u4").tobytes(), minima.astype("<u4").tobytes(), widths.tobytes(), outliers.tobytes(), *packed]
    )
    return HEADER.pack(b"PFR1", len(body), number, n, len(blocks)) + body


def decode_frame(body: memoryview, n: int, blocks: int) -> np.ndarray:
    starts = np.frombuffer(body, "<u4", blocks, 0)
    minima = np.frombuffer(body, "<u4", blocks, 4 * blocks)
    widths = np.frombuffer(body, np.uint8, blocks, 8 * blocks)
    outliers = np.frombuffer(body, "<u2", blocks, 9 * blocks)
    out = np.empty((blocks, BLOCK), dtype="<u4")
    for w in np.unique(widths):
        at, size = np.flatnonzero(widths == w), int(w) * LANES
        words = np.empty((len(at), size), dtype="<u4")
        for k, i in enumerate(at):
            words[k] = np.frombuffer(body, "<u4", size, int(starts[i]))
        out[at] = unpack_width(words, int(w))
    for i in np.flatnonzero(outliers):
        at, m = int(starts[i]) + int(widths[i]) * LANES * 4, int(outliers[i])
        out[i, np.frombuffer(body, "<u2", m, at)] = np.frombuffer(body, "<u4", m, at + 2 * m)
    out += minima[:, None]
    return out.reshape(-1)[:n]


def encode_index(doc_ids: list[int | None], counts: list[int]) -> bytes:
    body = b"".join(
        [
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            np.array(counts, "<i8").tobytes(),
        ]
    )
    return HEADER.pack(b"PFRD", len(body), 0, 0, len(doc_ids)) + body


def frames(shard: bytes) -> Iterator[tuple[bytes, int, int, int, memoryview]]:
    """magic, number, ids, blocks, body of each frame of a shard."""
    at, view = 0, memoryview(shard)
    while at < len(view):
        magic, size, number, n, blocks = HEADER.unpack_from(view, at)
        at += HEADER.size
        yield magic, number, n, blocks, view[at : at + size]
        at += size + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, partition_mb: float = 6) -> None:
    """Encode all documents (doc_id, text) and write shards and totals under `path`."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        doc_ids, counts, held, size, number = [], [], [], 0, 0

        def row(kind: str, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([data], pa.binary())], names=["kind", "frame"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                counts.append(len(ids) // 4 + 1)
                held += [ids, end]
                size += counts[-1]
                if size >= FRAME_IDS:
                    flat = np.frombuffer(b"".join(held), "<u4")
                    whole = size // BLOCK * BLOCK
                    yield row("shard", encode_frame(flat[:whole], number))
                    held, size, number = [flat[whole:].tobytes()], size - whole, number + 1
        if doc_ids:
            if size:
                yield row("shard", encode_frame(np.frombuffer(b"".join(held), "<u4"), number))
            yield row("shard", encode_index(doc_ids, counts))
            yield row("totals", f"{len(doc_ids)} {sum(counts)}".encode())

    bounded_batches(docs.sparkSession)
    n = partitions_for(docs, partition_mb)
    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(tidy(shard), "kind string, frame binary")
        .select("kind", F.col("frame").cast("string").alias("value"))
        .write.partitionBy("kind")
        .text(path)
    )


def _part(path: str) -> int:
    """The number in a shard's own file name, whatever the folders above it are called."""
    return int(re.match(r"part-(\d+)", path.rpartition("/")[2])[1])


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards at `path`."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(frames(content.as_buffer()))
                index = next((f for f in found if f[0] == b"PFRD"), None)
                if index is None:
                    continue
                m, body = index[3], index[4]
                ids, has = np.frombuffer(body, "<i8", m), np.frombuffer(body, np.uint8, m, 8 * m)
                counts = np.frombuffer(body, "<i8", m, 9 * m)
                crcs, doc, left, crc = np.zeros(m, np.int64), 0, int(counts[0]), 0
                for _, _, n, blocks, data in sorted((f for f in found if f[0] == b"PFR1"), key=lambda f: f[1]):
                    flat, at = memoryview(decode_frame(data, n, blocks)).cast("B"), 0
                    while at < len(flat):
                        step = min(4 * left, len(flat) - at)
                        crc = zlib.crc32(flat[at : at + step], crc)
                        at, left = at + step, left - step // 4
                        if not left:
                            crcs[doc], doc, crc = crc, doc + 1, 0
                            left = int(counts[doc]) if doc < m else 0
                starts = np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, _part(file), np.int64)),
                        pa.array(ids, mask=has == 0),
                        pa.array(starts),
                        pa.array(counts),
                        pa.array(crcs),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    name = lambda c: F.regexp_extract(c, r"^part-(\d+)", 1).cast("bigint")
    totals = spark.read.text(f"{path}/kind=totals").select(
        name(F.col("_metadata.file_name")).alias("p"), F.split("value", " ")[1].cast("bigint").alias("n")
    )
    totals = running.starts(totals, "p", "n").withColumnRenamed("start", "shard_start")
    read = (
        spark.read.format("binaryFile")
        .load(f"{path}/kind=shard")
        .select("path", "content")
        .mapInArrow(tidy(documents), "part bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )
    lost = F.raise_error(F.concat(F.lit("no total for shard "), F.col("part"))).cast("bigint")
    return read.join(totals, F.col("part") == F.col("p"), "left").select(
        "doc_id", (F.col("start") + F.coalesce("shard_start", lost)).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path())
    if not docs.take(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_tokens(spark, path)
