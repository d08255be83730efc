"""Documents as numbered rows with compressed texts, written once so that every later step sees the same numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.words import CHUNK_BYTES, tidy
from quarrylight.tables import bounded_batches

LEVEL = 3


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, rest: rest.doc is a struct of all columns but the text, whatever their names; rest.present says
    whether the text was not null."""
    bounded_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.struct(F.struct(*others).alias("doc"), F.col("text").isNotNull().alias("present")).alias("rest"),
    )


def pressed(docs: DataFrame) -> DataFrame:
    """row, doc_id, rest, z (the compressed text)."""
    source = numbered(docs).select("row", "doc_id", "rest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield batch.drop_columns(["text"]).append_column("z", compress(batch.column("text"), c))

    kind = T.StructType([*source.drop("text").schema.fields, T.StructField("z", T.BinaryType())])
    return source.mapInArrow(tidy(run), kind)


def compress(texts: pa.Array, c: zstandard.ZstdCompressor) -> pa.Array:
    return pa.array([c.compress((t.as_py() or "").encode()) for t in texts], pa.binary())


def opened(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of batches with a column z, each with its texts, about `limit` bytes at a time."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, at, size = [], 0, 0
        for i, x in enumerate(batch.column("z")):
            texts.append(unpress.decompress(x.as_py()))
            size += len(texts[-1])
            if size >= limit or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at), pa.array(texts, pa.large_binary())
                texts, at, size = [], i + 1, 0


def restored(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows (rest, z) as documents again, with the columns of `like`."""
    source = rows.select("rest", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in opened(batches):
            yield pa.RecordBatch.from_arrays([batch.column("rest"), texts.cast(pa.large_string()).cast(pa.string())], names=["rest", "text"])

    kind = T.StructType([source.schema["rest"], T.StructField("text", T.StringType())])
    return unpacked(source.mapInArrow(tidy(run), kind), like)


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    text = F.when(F.col("rest.present"), F.col("text"))
    return df.select(*[(text if c == "text" else F.col("rest.doc")[c]).alias(c) for c in like.columns])
