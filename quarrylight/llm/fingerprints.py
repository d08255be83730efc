"""Document fingerprints: a canonical exact digest.

The canonical form is NFKC, case-folded, NFKC again, with each run of white space one space and none at the ends. Its
fingerprint is the 128-bit xxhash of its UTF-8 bytes in hex. Inside equal hashes the bytes themselves are compared:
grouping by (hash, bytes) makes one row of each distinct form, pre-aggregated where the rows are, so a text with a third of
all copies is one row a task. Where one hash has several forms, the second and later ones (in byte order) get "-1", "-2",
... after their hash; so fingerprints are equal exactly if canonical forms are.

`deal_with_next` gives each document the next one by id without a global window: ids are cut into ranges, a document goes to
its range, and the first document of a range goes to the range before it as well.

Defined results: null text is empty; null ids come first; equal ids are ordered by their compressed
texts; repeated rows have equal
fingerprints; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.words import tidy
from quarrylight.tables import bounded_batches, partitions_for, written


#: Colliding forms (several texts with one 128-bit hash) that are sent to every task; more would mean a broken hash.
MAX_COLLISIONS = 1000


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = unicodedata.normalize("NFKC", text.casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: an exact digest is alike or not."""
    return float(a == b)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def shared_hashes(forms: DataFrame) -> DataFrame:
    """hash: hashes that more than one canonical form has. forms: hash, form."""
    distinct = forms.groupBy("hash", "form").agg(F.count("*").alias("n"))
    return distinct.groupBy("hash").agg(F.count("*").alias("forms")).where("forms > 1").select("hash")


def _forms(docs: DataFrame) -> DataFrame:
    """hash and canonical form of each text; forms are shipped compressed (equal forms compress equally, others don't)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            forms = [canonical(t.as_py()) for t in batch.column(0)]
            hashes, pressed = [digest(f) for f in forms], [press.compress(f) for f in forms]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(pressed, pa.binary())], names=["hash", "form"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "hash string, form binary")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint: the verified fingerprint of each document."""
    known = verified_suffixes(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            forms = [canonical(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([named(f, known) for f in forms], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(tidy(run), "doc_id bigint, n_chars bigint, fingerprint string")


def verified_suffixes(docs: DataFrame) -> dict[bytes, int]:
    """Form -> suffix for forms that share their hash with an earlier one; empty unless 128-bit hashes collide."""
    spark = docs.sparkSession
    bounded_batches(spark)
    forms = _forms(docs)
    shared = [r["hash"] for r in written(shared_hashes(forms), "shared-hashes").limit(MAX_COLLISIONS + 1).collect()]
    if len(shared) > MAX_COLLISIONS:
        raise RuntimeError(f"more than {MAX_COLLISIONS} collisions of 128-bit hashes")
    if not shared:
        return {}
    found, unpress = {}, zstandard.ZstdDecompressor()
    for row in forms.where(F.col("hash").isin(shared)).groupBy("hash").agg(F.collect_set("form").alias("forms")).collect():
        found |= {form: k for k, form in enumerate(sorted(unpress.decompress(f) for f in row["forms"])) if k}
    return found


def named(form: bytes, known: dict[bytes, int]) -> str:
    suffix = known.get(form) if known else None
    return f"{digest(form)}-{suffix}" if suffix else digest(form)


def deal_with_next(docs: DataFrame, partition_mb: float = 8) -> DataFrame:
    """range, own, doc_id, z: documents in ranges of ids, each range one sorted partition, with its successor behind it.

    A range starts at an id of the table, so the documents of that id go to the range before as well (own false); those of
    the lowest id also go behind the last range. z is the text, compressed. At most one number a partition goes to the driver.
    """
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    n = partitions_for(docs, partition_mb)
    places = [i / n for i in range(1, n)] or [0.5]
    cuts, least, nulls = ids.agg(
        F.percentile_approx("doc_id", places, max(10_000, 20 * n)), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())
    ).first()
    cuts = sorted({c for c in cuts or [] if nulls or c > least})
    lowest, last = (None if nulls else least), len(cuts)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ranges, own, doc_ids, zs = [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = c.compress((text.as_py() or "").encode())
                at = 0 if d is None else bisect.bisect_right(cuts, d)
                to = [(at, True)]
                if at and d == cuts[at - 1]:
                    to.append((at - 1, False))
                if d == lowest:
                    to.append((last, False))
                for r, mine in to:
                    ranges.append(r)
                    own.append(mine)
                    doc_ids.append(d)
                    zs.append(z)
            columns = [pa.array(ranges, pa.int32()), pa.array(own, pa.bool_()), pa.array(doc_ids, pa.int64()), pa.array(zs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "own", "doc_id", "z"])

    dealt = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        press, "range int, own boolean, doc_id bigint, z binary"
    )
    return dealt.repartitionById(last + 1, F.col("range")).sortWithinPartitions(
        "range", F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "z"
    )


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    known = verified_suffixes(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held = None  # the document whose successor has not come yet: range, id, text, fingerprint
        names = [x.split()[0] for x in EDITED.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            rows = []
            for r, own, d, z in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held is None and not own:
                    continue  # a further document of the successor's id
                text = unpress.decompress(z).decode()
                mark = named(canonical(text), known)
                if held is not None:
                    _, d0, text0, mark0 = held
                    changed = edit(text0, text)
                    mark1 = mark0 if changed == text0 else named(canonical(changed), known)
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    rows.append((d0, len(text0), sha, mark0, mark1, likeness(mark0, mark1), likeness(mark0, mark)))
                held = (r, d, text, mark) if own else None
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return deal_with_next(docs).select("range", "own", "doc_id", "z").mapInArrow(tidy(run), EDITED)
