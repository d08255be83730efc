"""Vector code compression: product codes of integer vectors, with codebooks that are the same on every run.

A component x becomes floor(1024 * x). Vectors are cut into equal parts; each part position has a codebook, which starts as
that part of the first vectors by id and is refined by rounds of assignment and componentwise floored means.

Nearest entries are exact. A float32 matrix product screens all entries: each score |c|^2 - 2 x.c comes with an interval
that rounding can't leave (bounds of any order of summation, from the norms of both sides), and an entry stays if its interval
overlaps that of the best. A row with one entry left is settled; the entries left in other rows are evaluated again in int64,
and ties go to the lower index. Errors are always computed in int64. Sums and counts of a round come from each task as one
vector of (parts x entries x (width + 1)) integers, so what moves depends on tasks and codebooks, not on vectors.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped; repeated ids are rows of
their own (the first entries go by id, null ids last, then by components); with fewer vectors than entries the codebooks are as short;
vectors shorter than the longest, or whose length is no multiple of the parts, count as if zeros followed; components beyond
+-2**25 after scaling (less for vectors of more than 256 components) are held to that, so that no error leaves int64; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import tallies
from quarrylight.llm.words import tidy
from quarrylight.tables import bounded_batches, written

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
HELD = 25
#: Unit roundoff of float32.
UNIT = 2.0**-24
#: Rows that are screened together, and candidate components evaluated together in int64.
ROWS, EXACT = 1024, 1 << 20


@dataclass
class Books:
    """Codebooks: int64 entries[part, entry, position]."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def screened(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of every entry that may be nearest: its interval of scores overlaps that of the row's best."""
    squares = (book * book).sum(axis=1)
    scores = x.astype(np.float32) @ book.astype(np.float32).T
    scores *= np.float32(-2)
    scores += squares.astype(np.float32)
    # The product: m + 2 roundings (both conversions, m products and sums) of terms whose sizes add up to |x||c| at most. The norm's
    # conversion and the last sum: one rounding each of |c|^2 and of the score. 1e-6 covers float64's own roundings here.
    m = x.shape[1] + 2
    gamma = m * UNIT / (1 - m * UNIT)
    longest = np.sqrt(float(squares.max()))
    reach = 2 * np.sqrt((x * x).sum(axis=1).astype(np.float64)) * longest
    width = (reach * (gamma + 2 * UNIT) + 3 * UNIT * longest**2) * (1 + 1e-6)
    limit = scores.min(axis=1).astype(np.float64) + 2 * width
    return np.nonzero(scores <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None])


def distances(x: np.ndarray, rows: np.ndarray, book: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs, some at a time."""
    out, step = np.empty(len(rows), np.int64), max(1, EXACT // max(1, x.shape[1]))
    for at in range(0, len(rows), step):
        d = x[rows[at : at + step]] - book[entries[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index. x, book: int64."""
    index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        rows, entries = screened(part, book)
        firsts = np.flatnonzero(np.diff(rows, prepend=-1))  # rows are in order, and each has one entry at least
        many = np.diff(firsts, append=len(rows)) > 1
        chosen = entries[firsts]
        if many.any():
            open_ = many[rows]
            r, e = rows[open_], entries[open_]
            d = distances(part, r, book, e)
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            best = np.minimum.reduceat(d, starts)
            best = np.repeat(best, np.diff(starts, append=len(r)))
            chosen[many] = np.minimum.reduceat(np.where(d == best, e, len(book)), starts)
        index[at : at + ROWS] = chosen
        error[at : at + ROWS] = distances(part, np.arange(len(part)), book, chosen)
    return index, error


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as (rows, dim), short rows filled with zeros."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - at] = flat
    return out


def parts_of(column: pa.Array, books: np.ndarray) -> Iterator[np.ndarray]:
    n, _, width = books.shape
    x = matrix(column, n * width)
    for p in range(n):
        yield np.ascontiguousarray(x[:, p * width : (p + 1) * width])


def integers(vectors: DataFrame, vector: str, vec_id: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """The kept rows (vec_id, label, v as integers), written once; and the width of a part."""
    kept = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    kept = kept.where("x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    longest = kept.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
    width = max(1, -(-longest // parts))
    most = float(1 << min(HELD, (60 - (width * parts - 1).bit_length()) // 2 - 1))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(most)), F.lit(-most))).cast("int"))
    return written(kept.select("vec_id", "label", whole.alias("v")), "vector-integers"), width


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    firsts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # `entries` rows at most
    x = matrix(pa.array([r["v"] for r in firsts], pa.list_(pa.int32())), parts * width) if firsts else np.zeros((0, parts * width), np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, width).transpose(1, 0, 2))


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to the floored mean of its parts."""
    parts, entries, width = books.shape

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for p, x in enumerate(parts_of(batch.column(0), books)):
                index, _ = nearest(x, books[p])
                order = np.argsort(index, kind="stable")
                found, starts = np.unique(index[order], return_index=True)
                sums[p, found, :width] += np.add.reduceat(x[order], starts) if len(found) else 0
                sums[p, :, width] += np.bincount(index, minlength=entries)
        yield tallies.sent(sums.reshape(-1))

    sums = tallies.total(rows.select("v").mapInArrow(tidy(local), tallies.KIND), parts * entries * (width + 1)).reshape(parts, entries, width + 1)
    counts = sums[..., width:]
    return np.where(counts > 0, sums[..., :width] // np.maximum(counts, 1), books)


def compress(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Books]:
    """vec_id, label, code (array of an entry's index a part), error of every kept row; and the codebooks."""
    if not 1 <= entries <= 1 << 15:
        raise ValueError("entries must be from 1 to 32768")
    bounded_batches(vectors.sparkSession)
    rows, width = integers(vectors, vector, vec_id, label, parts)
    books = first_books(rows, parts, entries, width)
    if not books.shape[1]:
        return vectors.sparkSession.createDataFrame([], f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, code array<int>, error bigint"), Books(books)
    for _ in range(rounds):
        books = refined(rows, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.empty((batch.num_rows, parts), np.int32), np.zeros(batch.num_rows, np.int64)
            for p, x in enumerate(parts_of(batch.column("v"), books)):
                code[:, p], e = nearest(x, books[p])
                error += e
            lists = pa.ListArray.from_arrays(np.arange(0, code.size + 1, parts, dtype=np.int32), code.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, code array<int>, error bigint"
    return rows.mapInArrow(tidy(coded), kind), Books(books)


def coded_rows(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over all rows of the label, nulls together), codebooks_sha256."""
    codes, books = compress(vectors, **how)
    codes = written(codes, "vector-codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    hexed = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", hexed.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def _oracle() -> str:
    """Rounds as materialised steps: parts as rows of components, an entry's distance as a sum over the shared positions."""
    steps = [
        f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (
  SELECT vec_id, (i * {PARTS}) // len(v) AS p, i % (len(v) // {PARTS}) AS k, v[i + 1] AS x
  FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
book0 AS MATERIALIZED (SELECT p, e, k, x AS c FROM comp JOIN first USING (vec_id))"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d
  FROM (SELECT vec_id, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM comp JOIN book{r} USING (p, k) GROUP BY ALL) GROUP BY ALL)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""mean{r} AS (
  SELECT p, e, k, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM near{r} JOIN comp USING (vec_id, p) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT p, e, k, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e, k))"""
            )
    last = f"near{ROUNDS}"
    return (
        ",\n".join(steps)
        + f""",
digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM book{ROUNDS}),
rows AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM rows JOIN kept USING (vec_id), digest
"""
    )


ORACLE_SQL = _oracle()
