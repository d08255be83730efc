"""Retrieval: BM25, exact cosine neighbours, reciprocal rank fusion and reranking, as DataFrame plans.

Frames and keys:
  chunks   chunk_id, document_id, chunk_index, topic, text     queries  query_id, query
  vectors  chunk_id, document_id, chunk_index, embedding       results  query_id, chunk_id, ..., rank, score
Scores are ranked at nine places, so that a sum in another order can't change a rank, and ties follow ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import STOP_TOKENS, strip, tokens
from quarrylight.tables import bounded_batches, written

# BM25 and fusion constants.
K1, B = 1.5, 0.75
RRF_K = 60
#: Query vectors go to the tasks up to this many rows; more are dealt in blocks.
BROADCAST_QUERIES = 20_000


def query_text(gap: Column, opportunity: Column, description: Column, signals: Column, terms: Column) -> Column:
    """One query from its parts; empty parts leave their space."""
    spaced = [F.replace(c, F.lit("_"), F.lit(" ")) for c in (gap, opportunity)]
    return strip(F.concat_ws(" ", *spaced, description, signals, terms))


def index_terms(chunks: DataFrame, stop: tuple[str, ...] = STOP_TOKENS) -> DataFrame:
    """chunks with their tokens (of topic and text) and length; a chunk without a topic is its text."""
    words = F.concat(F.replace(F.coalesce("topic", F.lit("")), F.lit("_"), F.lit(" ")), F.lit(" "), F.col("text"))
    return chunks.withColumn("terms", tokens(words, stop)).withColumn("length", F.size("terms"))


def index_stats(chunks: DataFrame, stop: tuple[str, ...] = STOP_TOKENS) -> DataFrame:
    """token, df: chunks that hold it (a repeated chunk counts each time)."""
    found = index_terms(chunks, stop).select(F.explode(F.array_distinct("terms")).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("df"))


_KEYS = ("chunk_id", "document_id", "chunk_index")
#: Tokens and query rows that go to the tasks at once; more queries take another pass over the texts.
QUERY_ROWS = 200_000
#: Queries and chunks whose scores are one matrix product.
QUERY_TILE, CHUNK_TILE = 512, 256
# Fixed value: share of the mean idf that a token in more than half of all chunks gets instead of a negative one.
OKAPI_FLOOR = 0.25


def _matches(chunks: DataFrame, wanted: pa.Array, stop: tuple[str, ...]) -> DataFrame:
    """keys, length, ids, tfs: for each chunk the places in `wanted` of the tokens that it holds, and how often, from one pass over
    the texts without a shuffle; written once."""
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in _KEYS)
    terms = index_terms(chunks, stop).select(*_KEYS, "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("terms")
            lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
            places = pc.index_in(column.flatten(), value_set=wanted)
            hit = np.flatnonzero(np.asarray(places.is_valid()))
            row = np.repeat(np.arange(len(lengths)), lengths)[hit]
            key, tf = np.unique(row * len(wanted) + places.take(pa.array(hit)).to_numpy().astype(np.int64), return_counts=True)
            at = np.searchsorted(key, np.arange(len(lengths) + 1) * len(wanted)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (key % len(wanted), tf)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEYS], pa.array(lengths), *lists], names=[*_KEYS, "length", "ids", "tfs"])

    return written(terms.mapInArrow(run, f"{kinds}, length bigint, ids array<int>, tfs array<int>"), "matches")


class _Best:
    """The k best rows (query_id, keys, score) of each query that a task has met, in the order of `top`: tiles are merged as they come,
    and a task sends k rows a query at most. once: whether rows of the same keys count once, at their best."""

    def __init__(self, k: int, once: bool):
        self.k, self.once, self.held, self.rows, self.limit = k, once, [], 0, 1 << 16

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows > self.limit:
            self.held = self._cut().to_batches()
            self.rows = sum(b.num_rows for b in self.held)
            self.limit = max(1 << 16, 4 * self.rows)

    def _cut(self) -> pa.Table:
        table = pa.Table.from_batches(self.held)
        if self.once:
            table = table.group_by(["query_id", *_KEYS]).aggregate([("score", "max")]).rename_columns({"score_max": "score"}).select(["query_id", *_KEYS, "score"])
        keys = [("query_id", "ascending"), ("score", "descending"), *((c, "ascending") for c in ("document_id", "chunk_index", "chunk_id"))]
        table = table.take(pc.sort_indices(table, keys, null_placement="at_start")).combine_chunks()
        query = table.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        nth = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
        return table.filter(pa.array(nth < self.k))

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        yield from self._cut().to_batches() if self.held else ()


def best_pairs(matrix: np.ndarray, weights: np.ndarray, cut: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score above 0 of at least each query's `cut` best rows (all without one) of matrix @ weights.

    The product only picks them: how it adds up depends on what stands beside a row, and the last bit can decide to which ninth place a
    score goes. What is picked is added up again, rounded once, so equal texts have equal scores wherever they are.
    """
    rough = (matrix @ weights).T
    good = rough > 4e-10
    if cut is not None and rough.shape[1] > cut:
        good &= rough >= np.partition(rough, -cut, axis=1)[:, -cut][:, None] - 2e-9
    q, c = np.nonzero(good)
    score = np.zeros(len(q))
    ends = np.searchsorted(q, np.arange(len(rough) + 1))
    for i in np.unique(q).tolist():
        mine, held = slice(ends[i], ends[i + 1]), np.flatnonzero(weights[:, i])
        score[mine] = [math.fsum(x) for x in (matrix[np.ix_(c[mine], held)] * weights[held, i]).tolist()]
    score = np.round(score, 9)
    kept = score > 0
    return q[kept], c[kept], score[kept]


class _Scores:
    """A task's part of BM25: batches of matches to the best chunks for each query."""

    def __init__(self, rows: pa.Table, idf: np.ndarray, mean: float, k: int, once: bool):
        """rows: query_id, id (place of a token), qtf. once: whether a chunk id that occurs twice counts once."""
        codes = rows.column("query_id").combine_chunks().dictionary_encode()
        self.names, self.mean, self.k, self.once, self.size = codes.dictionary, mean, k, once, len(idf)
        query, token, worth = codes.indices.to_numpy(), rows.column("id").to_numpy(), rows.column("qtf").to_numpy() * idf[rows.column("id").to_numpy()]
        order = np.argsort(query, kind="stable")
        self.query, self.token, self.worth = query[order], token[order], worth[order]

    def _tiles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First query, places of tokens and their weights for each QUERY_TILE queries: made where they are used, from sparse rows."""
        for at in range(0, len(self.names), QUERY_TILE):
            mine = slice(*np.searchsorted(self.query, (at, at + QUERY_TILE)))
            local, column = np.unique(self.token[mine], return_inverse=True)
            weights = np.zeros((len(local), min(QUERY_TILE, len(self.names) - at)))
            weights[column, self.query[mine] - at] = self.worth[mine]
            yield at, local, weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(self.k, self.once)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK_TILE):
                for found in self._tile(batch.slice(lo, CHUNK_TILE)):
                    best.add(found)
        yield from best

    def _tile(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, tf = (part.column(c).flatten().to_numpy() for c in ("ids", "tfs"))
        row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(part.column("ids")), np.int64))
        length = part.column("length").to_numpy()[row]
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (self.mean or 1.0)))
        cut = self.k if not self.once or len(pc.unique(part.column("chunk_id"))) == part.num_rows else None
        place = np.full(self.size, -1)
        for at, local, weights in self._tiles():
            place[local] = np.arange(len(local))
            column = place[ids]
            place[local] = -1
            has = column >= 0
            matrix = np.zeros((part.num_rows, len(local)))
            matrix[row[has], column[has]] = weight[has]
            q, c, score = best_pairs(matrix, weights, cut)
            columns = [part.column(x).take(pa.array(c)) for x in _KEYS]
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(at + q)), *columns, pa.array(score)], names=["query_id", *_KEYS, "score"])


def _ranked(chunks: DataFrame, queries: DataFrame, k: int, stop: tuple[str, ...], weigh: Callable[[np.ndarray, int], np.ndarray], once: bool) -> DataFrame:
    """query_id, keys, score: at least the k best chunks of each query. weigh: idf of tokens from their document frequencies and
    the number of chunks."""
    spark = chunks.sparkSession
    bounded_batches(spark)
    asked = queries.select("query_id", F.explode(tokens(F.col("query"), stop)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    asked = written(asked, "asked")
    kinds = {f.name: f.dataType.simpleString() for f in (*chunks.schema.fields, queries.schema["query_id"])}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", *_KEYS)) + ", score double"
    blocks, out = -(-asked.count() // QUERY_ROWS) or 1, None
    for block in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
        wanted = pc.unique(rows.column("token"))
        wanted = wanted.combine_chunks() if isinstance(wanted, pa.ChunkedArray) else wanted
        if not len(wanted):
            continue
        found = _matches(chunks, wanted, stop)
        n, mean = found.agg(F.count("*"), F.avg("length")).first()
        df = np.zeros(len(wanted), np.int64)
        for r in found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect():  # a row a wanted token
            df[r["id"]] = r["n"]
        rows = rows.append_column("id", pc.index_in(rows.column("token"), value_set=wanted))
        hits = found.mapInArrow(_Scores(rows, weigh(df, n), mean or 0.0, k, once), schema)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], schema)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 3, stop: tuple[str, ...] = STOP_TOKENS) -> DataFrame:
    """The k best chunks of each query with a positive score.

    Texts are read once, without a shuffle; a task scores its chunks by matrix products, merges the best of its tiles and sends k rows
    a query at most, so rows that move grow with tasks, not with matches.
    """
    idf = lambda df, n: np.log1p((n - df + 0.5) / (df + 0.5))
    scored = _ranked(chunks, queries, k, stop, idf, once=True)
    best = scored.groupBy("query_id", *_KEYS).agg(F.max("score").alias("score"))
    return top(best, k, "document_id", "chunk_index", "chunk_id").withColumn("strategy", F.lit("bm25_lexical"))


def okapi(chunks: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """BM25 in the Okapi form: idf is the log odds of a token, negative ones are replaced by a share of the mean idf over all
    tokens of the corpus. No stop tokens, a chunk that occurs twice counts twice, scores above 0 only."""
    held: list[float] = []

    def idf(df: np.ndarray, n: int) -> np.ndarray:
        if not held:
            odds = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
            held.append(index_stats(chunks, ()).agg(F.avg(odds)).first()[0] or 0.0)
        odds = np.log(n - df + 0.5) - np.log(df + 0.5)
        return np.where(odds < 0, OKAPI_FLOOR * held[0], odds)

    scored = _ranked(chunks, queries, k, (), idf, once=False)
    return top(scored, k, "document_id", "chunk_index", "chunk_id").withColumn("strategy", F.lit("rank_bm25_lexical"))


def top(scored: DataFrame, k: int, *ties: str, by: str = "query_id", score: str = "score") -> DataFrame:
    """The first k of each group by descending score, then the tie columns."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """The vectors; fails where one has another size."""
    message = F.concat(
        F.lit("embedding_dimension_mismatch:"), F.col("chunk_id").cast("string"),
        F.lit(f":expected_{dimension}:actual_"), F.size("embedding").cast("string"),
    )
    right = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(message))
    return vectors.withColumn("embedding", right)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.0, repeated: bool = False) -> DataFrame:
    """The k vectors of the largest cosine, above `least`, for each query (query_id, embedding): exact.

    Queries are a stated set: at most BROADCAST_QUERIES of them go to the tasks at once, more take another pass over the vectors
    each. A task multiplies matrices batch by batch, merges the best of its batches and sends k rows a query at most, so rows that
    move grow with tasks, not with vectors times queries. Vectors of another size than a query's are not compared
    with it. Set `repeated` if chunk ids can occur twice; then each counts once, at its best, and batches are not cut.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields} | {"query_id": queries.schema["query_id"].dataType.simpleString()}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", *_KEYS)) + ", score double"
    held = vectors.select(*_KEYS, F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
    blocks = -(-asked.count() // BROADCAST_QUERIES) or 1
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        hits = held.mapInArrow(_Neighbours(part.toArrow(), None if repeated else k, least), schema)
        out = hits if out is None else out.unionByName(hits)
    first = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"))
    once = out if not repeated else out.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")
    return top(once, k, "document_id", "chunk_index", "chunk_id").withColumn("strategy", F.lit("vector_similarity"))


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size, the rows of a list column that have it (without nulls) and their vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = np.asarray(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
        whole = ~np.isnan(flat).any(axis=1)
        out[size] = rows[whole], flat[whole]
    return out


class _Neighbours:
    """A task's part of `nearest`: batches of vectors to the queries' best among them."""

    def __init__(self, queries: pa.Table, k: int | None, least: float, undefined: float = 0.0):
        """undefined: what the cosine of a zero vector counts as."""
        self.ids = queries.column("query_id").combine_chunks()
        self.queries, self.k, self.least, self.undefined = _matrices(queries.column("v")), k, least, undefined

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if self.k is None:
            yield from self._found(batches)
            return
        best = _Best(self.k, False)
        for found in self._found(batches):
            best.add(found)
        yield from best

    def _found(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrices(batch.column("v"))
            for size, (q_rows, q) in self.queries.items():
                rows, v = vectors.get(size, (np.zeros(0, np.int64), None))
                for at in range(0, len(q_rows) if len(rows) else 0, QUERY_TILE):
                    qi, vi, score = self._best(q[at : at + QUERY_TILE], v)
                    columns = [batch.column(c).take(pa.array(rows[vi])) for c in _KEYS]
                    yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q_rows[at + qi])), *columns, pa.array(score)], names=["query_id", *_KEYS, "score"])

    def _best(self, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
        score = np.where(norms == 0, self.undefined, np.round((q @ v.T) / np.where(norms == 0, 1.0, norms), 9))
        good = score > self.least
        if self.k is not None and score.shape[1] > self.k:
            good &= score >= np.partition(score, -self.k, axis=1)[:, -self.k][:, None]
        qi, vi = np.nonzero(good)
        return qi, vi, score[qi, vi]


def vector_store(
    vectors: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame, index: dict[str, object], k: int = 3, least: float = 0.0
) -> DataFrame:
    """The k nearest stored vectors of each query: only those whose index fields have the values of `index` (corpus version,
    provider, model, version, dimension, metric), whose chunk and document are stored in the same corpus version, and whose
    similarity is above `least`, before the cut and again at six places after it.

    vectors: corpus_version, chunk_id, the index fields, embedding; chunks: corpus_version, chunk_id, document_id, chunk_index;
    documents: corpus_version, document_id. Filters reach the scans; no vector without a chunk is compared.
    """
    held = vectors
    for field, value in index.items():
        held = held.where(F.col(field) == F.lit(value))
    placed = chunks.where(F.col("corpus_version") == F.lit(index["corpus_version"])).select("chunk_id", "document_id", "chunk_index")
    known = documents.where(F.col("corpus_version") == F.lit(index["corpus_version"])).select("document_id")
    stored = held.select("chunk_id", "embedding").join(placed, "chunk_id").join(known, "document_id", "left_semi")
    found = nearest(stored, queries, k, least).withColumn("score", F.round("score", 6))
    return found.where(F.col("score") > least)


def index_rows(vectors: DataFrame, metadata: dict[str, object]) -> DataFrame:
    """Vectors (chunk_id, embedding) as rows of a vector store: each has the index's six key fields; a vector of another size than
    the stated dimension fails."""
    checked = check_dimension(vectors, int(metadata["dimension"]))
    return checked.select(*[F.lit(v).alias(f) for f, v in metadata.items()], "chunk_id", "embedding")


class Retriever(Protocol):
    """What the workflow asks of a retriever: results (query_id, chunk keys, score, strategy, rank) of queries (query_id, query)."""

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Lexical:
    chunks: DataFrame

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return bm25(self.chunks, queries, k)


@dataclass(frozen=True)
class Okapi:
    chunks: DataFrame

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return okapi(self.chunks, queries, k)


@dataclass(frozen=True)
class Stored:
    """Neighbours in a vector store; `embed` turns a query's text into its vector."""

    vectors: DataFrame
    chunks: DataFrame
    documents: DataFrame
    index: dict[str, object]
    embed: Callable[[Column], Column]
    least: float = 0.0

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        asked = queries.where(F.col("query") != "").select("query_id", self.embed(F.col("query")).alias("embedding"))
        return vector_store(self.vectors, self.chunks, self.documents, asked, self.index, k, self.least)


@dataclass(frozen=True)
class Hybrid:
    """Fusion of any lexical side with any vector side."""

    lexical: Retriever
    vector: Retriever
    pool: tuple[int, int] = (3, 3)
    weights: tuple[float, float] = (1.0, 1.0)
    rrf_k: int = RRF_K

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        sides = self.lexical.retrieve(queries, self.pool[0]), self.vector.retrieve(queries, self.pool[1])
        return fuse(*sides, k, self.rrf_k, self.weights)


# Fixed value: candidates that a reranker sees at least.
LEAST_POOL = 30


def pooled(retriever: Retriever, queries: DataFrame, scores: Callable[[DataFrame], DataFrame], k: int = 3) -> DataFrame:
    """Two stages: a pool of at least LEAST_POOL hybrid candidates, then the k best by other scores."""
    candidates = retriever.retrieve(queries, max(k, LEAST_POOL))
    return rerank(candidates, scores(candidates), k)


def choose_retriever(
    chunks: DataFrame | None, given: Retriever | None = None, vector: Retriever | None = None
) -> Retriever | None:
    """The retriever of a run: a given one, else hybrid where there are texts and vectors, else lexical; none without texts."""
    if given is not None or chunks is None:
        return given
    return Lexical(chunks) if vector is None else Hybrid(Lexical(chunks), vector)


def route(skip: Column, has_results: Column, has_preset: Column, has_retriever: Column) -> Column:
    """Where a startup's retrievals come from: skipped for review, what it has, what was preset, a retriever, or an error."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(skip), "skipped").when(yes(has_results), "kept").when(yes(has_preset), "preset")
        .when(yes(has_retriever), "retrieved").otherwise("missing_knowledge_input")
    )


def routed(queries: DataFrame, kept: DataFrame, preset: DataFrame, retriever: Retriever | None, k: int) -> tuple[DataFrame, DataFrame]:
    """Results of queries (query_id, query, skip) by their route, and errors (query_id, error_type, reason) of those without one.

    kept, preset: results stored for some queries. Only queries that need it go to the retriever.
    """
    has = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True)).hint("merge")
    marked = queries.join(has(kept, "has_kept"), "query_id", "left").join(has(preset, "has_preset"), "query_id", "left")
    marked = marked.withColumn("route", route(F.col("skip"), F.col("has_kept"), F.col("has_preset"), F.lit(retriever is not None)))
    on = lambda name: marked.where(F.col("route") == name).select("query_id", "route").hint("merge")
    out = kept.join(on("kept"), "query_id").unionByName(preset.join(on("preset"), "query_id"), allowMissingColumns=True)
    if retriever is not None:
        found = retriever.retrieve(marked.where("route = 'retrieved'").select("query_id", "query"), k)
        out = out.unionByName(found.withColumn("route", F.lit("retrieved")), allowMissingColumns=True)
    missing = marked.where("route = 'missing_knowledge_input'")
    return out, missing.select("query_id", F.col("route").alias("error_type"), F.lit("retrieval_skipped_missing_corpus_or_fixture").alias("reason"))


def _same(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Both frames; reading the second fails where it has a value in one of the columns that the first has not."""
    for c in columns:
        if c in a.columns and c in b.columns:
            first = a.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))  # one row
            wrong = F.raise_error(F.lit(f"hybrid_{c}_mismatch")).cast("boolean")
            fits = F.col("lo").isNull() | ((F.col("lo") == F.col(c)) & (F.col("hi") == F.col(c)))
            b = b.crossJoin(F.broadcast(first)).where(F.when(~fits, wrong).otherwise(F.lit(True))).drop("lo", "hi")
    return a, b


def fuse(lexical: DataFrame, vector: DataFrame, k: int = 3, rrf_k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (rrf_k + rank) over the sources that found a chunk. Where both sides say of what run or
    corpus version they are, they must agree."""
    lexical, vector = _same(lexical, vector, ("run_id", "corpus_version"))
    keys = ["query_id", "chunk_id", "document_id", "chunk_index"]
    side = lambda df, name: df.select(*keys, F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
    both = side(lexical, "lexical").join(side(vector, "vector"), keys, "full_outer")
    share = lambda name, w: F.coalesce(w / (rrf_k + F.col(f"{name}_rank")), F.lit(0.0))
    both = both.withColumn("score", F.round(share("lexical", F.lit(weights[0])) + share("vector", F.lit(weights[1])), 12))
    return top(both, k, "document_id", "chunk_index", "chunk_id").withColumn("strategy", F.lit("hybrid"))


def rerank(candidates: DataFrame, scores: DataFrame, k: int = 3, by: str = "rerank_score") -> DataFrame:
    """Candidates (of fuse) in the order of other scores (query_id, chunk_id, rerank_score); none can be added.

    original_rank and original_score stay, and the rationale says by what it was reranked; candidates without a score go.
    """
    wrong = F.when(F.col("strategy") != "hybrid", F.raise_error(F.lit("rerank_requires_hybrid_candidates")))
    kept = candidates.where(wrong.isNull()).withColumnRenamed("rank", "original_rank").withColumnRenamed("score", "original_score")
    joined = kept.join(scores, ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "original_rank", "document_id", "chunk_index", "chunk_id")
    why = F.col("rationale") if "rationale" in candidates.columns else F.lit("Found by hybrid retrieval.")
    ranked = joined.withColumn("rationale", F.concat(why, F.lit(f" Reranked by {by}.")))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def invented(candidates: DataFrame, reranked: DataFrame) -> DataFrame:
    """query_id, chunk_id, reason: what a reranker returned that it may not have: an unknown chunk, one twice, or one whose other
    columns (those that both frames have, but ranks and scores) are not the candidate's."""
    extra = reranked.join(candidates, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit("unknown_chunk").alias("reason"))
    twice = reranked.groupBy("query_id", "chunk_id").count().where("count > 1").select("query_id", "chunk_id", F.lit("repeated_chunk").alias("reason"))
    free = {"query_id", "chunk_id", "rank", "score", "rationale", "strategy"}
    both = [c for c in candidates.columns if c in reranked.columns and c not in free]
    if not both:
        return extra.unionByName(twice)
    a = candidates.select("query_id", "chunk_id", F.struct(*both).alias("a"))
    b = reranked.select("query_id", "chunk_id", F.struct(*both).alias("b"))
    other = a.join(b, ["query_id", "chunk_id"]).where(~F.col("a").eqNullSafe(F.col("b"))).select("query_id", "chunk_id", F.lit("changed_chunk").alias("reason"))
    return extra.unionByName(twice).unionByName(other)


def index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """reasons: what makes an index that was built with one metadata row unfit for another, in a fixed order; other columns of
    `before` stay."""
    fields = ("corpus_version", "provider", "model", "version", "dimension", "metric", "chunking_fingerprint")
    a, b = before.alias("a"), after.alias("b")
    found = F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f"{f}_changed")) for f in fields])
    others = [F.col(f"a.{c}") for c in before.columns if c not in fields]
    return a.crossJoin(F.broadcast(b.limit(1))).select(*others, F.array_compact(found).alias("reasons"))


def check_index(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of `before` that fit; a retrieval over an index that does not fails with the reasons."""
    judged = index_changes(before, after)
    wrong = F.raise_error(F.concat(F.lit("embedding_index_incompatible:"), F.array_join("reasons", ",")))
    return judged.where(F.when(F.size("reasons") > 0, wrong.cast("boolean")).otherwise(F.lit(True)))


#: Rows that are hashed together before their hashes are.
HASH_RANGE = 4096


def chunking_fingerprint(chunks: DataFrame) -> DataFrame:
    """sha256 over chunk fields in the corpus's order (column pos, from 0): a tree of hashes, so that no task sees the corpus. Rows
    are hashed, ranges of HASH_RANGE row hashes in order are, and so on to the top."""
    row = F.sha2(F.concat_ws("\0", "chunk_id", "document_id", F.col("chunk_index").cast("string"), "topic", "text"), 256)
    level = chunks.select(F.col("pos").cast("bigint").alias("pos"), row.alias("h"))
    top_row = level.agg(F.max("pos")).first()[0] or 0
    while True:
        up = level.groupBy(F.floor(F.col("pos") / HASH_RANGE).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("hs"))
        level = up.select("pos", F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), ""), 256).alias("h"))
        top_row //= HASH_RANGE
        if not top_row:
            return level.select(F.col("h").alias("fingerprint"))


def official_quality(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, quality: no_results, official or none_official."""
    per = results.groupBy("query_id").agg(F.bool_or("is_official").alias("official"))
    state = F.when(F.col("official").isNull(), "no_results").when(F.col("official"), "official").otherwise("none_official")
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", state.alias("quality"))
