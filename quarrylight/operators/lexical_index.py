"""A stored BM25 index in Parquet: built once, extended by upserts, searched without reading texts.

Chunks are numbered as they come; SPAN neighbours in number are a span. An index is a folder of generations, each with
  forward   span, place, chunk keys, length, terms and their counts: one row a chunk
  postings  token, span, n, max_tf, min_length; gaps between places, counts, lengths: the chunks of one span that hold a token, in order of tokens
  stats     token, df, by how much this generation changes it; totals the same for chunks and their length
  dead      span, place of chunks of earlier generations that this one replaces
Chunk ids are unique; an upsert in which one repeats is refused. An upsert writes a generation with its own chunks only; the search takes all generations together, so documents found, their
scores and document frequencies are those of an index built at once from what is live. `compact` makes one generation of all.

A search reads the postings' bounds first. A span can give a query no more than the sum, over its tokens, of the weight at the largest
count and the shortest text (which holds whatever the mean length has become). Each query's FIRST spans by bound are scored, the k-th
score so far is its threshold, and of the other spans only those are scored whose bound reaches it. Spans are scored by
themselves, all tokens of a span in one group of at most SPAN chunks, so no token, however frequent, meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import STOP_TOKENS, tokens
from quarrylight.operators.retrieval import _KEYS, K1, QUERY_ROWS, B, best_pairs, index_terms, top
from quarrylight.tables import bounded_batches, partitions_for, written

SPAN_BITS = 9
SPAN = 1 << SPAN_BITS
#: Spans of each query that are scored before it has a threshold.
FIRST = 2
#: Rows that may be broadcast to the scan of the postings; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Queries of a span that are scored by one matrix product.
TILE = 64
#: Bytes of forward rows whose postings are made together, and of a row group of postings.
TOGETHER, ROW_GROUP = 8 << 20, 8 << 20
#: MB of stored rows for each task that sorts postings or scores spans: in memory they are several times that.
TASK_MB = 16
GENERATION = 48


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (span, place, keys, terms in order, length) with each row's distinct terms and their counts."""
    for batch in batches:
        column = batch.column("terms")
        sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
        codes = column.flatten().dictionary_encode()
        base = len(codes.dictionary) or 1
        key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * base + np.asarray(codes.indices, np.int64), return_counts=True)
        at = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * base).astype(np.int32))
        terms = pa.ListArray.from_arrays(at, codes.dictionary.take(pa.array(key % base)))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("span", "place", *_KEYS, "length")], terms, pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))],
            names=["span", "place", *_KEYS, "length", "terms", "tfs"],
        )


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward rows as posting rows, span by span as far as they come together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TOGETHER:
            yield from _postings(held)
            held, size = [], 0
    if held:
        yield from _postings(held)


def _postings(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    if not rows.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.list_value_length(rows.column("terms").combine_chunks()), 0), np.int64)
    row = np.repeat(np.arange(rows.num_rows), sizes)
    codes = rows.column("terms").combine_chunks().flatten().dictionary_encode()
    code, tf = np.asarray(codes.indices, np.int64), rows.column("tfs").combine_chunks().flatten().to_numpy()
    spans, place, length = (rows.column(c).to_numpy()[row] for c in ("span", "place", "length"))
    order = np.lexsort((place, spans, code))
    code, tf, spans, place, length = code[order], tf[order], spans[order], place[order], length[order]
    starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(spans, prepend=-1) != 0))
    if not len(starts):
        return
    gaps = np.diff(place, prepend=0)  # small numbers, which Parquet packs to few bits
    gaps[starts] = place[starts]
    at = pa.array(np.append(starts, len(code)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (gaps, tf, length)]
    yield pa.RecordBatch.from_arrays(
        [
            codes.dictionary.take(pa.array(code[starts])), pa.array(spans[starts]), pa.array(np.diff(starts, append=len(code)).astype(np.int32)),
            pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), pa.array(np.minimum.reduceat(length, starts).astype(np.int64)), *lists,
        ],
        names=["token", "span", "n", "max_tf", "min_length", "gaps", "tfs", "lengths"],
    )


POSTINGS = "token string, span bigint, n int, max_tf int, min_length bigint, gaps array<int>, tfs array<int>, lengths array<int>"


def weight(tf, length, mean: float):  # noqa: ANN001, ANN201 - numbers, arrays or Columns
    """What tf occurrences in a text of some length weigh."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))


@dataclass
class LexicalIndex:
    """An index at `path`, a folder that executors share. stop: tokens that are not indexed."""

    spark: SparkSession
    path: str
    stop: tuple[str, ...] = STOP_TOKENS

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def generations(self) -> list[int]:
        """Those whose totals, written last, are complete; what a writer that died has left is not read."""
        found, last = [], 0
        while self._exists(f"gen={last}"):
            if self._exists(f"gen={last}/totals/_SUCCESS"):
                found.append(last)
            last += 1
        base = [g for g in found if self._exists(f"gen={g}/base/_SUCCESS")]
        return [g for g in found if g >= base[-1]] if base else found

    def _claimed(self) -> int:
        """A new generation's number: the file that claims it is created without overwriting, so one writer has it."""
        last = 0
        while self._exists(f"gen={last}"):
            last += 1
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gen={last}/_claimed")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False).close()
        return last

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.path}/gen={g}/{name}" for g in self.generations()]
        if not paths:
            raise ValueError(f"no index at {self.path}")
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def live(self) -> DataFrame:
        """Forward rows that no later generation has replaced."""
        return self._read("forward").join(self._read("dead"), ["span", "place"], "left_anti")

    def upsert(self, chunks: DataFrame, removed: DataFrame | None = None) -> int:
        """All chunks of some documents, new or in place of what the index has of them; removed: document_id of others that go.
        Returns the generation's number. Of two writers of one generation the later one fails."""
        bounded_batches(self.spark)
        first, gen = not self.generations(), self._claimed()
        at = f"{self.path}/gen={gen}"
        number = F.monotonically_increasing_id()
        rows = index_terms(chunks, self.stop).select(
            (F.lit(gen << GENERATION) + F.shiftright(number, SPAN_BITS)).alias("span"), number.bitwiseAND(SPAN - 1).cast("int").alias("place"), *_KEYS,
            F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).cast("bigint").alias("length"), "terms",
        )
        kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in _KEYS)
        rows.mapInArrow(_counted, f"span bigint, place int, {kinds}, length bigint, terms array<string>, tfs array<int>").write.parquet(f"{at}/forward")
        fresh = self.spark.read.parquet(f"{at}/forward")
        if fresh.groupBy("chunk_id").count().where("count > 1").take(1):
            raise ValueError("chunk ids repeat")
        if first:
            replaced = fresh.limit(0)
        else:
            ids = fresh.select("document_id") if removed is None else fresh.select("document_id").union(removed.select("document_id"))
            replaced = written(self.live().join(ids.distinct(), "document_id", "left_semi").select("span", "place", "length", "terms"), "replaced")
        replaced.select("span", "place").write.parquet(f"{at}/dead")
        self._finish(at, fresh, replaced)
        return gen

    def _finish(self, at: str, fresh: DataFrame, replaced: DataFrame) -> None:
        postings = fresh.select("span", "place", "length", "terms", "tfs").mapInArrow(_inverted, POSTINGS)
        postings = postings.repartitionByRange(partitions_for(fresh, TASK_MB), "token", "span").sortWithinPartitions("token", "span")
        postings.write.option("parquet.block.size", ROW_GROUP).parquet(f"{at}/postings")
        more = self.spark.read.parquet(f"{at}/postings").groupBy("token").agg(F.sum("n").alias("df"))
        less = replaced.select(F.explode("terms").alias("token")).groupBy("token").agg((-F.count("*")).alias("df"))
        more.union(less).groupBy("token").agg(F.sum("df").alias("df")).repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{at}/stats")
        sums = lambda df, sign: df.agg((F.lit(sign) * F.count("*")).alias("chunks"), (F.lit(sign) * F.coalesce(F.sum("length"), F.lit(0))).alias("length"))
        sums(fresh, 1).union(sums(replaced, -1)).agg(F.sum("chunks").alias("chunks"), F.sum("length").alias("length")).write.parquet(f"{at}/totals")

    def compact(self) -> int:
        """One generation of all live rows, which later reads start from."""
        gen = self._claimed()
        at = f"{self.path}/gen={gen}"
        number = F.monotonically_increasing_id()
        rows = self.live().withColumns({"span": F.lit(gen << GENERATION) + F.shiftright(number, SPAN_BITS), "place": number.bitwiseAND(SPAN - 1).cast("int")})
        rows.write.parquet(f"{at}/forward")
        fresh = self.spark.read.parquet(f"{at}/forward")
        fresh.select("span", "place").limit(0).write.parquet(f"{at}/dead")
        fresh.select("span").limit(0).write.parquet(f"{at}/base")
        self._finish(at, fresh, fresh.limit(0))
        return gen

    def search(self, queries: DataFrame, k: int = 3, report: dict[str, int] | None = None) -> DataFrame:
        """The k best chunks of each query (query_id, query) with a positive score, as `retrieval.bm25` of the live texts gives
        them. report: gets the numbers of a query's spans (pairs) and of posting rows, all that hold a wanted token and those scored."""
        asked = queries.select("query_id", F.explode(tokens(F.col("query"), self.stop)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
        totals = self._read("totals").agg(F.sum("chunks").alias("n"), F.sum("length").alias("length")).first()
        n, mean = totals["n"] or 0, (totals["length"] or 0) / (totals["n"] or 1)
        df = self._read("stats").groupBy("token").agg(F.sum("df").alias("df"))
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = written(asked.join(df, "token").where("df > 0").select("query_id", "token", (F.col("qtf") * idf).alias("worth")), "asked")
        blocks, out = -(-asked.count() // QUERY_ROWS) or 1, None
        for block in range(blocks):  # blocks of whole queries: a span's bound needs all tokens of its query
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            hits = self._search(part, mean, k, report)
            out = hits if out is None else out.unionByName(hits)
        return top(out, k, "document_id", "chunk_index", "chunk_id").withColumn("strategy", F.lit("bm25_lexical"))

    def _search(self, asked: DataFrame, mean: float, k: int, report: dict[str, int] | None) -> DataFrame:
        """asked (query_id, token, worth): at most about QUERY_ROWS rows, which may go to every task."""
        rows, arrow = F.broadcast(asked), asked.toArrow()
        held = self._read("postings").join(rows.select("token").distinct(), "token", "left_semi")
        peaks = held.groupBy("token", "span").agg(F.max("max_tf").alias("tf"), F.min("min_length").alias("length"), F.count("*").alias("rows"))
        peaks = written(peaks, "peaks")
        bound = F.sum(F.col("worth") * weight(F.col("tf"), F.col("length"), mean)).alias("bound")
        bounds = written(peaks.join(rows, "token").groupBy("query_id", "span").agg(bound), "bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "span")
        early = written(bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST).select("query_id", "span"), "first-spans")
        first = written(self._scored(early, asked, arrow, mean, k), "first-hits")
        nth = first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("nth") == k)
        rest = bounds.join(early, ["query_id", "span"], "left_anti").join(nth.select("query_id", F.col("score").alias("least")), "query_id", "left")
        late = written(rest.where(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least"))).select("query_id", "span"), "other-spans")
        if report is not None:
            used = early.union(late)
            wanted = peaks.join(rows, "token").join(used, ["query_id", "span"], "left_semi").dropDuplicates(["token", "span"])
            for name, value in {
                "pairs": bounds.count(), "pairs_scored": used.count(),
                "rows": peaks.agg(F.sum("rows")).first()[0] or 0, "rows_scored": wanted.agg(F.sum("rows")).first()[0] or 0,
            }.items():
                report[name] = report.get(name, 0) + value
        hits = first.unionByName(self._scored(late, asked, arrow, mean, k))
        # Only what can still be among the k best is given its keys, which then settle ties.
        ranks = Window.partitionBy("query_id").orderBy(F.desc("score"))
        last = written(hits.withColumn("nth", F.rank().over(ranks)).where(F.col("nth") <= k).drop("nth"), "hits")
        found = self._read("forward").select("span", "place", *_KEYS).join(self._small(last), ["span", "place"])
        return found.select("query_id", *_KEYS, "score")

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def _scored(self, pairs: DataFrame, asked: DataFrame, arrow: pa.Table, mean: float, k: int) -> DataFrame:
        """query_id, span, place, score: of each pair (query_id, span) at least the k best, and what ties with the last."""
        wanted = written(pairs.join(F.broadcast(asked), "query_id").select("token", "span").distinct(), "wanted")
        held = self._read("postings").select("token", "span", "gaps", "tfs", "lengths").join(self._small(wanted), ["token", "span"], "left_semi")
        by_span = pairs.groupBy("span").agg(F.collect_list("query_id").alias("queries"))
        gone = self._read("dead").groupBy("span").agg(F.collect_list("place").alias("gone"))
        by_span = by_span.join(gone, "span", "left").select("span", "queries", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
        kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, span bigint, place int, score double"
        best, n = _Spans(arrow, mean, k), partitions_for(held, TASK_MB)
        held, by_span = held.repartition(n, "span"), by_span.repartition(n, "span")
        return held.groupBy("span").cogroup(by_span.groupBy("span")).applyInArrow(lambda posts, wanted: best(posts, wanted), kind)


class _Spans:
    """A task's part of a search: postings and queries of a span to the queries' best chunks in it."""

    def __init__(self, asked: pa.Table, mean: float, k: int):
        self.asked, self.mean, self.k, self.rows = asked.combine_chunks(), mean, k, None

    def _of(self, queries: pa.Array) -> pa.Table:
        """asked rows of some queries, by a look-up made once a task."""
        if self.rows is None:
            codes = self.asked.column("query_id").combine_chunks() if isinstance(self.asked.column("query_id"), pa.ChunkedArray) else self.asked.column("query_id")
            codes = codes.dictionary_encode()
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            ends = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(codes.dictionary) + 1))
            self.rows = codes.dictionary, order, ends
        names, order, ends = self.rows
        at = pc.index_in(queries, value_set=names).to_numpy()
        return self.asked.take(pa.array(np.concatenate([order[ends[i] : ends[i + 1]] for i in at] or [np.zeros(0, np.int64)])))

    def __call__(self, held: pa.Table, by_span: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and by_span.num_rows:
            queries, gone = (by_span.column(c).combine_chunks().flatten() for c in ("queries", "gone"))
            words = held.column("token").combine_chunks().dictionary_encode()
            sizes = np.asarray(pc.list_value_length(held.column("gaps").combine_chunks()), np.int64)
            gaps, tf, length = (held.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("gaps", "tfs", "lengths"))
            sums = np.cumsum(gaps)
            place = sums - np.repeat(sums[np.cumsum(sizes) - sizes] - gaps[np.cumsum(sizes) - sizes], sizes)
            token = np.repeat(words.indices.to_numpy(), sizes)
            alive = ~np.isin(place, gone.to_numpy(zero_copy_only=False))
            place, token, worth = place[alive], token[alive], weight(tf[alive], length[alive], self.mean)
            places, row = np.unique(place, return_inverse=True)
            span = held.column("span")[0].as_py()
            for at in range(0, len(queries) if len(places) else 0, TILE):
                out += self._tile(queries.slice(at, TILE), words.dictionary, places, row, token, worth, span)
        return pa.Table.from_batches(out, self._schema()) if out else self._schema().empty_table()

    def _tile(self, queries, words, places, row, token, worth, span) -> list[pa.RecordBatch]:  # noqa: ANN001
        mine = self._of(queries)
        t = pc.index_in(mine.column("token"), value_set=words)
        has = np.asarray(t.is_valid())
        t = np.asarray(pc.drop_null(t), np.int64)
        q = np.asarray(pc.index_in(mine.column("query_id"), value_set=queries), np.int64)[has]
        used, column = np.unique(t, return_inverse=True)
        weights = np.zeros((len(used), len(queries)))
        weights[column, q] = mine.column("worth").to_numpy()[has]
        local = np.full(len(words), -1)
        local[used] = np.arange(len(used))
        kept = local[token] >= 0
        matrix = np.zeros((len(places), len(used)))
        matrix[row[kept], local[token[kept]]] = worth[kept]
        qi, ci, score = best_pairs(matrix, weights, self.k)
        columns = [queries.take(pa.array(qi)), pa.array(np.full(len(qi), span, np.int64)), pa.array(places[ci].astype(np.int32)), pa.array(score)]
        return [pa.RecordBatch.from_arrays(columns, schema=self._schema())]

    def _schema(self) -> pa.Schema:
        return pa.schema([("query_id", self.asked.schema.field("query_id").type), ("span", pa.int64()), ("place", pa.int32()), ("score", pa.float64())])
