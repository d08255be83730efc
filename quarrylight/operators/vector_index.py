"""A stored vector index: vectors dealt to pivots, with radii, so that a search skips what the triangle inequality rules out.

An index is a folder: `pivots` (unit vectors, fitted on a bounded sample), `metadata`, and generations, each with `vectors` (one folder a
cluster: the vectors nearest to one pivot by angle), `radii` (rows, least and largest angle of each cluster) and `gone` (chunk ids
that this generation replaces or removes). Every vector is indexed; the sample only places the pivots.

Angles are a metric: a vector whose angle to its pivot lies in [near, far] has an angle to a query of at least (query's angle to the pivot)
- far and near - (query's angle to the pivot). The cosine of that bounds the cluster's best score. Each query's nearest clusters are
read first, its k-th score so far is its threshold, and of the other clusters only those are read whose bound reaches it. Zero vectors,
which have no direction, are a cluster of their own with the score 0. Results are those of `retrieval.nearest`.
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

from quarrylight.operators.retrieval import _KEYS, BROADCAST_QUERIES, _Best, _matrices, _Neighbours, check_dimension, check_index, top
from quarrylight.tables import bounded_batches, partitions_for, written

PIVOTS = 64
#: Vectors that the pivots are fitted on, for each pivot, and rounds of the fit.
SAMPLE, FIT = 64, 8
#: Clusters that each query reads before it has a threshold.
FIRST = 2
#: What rounding may do to an angle or a cosine.
SLACK = 1e-7
ZERO = -1
BROADCAST_ROWS = 1_000_000


def units(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots by spherical k-means: each first pivot is the sample's farthest from those before it."""
    x = units(sample)
    x = x[(x != 0).any(axis=1)]
    if not len(x):
        return np.zeros((0, sample.shape[1]))
    chosen, away = [0], angles(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and away.max() > SLACK:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, angles(x, x[chosen[-1:]])[:, 0])
    pivots = x[chosen]
    for _ in range(FIT):
        at = (x @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, at, x)
        means = units(sums)
        pivots = np.where((means != 0).any(axis=1)[:, None], means, pivots)
    return pivots


@dataclass
class VectorIndex:
    """An index at `path`, a folder that executors share. Vectors: chunk_id, document_id, chunk_index, embedding."""

    spark: SparkSession
    path: str

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def generations(self) -> list[int]:
        """Complete ones: `gone`, written last, is there."""
        found, last = [], 0
        while self._exists(f"gen={last}"):
            if self._exists(f"gen={last}/gone/_SUCCESS"):
                found.append(last)
            last += 1
        return found

    def _claimed(self) -> int:
        last = 0
        while self._exists(f"gen={last}"):
            last += 1
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gen={last}/_claimed")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False).close()
        return last

    def pivots(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/pivots").orderBy("pivot").collect()  # at most as many as were asked for
        return np.array([r["v"] for r in rows], np.float64).reshape(len(rows), self.dimension())

    def dimension(self) -> int:
        return int(self.spark.read.parquet(f"{self.path}/metadata").first()["dimension"])

    def build(self, vectors: DataFrame, metadata: dict[str, object], pivots: int = PIVOTS) -> None:
        """Places the pivots and writes the first generation. metadata: as of `retrieval.index_rows`, dimension among it."""
        dimension = int(metadata["dimension"])
        held = written(check_dimension(vectors.where("embedding IS NOT NULL"), dimension).select(*_KEYS, "embedding"), "vectors")
        sample = held.select(F.col("embedding").cast("array<double>").alias("v"), F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(SAMPLE * pivots)
        rows = _matrices(sample.toArrow().column("v")).get(dimension, (None, np.zeros((0, dimension))))[1]
        placed = [(i, p.tolist()) for i, p in enumerate(fitted(rows, pivots))]
        self.spark.createDataFrame(placed, "pivot int, v array<double>").coalesce(1).write.parquet(f"{self.path}/pivots")
        self.spark.createDataFrame([{k: str(v) for k, v in metadata.items()}]).coalesce(1).write.parquet(f"{self.path}/metadata")
        self.upsert(held)

    def upsert(self, vectors: DataFrame, removed: DataFrame | None = None) -> int:
        """Writes a generation of vectors that are new or take the place of those with their chunk id; removed: chunk_id of others
        that go. Generations before it stay as they are."""
        bounded_batches(self.spark)
        at = f"{self.path}/gen={self._claimed()}"
        pivots = self.pivots()
        held = vectors.select(*_KEYS, F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))")

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, angle = np.full(batch.num_rows, ZERO, np.int32), np.zeros(batch.num_rows)
                for rows, x in _matrices(batch.column("v")).values():
                    x = units(x)
                    some = np.flatnonzero((x != 0).any(axis=1))
                    if len(some) and len(pivots):
                        a = angles(x[some], pivots)
                        cluster[rows[some]], angle[rows[some]] = a.argmin(axis=1), a.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle)], names=[*batch.schema.names, "cluster", "angle"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)
        rows = written(held.mapInArrow(dealt, f"{kinds}, cluster int, angle double"), "dealt-vectors")
        # Ranges of (cluster, angle, id): a cluster that holds most rows is several tasks' and files', each a ring around its pivot.
        n = partitions_for(rows, 64)
        rows.repartitionByRange(n, "cluster", "angle", "chunk_id").sortWithinPartitions("cluster", "angle").write.partitionBy("cluster").parquet(f"{at}/vectors")
        rows.limit(0).write.parquet(f"{at}/columns")  # names and types, whatever folders there are
        radii = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
        radii.coalesce(1).write.parquet(f"{at}/radii")
        ids = vectors.select("chunk_id")
        (ids if removed is None else ids.union(removed.select("chunk_id"))).distinct().write.parquet(f"{at}/gone")
        return int(at.rpartition("=")[2])

    def _radii(self, generations: list[int]) -> DataFrame:
        paths = [f"{self.path}/gen={g}/radii" for g in generations]
        return self.spark.read.parquet(*paths).groupBy("cluster").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"))

    def _rows(self, generations: list[int], clusters: list[int]) -> DataFrame:
        """Live vectors of some clusters: other clusters' folders are not read."""
        out = None
        for g in generations:
            columns = self.spark.read.parquet(f"{self.path}/gen={g}/columns").schema
            rows = self.spark.read.schema(columns).parquet(f"{self.path}/gen={g}/vectors").where(F.col("cluster").isin(clusters))
            later = [f"{self.path}/gen={x}/gone" for x in generations if x > g]
            if later:
                gone = self.spark.read.parquet(*later)
                rows = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "chunk_id", "left_anti")
            rows = rows.select("cluster", *_KEYS, "v")
            out = rows if out is None else out.unionByName(rows)
        return out

    def check(self, metadata: dict[str, object]) -> None:
        """Fails, with the reasons, where the index was built with other metadata."""
        mine = self.spark.createDataFrame([{k: str(v) for k, v in metadata.items()}])
        missing = [c for c in ("corpus_version", "provider", "model", "version", "dimension", "metric", "chunking_fingerprint") if c not in mine.columns]
        stored = self.spark.read.parquet(f"{self.path}/metadata")
        for c in missing:
            mine, stored = mine.withColumn(c, F.lit(None).cast("string")), stored.withColumn(c, F.lit(None).cast("string"))
        check_index(stored, mine).collect()  # one row

    def search(self, queries: DataFrame, k: int = 3, least: float = 0.0, report: dict[str, int] | None = None, undefined: float = 0.0) -> DataFrame:
        """The k vectors of the largest cosine above `least` for each query (query_id, embedding), as `retrieval.nearest` of the live
        vectors gives them. report: gets the numbers of pairs of a query and a cluster with rows, and of those that were read.
        undefined: what the cosine of a zero vector counts as; infinite, it comes first, as NaN does in SQL."""
        generations = self.generations()
        if not generations:
            raise ValueError(f"no index at {self.path}")
        bounded_batches(self.spark)
        asked = written(queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL"), "asked")
        blocks, out = -(-asked.count() // BROADCAST_QUERIES) or 1, None
        radii = {r["cluster"]: (r["n"], r["near"], r["far"]) for r in self._radii(generations).collect()}  # a row a cluster
        for block in range(blocks):
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            hits = self._search(part.toArrow(), generations, radii, k, least, report, undefined)
            out = hits if out is None else out.unionByName(hits)
        return top(out, k, "document_id", "chunk_index", "chunk_id").withColumn("strategy", F.lit("vector_similarity"))

    def _search(self, asked: pa.Table, generations: list[int], radii: dict, k: int, least: float, report: dict[str, int] | None, undefined: float) -> DataFrame:  # noqa: ANN001
        pivots, names = self.pivots(), sorted(radii)
        found = _matrices(asked.column("v")).get(pivots.shape[1], (np.zeros(0, np.int64), np.zeros((0, pivots.shape[1]))))
        rows, q = found[0], units(found[1])
        asked = asked.take(pa.array(rows))
        bound = np.full((len(q), len(names)), undefined)  # of the cosine; a zero vector has none on either side
        some = (q != 0).any(axis=1)
        placed = [i for i, c in enumerate(names) if c != ZERO]
        if placed and some.any():
            a = angles(q[some], pivots[[names[i] for i in placed]])
            near, far = (np.array([radii[names[i]][j] for i in placed]) for j in (1, 2))
            at_least = np.clip(np.maximum(a - far, near - a) - SLACK, 0.0, np.pi)
            bound[np.ix_(some, placed)] = np.cos(at_least)
        order = np.argsort(-bound, axis=1, kind="stable")
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order[:, :FIRST], True, axis=1)
        first &= bound + SLACK > least
        early = written(self._scored(asked, names, first, generations, k, least, undefined), "nearest-first")
        ranks = Window.partitionBy("query_id").orderBy(F.desc("score"))
        known = early.withColumn("nth", F.row_number().over(ranks)).where(F.col("nth") == k).select("query_id", "score").toArrow()  # a row a query of the block
        threshold = np.full(len(q), -np.inf)
        at = pc.index_in(asked.column("query_id"), value_set=known.column("query_id").combine_chunks()).to_pylist()
        reached = known.column("score").to_pylist()
        threshold[[i for i, x in enumerate(at) if x is not None]] = [reached[x] for x in at if x is not None]
        more = ~first & (bound + SLACK >= np.maximum(threshold, least)[:, None])
        if report is not None:
            for name, value in {"pairs": bound.size, "pairs_read": int(first.sum() + more.sum())}.items():
                report[name] = report.get(name, 0) + value
        return early.unionByName(self._scored(asked, names, more, generations, k, least, undefined))

    def _scored(self, asked: pa.Table, names: list[int], pairs: np.ndarray, generations: list[int], k: int, least: float, undefined: float) -> DataFrame:
        """query_id, keys, score of the k best for each query among the clusters it is paired with."""
        used = np.flatnonzero(pairs.any(axis=0)).tolist()
        wanted = {names[i]: np.packbits(pairs[:, i]) for i in used}  # a bit a query: vectors of queries go to a task once, not for each cluster
        held = self._rows(generations, list(wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, now, kernel = _Best(k, False), None, None
            for batch in batches:
                clusters = batch.column("cluster").to_numpy()
                for c in np.unique(clusters).tolist():
                    if c != now:  # rows come cluster by cluster; one cluster's queries are held at a time
                        now, kernel = c, None
                        kernel = _Neighbours(asked.take(pa.array(np.flatnonzero(np.unpackbits(wanted[c], count=asked.num_rows)))), k, least, undefined)
                    rows = batch.take(pa.array(np.flatnonzero(clusters == c)))
                    for found in kernel._found([rows]):
                        best.add(found)
            yield from best

        kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
        query = self.spark.createDataFrame(asked.select(["query_id"]).slice(0, 0)).schema["query_id"].dataType.simpleString()
        return held.mapInArrow(run, f"query_id {query}, " + ", ".join(f"{c} {kinds[c]}" for c in _KEYS) + ", score double")
