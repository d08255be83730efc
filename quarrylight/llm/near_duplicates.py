"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact verification.

A document's set is its distinct shingles of five words (A-Z in lower case; a shorter text is one shingle). Its sketch is
REGISTERS truncated, exponentially spaced minima: register i is floor(1 - log_B(min of h_i / RATE)) with exponential h_i.
Sketches of sets merge by the maximum of each register.

1. Equal sets (128-bit digest) form classes; a class goes on as one set, so copies cost one row a task.
2. Bands of ROWS registers are bucket keys. A class is paired with the least class of each of its STARS largest buckets.
3. Pairs whose likelihood estimate of the Jaccard similarity (from counts of greater, equal and lesser registers and the
   exact set sizes) is within Z standard errors of the limit are verified on full sets; components of the links follow.
4. Buckets that still hold several components are gone through once more: classes outside the bucket's largest component
   meet those of the bucket whose set sizes allow it, in blocks of bounded size. They are compared by sketch inside the task, and pairs that pass the
   estimate are verified there on full sets, each in the first bucket that both share. Only links that join components come
   out, so a task gives fewer links than it has classes; components follow again.

So no pairs of a group are listed, and no link between classes in a common bucket is lost but by the estimate (Z = 4).
A pair at the limit shares a bucket with probability 1 - (1 - 0.75**ROWS)**BANDS > 1 - 2e-6.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; rows with a
null id are never linked; repeated rows are equal sets of one class; an empty table gives no rows; extra columns ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.graph import components
from quarrylight.llm.rows import LEVEL, compress, numbered, restored
from quarrylight.llm.words import MULTIPLIERS, Texts, chunks, mixed, tidy, windows
from quarrylight.tables import made, made_since, remove, written

SHINGLE, LIMIT = 5, (75, 100)
ROWS, BANDS = 4, 36
REGISTERS = ROWS * BANDS
B, RATE, TOP = 1.001, 20.0, 65_535
Z = 4.0
BLOCK = 1024
#: Buckets of a class whose least class it is paired with at first; the rest of its buckets follow in step 4.
STARS = 6
_DRAW = np.random.default_rng(10)
_FLIPS = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_ODD = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document. `texts` must be lower-cased."""
    hashes, at = texts.word_hashes(), texts.word_offsets
    grams = windows(hashes, SHINGLE)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = hi - lo
        if n >= SHINGLE:
            out.append(np.unique(grams[lo : hi - SHINGLE + 1]))
        elif n:
            out.append(mixed(windows(hashes[lo:hi], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers_of(least: np.ndarray) -> np.ndarray:
    """Registers from the least 64-bit hash values."""
    unit = ((least >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    h = -np.log1p(-unit) / RATE
    return np.clip(np.floor(1.0 - np.log(h) / math.log(B)), 0, TOP).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS for each set; all zeros for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        least = np.empty((len(full), REGISTERS), np.uint64)
        work = np.empty_like(flat)
        for r in range(REGISTERS):
            np.bitwise_xor(flat, _FLIPS[r], out=work)
            np.multiply(work, _ODD[r], out=work)
            least[:, r] = np.minimum.reduceat(work, starts)
        out[full] = registers_of(least)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 48) -> np.ndarray:
    """Likelihood estimate of the Jaccard similarity of pairs of sketches whose set sizes are known."""
    more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    same = a.shape[-1] - more - less
    u = na / (na + nb)
    v = 1.0 - u
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * (B - 1) / B) / math.log(B)
    best, value = np.zeros(len(u)), np.full(len(u), -np.inf)
    for step in range(grid + 1):
        j = top * (step / grid)
        up, down = p(u - v * j), p(v - u * j)
        ll = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
        better = ll > value
        best[better], value[better] = j[better], ll[better]
    return best


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs can reach the limit: by size, and by estimate within Z standard errors."""
    t = LIMIT[0] / LIMIT[1]
    floor = t - Z * math.sqrt(t * (1 - t) / REGISTERS) - 1 / 48
    at = np.flatnonzero(LIMIT[1] * np.minimum(na, nb) >= LIMIT[0] * np.maximum(na, nb))
    # with B near 1 equal registers are about as many as the similarity says: most pairs end here, two errors below
    same = (a[at] == b[at]).sum(axis=1)
    at = at[same >= REGISTERS * (floor - 2 * math.sqrt(t * (1 - t) / REGISTERS))]
    out = np.zeros(len(na), bool)
    out[at] = estimate(a[at], b[at], na[at], nb[at]) >= floor
    return out


def reach_limit(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return LIMIT[1] * both >= LIMIT[0] * (len(x) + len(y) - both)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """row, doc_id, rest, n (set size), d1, d2 (digest of the set), sketch, z (compressed text): written once, for every step."""
    source = numbered(docs).select("row", "doc_id", "rest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in chunks(batch, 3):
                texts = Texts(part.column("text"), lower=True)
                sets = shingle_sets(texts)
                out = part.drop_columns(["text"]).append_column("n", pa.array([len(s) for s in sets], pa.int64()))
                for name, m in zip(("d1", "d2"), MULTIPLIERS, strict=True):
                    sums = [mixed(s * np.uint64(m)).sum(dtype=np.uint64) if len(s) else 0 for s in sets]
                    out = out.append_column(name, pa.array(np.array(sums, np.uint64).view(np.int64)))
                out = out.append_column("sketch", pa.array([r.tobytes() for r in sketches(sets)], pa.binary()))
                yield out.append_column("z", compress(part.column("text"), press))

    kinds = [T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")] + [T.StructField(c, T.BinaryType()) for c in ("sketch", "z")]
    return written(source.mapInArrow(tidy(run), T.StructType([*source.drop("text").schema.fields, *kinds])), "sketched")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def filter_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that the likelihood estimate lets through."""
    side = lambda k: classes.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(i).to_numpy().astype(float) for i in (2, 3)]
                ok = plausible(_matrix(batch.column(4)), _matrix(batch.column(5)), *sizes)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(tidy(run), "a bigint, b bigint")


def texts_of(members: DataFrame, sketched: DataFrame) -> DataFrame:
    """row, z of the classes that share a bucket. Both sides grow with the corpus: they are never broadcast."""
    needed = members.select(F.col("class").alias("row")).distinct().hint("merge")
    return written(sketched.select("row", "z").join(needed, "row", "left_semi"), "bucket-texts")


def verify_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that reach the limit on full sets, built anew from the texts of the classes' first rows."""
    pairs = written(pairs.distinct(), "plausible")
    side = lambda k: texts.select(F.col("row").alias(k), F.col("z").alias(f"z{k}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, recent = zstandard.ZstdDecompressor(), (None, None)
        for batch in batches:
            ok = []
            for a, za, zb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                new = [unpress.decompress(zb)] + ([] if recent[0] == a else [unpress.decompress(za)])
                sets = shingle_sets(Texts(pa.array(new, pa.binary()), lower=True))
                if recent[0] != a:
                    recent = (a, sets[1])
                ok.append(reach_limit(recent[1], sets[0]))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(joined.mapInArrow(tidy(run), "a bigint, b bigint"), "links")


def bucket_members(classes: DataFrame) -> DataFrame:
    """band, key, class, first (least class of the bucket), size: members of buckets of two or more."""
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(BANDS)])
    bands = classes.where("n > 0").select("class", F.posexplode(keys).alias("band", "key"))
    several = bands.groupBy("key").agg(F.min("class").alias("first"), F.count("*").alias("size")).where("size > 1")
    return written(bands.join(several.hint("merge"), "key"), "members")


def star_pairs(members: DataFrame) -> DataFrame:
    """a, b: each class with the least classes of its largest buckets."""
    centers = F.array_sort(F.collect_set(F.struct((-F.col("size")).alias("order"), "first")))
    per = members.where("class <> first").groupBy("class").agg(centers.alias("centers"))
    firsts = F.array_distinct(F.transform("centers", lambda c: c["first"]))
    return per.select(F.explode(F.slice(firsts, 1, STARS)).alias("a"), F.col("class").alias("b"))


class _Forest:
    """Components that links found so far have joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _links_of_block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Links between components in one block of a bucket: guests (held false) against those the block holds."""
    t = pa.Table.from_batches(rows).combine_chunks()
    band, cls, comp, n = (t.column(c).to_numpy() for c in ("band", "class", "component", "n"))
    is_held = t.column("held").to_numpy(zero_copy_only=False).astype(bool)
    sketch, inside = _matrix(t.column("sketch")), np.flatnonzero(is_held)
    size, z, unpress = n.astype(float), t.column("z"), zstandard.ZstdDecompressor()
    forest, sets, out = _Forest(), {}, []

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_sets(Texts(pa.array([unpress.decompress(z[i].as_py())], pa.binary()), lower=True))[0]
        return sets[i]

    for g in np.flatnonzero(~is_held):
        others = inside[(comp[inside] != comp[g]) & (cls[inside] != cls[g])]
        if not len(others):
            continue
        near = others[plausible(sketch[others], np.broadcast_to(sketch[g], (len(others), REGISTERS)), size[others], np.full(len(others), size[g]))]
        shared = (sketch[near] == sketch[g]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        for i in near[shared == band[g]].tolist():
            if forest.root(int(comp[i])) != forest.root(int(comp[g])) and reach_limit(set_of(i), set_of(int(g))):
                forest.join(int(comp[i]), int(comp[g]))
                out.append((int(cls[i]), int(cls[g])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def rest_links(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links inside buckets that hold several components, each class outside the bucket's largest component against the
    classes of the bucket of about its size, in blocks of about BLOCK."""
    labelled = members.join(labels, F.col("class") == F.col("node"), "left").select(
        "band", "key", "class", "size", F.coalesce("component", "class").alias("component")
    )
    per = labelled.groupBy("key", "component").agg(F.count("*").alias("m"))
    largest = per.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("m", "component")).alias("top")).where("comps > 1")
    mixed_keys = written(
        labelled.join(largest.select("key", F.col("top.component").alias("top")), "key").withColumn(
            "outside", F.col("component") != F.col("top")
        ),
        "mixed",
    )
    # sets that reach the limit are within 3/4 of each other in size: a guest meets blocks of its own size class and its neighbours
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(LIMIT[1] / LIMIT[0])).cast("int")
    sized = mixed_keys.join(classes.select("class", size_class.alias("sc")), "class")
    counts = sized.groupBy("key", "sc").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    columns = ("band", "key", "class", "component")
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    held = sized.join(counts, ["key", "sc"]).select(*columns, "sc", mine.alias("block"), F.lit(True).alias("held"))
    near = sized.where("outside").withColumn("sc", F.explode(F.array(*[F.col("sc") + d for d in (-1, 0, 1)]))).join(counts, ["key", "sc"])
    guests = near.select(*columns, "sc", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("held"))
    about = classes.select("class", "n", "sketch").join(texts, F.col("class") == F.col("row"))
    rows = held.union(guests).join(about, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "sc", "block")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if at is not None and at != tuple(keys[:, lo]):
                        yield _links_of_block(held)
                        held = []
                    at = tuple(keys[:, lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield _links_of_block(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.select(*columns, "sc", "block", "held", "n", "sketch", "z").repartition(n, "key", "sc", "block")
    return grouped.sortWithinPartitions("key", "sc", "block").mapInArrow(tidy(run), "a bigint, b bigint")


def _components(sketched: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component_id, first (the least (doc_id, row) of its component): one row a document."""
    others = made()
    known = sketched.where(F.col("doc_id").isNotNull())
    classes = known.groupBy("d1", "d2", "n").agg(
        F.min(F.struct("row", "sketch")).alias("rep"), F.min(F.struct("doc_id", "row")).alias("least")
    )
    classes = written(
        classes.select("d1", "d2", "n", F.col("rep.row").alias("class"), F.col("rep.sketch").alias("sketch"), "least"), "classes"
    )
    members = bucket_members(classes)
    texts = texts_of(members, sketched)
    links = verify_pairs(filter_pairs(star_pairs(members), classes), texts)
    labels = components(links, "a", "b")
    more = written(rest_links(members, labels, classes, texts), "more-links")
    labels = components(links.union(more), "a", "b")
    labelled = classes.join(labels, F.col("class") == F.col("node"), "left").select(
        "d1", "d2", "n", "least", F.coalesce("component", "class").alias("component")
    )
    done = made_since(others)
    labelled = written(labelled, "labelled")
    remove(done)
    # written apart: a join of two plain tables is one that AQE splits where a component holds very many classes
    lowest = written(labelled.groupBy("component").agg(F.min("least").alias("lowest")), "lowest").hint("merge")
    by_class = labelled.join(lowest, "component").select("d1", "d2", "n", "lowest")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    found = sketched.select("row", "doc_id", "n", "d1", "d2").join(by_class, ["d1", "d2", "n"], "left")
    first = F.when(alone, F.struct("doc_id", "row")).otherwise(F.col("lowest"))
    return found.select("row", "doc_id", F.col("n").alias("n_shingles"), first["doc_id"].alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    found = _components(sketch_documents(docs))
    return found.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """The first document of each component, with all columns."""
    sketched = sketch_documents(docs)
    kept = _components(sketched).where(F.col("first.row") == F.col("row")).select("row")
    return restored(sketched.select("row", "rest", "z").join(kept, "row", "left_semi"), docs)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT rid, md5_number(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sets AS (SELECT rid, count(*) AS n, md5(string_agg(g::VARCHAR, ',' ORDER BY g)) AS c FROM sh GROUP BY rid),
rep AS (SELECT c, any_value(n) AS n, min(rid) AS node FROM sets JOIN d USING (rid) WHERE doc_id IS NOT NULL GROUP BY c),
gr AS (SELECT node, n, g, row_number() OVER (PARTITION BY node ORDER BY df, g) AS pos
       FROM (SELECT node, n, g, count(*) OVER (PARTITION BY g) AS df FROM rep JOIN sh ON rid = node)),
head AS (SELECT * FROM gr WHERE pos <= n - ceil(0.75 * n) + 1),
cand AS (SELECT DISTINCT x.node AS a, y.node AS b FROM head x JOIN head y ON x.g = y.g AND x.node < y.node AND 4 * x.n >= 3 * y.n AND 4 * y.n >= 3 * x.n),
link AS (
  SELECT a, b FROM (SELECT a, b, any_value(x.n) AS na, count(*) AS both_ FROM cand JOIN gr x ON x.node = a JOIN gr y ON y.node = b AND y.g = x.g GROUP BY a, b)
  JOIN rep ON rep.node = b WHERE 100 * both_ >= 75 * (na + n - both_)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT node AS a, node AS b FROM rep UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
least AS (SELECT sets.c, min(doc_id) AS low FROM sets JOIN d USING (rid) WHERE doc_id IS NOT NULL GROUP BY sets.c),
comp AS (SELECT ra.c, min(low) AS component_id FROM reach JOIN rep ra ON ra.node = reach.a JOIN rep rb ON rb.node = reach.b JOIN least ON least.c = rb.c GROUP BY ra.c),
found AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(component_id, doc_id) END AS component_id
          FROM d LEFT JOIN sets USING (rid) LEFT JOIN comp ON comp.c = sets.c)
SELECT *, component_id IS NOT DISTINCT FROM doc_id AS kept FROM found
"""
