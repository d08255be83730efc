"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source gets a target number of words. Its documents are shuffled by a hash of their id; a document's
virtual finish time is the source's running word count (over repeated passes) divided by the source's target.
All items are ordered by finish time and the mix is cut where the running total would pass the budget.

Running sums never gather a source into one task. Items are first dealt to fine buckets (of the shuffle hash, then of
the finish time); bucket totals give each bucket's start, and only the rows of one bucket are sorted together.

Defined results: null text counts as empty; a document without words has size 0, takes no place in the order (finish and
running are null) and is not taken; null source is a source of its own, last in order; repeated rows are separate documents;
an empty table gives an empty mix; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.llm.running import starts as running_starts
from quarrylight.tables import written

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
ROWS_A_BUCKET = 2048


def shuffle_hash(doc_id: Column, seed: int) -> Column:
    """The first 60 bits of md5("seed:doc_id"): reruns and other engines get the same order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_repeats: int, share: float) -> DataFrame:
    """source, source_size, target. One row a source; caps are filled in order of cap per weight (water-filling)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    choices = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.get(choices, F.col("rank") % len(weights)))
    per = per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("cap", F.col("source_size").cast("double") * F.lit(float(max_repeats)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0.0))
    per = per.withColumn("capped_before", before("cap"))
    per = per.withColumn("weight_left", F.sum("weight").over(everything) - before("weight"))
    per = per.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    per = per.withColumn("is_capped", F.col("level") * F.col("weight") > F.col("cap"))
    ratio = F.col("cap") / F.col("weight")
    first_open = F.min(F.when(~F.col("is_capped"), F.struct(ratio.alias("r"), "rank", "level"))).over(everything)
    per = per.withColumn("open", first_open)
    below = (ratio < F.col("open.r")) | ((ratio == F.col("open.r")) & (F.col("rank") < F.col("open.rank")))
    target = F.when(below | F.col("open").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("open.level") * F.col("weight"))
    )
    return per.select("source", "source_size", target.alias("target"), F.col("budget"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    share: float = 1.0,
    seed: int = 20,
    number: Column | None = None,
) -> DataFrame:
    """All items of the mix, range-sorted by virtual finish time. `number` numbers the rows of docs; else they are numbered here.

    Returns row_id, doc_id, source, epoch, size, source_size, target, finish, running (words up to and with this
    item), taken (whether the item is within the budget of share x all words). Every document has its item of epoch 0;
    a later pass over a source has items if it starts before twice the target.
    """
    spark = docs.sparkSession
    sized = written(
        docs.select(
            (F.monotonically_increasing_id() if number is None else number).cast("bigint").alias("row_id"),
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            shuffle_hash(F.col("doc_id"), seed).alias("h"),
        ),
        "mix-sizes",
    )
    targets = written(source_targets(sized, weights, max_repeats, share).coalesce(1), "mix-targets")
    bits = max(4, math.ceil(math.log2(max(1, sized.count()) / ROWS_A_BUCKET + 1)))
    wordless = sized.where("size = 0")
    sized = sized.where("size > 0").withColumn("b", F.shiftright("h", HASH_BITS - bits))

    starts = sized.groupBy("source", "b").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col("source").alias("s_source"), F.col("b").alias("s_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("b") == F.col("s_b")))
        .withColumn("cum", F.col("start") + F.sum("size").over(within))
        .drop("s_source", "s_b", "start", "b", "h")
    )
    by_source = targets.select(F.col("source").alias("t_source"), "source_size", "target", "budget")
    placed = placed.join(by_source, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    epochs = F.filter(
        F.sequence(F.lit(0), F.lit(max_repeats - 1)),
        lambda e: (e == 0) | ((F.col("target") > 0) & (e * F.col("source_size") <= 2 * F.col("target"))),
    )
    # a target is 0 only if the share is: then nothing is taken, and any order will do
    finish = (F.col("epoch") * F.col("source_size") + F.col("cum")).cast("double") / F.when(F.col("target") > 0, F.col("target")).otherwise(F.col("source_size"))
    items = placed.withColumn("epoch", F.explode(epochs)).withColumn("finish", finish)
    # Finish times to 2 get even buckets; later ones, which only sources far above their target have, get buckets a part of an octave wide.
    slots = 1 << bits
    late = F.log2(F.greatest(F.col("finish"), F.lit(2.0)) / 2) * (slots / 4)
    items = items.withColumn("v", F.floor(F.when(F.col("finish") < 2, F.col("finish") * slots).otherwise(2 * slots + late)))
    items = written(items, "mix-items")
    v_starts = running_starts(items.groupBy("v").agg(F.sum("size").alias("n")), "v", "n")
    v_starts = v_starts.select(F.col("v").alias("s_v"), F.col("start").alias("v_start"))
    order = ("finish", "source", "doc_id", "epoch", "size", "row_id")
    in_v = Window.partitionBy("v").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    queued = (
        items.join(v_starts, F.col("v") == F.col("s_v"))
        .repartitionByRange(n, "v")
        .withColumn("running", F.col("v_start") + F.sum("size").over(in_v))
        .withColumn("taken", F.col("running") <= F.col("budget"))
        .select("row_id", "doc_id", "source", "epoch", "size", "source_size", "target", "finish", "running", "taken")
    )
    return queued.union(
        wordless.join(by_source, F.col("source").eqNullSafe(F.col("t_source"))).select(
            "row_id", "doc_id", "source", F.lit(0).alias("epoch"), "size", "source_size", "target",
            F.lit(None).cast("double").alias("finish"), F.lit(None).cast("bigint").alias("running"), F.lit(False).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("doc")), "mix-documents")
    plain = rows.select("row_id", "doc.doc_id", "doc.source", "doc.text")
    times = mix(plain, number=F.col("row_id"), **how).where("taken AND size > 0").groupBy("row_id").agg(F.count("*").cast("int").alias("times"))
    taken = rows.join(times, "row_id").select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass"))
    return taken.select("doc.*")


def taken_per_document(items: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document of the mix's input."""
    return (
        items.groupBy("row_id")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("size").alias("size"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"),
        )
        .drop("row_id")
    )


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS budget FROM per),
lv AS (
  SELECT *, (budget - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
op AS (SELECT cap / weight AS r, rank, level FROM lv WHERE NOT (level * weight > cap) ORDER BY 1, 2 LIMIT 1),
t AS (
  SELECT lv.source, source_size, budget,
         CASE WHEN op.r IS NULL OR cap / weight < op.r OR (cap / weight = op.r AND lv.rank < op.rank) THEN cap
              ELSE least(cap, op.level * weight) END AS target
  FROM lv LEFT JOIN op ON true),
cum AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size > 0),
items AS (
  SELECT *, (epoch * source_size + cum)::DOUBLE / target AS finish
  FROM cum, (VALUES (0), (1), (2)) e(epoch) WHERE epoch = 0 OR epoch * source_size <= 2 * target),
run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, doc_id NULLS FIRST, epoch, size ROWS UNBOUNDED PRECEDING) AS running FROM items)
SELECT doc_id, size, source_size, target,
       (sum(CASE WHEN running <= budget THEN size ELSE 0 END))::BIGINT AS taken
FROM run GROUP BY doc_id, size, source_size, target
UNION ALL
SELECT s.doc_id, s.size, t.source_size, t.target, 0::BIGINT FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size = 0
"""
