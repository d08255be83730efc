"""Running totals over many keys without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Neighbouring keys that are summed together first, so that one row in this many meets all others.
FAN = 4096


def starts(totals: DataFrame, key: str, value: str, fan: int = FAN) -> DataFrame:
    """key, start: the sum of `value` over all smaller keys. totals: one row a key, keys are integers from 0 on.

    Runs of `fan` keys are summed first; only one row a run meets the others, and each run is then gone through by itself.
    """
    rows = totals.select(key, value, F.floor(F.col(key) / fan).alias("run"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("run").agg(F.sum(value).alias("n"))
    runs = runs.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(runs, "run").select(key, (F.col("before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("start"))
