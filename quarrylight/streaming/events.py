"""Event streams: windowed counts with a watermark, and the same plan over a table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.tables import fresh_path, table

WINDOW = "1 hour"


def hourly(events: DataFrame) -> DataFrame:
    """hour, event_type, events, value: works on a stream as on a table."""
    at = F.window("ts", WINDOW)
    return events.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(
        F.col("w.start").alias("hour"), "event_type", "events", F.round("value", 2).alias("value")
    )


def stream_hourly(spark: SparkSession, sf_dir: str, late: str = "2 hours") -> DataFrame:
    """Run the events through an available-now stream with a watermark and state, and return what it has written.

    Complete windows are appended once the watermark has passed; the rest follow from a last event far ahead, which is not kept.
    All files that are there make one batch: each holds events of any time, so a watermark that moved between them would drop
    most of the later ones as late. What is held is a row a window and type, whatever the number of events.
    """
    kind = _events(spark, sf_dir).schema
    source = spark.readStream.schema(kind).parquet(_folder(spark, sf_dir))
    counted = hourly(source.withWatermark("ts", late))
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    query = counted.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(out).where(~F.col("event_type").eqNullSafe("end_of_stream"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as instants: a watermark needs them."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of event files in the shared place: the table's, then one with an event far ahead."""
    path = fresh_path(spark, "stream-in")
    events = _events(spark, sf_dir)
    events.write.parquet(path)
    last = events.agg(F.max("ts").alias("m")).first()["m"]
    end = spark.createDataFrame([(None, last + datetime.timedelta(days=30), None, "end_of_stream", 0.0, None)], events.schema)
    end.coalesce(1).write.mode("append").parquet(path)
    return path
