"""Registered queries that take further data into what is stored, beside the SQL of doing it all at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import entities
from quarrylight.plans import oracles, queries
from quarrylight.plans.registry import query


@query(oracles.ORACLES["entity_dedup"])
def entity_merge(spark, sf):
    """The first half of the search results is resolved and stored, the second half taken in: as if all had come at once."""
    found = entities.candidates(queries._results(spark, sf))
    half = found.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY pos)")).first()[0]
    stored = entities.resolve(found.where(F.col("pos") <= half))
    members = entities.extend(stored, found.where(F.col("pos") > half))
    return entities.merged(members).select(
        "pos", "name", "primary_url", "score", F.array_join("source_types", ",").alias("source_types"), "evidences", F.size("members").alias("members")
    )
