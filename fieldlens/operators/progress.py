"""Progress events of long jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed_events(events: DataFrame) -> DataFrame:
    """Kind, collection and deployment of ``event:collection:deployment[:file]`` texts."""
    part = F.split("event", ":", 4)
    return events.select(
        F.try_element_at(part, F.lit(1)).alias("kind"),
        F.try_element_at(part, F.lit(2)).alias("collection"),
        F.try_element_at(part, F.lit(3)).alias("deployment"),
        "count",
    )


def roll_up(events: DataFrame) -> DataFrame:
    """Announced and advanced counts per collection and deployment."""
    count = F.col("count")

    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, count)), F.lit(0))

    return parsed_events(events).groupBy("collection", "deployment").agg(
        (of("deployment_start") + of("collection_start")).alias("total"),
        of("file_progress").alias("advanced"),
        of("deployment_complete").alias("completed"),
    )
