"""Gated preparation: a deployment is prepared only when everything before it passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import preparation, rules
from fieldlens.session import stored


def passed_collections(name_findings: DataFrame, collections: DataFrame) -> DataFrame:
    """Collections with findings, none of them an error, for their name or a deployment of theirs.

    name_findings carries the collection every finding belongs to.
    """
    judged = name_findings.groupBy("collection").agg(
        F.count_if(F.col("status") == "error").alias("_errors"),
        F.count_if(F.col("status") == "success").alias("_successes"),
    )
    passed = judged.where("_errors = 0 AND _successes > 0").select("collection")
    return collections.select("collection").distinct().join(passed, "collection", "left_semi")


def gated_preparation(
    collections: DataFrame,
    deployments: DataFrame,
    log: DataFrame,
    media: DataFrame,
    metadata: DataFrame,
    *,
    zone: str,
    locations: DataFrame | None = None,
    tolerance_hours: float = 1,
    ignore_dst: bool = True,
    chunk_rows: int | None = None,
    **prepare_options,
) -> DataFrame:
    """Prepare the deployments whose collection passed the name checks and whose own dates passed.

    Later checks read only rows that passed the earlier ones, by semi-joins on small key tables.
    """
    names = rules.check_deployment_names(deployments, locations, validate_locations=locations is not None)
    own = rules.check_collection_names(collections).withColumn("collection", F.col("identifier"))
    all_names = names.select("collection", "status").unionByName(own.select("collection", "status"))
    # A few names and keys; stored, the checks run once though later steps read them several times.
    good = stored(passed_collections(all_names, collections), "passed-collections")
    logged = rules.valid_log(log.join(good, "collection", "left_semi"))
    found = rules.media_findings(media, logged, tolerance_hours=tolerance_hours, chunk_rows=chunk_rows)
    valid = rules.validated_deployments(logged, deployments, found).select("collection", "deployment")
    valid = stored(valid, "valid-deployments")
    wanted = metadata.join(valid, ["collection", "deployment"], "left_semi")
    return preparation.prepare_deployments(
        wanted, zone=zone, ignore_dst=ignore_dst, chunk_rows=chunk_rows, **prepare_options
    )
