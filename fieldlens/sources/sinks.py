"""Writers: observations, form entries, deployments tables, field logs, manifests, findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens import schema
from fieldlens.functions import filters

# Fixed column order of the observation file.
OBSERVATION_FIELDS = (
    "observationType",
    "scientificName",
    "count",
    "classifiedBy",
    "classificationMethod",
    "observationComments",
    "_id",
)


def _csv(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite").option("header", "true").option("escape", '"')
    (writer.partitionBy(*partitions) if partitions else writer).csv(path)


def _sorted_csv(rows: DataFrame, path: str, key: str) -> None:
    ranged = rows.repartitionByRange("collection", key).sortWithinPartitions("collection", key)
    _csv(ranged, path, "collection")


def timestamp_text(df: DataFrame) -> DataFrame:
    """Dates of all timestamp columns as text, with offset where the column is an instant."""
    instants = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    walls = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    plain = "yyyy-MM-dd'T'HH:mm:ss"
    return df.withColumns(
        {c: F.date_format(c, plain + "xx") for c in instants} | {c: F.date_format(c, plain) for c in walls}
    )


def observation_rows(observations: DataFrame, fields: Sequence[str] = OBSERVATION_FIELDS) -> DataFrame:
    return timestamp_text(observations.select(*fields))


def write_observations(observations: DataFrame, path: str, fields: Sequence[str] = OBSERVATION_FIELDS) -> None:
    _csv(observation_rows(observations, fields), path)


def entry_rows(parts: Sequence[DataFrame], fields: Sequence[str] | None = None) -> DataFrame:
    """Entries of several forms with the sorted union of their keys, missing cells blank."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = list(fields) if fields else sorted(stacked.columns)
    chosen = filters.project(stacked, names)
    return chosen.select(*[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) for n in names])


def write_entries(parts: Sequence[DataFrame], path: str, fields: Sequence[str] | None = None) -> None:
    _csv(entry_rows(parts, fields), path)


def write_deployments(summary: DataFrame, path: str) -> None:
    """Deployments tables by collection, sorted by id; a large collection is several sorted files."""
    _sorted_csv(summary.select("collection", *schema.SUMMARY_FIELDS), path, "deploymentID")


def write_field_logs(log: DataFrame, path: str) -> None:
    """Rewritten field logs by collection."""
    _sorted_csv(log.select("collection", *schema.LOG_FIELDS), path, "Deployment")


def write_log_files(logs: DataFrame, path: str) -> None:
    """One field-log file per collection, named after it. ``logs``: collection, place, text; the texts of a
    collection are written in the order of ``place``, each followed by a line feed, as they come from the sort.

    Spark names the files it writes itself, so they are renamed; there is one per collection.
    """
    ordered = logs.repartition("collection").sortWithinPartitions("collection", "place").select("collection", "text")
    ordered.write.mode("overwrite").option("lineSep", "\n").partitionBy("collection").text(path)
    spark = logs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in files.listStatus(root):
        if folder.isDirectory():
            name = unquote(folder.getPath().getName().split("=", 1)[1])
            (part,) = [f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            files.rename(part, hadoop.Path(root, f"{name}_FileTimestampLog.csv"))
            files.delete(folder.getPath(), True)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """One JSON document per part and page, foldered by collection and deployment."""
    manifests.write.mode("overwrite").partitionBy("collection", "deployment").json(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """Write findings to the report store, foldered by run. A run written again replaces itself."""
    writer = findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)
