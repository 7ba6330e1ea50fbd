"""Queries that go through files: readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import preparation as P
from fieldlens.operators.packaging import build_packages, manifests
from fieldlens.session import delete, scratch_path, stored
from fieldlens.sources import committed, sinks, tables
from fieldlens.workload.package_queries import LIMIT
from fieldlens.workload.preparation_queries import _lower_log, _prepared, _recorded
from fieldlens.workload.registry import query


@query(
    "s1_media_inventory",
    """SELECT m.collection, m.deployment, CASE WHEN m.media_id % 4 = 0 THEN m.file_name ELSE m.rel_path END AS rel_path, m.file_name,
         lower(regexp_extract(m.file_name, '\\.[^.]+$')) AS ext, m.size FROM media m""",
)
def _(t):
    listing = tables.media_listing(t.media_paths, "/data/")
    return listing.select("collection", "deployment", "rel_path", "file_name", "ext", "size")


@query(
    "s1_direct_children",
    "SELECT collection, deployment, file_name FROM media WHERE media_id % 4 = 0",
)
def _(t):
    listing = tables.media_listing(t.media_paths, "/data/", direct_children=True)
    return listing.select("collection", "deployment", "file_name")


@query(
    "s1_media_tree",
    """SELECT 'collection=' || collection AS collection, 'deployment=' || deployment AS deployment, '.txt' AS ext,
         CAST(sum(length(CAST(media_id AS varchar)) + 1) AS bigint) AS size,
         sha1(string_agg(CAST(media_id AS varchar) || chr(10), '' ORDER BY media_id)) AS hash
       FROM media GROUP BY collection, deployment""",
)
def _(t):
    # A tree of folders with one file each, which holds the ids of the deployment's media.
    path = scratch_path(t.spark, "media-tree")
    keys = ["collection", "deployment"]
    rows = t.media.repartition(*keys).sortWithinPartitions(*keys, "media_id")
    rows.select(*keys, F.col("media_id").cast("string").alias("value")).write.partitionBy(*keys).text(path)
    return tables.read_media(t.spark, path, with_hash=True).select(*keys, "ext", "size", "hash")


_LOG_HEADER = ["EndTime", "Deployment", "StartDate", "StartTime", "EndDate"]


def _log_files(t) -> str:
    """Field logs as typed by hand: with a byte order mark, other column order, and line breaks in cells."""
    name = F.when(F.col("row_number") % 7 == 0, F.concat(F.lit('"'), F.col("Deployment"), F.lit('\n""moved"""'))).otherwise(F.col("Deployment"))
    line = F.concat_ws(",", *[name if c == "Deployment" else F.col(c) for c in _LOG_HEADER])
    lines = t.field_log.select("collection", F.col("row_number").alias("place"), F.concat(line, F.lit("\r")).alias("text"))
    header = t.field_log.select("collection").distinct().select(
        "collection", F.lit(-1).alias("place"), F.lit("\ufeff" + ",".join(_LOG_HEADER) + "\r").alias("text")
    )
    path = scratch_path(t.spark, "log-files")
    sinks.write_log_files(header.unionByName(lines), path)
    return path


@query(
    "s2_log_files",
    """SELECT collection, row_number() OVER (PARTITION BY collection ORDER BY row_number) + 1 AS row_number,
         CASE WHEN row_number % 7 = 0 THEN Deployment || chr(10) || '"moved"' ELSE Deployment END AS "Deployment",
         StartDate AS "StartDate", StartTime AS "StartTime", EndDate AS "EndDate", EndTime AS "EndTime" FROM field_log""",
)
def _(t):
    return tables.read_field_logs(t.spark, _log_files(t))


@query("s2_log_headers", f"SELECT DISTINCT collection, '{','.join(_LOG_HEADER)}' AS header FROM field_log")
def _(t):
    return tables.read_log_headers(t.spark, _log_files(t))


_LOG = 'collection, Deployment AS "Deployment", StartDate AS "StartDate", StartTime AS "StartTime", EndDate AS "EndDate", EndTime AS "EndTime"'


@query("s2_field_log_table", f"SELECT {_LOG} FROM field_log")
def _(t):
    path = scratch_path(t.spark, "field-logs")
    sinks.write_field_logs(t.field_log, path)
    return tables.read_log_table(t.spark, path).select(
        "collection", "Deployment", "StartDate", "StartTime", "EndDate", "EndTime"
    )


_EXPORT = [
    "classification_id", "user_name", "user_id", "workflow_id", "workflow_name", "workflow_version", "subject_ids",
    "subject_data", "annotations",
]


# Some 90 MB of text.
_FILE_ROWS = 250_000
# Some 7 GB of text.
_PORTION_ROWS = 20_000_000


@query("s3_classification_export", f"SELECT {', '.join(_EXPORT)} FROM export")
def _(t):
    path = scratch_path(t.spark, "export")
    writer = t.export.select(_EXPORT).write.option("header", "true").option("escape", '"').option("quoteAll", "true")
    # Compressed files are read whole, each by a task, so none is large.
    writer = writer.option("compression", "gzip").option("maxRecordsPerFile", _FILE_ROWS)
    writer.option("emptyValue", "").csv(path)
    # A CSV cell cannot tell null from blank; the export's blank user ids come back as null.
    return tables.read_export(t.spark, path).withColumn("user_id", F.coalesce("user_id", F.lit("")))


@query(
    "s3_export_ranges",
    """SELECT classification_id, annotations || chr(10) || '"' || chr(10) || '",' AS annotations FROM export""",
)
def _(t):
    # Cells with line breaks and quotes, read in byte ranges far smaller than the files. The text is many times its table, so
    # it is written and read a portion at a time.
    cells = t.export.withColumn("annotations", F.concat("annotations", F.lit('\n"\n",'))).select(_EXPORT)
    portions = t.table("lineitem").count() // _PORTION_ROWS + 1
    dealt = F.pmod(F.xxhash64("classification_id"), F.lit(portions))
    before = t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = []
    for number in range(portions):
        path = scratch_path(t.spark, "export")
        cells.where(dealt == number).write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
        t.spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 19))
        try:
            read.append(stored(tables.read_export(t.spark, path).select("classification_id", "annotations"), "read-export"))
        finally:
            t.spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        delete(t.spark, path)
    return reduce(DataFrame.unionByName, read)


@query(
    "s6_observation_file",
    """SELECT obs_id AS "_id", observation_type AS "observationType", strftime(observed_at, '%Y-%m-%dT%H:%M:%S') AS "observedAt",
         strftime(observed_at, '%Y-%m-%dT%H:%M:%S+0000') AS "classifiedAt" FROM obs""",
)
def _(t):
    rows = t.obs.selectExpr(
        "obs_id AS _id", "observation_type AS observationType", "observed_at AS observedAt",
        "CAST(observed_at AS timestamp) AS classifiedAt",
    )
    path = scratch_path(t.spark, "observations")
    fields = ["observationType", "observedAt", "classifiedAt", "_id"]
    sinks.write_observations(rows, path, fields)
    columns = "observationType string, observedAt string, classifiedAt string, _id bigint"
    return t.spark.read.schema(columns).option("header", "true").csv(path)


@query(
    "s8_deployments_file",
    "SELECT * FROM summaries",
)
def _(t):
    summary = P.deployment_summary(_prepared(t))
    path = scratch_path(t.spark, "deployments")
    sinks.write_deployments(summary, path)
    columns = "deploymentID string, locationID string, deploymentStart string, deploymentEnd string, cameraModel string, collection string"
    return t.spark.read.schema(columns).option("header", "true").csv(path)


@query(
    "s9_rewritten_field_log",
    """SELECT * FROM lower_log UNION ALL SELECT * FROM new_rows WHERE (collection, upper("Deployment")) NOT IN
       (SELECT (collection, upper("Deployment")) FROM lower_log)""",
)
def _(t):
    log = P.insert_if_absent(_lower_log(t), P.log_rows(_recorded(t, True)))
    path = scratch_path(t.spark, "rewritten-logs")
    sinks.write_field_logs(log, path)
    return tables.read_log_table(t.spark, path)


@query(
    "s10_manifest_files",
    "SELECT collection, deployment, CAST(part AS bigint) AS part, name, file_size FROM packed",
)
def _(t):
    packed = build_packages(t.files, max_bytes=LIMIT, project_id=7, stamp="20240101000000")
    path = scratch_path(t.spark, "manifests")
    sinks.write_manifests(manifests(packed, sizes=t.files), path)
    columns = "part bigint, page bigint, resources array<struct<name:string,file_size:bigint>>, collection string, deployment string"
    back = t.spark.read.schema(columns).json(path)
    return back.select("collection", "deployment", "part", F.inline("resources"))


@query("s8_committed_summaries", "SELECT * FROM summaries")
def _(t):
    # Half of the deployments, then all in their final state, once broken off and once more.
    summary = P.deployment_summary(_prepared(t))
    path = scratch_path(t.spark, "committed")
    keys = ["collection", "deploymentID"]
    merge = lambda old, new: P.upsert(old, new, keys)
    early = summary.where("pmod(xxhash64(deploymentID), 2) = 0").withColumn("deploymentEnd", F.lit("unknown"))
    committed.commit_change(t.spark, path, early, merge)
    broken = summary.withColumn("deploymentStart", F.lit("broken off"))
    broken.write.partitionBy("collection").parquet(f"{path}/data/version=2-broken")
    committed.commit_change(t.spark, path, summary, merge)
    return committed.read_committed(t.spark, path, summary.schema)


@query("s13_handled_paths", "SELECT rel_path AS path FROM media WHERE file_public")
def _(t):
    # Blank lines and stray blanks, as a hand-edited ledger has them.
    line = F.when(F.col("file_public"), F.concat(F.lit("  "), F.col("rel_path"), F.lit(" "))).otherwise("   ")
    path = scratch_path(t.spark, "handled")
    t.media.select(line.alias("value")).write.text(path)
    return tables.read_ledger(t.spark, path)


@query("j11_pending_media", "SELECT media_id FROM media WHERE NOT file_public")
def _(t):
    path = scratch_path(t.spark, "handled")
    t.media.where("file_public").select("rel_path").write.text(path)
    from fieldlens.operators.packaging import pending

    done = tables.read_ledger(t.spark, path).withColumnRenamed("path", "rel_path")
    return pending(t.media, done, ["rel_path"]).select("media_id")
