"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the library relies on. All can be set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even when the next step wants the same partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot never compiles a method of more than 8000 bytes; Spark then splits such expressions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streaming sessions are merged inside each map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; cluster sizing is left to the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}
_STORED: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, and driver and executors
    are one process, as in local tests, a temporary folder is made once per application.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _LOCAL_FOLDERS.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="fieldlens-")
        _LOCAL_FOLDERS[context.applicationId] = folder
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    Parquet instead of ``checkpoint()``: later steps read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a table in the shared folder; whether there was one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has stored; call it when the results are written.

    Results that still read them fail afterwards. Returns how many were deleted.
    """
    count = 0
    while _STORED:
        count += delete(spark, _STORED.pop())
    return count
