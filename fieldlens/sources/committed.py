"""Tables that are changed by whole commits, collection by collection.

A table is a folder with ``data``, ``parts`` and ``commits``. A commit writes the rows of the collections it
touches below a new version of ``data``, and below ``parts`` one row for every collection of the table: the version
that holds it. It becomes valid with the file ``commits/N``, which names the version and can be made once, by one
writer. So a commit that is broken off, or comes second, changes nothing, and collections that are not touched
are not written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.session import stored

COLLECTION = "collection"


class CommitConflict(RuntimeError):
    """Another writer has made the commit of that number."""


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Versions by the number of their commit; one that was broken off while it was made has none."""
    where, files = _file_system(spark, f"{path}/commits")
    if not files.exists(where):
        return {}
    whole = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    found = {}
    for status in files.listStatus(where):
        if status.getPath().getName().isdigit():
            stream = files.open(status.getPath())
            try:
                version = whole.toString(stream, "UTF-8")
            finally:
                stream.close()
            if version:
                found[int(status.getPath().getName())] = version
    return found


def last_commit(spark: SparkSession, path: str) -> int:
    """The number of the last commit; 0 before the first."""
    return max(_commits(spark, path), default=0)


def _parts(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.schema(f"{COLLECTION} string, version string").parquet(f"{path}/parts/{version}")


def read_committed(spark: SparkSession, path: str, columns: T.StructType, commit: int | None = None) -> DataFrame:
    """The rows of a commit, the last one unless given; no rows before the first.

    ``columns`` are those of the table, with the collection. A small table of versions meets the folders of the
    data, so only the folders that belong to the commit are read.
    """
    commits = _commits(spark, path)
    number = max(commits, default=0) if commit is None else commit
    if not number:
        return spark.createDataFrame([], columns)
    fields = T.StructType([f for f in columns.fields if f.name != COLLECTION])
    layout = T.StructType([*fields.fields, T.StructField("version", T.StringType()), T.StructField(COLLECTION, T.StringType())])
    rows = spark.read.schema(layout).parquet(f"{path}/data")
    return rows.join(_parts(spark, path, commits[number]), [COLLECTION, "version"], "left_semi").select(*columns.names)


def _publish(spark: SparkSession, path: str, number: int, version: str) -> None:
    where, files = _file_system(spark, f"{path}/commits/{number}")
    try:
        stream = files.create(where, False)  # fails if the file is there
        stream.write(bytearray(version.encode()))
        stream.close()
    except Py4JJavaError as error:
        if "AlreadyExists" not in str(error.java_exception):
            raise
        raise CommitConflict(f"commit {number} of {path} was made by another writer") from None


def commit_change(
    spark: SparkSession,
    path: str,
    change: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
) -> int:
    """Commit ``merge(rows of the touched collections, change)`` and return the number of the commit.

    ``change`` has the columns of the table; the collections in it are those that are touched. Running the
    same change again after a commit gives a further commit, so ``merge`` should be one that can be repeated.
    """
    before = last_commit(spark, path)
    number = before + 1
    version = f"{number}-{uuid.uuid4().hex[:12]}"
    touched = stored(change.select(COLLECTION).distinct(), "touched")
    old = read_committed(spark, path, change.schema, before).join(touched, COLLECTION, "left_semi")
    merged = merge(old, change).select(*change.columns)
    # One sorted run of files per collection; a large collection has several tasks.
    dealt = merged.repartition(COLLECTION, F.pmod(F.xxhash64(*merged.columns), F.lit(8)))
    dealt.write.mode("overwrite").partitionBy(COLLECTION).parquet(f"{path}/data/version={version}")
    parts = touched.select(COLLECTION, F.lit(version).alias("version"))
    if before:
        parts = parts.unionByName(_parts(spark, path, _commits(spark, path)[before]).join(touched, COLLECTION, "left_anti"))
    parts.write.mode("overwrite").parquet(f"{path}/parts/{version}")
    _publish(spark, path, number, version)
    return number
