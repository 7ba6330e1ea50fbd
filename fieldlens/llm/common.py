"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.session import configure, stored

# ASCII white space; words are the runs between.
SPACE = r"[\x20\x09-\x0D]+"


# Rows, and about the bytes, that a Python worker holds at a time; the longest texts have hundreds of kilobytes.
BATCH_ROWS, BATCH_BYTES = "1000", str(16 << 20)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # Spark's own limit: these operators were measured with it.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    return spark


def utf8(text: Column) -> Column:
    """The bytes of a text; a null text has none."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def globally_ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add a gapless 0-based ``rank`` in the given order and the row count ``total``.

    The rows are dealt out by ranges of the order, so no task holds more than its range, and are
    stored with their place in the range. The ranges' offsets are one row per partition.
    """
    number = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    ranged = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_number", number), name)
    sizes = (
        placed.groupBy(F.shiftright("_number", 33).alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        # One row per partition of the step above.
        .groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("s"), F.sum("_n").alias("total"))
        .select(
            "total",
            F.inline(
                F.expr(
                    "transform(s, (x, i) -> struct(x._part as _part, "
                    "aggregate(slice(s, 1, i), 0L, (a, y) -> a + y._n) as _before))"
                )
            ),
        )
    )
    joined = placed.withColumn("_part", F.shiftright("_number", 33)).join(F.broadcast(sizes), "_part")
    return joined.withColumn(
        "rank", F.col("_before") + F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("_part", "_number", "_before")
