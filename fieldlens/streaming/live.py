"""Live versions of batch operators on Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fieldlens.operators import progress, rules


# A batch lays down its changes alone, not the files that the store has merged meanwhile.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}
# Neighbouring values of a whole-number key that share a row of the ledger's state.
_SLOTS = 8


def live_sequences(media: DataFrame, max_interval: int = 90, late_by: str = "1 hour") -> DataFrame:
    """Sequences of a media stream: start, end and number of images per deployment.

    A sequence is emitted once the watermark has passed its end plus the interval. Images later than
    ``late_by`` behind the newest one are dropped. The watermark needs TIMESTAMP, so wall-clock times
    are cast. An image exactly ``max_interval`` after another one still joins its sequence.
    """
    timed = media.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late_by)
    gap = F.session_window("ts", f"{max_interval} seconds")
    return timed.groupBy("deployment_id", gap.alias("_gap")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_images")
    ).drop("_gap")


def open_sequences(media: DataFrame, emitted: DataFrame, max_interval: int = 90) -> DataFrame:
    """The sequences a finished stream has left open: batch work on the images after the emitted ones.

    ``emitted`` is what :func:`live_sequences` has written (deployment_id, ended). Sequences of a
    deployment are emitted in order, so its later images are those of the open ones.
    """
    last = emitted.groupBy("deployment_id").agg(F.max("ended").alias("_last"))
    timed = media.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    rest = timed.join(last, "deployment_id", "left").where("_last IS NULL OR ts > _last")
    gap = F.session_window("ts", f"{max_interval} seconds")
    return rest.groupBy("deployment_id", gap.alias("_gap")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_images")
    ).drop("_gap")


def live_progress(events: DataFrame) -> DataFrame:
    """Running progress per collection and deployment, for update mode."""
    return progress.roll_up(events)


def run_each(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Start a stream that hands every micro-batch to a function."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _write_batch(df: DataFrame, target: str, batch: str | int) -> None:
    """Write a micro-batch to a folder of its own, so a replayed batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{target}/batch={batch}")


def written_batches(spark: SparkSession, target: str, columns: str) -> DataFrame | None:
    """What earlier micro-batches wrote, with their ``batch``; None before the first."""
    try:
        return spark.read.schema(columns).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def incremental_checks(
    deployments: DataFrame, locations: DataFrame, target: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Check the names of deployments as they land and append the findings."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(rules.check_deployment_names(batch, locations), target, batch_id)

    return run_each(deployments, handle, checkpoint, **trigger)


def _is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def incremental_ledger(
    work: DataFrame,
    ledger_path: str,
    checkpoint: str,
    keys: Sequence[str],
    read_ledger: Callable[[], DataFrame | None],
    within: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Write work the ledger does not hold yet, once, also when a batch is replayed.

    What is held is keyed state of the stream: an aggregate that tells for each key when it came first and last, 0 where
    another run wrote it. Work is new where both times are the present batch's, which Spark keeps with the
    batch's offsets. ``within`` names a whole-number key, as of a file's chunks: neighbouring values of it lie in one row of
    state, each with times of its own, so rows are fewer before the shuffle already. A batch looks up its own keys and reads no ledger file, however long the ledger is. Only
    a new checkpoint reads the ledger, once: ``read_ledger`` returns the batches written so far with ``batch``,
    or None, and the keys of other runs, laid down beside the checkpoint, are a second source, read whole in the first
    batch. Batches are named by their checkpoint too, so a replayed batch replaces its own output and no other's.
    Of new rows with equal keys one is written, with the largest value of each other column.
    """
    spark = work.sparkSession
    run, keys = hashlib.sha1(checkpoint.encode()).hexdigest()[:12], list(keys)
    held_path = f"{checkpoint.rstrip('/')}-held"
    key_schema = StructType([work.schema[key] for key in keys])
    if not _is_written(spark, held_path):
        held = read_ledger()
        held = spark.createDataFrame([], key_schema) if held is None else held.where(~F.col("batch").startswith(run)).select(keys)
        held.write.mode("overwrite").option("compression", "zstd").parquet(held_path)
    held = spark.readStream.schema(key_schema).parquet(held_path).withColumn("_at", F.lit(0).cast("bigint"))
    now = F.unix_micros(F.current_timestamp())
    both = work.withColumn("_at", now).unionByName(held, allowMissingColumns=True)
    others = [name for name in work.columns if name not in keys]
    slots, groups = range(1), [F.col(key) for key in keys]
    if within is not None:
        slots, groups = range(_SLOTS), [F.col(key) for key in keys if key != within]
        place = F.coalesce(F.pmod(within, F.lit(_SLOTS)), F.lit(0))
        both = both.withColumn("_slot", place)
        groups.append((F.col(within) - F.col("_slot")).alias("_base"))

    def in_slot(n: int, name: str):
        return F.col(name) if within is None else F.when(F.col("_slot") == n, F.col(name))

    seen = both.groupBy(*groups).agg(
        *[of(in_slot(n, "_at")).alias(f"_{of.__name__}{n}") for n in slots for of in (F.min, F.max)],
        *[F.max(in_slot(n, name)).alias(f"{name}_{n}") for n in slots for name in others],
    ).withColumn("_now", now)

    def row(n: int):
        new = (F.col(f"_min{n}") == F.col("_now")) & (F.col(f"_max{n}") == F.col("_now"))
        own = [(F.col("_base") + n).cast(work.schema[within].dataType).alias(within)] if within is not None else []
        return F.struct(*own, *[F.col(f"{name}_{n}").alias(name) for name in others], F.coalesce(new, F.lit(False)).alias("_new"))

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.select(*[key for key in keys if key != within], F.inline(F.array(*[row(n) for n in slots])))
        _write_batch(rows.where("_new").select(work.columns), ledger_path, f"{run}-{number}")

    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():  # read when the stream starts
        spark.conf.set(key, value)
    try:
        writer = seen.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(handle)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
