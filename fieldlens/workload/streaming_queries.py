"""Queries that run the given tables through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators.packaging import chunk_plan
from fieldlens.session import scratch_path
from fieldlens.streaming import live
from fieldlens.workload.adapters import VIEWS
from fieldlens.workload.finding_queries import ROLL_UP
from fieldlens.workload.package_queries import CHUNK
from fieldlens.workload.registry import query
from fieldlens.workload.sequence_queries import GAP


PARTS = 4


def _quarter(rows) -> tuple[int, int]:
    """First second of the rows, and the length of a quarter of their time."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(at), F.max(at)).first()
    return first or 0, ((last or 0) - (first or 0)) // PARTS + 1


def _stream(t, view: str, in_time: bool = False):
    """A view as a file stream of several micro-batches over its whole given table.

    ``in_time`` lands the rows one quarter of the time after another, as a camera sends them; the files of
    a quarter come in any order, so the stream's rows are late by :func:`_quarter` at most.
    """
    table, columns = VIEWS[view]
    rows, folder = t.table(table), scratch_path(t.spark, f"landing-{view}")
    if in_time:
        first, length = _quarter(rows)
        at = F.unix_seconds(F.col("ts").cast("timestamp"))
        number = F.least(F.floor((at - first) / length), F.lit(PARTS - 1))
        for part in range(PARTS):
            rows.where(F.coalesce(number, F.lit(0)) == part).write.mode("append").parquet(folder)
    else:
        rows.repartition(PARTS).write.parquet(folder)
    files = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return files.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _result(t, path: str, columns: str):
    return t.spark.read.schema(columns).parquet(path)


@query(
    "st1_live_sequences",
    "SELECT deployment_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_images FROM all_seqs GROUP BY deployment_id, seq_id",
)
def _(t):
    _, late = _quarter(t.table(VIEWS["media"][0]))
    sequences = live.live_sequences(_stream(t, "media", in_time=True), GAP, f"{late} seconds")
    target = scratch_path(t.spark, "live-sequences")
    writer = sequences.writeStream.format("parquet").option("checkpointLocation", target + "-state")
    writer.outputMode("append").trigger(availableNow=True).start(target).awaitTermination()
    back = _result(t, target, "deployment_id string, started timestamp, ended timestamp, n_images bigint")
    whole = back.unionByName(live.open_sequences(t.media, back, GAP))
    return whole.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("st2_live_progress", ROLL_UP)
def _(t):
    target = scratch_path(t.spark, "live-progress")
    columns = "collection string, deployment string, total bigint, advanced bigint, completed bigint"

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    rolled = live.live_progress(_stream(t, "events_text"))
    writer = rolled.writeStream.outputMode("update").option("checkpointLocation", target + "-state")
    writer.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    # Update mode writes a group again when it changes; its last batch holds its present state.
    changes = _result(t, target, columns + ", batch int")
    names = ["total", "advanced", "completed"]
    last = changes.groupBy("collection", "deployment").agg(F.max_by(F.struct(*names), "batch").alias("state"))
    return last.select("collection", "deployment", "state.*")


@query("st3_incremental_checks", "SELECT identifier, action, status, message FROM name_findings")
def _(t):
    target = scratch_path(t.spark, "live-checks")
    query_ = live.incremental_checks(_stream(t, "folders"), t.locations, target, target + "-state")
    query_.awaitTermination()
    columns = "collection string, deployment string, identifier string, action string, status string, message string"
    return _result(t, target, columns).select("identifier", "action", "status", "message")


@query("st4_live_ledger", "SELECT file, chunk_index, chunk_len FROM chunk_ledger")
def _(t):
    target = scratch_path(t.spark, "live-ledger")
    columns = "file string, chunk_index bigint, chunk_len bigint, batch string"
    work = chunk_plan(_stream(t, "transfers"), CHUNK).select("file", "chunk_index", "chunk_len")

    def read_ledger():
        return live.written_batches(t.spark, target, columns)

    # The second run finds nothing left to do, and the third, without the state of the others, neither.
    for state in ("-state", "-state", "-other-state"):
        run = live.incremental_ledger(work, target, target + state, ["file", "chunk_index"], read_ledger, within="chunk_index")
        run.awaitTermination()
    return _result(t, target, columns).drop("batch")
