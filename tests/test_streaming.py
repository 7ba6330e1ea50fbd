"""Streams give what the batch operators give, also over several micro-batches and replays."""

from datetime import datetime, timedelta

from tests.conftest import listed
from pyspark.sql import functions as F

from fieldlens.operators import sequences
from fieldlens.streaming import live

START = datetime(2024, 1, 1)
MEDIA = "media_id bigint, deployment_id string, ts timestamp_ntz"


def drop(spark, folder, values, schema):
    spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run_sequences(spark, source, target):
    stream = spark.readStream.schema(MEDIA).parquet(str(source))
    writer = live.live_sequences(stream, 90, "10 minutes").writeStream.format("parquet").outputMode("append")
    writer.option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start(str(target)).awaitTermination()


def test_sequences_over_micro_batches_equal_batch(spark, tmp_path):
    moments = [i * 40 + (i // 7) * 200 for i in range(60)]
    rows = [(i, f"d{i % 2}", START + timedelta(seconds=s)) for i, s in enumerate(moments)]
    end = [(1000 + i, f"d{i}", START + timedelta(hours=9)) for i in range(2)]
    for part in (rows[:20], rows[20:23], rows[23:], end):
        drop(spark, tmp_path / "in", part, MEDIA)
        run_sequences(spark, tmp_path / "in", tmp_path / "out")
    drop(spark, tmp_path / "in", [(2000, "late", START)], MEDIA)  # behind the watermark: dropped
    run_sequences(spark, tmp_path / "in", tmp_path / "out")
    batch = sequences.gap_sequences(spark.createDataFrame(rows, MEDIA), 90).groupBy("deployment_id", "seq_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_images")
    )
    got = spark.read.parquet(str(tmp_path / "out")).select(
        "deployment_id", F.col("started").cast("timestamp_ntz"), F.col("ended").cast("timestamp_ntz"), "n_images"
    )
    assert listed(got) == listed(batch.drop("seq_id"))


def test_incremental_checks_see_each_deployment_once(spark, tmp_path):
    schema = "collection string, deployment string, n_files int"
    known = spark.createDataFrame([("a",)], "location_id string")
    for names in (["R0001-a", "R0001-b"], ["bad"]):
        drop(spark, tmp_path / "in", [("R0001", n, 1) for n in names], schema)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.incremental_checks(stream, known, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = listed(spark.read.parquet(str(tmp_path / "out")), "identifier", "status")
    assert got == [("R0001:R0001-a", "success"), ("R0001:R0001-b", "error"), ("R0001:bad", "error"), ("bad", "error")]


def test_ledger_ignores_repeats_and_replays(spark, tmp_path):
    schema, columns = "path string", "path string, batch string"
    target = str(tmp_path / "ledger")

    def run(state):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.incremental_ledger(
            stream, target, str(tmp_path / state), ["path"], lambda: live.written_batches(spark, target, columns)
        ).awaitTermination()

    drop(spark, tmp_path / "in", [("a",), ("b",), ("a",)], schema)
    run("state")
    drop(spark, tmp_path / "in", [("b",), ("c",)], schema)
    run("state")
    assert listed(spark.read.parquet(target), "path") == [("a",), ("b",), ("c",)]
    run("other-state")  # everything is replayed as batch 0
    assert listed(spark.read.parquet(target), "path") == [("a",), ("b",), ("c",)]


def test_ledger_of_many_keys_calls_no_python(spark, tmp_path):
    """Keys of many files go through native state; another checkpoint takes what is new since, and all columns stay."""
    schema, target = "file string, chunk_index bigint, chunk_len bigint", str(tmp_path / "ledger")

    def run(state):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ledger = lambda: live.written_batches(spark, target, schema + ", batch string")
        query = live.incremental_ledger(stream, target, str(tmp_path / state), ["file", "chunk_index"], ledger)
        query.awaitTermination()
        return query

    rows = spark.range(20_000).selectExpr("CAST(id % 10000 AS string) AS file", "id div 10000 AS chunk_index", "id AS chunk_len")
    rows.write.parquet(str(tmp_path / "in"))
    first = run("state")
    assert "InPandas" not in first._jsq.explainInternal(True)
    rows.withColumn("chunk_index", F.expr("chunk_index + 1")).write.mode("append").parquet(str(tmp_path / "in"))
    run("other-state")
    ledger = spark.read.parquet(target)
    assert ledger.count() == 30_000 and ledger.select("file", "chunk_index").distinct().count() == 30_000
    assert ledger.where("chunk_len IS NULL").isEmpty()
    run("state")
    assert spark.read.parquet(target).count() == 30_000 + 10_000  # the first run does not know the other's work


def test_ledger_cost_does_not_grow(spark, tmp_path):
    """Many batches over the same files: no batch reads the ledger, and state reads stay as they were."""
    schema, target, state = "file string, chunk_index bigint", str(tmp_path / "ledger"), str(tmp_path / "state")
    asked = []

    def read_ledger():
        asked.append(1)
        return live.written_batches(spark, target, schema + ", batch string")

    for part in range(10):
        drop(spark, tmp_path / "in", [(f"f{i % 40}", part * 30 + i % 60) for i in range(120)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = live.incremental_ledger(stream, target, state, ["file", "chunk_index"], read_ledger)
    run.awaitTermination()
    assert len(asked) == 1
    rows = listed(spark.read.parquet(target), "file", "chunk_index")
    want = {(f"f{i % 40}", part * 30 + i % 60) for part in range(10) for i in range(120)}
    assert len(rows) == len(set(rows)) == len(want) and set(rows) == want
    progress = [p for p in run.recentProgress if p["numInputRows"]]
    assert len(progress) == 10 and all(p["numInputRows"] == 120 for p in progress)
    read = [int(p["stateOperators"][0]["customMetrics"].get("rocksdbTotalBytesRead", 0)) for p in progress]
    assert read[9] <= 2 * read[4] + 10_000


def test_ledger_keeps_neighbouring_chunks_in_one_row_of_state(spark, tmp_path):
    """Chunks of a file share rows of state; repeats, grown files, missing keys and other runs are told apart by chunk."""
    schema, target = "file string, chunk_index int, chunk_len bigint", str(tmp_path / "ledger")

    def run(state):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ledger = lambda: live.written_batches(spark, target, schema + ", batch string")
        query = live.incremental_ledger(stream, target, str(tmp_path / state), ["file", "chunk_index"], ledger, within="chunk_index")
        query.awaitTermination()
        return [p for p in query.recentProgress if p["numInputRows"]]

    def chunks(file, numbers):
        return [(file, i, None if i is None else 10 * i) for i in numbers]

    drop(spark, tmp_path / "in", chunks("a", [*range(20), *range(20)]) + chunks("b", [3]), schema)
    drop(spark, tmp_path / "in", chunks("a", range(10, 26)) + chunks(None, [0, 1, 1]) + chunks("c", [None, None, -1, -8, -9]), schema)
    last = run("state")[-1]
    want = chunks("a", range(26)) + chunks("b", [3]) + chunks(None, [0, 1]) + chunks("c", [None, -1, -8, -9])
    same = sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))
    assert listed(spark.read.parquet(target), "file", "chunk_index", "chunk_len") == same
    # 26 chunks of a in 4 rows, b in 1, the missing file in 1, and c in 3
    assert last["stateOperators"][0]["numRowsTotal"] == 9
    drop(spark, tmp_path / "in", chunks("b", range(5)), schema)
    run("other-state")  # knows the other run's chunks and takes the new ones
    want += chunks("b", [0, 1, 2, 4])
    same = sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))
    assert listed(spark.read.parquet(target), "file", "chunk_index", "chunk_len") == same
