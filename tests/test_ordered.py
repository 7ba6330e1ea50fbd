"""Ordered operators give the same result whether a group fits one task or spans many chunks."""

import random
from datetime import datetime, timedelta

import pytest
from tests.conftest import listed
from pyspark.sql import functions as F

from fieldlens.operators import forms, packaging, preparation, rules, sequences
from fieldlens.plans.ordered import ordered_rows

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed():
    """Rows of one hot group with a third of all rows, many small ones, tied times and missing values."""
    draw = random.Random(7)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else f"g{draw.randrange(40):02d}"
        moment = START + timedelta(seconds=draw.randrange(0, 4000, 20))
        value = None if i % 7 == 0 else draw.randrange(50)
        rows.append((group, moment, i, value, i % 5 == 0))
    return rows


SCHEMA = "g string, ts timestamp_ntz, id bigint, value int, skip boolean"


@pytest.mark.parametrize("chunk_rows", [None, 10_000, 25, 3])
def test_all_columns(spark, skewed, chunk_rows):
    df = spark.createDataFrame(skewed, SCHEMA)
    result = ordered_rows(df, ["g"], ["ts", "id"], chunk_rows=chunk_rows)
    assert result.chunked == (chunk_rows is not None)
    result = result.extend(
        position="position",
        total="total",
        running={"sum": F.col("value"), "n": F.col("value").isNotNull().cast("bigint")},
        previous={"before": F.col("value")},
        previous_where={"kept": (F.col("value"), ~F.col("skip"))},
        maximum={"top": F.col("value")},
    ).result()
    got = {r["id"]: r for r in result.collect()}
    groups = {}
    for row in sorted(skewed, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    for members in groups.values():
        total = kept = before = None
        for place, (_, _, key, value, skip) in enumerate(members, 1):
            total = value if total is None else total + (value or 0)
            row = got[key]
            assert (row["position"], row["total"]) == (place, len(members))
            assert (row["before"], row["kept"]) == (before, kept)
            assert row["sum"] == total
            assert row["n"] == sum(m[3] is not None for m in members[:place])
            assert row["top"] == max((m[3] for m in members if m[3] is not None), default=None)
            before = value
            if not skip:
                kept = value


def test_small_chunks_share_ranges(spark):
    """The tasks follow the rows, not the chunks, which hold chunk_rows rows at most and follow the order."""
    df = spark.range(3000).selectExpr("'g' AS g", "id", "id * 7 % 3000 AS at")
    rows = ordered_rows(df, ["g"], ["at"], chunk_rows=5)
    assert len(rows.rows.inputFiles()) <= 2
    chunks = rows.rows.groupBy("_chunk").agg(F.count("at"), F.min("at"), F.max("at")).orderBy("_chunk").collect()
    assert 600 <= len(chunks) <= 602 and all(n <= 5 for _, n, _, _ in chunks)
    assert all(a[3] < b[2] for a, b in zip(chunks, chunks[1:]))


@pytest.mark.parametrize("chunk_rows", [40, 5])
def test_no_group(spark, skewed, chunk_rows):
    df = spark.createDataFrame(skewed, SCHEMA)
    result = ordered_rows(df, [], ["ts", "id"], chunk_rows=chunk_rows).extend(
        position="position", previous={"before": F.col("id")}
    )
    order = [r[2] for r in sorted(skewed, key=lambda r: (r[1], r[2]))]
    got = {r["position"]: (r["id"], r["before"]) for r in result.result().collect()}
    assert got == {i + 1: (key, order[i - 1] if i else None) for i, key in enumerate(order)}


def _media(spark, skewed):
    df = spark.createDataFrame(skewed, SCHEMA)
    return df.selectExpr(
        "id AS media_id", "g AS deployment_id", "ts", "concat('f', id, '.jpg') AS file_name",
        "true AS file_public", "false AS private_human", "false AS private_vehicle",
    )


def test_sequences_over_chunks(spark, skewed):
    media = _media(spark, skewed)
    seen = media.selectExpr(
        "media_id", "CASE WHEN media_id % 4 = 0 THEN 'human' ELSE 'animal' END AS observation_type"
    )
    plain = listed(sequences.select_sequences(media, seen, max_interval=60, n_images=3))
    assert len(plain) > 100
    for chunk_rows in (50, 4):
        chunked = sequences.select_sequences(media, seen, max_interval=60, n_images=3, chunk_rows=chunk_rows)
        assert listed(chunked) == plain


def test_sequences_by_hand(spark, skewed):
    numbered = sequences.gap_sequences(_media(spark, skewed), 60, chunk_rows=11)
    got = {r["media_id"]: r["seq_id"] for r in numbered.collect()}
    for group in {r[0] for r in skewed}:
        members, number, last = sorted((r[1], r[2]) for r in skewed if r[0] == group), 0, None
        for moment, key in members:
            if last is None or (moment - last).total_seconds() > 60:
                number += 1
            assert got[key] == number
            last = moment


def test_media_findings_over_chunks(spark, skewed):
    media = spark.createDataFrame(skewed, SCHEMA).selectExpr(
        "'R0001' AS collection", "g AS deployment", "concat('d/IMG_', id, '.jpg') AS rel_path",
        "CASE WHEN value IS NOT NULL THEN ts END AS taken", "CASE WHEN skip THEN 'broken' END AS error",
    )
    log = media.groupBy("collection", "deployment").agg(
        F.min("taken").alias("expected_start"), (F.min("taken") + F.expr("INTERVAL '30' MINUTE")).alias("expected_end")
    )
    plain = listed(rules.media_findings(media, log, tolerance_hours=0.25))
    assert {row[4] for row in plain} == {"gather_metadata", "date order", "image date out of range"}
    assert listed(rules.media_findings(media, log, tolerance_hours=0.25, chunk_rows=13)) == plain


def test_numbered_files_over_chunks(spark, skewed):
    media = spark.createDataFrame(skewed, SCHEMA).selectExpr(
        "'R0001' AS collection", "g AS deployment", "concat('d', id % 12, '/IMG_', id, '.jpg') AS rel_path"
    )
    assert listed(preparation.numbered_files(media, chunk_rows=9)) == listed(preparation.numbered_files(media))


def test_field_sheet_over_chunks(spark, skewed):
    entries = spark.createDataFrame(skewed, SCHEMA).selectExpr(
        "CAST(id AS string) AS entry_uuid", "g AS site_raw", "CAST(id % 30 AS string) AS session_raw",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS created_at",
    )
    keyed = forms.group_keys(entries, "site_raw", "session_raw")
    assert listed(forms.field_sheet(keyed, chunk_rows=17)) == listed(forms.field_sheet(keyed))
    nested = forms.nested_entries(keyed, ["entry_uuid"], page_rows=7, chunk_rows=17)
    pages = nested.select("site", "session", "page", F.size("entries").alias("n")).collect()
    assert max(p["n"] for p in pages) <= 7 and sum(p["n"] for p in pages) == 900


def _packed_by_hand(files, limit):
    parts, part, size = {}, 0, None
    for name, bytes_ in sorted(files):
        if size is None or size + bytes_ > limit:
            part, size = part + 1, 0
        size += bytes_
        parts[name] = part
    return parts


@pytest.mark.parametrize("chunk_rows", [None, 40, 7, 2])
@pytest.mark.parametrize("limit", [1, 60, 400, 10**9])
def test_parts(spark, chunk_rows, limit):
    draw = random.Random(limit)
    files = [
        ("R0001", "hot" if i % 3 else f"d{i % 4}", f"f{i:04d}", draw.choice([0, 0, 5, 20, 35, 90, 700]))
        for i in range(300)
    ]
    df = spark.createDataFrame(files, "collection string, deployment string, name string, size bigint")
    got = packaging.pack_parts(df, limit, chunk_rows=chunk_rows).collect()
    assert len(got) == 300
    for deployment in {f[1] for f in files}:
        expected = _packed_by_hand([f[2:] for f in files if f[1] == deployment], limit)
        assert {r["name"]: r["part"] for r in got if r["deployment"] == deployment} == expected


def test_part_micro_cases(spark):
    files = [("c", "a", f"f{i}", s) for i, s in enumerate([40, 50, 30, 70, 10])]
    files += [("c", "b", "f0", 150), ("c", "b", "f1", 10)]
    df = spark.createDataFrame(files, "collection string, deployment string, name string, size bigint")
    parts = listed(packaging.pack_parts(df, 100), "deployment", "name", "part")
    assert [p[2] for p in parts] == [1, 1, 2, 2, 3, 1, 2]
    assert {r["part"] for r in packaging.pack_parts(df, None).collect()} == {1}


def test_manifest_pages_hold_everything(spark):
    files = [("c", "hot", f"f{i:03d}", 10, 1) for i in range(95)] + [("c", "d", "only", 10, 1)]
    packed = spark.createDataFrame(
        files, "collection string, deployment string, name string, file_size bigint, part bigint"
    )
    for chunk_rows in (None, 10):
        documents = packaging.manifests(packed, page_rows=20, chunk_rows=chunk_rows).collect()
        hot = sorted((d["page"], [r["name"] for r in d["resources"]]) for d in documents if d["deployment"] == "hot")
        assert [len(names) for _, names in hot] == [20, 20, 20, 20, 15]
        assert [n for _, names in hot for n in names] == [f"f{i:03d}" for i in range(95)]


def test_a_million_files_of_one_deployment_in_chunks(spark):
    """A part holds more files than a chunk, and no group of the plan holds more files than a chunk."""
    count, chunk, limit = 1_000_000, 50_000, 30_000_000
    size = F.pmod(F.xxhash64("id"), F.lit(997))
    files = spark.range(count).select(
        F.lit("c").alias("collection"), F.lit("hot").alias("deployment"), F.format_string("f%07d", "id").alias("name"), size.alias("size")
    )
    steps = packaging._part_steps(files, limit, chunk)
    assert steps.groupBy("collection", "deployment", "chunk").count().agg(F.max("count")).first()[0] == chunk
    got = packaging.pack_parts(files, limit, chunk_rows=chunk).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("name").alias("first")
    )
    mine = [(r["part"], r["n"], r["bytes"], r["first"]) for r in got.orderBy("part").collect()]
    want, used, n, part, first = [], None, 0, 0, None
    for name, bytes_ in sorted((r["name"], r["size"]) for r in files.select("name", "size").collect()):
        if used is None or used + bytes_ > limit:
            if used is not None:
                want.append((part, n, used, first))
            part, used, n, first = part + 1, 0, 0, name
        used, n = used + bytes_, n + 1
    want.append((part, n, used, first))
    assert mine == want and min(w[1] for w in want[:-1]) > chunk
