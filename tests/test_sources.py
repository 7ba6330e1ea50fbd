"""Readers and writers on small real files."""

import csv
import hashlib
import json
import random
import time
from datetime import datetime
from pathlib import Path

import pytest
from tests.conftest import listed
from pyspark.sql import functions as F

from fieldlens.operators import rules
from fieldlens.session import scratch_root
from fieldlens.sources import sinks, tables
from fieldlens.workload import registry, source_queries
from fieldlens.workload.adapters import Tables


def test_media_tree(spark, tmp_path):
    root = tmp_path / "da.ta"
    for name, body in {"R0001/R0001-a/x.JPG": b"one", "R0001/R0001-a/sub/y.png": b"two", "R0002/R0002-b/z": b"3"}.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(body)
    got = listed(tables.read_media(spark, str(root)), "collection", "deployment", "rel_path", "ext", "size")
    assert got == [
        ("R0001", "R0001-a", "sub/y.png", ".png", 3), ("R0001", "R0001-a", "x.JPG", ".jpg", 3), ("R0002", "R0002-b", "z", "", 1),
    ]
    digest = hashlib.sha1(b"one").hexdigest()
    hashed = tables.read_media(spark, str(root), with_hash=True).where("file_name = 'x.JPG'").first()
    assert (hashed["hash"], hashed["hash_path"]) == (digest, f"/{digest[:2]}/{digest[2:4]}/{digest}")
    plan = tables.read_media(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_field_logs(spark, tmp_path):
    (tmp_path / "c").mkdir()
    header = "StartDate,Deployment,StartTime,EndDate,EndTime,Notes"
    body = '2024:09:04,"a, b",3:10:00,2024:09:05,03:10:00,"say ""hi"""\r\n\r\n2024:09:04,c,3:10:00,2024:09:05'
    (tmp_path / "c" / "R0001_FileTimestampLog.csv").write_bytes(("﻿" + header + "\r\n" + body).encode())
    (tmp_path / "R0002_FileTimestampLog.csv").write_text("Deployment,Deployment,StartDate,StartTime\nx,x,d,t\n")
    (tmp_path / "R0003_FileTimestampLog.csv").write_text("\n")
    (tmp_path / "R0004_FileTimestampLog.csv").write_text(header + '\nd,e,t,d,t,"two\nlines"\nd,f,t,d,"t"\n')
    (tmp_path / "other.csv").write_text("Deployment\nno\n")
    rows = tables.read_field_logs(spark, str(tmp_path))
    assert listed(rows.where("collection = 'R0001'"), "row_number", "Deployment", "StartDate", "EndTime") == [
        (2, "a, b", "2024:09:04", "03:10:00"), (3, "c", "2024:09:04", None),
    ]
    assert listed(rules.valid_log(rows), "collection", "deployment") == [("R0001", "a, b")]
    assert listed(rows.where("collection = 'R0004'"), "row_number", "Deployment", "EndTime") == [(2, "e", "t"), (3, "f", "t")]
    heads = rules.check_log_headers(tables.read_log_headers(spark, str(tmp_path)))
    assert listed(heads, "identifier", "message") == [
        ("R0002", "Columns named twice: Deployment"),
        ("R0002", "Columns not there: EndDate, EndTime"),
        ("R0003", "Header is empty"),
    ]


def test_field_logs_are_read_in_byte_ranges(spark, tmp_path):
    """A long log is numbered over its ranges, and quoted line breaks do not cost more in a longer file."""
    cells = [f'"{i}\n""x"""' if i % 7 == 0 else str(i) for i in range(60_000)]
    lines = [f"{c},d,t,d,{i}" for i, c in enumerate(cells)]
    lines.insert(500, "")
    (tmp_path / "R0001_FileTimestampLog.csv").write_text("\ufeffDeployment,StartDate,StartTime,EndDate,EndTime\n" + "\n".join(lines), newline="\r\n")
    (tmp_path / "R0002_FileTimestampLog.csv").write_text("\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        started = time.monotonic()
        rows = tables.read_field_logs(spark, str(tmp_path)).collect()
        heads = listed(tables.read_log_headers(spark, str(tmp_path)))
        assert time.monotonic() - started < 120
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(i + 2, f'{i}\r\n"x"' if i % 7 == 0 else str(i), str(i)) for i in range(60_000)}
    assert len(rows) == 60_000 and {(r.row_number, r.Deployment, r.EndTime) for r in rows} == want
    assert heads == [("R0001", "Deployment,StartDate,StartTime,EndDate,EndTime"), ("R0002", None)]


def test_export_cells_hold_json_and_line_breaks(spark, tmp_path):
    cell = '[{"task":"T0","value":[{"choice":"A","answers":{"NOTE":"two\nlines"}}]}]'
    with open(tmp_path / "export.csv", "w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow([f.name for f in tables.schema.EXPORT])
        writer.writerow(["1", "u", "", "29186", "w, x", "1", "[5]", '{"5": {"filename": "7_x_d_x_f"}}', cell])
    read = tables.read_export(spark, str(tmp_path / "export.csv"))
    assert read.count() == 1 and read.first()["annotations"] == cell
    from fieldlens.operators.consensus import classification_table

    row = classification_table(read).first()
    assert (row["sid"], row["media_id"], row["workflow_key"]) == (5, "7", "29186:w, x:1")


def test_export_in_byte_ranges_equals_whole_files(spark, tmp_path):
    """Records over many ranges, cells larger than a range, and files that end without a line feed."""
    draw = random.Random(4)
    names = tables.schema.EXPORT.names
    folder = tmp_path / "exports"
    folder.mkdir()
    truth = []
    for n, end in ((0, "\n"), (1, "\r\n"), (2, "\n")):
        with open(folder / f"e{n}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerow(names)
            for i in range(400):
                cells = ["".join(draw.choices(['"', "\n", "\r\n", ",", "a", "é", " ", "{}"], k=draw.choice([0, 1, 5, 30]))) for _ in names]
                cells[-1] += "x\n" * 900 if i % 100 == 7 else ""
                writer.writerow([f"{n}-{i}", *cells[1:]])
                truth.append((f"{n}-{i}", *(c or None for c in cells[1:])))
        if n == 2:
            (folder / "e2.csv").write_bytes((folder / "e2.csv").read_bytes().removesuffix(b"\n"))
    want = listed(spark.createDataFrame(truth, tables.schema.EXPORT))
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("lineSep", "\n")
    # The reader of whole files takes line feeds as they are where it is told that they end lines.
    plain = reader.schema(tables.schema.EXPORT).csv(str(folder / "e0.csv"))
    assert listed(plain) == [w for w in want if w[0].startswith("0-")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "20000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            read = tables.read_export(spark, str(folder))
            got = listed(read)
            assert len(got) == 1200 and got == want
            if size == "20000":
                assert tables._lines(spark, str(folder)).select("file", "block").distinct().count() >= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a\n" * 100_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        lines = tables._lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert lines.select("block").distinct().count() == 200 and lines.count() == 100_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ledger_and_tables(spark, tmp_path):
    (tmp_path / "done.txt").write_text(" a/b \n\n   \nc\n")
    assert listed(tables.read_ledger(spark, str(tmp_path / "done.txt"))) == [("a/b",), ("c",)]
    (tmp_path / "t.csv").write_text("pk,name\n1,x\n")
    assert listed(tables.read_table(spark, str(tmp_path / "t.csv"), "pk int, name string", "csv")) == [(1, "x")]


def test_form_pages(spark, tmp_path):
    page = {"meta": {"current_page": 1, "last_page": 1}, "data": {"entries": [{"a": "1", "b": ["x", "y"]}, {"a": "2", "b": ["z"]}]}}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    from fieldlens.operators.forms import entries_of_pages, select_entries

    pages = tables.read_form_pages(spark, str(tmp_path), "struct<a:string,b:array<string>>")
    entries = entries_of_pages(pages)
    assert listed(select_entries(entries, ["a>=1"], ["b", "c"])) == [("x:::y", None), ("z", None)]


def test_reports(spark, tmp_path):
    made = spark.createDataFrame(
        [("1", "i", "a", "error", None, {"k": "v"}, datetime(2024, 1, 1)), ("2", "i", "a", "success", "m", {}, datetime(2024, 1, 2))],
        tables.schema.FINDINGS,
    )
    store = str(tmp_path / "store")
    sinks.write_findings(made.where("run_id = '1'"), store)
    sinks.write_findings(made.where("run_id = '2'"), store)
    back = tables.read_reports(spark, store)
    assert back.count() == 2 and tables.latest_report(back).first()["run_id"] == "2"
    catalogue = tables.report_catalogue(back).collect()
    assert [(r["run_id"], r["status"]) for r in catalogue] == [("2", "success"), ("1", "failed")]
    old = tables.reports_older_than(tables.report_catalogue(back), 60, F.lit("2024-03-01 12:00:00").cast("timestamp"))
    assert [r["run_id"] for r in old.collect()] == ["1"]


def test_unreadable_report_shows_as_an_error_row(spark, tmp_path):
    row = {"run_id": "1", "identifier": "i", "action": "a", "status": "success", "ts": "2024-01-01T00:00:00Z"}
    (tmp_path / "good.json").write_text(json.dumps(row) + "\n")
    (tmp_path / "bad.json").write_text("{broken\n")
    got = {r["file_name"]: r["status"] for r in tables.report_catalogue_json(spark, str(tmp_path)).collect()}
    assert got == {"good.json": "success", "bad.json": "error loading"}


def test_manifest_and_tables_are_foldered(spark, tmp_path):
    summary = spark.createDataFrame(
        [("R1", f"d{i:02d}", "l", "s", "e", "cam") for i in range(20)],
        "collection string, deploymentID string, locationID string, deploymentStart string, deploymentEnd string, cameraModel string",
    )
    sinks.write_deployments(summary, str(tmp_path / "sum"))
    files = sorted((tmp_path / "sum" / "collection=R1").glob("*.csv"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert lines[0] == "deploymentID,locationID,deploymentStart,deploymentEnd,cameraModel"
    assert [line[:3] for line in lines if line.startswith("d") and not line.startswith("dep")] == [f"d{i:02d}" for i in range(20)]


def test_entry_rows_union_keys_in_order(spark):
    first = spark.createDataFrame([("1", 2.5)], "b string, a double")
    second = spark.createDataFrame([("3",)], "c string")
    rows = sinks.entry_rows([first, second])
    assert rows.columns == ["a", "b", "c"] and listed(rows) == [("", "", "3"), ("2.5", "1", "")]


def test_scratch_follows_the_session(spark):
    from fieldlens import session

    assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_list_tree_finds_empty_files_and_folders(spark, tmp_path):
    for folder in ("R0001/R0001-a/deep", "R0001/R0001-empty", "R0002"):
        (tmp_path / "tree" / folder).mkdir(parents=True)
    for file, content in (("R0001/R0001-a/1.jpg", b"abc"), ("R0001/R0001-a/deep/0.jpg", b""), ("x.txt", b"x")):
        (tmp_path / "tree" / file).write_bytes(content)
    root = str(tmp_path / "tree")
    found = tables.list_tree(spark, root)
    got = {(r.path.removeprefix(root + "/"), r.is_folder, r.size) for r in found.collect()}
    assert got == {
        ("R0001", True, None), ("R0002", True, None), ("x.txt", False, 1),
        ("R0001/R0001-a", True, None), ("R0001/R0001-empty", True, None),
        ("R0001/R0001-a/1.jpg", False, 3), ("R0001/R0001-a/deep", True, None), ("R0001/R0001-a/deep/0.jpg", False, 0),
    }
    files = tables.media_listing(found.where("not is_folder"), root)
    assert {(r.deployment, r.rel_path, r.size) for r in files.collect()} == {("R0001-a", "1.jpg", 3), ("R0001-a", "deep/0.jpg", 0)}
    (tmp_path / "nothing").mkdir()
    assert tables.list_tree(spark, str(tmp_path / "nothing")).isEmpty()


@pytest.fixture
def lines_folder(spark, tmp_path):
    """A folder with a lineitem table, whose rows become a classification export."""
    rows = spark.range(3000).selectExpr(
        "id AS l_orderkey", "id % 97 AS l_partkey", "id % 13 AS l_suppkey", "CAST(id % 7 + 1 AS int) AS l_linenumber",
        "CAST(id % 50 AS double) AS l_quantity", "CAST(id AS double) AS l_extendedprice",
        "CASE id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'A' ELSE 'R' END AS l_returnflag",
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def folders_of(spark, name):
    """Sizes of the scratch folders whose names begin so: path and bytes of data files."""
    root = Path(scratch_root(spark).removeprefix("file:"))
    return {p: sum(f.stat().st_size for f in p.glob("part-*")) for p in root.glob(f"{name}-*")}


def test_export_is_read_in_portions(spark, lines_folder, monkeypatch):
    """Of a table whose text would fill the disk one portion lies there at a time, and whole records are not stored."""
    before = {name: set(folders_of(spark, name)) for name in ("export", "record", "read-export")}
    whole = registry.QUERIES["s3_export_ranges"](spark, lines_folder)
    monkeypatch.setattr(source_queries, "_PORTION_ROWS", 700)
    got = registry.QUERIES["s3_export_ranges"](spark, lines_folder)
    text = F.concat("annotations", F.lit('\n"\n",')).alias("annotations")
    want = listed(Tables(spark, lines_folder).export.select("classification_id", text))
    assert listed(got) == want == listed(whole) and len(want) == 3000
    assert set(folders_of(spark, "export")) == before["export"]
    assert len(set(folders_of(spark, "read-export")) - before["read-export"]) == 1 + 5
    pieces = [p for p in folders_of(spark, "record") if p not in before["record"]]
    assert sum(spark.read.parquet(str(p)).count() for p in pieces) < 300


def test_export_file_is_compressed(spark, lines_folder):
    before = set(folders_of(spark, "export"))
    got = registry.QUERIES["s3_classification_export"](spark, lines_folder)
    want = Tables(spark, lines_folder).export
    assert listed(got) == listed(want.select(got.columns)) and got.count() == 3000
    (size,) = [size for path, size in folders_of(spark, "export").items() if path not in before]
    cells = want.select(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in got.columns))).first()[0]
    assert 0 < size < cells / 3
