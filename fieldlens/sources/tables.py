"""Readers: media trees, field logs, exports, form pages, ledgers, package listings, stored reports."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens import schema
from fieldlens.functions import naming
from fieldlens.session import stored


def media_listing(paths: DataFrame, root: str = "", *, direct_children: bool = False) -> DataFrame:
    """Collection, deployment and relative path from a table with a ``path`` column.

    The first two levels below ``root`` are collection and deployment; files lie at any depth below,
    or only directly there with ``direct_children``.
    """
    relative = F.regexp_replace("path", "^" + "".join("\\" + c if not c.isalnum() else c for c in root), "")
    form = r"^/*([^/]+)/([^/]+)/(.+)$"
    rows = paths.withColumn("_relative", relative).where(F.col("_relative").rlike(form))

    def part(number: int):
        return F.regexp_extract("_relative", form, number)

    rows = rows.withColumns({"collection": part(1), "deployment": part(2), "rel_path": part(3)})
    if direct_children:
        rows = rows.where(~F.col("rel_path").contains("/"))
    name = naming.base_name(F.col("rel_path"))
    return rows.withColumns({"file_name": name, "ext": naming.extension(name)}).drop("_relative")


def read_media(spark: SparkSession, root: str, *, with_hash: bool = False) -> DataFrame:
    """Media inventory of a directory tree.

    The content is read only when hashes are asked for, and never leaves the scan. Spark's file readers
    pass over files of zero bytes; where those matter, use :func:`media_listing` on a listing table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    if with_hash:
        digest = F.sha1("content")
        columns += [digest.alias("hash"), naming.content_path(digest).alias("hash_path")]
    base = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    clean = root.split(":", 1)[-1].rstrip("/")
    listing = media_listing(files.select(*columns).withColumn("path", base), "/" + clean.lstrip("/"))
    return listing.drop("path")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files and folders below a folder, empty ones too: path, is_folder, size and mtime.

    Folders are listed by tasks, one level of the tree after the other, through the file system that pyarrow finds
    for ``root`` (local, HDFS, S3, GCS), which executors must reach. Each level is stored, so its listing is not
    repeated. Files below ``path`` feed :func:`media_listing`; size and mtime of folders are null.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = files.get_file_info(fs.FileSelector(folder))
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    folders = [i.type == fs.FileType.Directory for i in some]
                    columns = [
                        pa.array([i.path for i in some], pa.string()), pa.array(folders, pa.bool_()),
                        pa.array([None if f else i.size for i, f in zip(some, folders)], pa.int64()),
                        pa.array([None if f else i.mtime for i, f in zip(some, folders)], pa.timestamp("us", "UTC")),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "is_folder", "size", "mtime"])

    _, top = fs.FileSystem.from_uri(root)
    columns = "path string, is_folder boolean, size bigint, mtime timestamp"
    level = spark.createDataFrame([(top,)], "path string")
    levels = []
    while True:
        listed = stored(level.mapInArrow(task, columns), "listing")
        levels.append(listed)
        folders = listed.where("is_folder").select("path")
        if folders.isEmpty():
            break
        level = folders.repartition("path")
    return reduce(DataFrame.unionByName, levels)


_LOG_FILES = "*_FileTimestampLog.csv"
# Followed by whole quoted parts only, so itself outside quotes.
_CSV_COMMA = r',(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cell lists of the records of every field-log file, numbered from 1 (the header): file, collection, number, cells.

    Blank lines are dropped as csv readers do; a line break inside quotes belongs to its cell. Files are read in byte
    ranges, see :func:`export_records`; a file without any record has one row, whose number is null.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": _LOG_FILES}
    records = stored(export_records(spark, path, options), "log-records")
    # A prefix sum over the ranges of each file.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = records.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    name = F.regexp_replace(F.col("_metadata.file_name"), "_FileTimestampLog\\.csv$", "")
    files = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("file"), name.alias("collection"))
    plain = F.transform(F.split("record", _CSV_COMMA), lambda c: F.regexp_replace(c, '(?s)^"|"$', ""))
    numbered = records.join(before, ["file", "block"]).select(
        "file",
        (F.col("_before") + F.col("number") + 1).alias("number"),
        F.transform(plain, lambda c: F.regexp_replace(c, '""', '"')).alias("cells"),
    )
    return files.distinct().join(numbered, "file", "left")


def read_log_headers(spark: SparkSession, path: str) -> DataFrame:
    """Column names of every field log. ``read.csv`` would rename repeated columns and hide them."""
    first = _log_lines(spark, path).where("coalesce(number, 1) = 1")
    return first.select("collection", F.array_join("cells", ",").alias("header"))


def read_field_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of all field-log files below a path: collection, row number (header is 1), five cells.

    Cells are found by the header's names, whatever their order.
    """
    lines = _log_lines(spark, path)
    headers = lines.where("number = 1").select("file", F.col("cells").alias("_header"))
    rows = lines.where("number > 1").join(headers, "file")

    def cell(name: str):
        place = F.array_position("_header", name).cast("int")
        return F.when(place > 0, F.try_element_at("cells", F.greatest(place, F.lit(1)))).alias(name)

    return rows.select("collection", F.col("number").alias("row_number"), *[cell(name) for name in schema.LOG_FIELDS])


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    """Field logs as the log sink stores them, foldered by collection."""
    columns = T.StructType(list(schema.LOG.fields)).add("collection", "string")
    return spark.read.schema(columns).option("header", "true").csv(path)


_QUOTE = '"'
_EXPORT_OPTIONS = {"escape": _QUOTE, "multiLine": "true", "lineSep": "\n"}


# A task reads as many small byte ranges, one after the other, as lie in so many bytes.
_TASK_BYTES = 1 << 25


def _lines(spark: SparkSession, path: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Lines of text files with the byte range they lie in: file, block and value, in order inside a range."""
    lines = spark.read.options(**(options or {})).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    size = re.fullmatch(r"(\d+)b?", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    together = _TASK_BYTES // max(int(size[1]), 1) if size else 1
    if together > 1:
        tasks = max(ceil(lines.rdd.getNumPartitions() / together), spark.sparkContext.defaultParallelism)
        lines = lines.coalesce(tasks)
    return lines


def _open_blocks(lines: DataFrame) -> DataFrame:
    """Per byte range that begins or ends inside quotes: file, block, ``begins`` and ``ends`` (0 or 1)."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(_QUOTE), F.lit("")))
    ranges = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    # One row per range; a prefix sum over the ranges of each file.
    upto = F.sum("odd").over(Window.partitionBy("file").orderBy("block"))
    return ranges.select("file", "block", (((upto - F.col("odd")) % 2)).alias("begins"), (upto % 2).alias("ends")).where("begins + ends > 0")


def _records(lines: DataFrame, known: dict[tuple[str, int], tuple[int, int]], pieces: bool = False) -> DataFrame:
    """Records of byte ranges: file, block, number, kind, head and record; blank ones are left out.

    ``number`` counts, from 0, the records that begin in the range. kind 0 is a whole record; 1 ends one of an earlier range; 2 begins one that goes on; 3 is a range inside
    one record. ``head`` marks the first of a file. ``known`` tells for ranges that begin or end inside quotes
    whether they do. With ``pieces`` kinds 1 to 3 come, else kind 0.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[str, int] | None = None
        held: list[str] = []  # lines of the record that is open
        inside = begun = head = False
        number = 0

        def rows(kind: int, records: pa.Array, number: int, head: bool) -> Iterator[pa.RecordBatch]:
            n = len(records)
            if n and pieces == (kind > 0):
                columns = [
                    pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(pa.scalar(key[1], pa.int64()), n),
                    pa.array(np.arange(number, number + n)), pa.repeat(pa.scalar(kind, pa.int32()), n),
                    pa.array(np.arange(n) < head), records,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "number", "kind", "head", "record"])

        def one(kind: int) -> Iterator[pa.RecordBatch]:
            """The record whose lines are held."""
            nonlocal number, head
            record = "\n".join(held)
            record = record.removesuffix("\r") if kind < 2 else record  # at the end of a line, not of a piece
            held.clear()
            if record or kind:
                yield from rows(kind, pa.array([record], pa.string()), number, head)
                head = False
                number += kind in (0, 2)

        for batch in batches:
            file, block, value = batch.columns
            value = value.cast(pa.string())
            odd = pc.count_substring(value, _QUOTE).to_numpy(zero_copy_only=False) % 2
            same = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(~same) + 1), len(value)] if len(value) else [0]
            for low, high in zip(edges, edges[1:]):
                if (here := (file[low].as_py(), block[low].as_py())) != key:
                    if held:
                        yield from one(3 if begun else 2)
                    key, head, number = here, here[1] == 0, 0
                    inside = begun = bool(known.get(key, (0, 0))[0])
                state = (np.cumsum(odd[low:high]) + inside) % 2  # 1 after a line that ends inside quotes
                ends = np.flatnonzero(state == 0) + low + 1
                inside = bool(state[-1])
                if len(ends):
                    held += value[low : ends[0]].to_pylist()
                    yield from one(1 if begun else 0)
                    begun = False
                    grouped = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value)
                    records = pc.binary_join(grouped, "\n")
                    records = pc.if_else(pc.ends_with(records, "\r"), pc.utf8_slice_codeunits(records, 0, -1), records)
                    records = records.filter(pc.not_equal(records, ""))
                    yield from rows(0, records, number, head)
                    head &= not len(records)
                    number += len(records)
                    low = ends[-1]
                held += value[low:high].to_pylist()
        if held:
            yield from one(3 if begun else 2)

    return lines.mapInArrow(task, "file string, block bigint, number bigint, kind int, head boolean, record string")


def export_records(spark: SparkSession, path: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Records of quoted CSV files, whose cells may hold line breaks, as texts: file, block, number, head, record.

    Files are read in byte ranges, by as many tasks as the reader makes of them. One pass counts quotes: by
    their number before it, a range begins inside a cell or not. Ranges then cut their records at the line
    ends outside quotes. Where any range begins or ends inside a cell, the pieces of records that lie in several ranges are
    found first, stored and put together, one group per such record; whole records are read again and never stored. ``block`` is the range a record begins in,
    ``number`` its place there, from 0; ``head`` marks the first record of a file. Lines end with a line feed, with
    or without a carriage return before it; blank records are left out. Quotes stand around cells and doubled
    inside them, and nowhere else. ``options`` are the reader's, for the choice of files.
    """
    lines = _lines(spark, path, options)
    blocks = stored(_open_blocks(lines), "open-ranges")
    known = {(r.file, r.block): (r.begins, r.ends) for r in blocks.collect()}  # a row per byte range at most
    whole = _records(lines, known).select("file", "block", "number", "head", "record")
    if not known:
        return whole
    pieces = stored(_records(lines, known, pieces=True), "record-pieces")
    # A record's pieces: the one that begins it, ranges inside it, and the one that ends it.
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == 1, 0).otherwise(1))
    started = F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(order)
    together = pieces.withColumn("_record", started).groupBy("file", "_record").agg(
        F.min("block").alias("block"), F.min_by("number", "block").alias("number"), F.max("head").alias("head"),
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("_pieces"),
    )
    record = F.array_join(F.transform("_pieces", lambda p: p["record"]), "\n").alias("record")
    return whole.unionByName(together.select("file", "block", "number", "head", record))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Classification export: CSV whose cells hold JSON with doubled quotes and line breaks.

    One file is read by many tasks, see :func:`export_records`; cells are the same as by a reader of whole
    files. The first record of every file is its header.
    """
    columns = ", ".join(f"{name} string" for name in schema.EXPORT.names)
    data = export_records(spark, path).where("not head")
    return data.select(F.from_csv("record", columns, _EXPORT_OPTIONS).alias("_row")).select("_row.*")


def read_table(spark: SparkSession, path: str, columns: str, kind: str = "parquet") -> DataFrame:
    """An entity table with a declared schema."""
    reader = spark.read.schema(columns).format(kind)
    return (reader.option("header", "true") if kind == "csv" else reader).load(path)


def read_form_pages(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Pages of form entries; ``entry`` is the struct type of one entry."""
    page = (
        "errors array<struct<title:string>>, "
        f"meta struct<current_page:int,last_page:int>, data struct<entries:array<{entry}>>"
    )
    return spark.read.schema(page).json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Paths already handled: one per line, trimmed, blanks dropped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("path")).where("path != ''")


def package_listing(paths: DataFrame) -> DataFrame:
    """Package files among listed paths: (file_name, bytes)."""
    name = naming.base_name(F.col("path"))
    listed = paths.select(name.alias("file_name"), F.col("size").alias("bytes"))
    return listed.where(F.col("file_name").rlike(r"\.(yaml|zip)$"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.FINDINGS).option("basePath", path).parquet(path)


def report_catalogue(findings: DataFrame) -> DataFrame:
    """Stored reports, newest first, with times, totals and status."""
    from fieldlens.operators.findings import summarise

    columns = ["run_id", "start_time", "end_time", "total_errors", "total_successes", "status"]
    return summarise(findings).select(columns).orderBy(F.desc("end_time"), "run_id")


def report_catalogue_json(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of findings stored as JSON lines; unreadable lines show as an error row per file."""
    rows = (
        spark.read.schema(T.StructType(list(schema.FINDINGS.fields)).add("_corrupt_record", "string"))
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    status = F.col("status")
    counted = rows.groupBy("_file").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count_if(status == "error").alias("_errors"),
        F.count_if(status == "success").alias("_successes"),
        F.count("_corrupt_record").alias("_broken"),
    )
    from fieldlens.operators.findings import report_status

    derived = report_status(F.col("_errors") > 0, F.col("_successes") > 0)
    return counted.select(
        F.substring_index("_file", "/", -1).alias("file_name"),
        "start_time",
        "end_time",
        F.when(F.col("_broken") > 0, "error loading").otherwise(derived).alias("status"),
    ).orderBy(F.desc("end_time"), "file_name")


def latest_report(findings: DataFrame) -> DataFrame:
    """The run that ended last; the larger id wins a tie."""
    return findings.agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"), F.max("ts").alias("end_time"))


def reports_older_than(catalogue: DataFrame, days: int, now) -> DataFrame:
    """Reports that ended more than ``days`` before ``now``, a timestamp column."""
    return catalogue.where(F.col("end_time") < now - F.make_dt_interval(days=F.lit(days)))


def listed_reports(catalogue: DataFrame) -> DataFrame:
    return catalogue.where("NOT archived")
