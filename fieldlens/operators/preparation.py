"""Preparing deployments for the archive, and registering new ones in the field log."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens import schema
from fieldlens.functions import dates, filters, naming, parsing
from fieldlens.operators.findings import emit, finding
from fieldlens.operators.rules import existing_targets
from fieldlens.plans.ordered import ordered_rows

_KEYS = ("collection", "deployment")


def recorded_media(
    metadata: DataFrame, zone: str, *, ignore_dst: bool = False, fallback: bool = True
) -> DataFrame:
    """Media with the instant, wall time and offset they were recorded at, and the camera model."""
    text = dates.recorded_text(
        F.col("date_time_original"), F.col("create_date"), F.col("file_modify_date") if fallback else None
    )
    return metadata.withColumns(
        {
            **dates.recorded_at(text, zone, ignore_dst=ignore_dst),
            "camera": parsing.camera_model(F.col("make"), F.col("model")),
        }
    )


def numbered_files(
    media: DataFrame, *, sizes: DataFrame | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """Media with their 1-based place in the natural path order of their deployment."""
    keyed = media.withColumn("_key", naming.natural_key(F.col("rel_path")))
    rows = ordered_rows(keyed, _KEYS, ["_key", "rel_path"], sizes=sizes, chunk_rows=chunk_rows)
    return rows.extend(position="file_index").result().drop("_key")


def metadata_record(
    *,
    camera: Column,
    recorded: Column,
    mime: Column,
    identifier_hash: Column,
    source_hash: Column,
    project: str,
    owner: str,
    publisher: str,
    coverage: str,
    year: int,
    website: str = "",
) -> Column:
    """The archive's eleven metadata tags of a media file. The tag names are fixed values."""
    site = f" {website}" if website else ""
    return F.create_map(
        *[
            part
            for tag, value in (
                ("XMP-dc:Creator", F.concat(F.lit("CT ("), camera, F.lit(f" {project})"))),
                ("XMP-dc:Date", recorded),
                ("XMP-dc:Format", mime),
                ("XMP-dc:Identifier", F.concat(F.lit(f"{project}:"), identifier_hash)),
                ("XMP-dc:Source", F.concat(F.lit(f"{project}:"), source_hash)),
                ("XMP-dc:Publisher", F.lit(publisher)),
                ("XMP-dc:Rights", F.lit(f"© {owner}, {year}. All rights reserved.")),
                (
                    "XMP-dc:Coverage",
                    # Fixed value: the sentence is part of the archive's record.
                    F.lit(f"This image was taken at {coverage}, as part of the {project} project.{site}"),
                ),
                ("XMP-xmpRights:Marked", F.lit("true")),
                ("XMP-xmpRights:Owner", F.lit(owner)),
                ("XMP-xmpRights:WebStatement", F.lit("https://creativecommons.org/licenses/by-nc/4.0/")),
            )
            for part in (F.lit(tag), value)
        ]
    )


def deployment_summary(recorded: DataFrame, *, convert_to_utc: bool = True) -> DataFrame:
    """The deployments table: first and last date and the camera of the first file.

    recorded: (collection, deployment_id, file_index, instant, wall, offset_seconds, camera). One row per
    collection and deployment, for equal names occur in several collections. Files without a date do not
    count. Minimum, maximum and first are partial aggregates: nothing is sorted.
    """
    moment = F.col("instant").cast("timestamp_ntz") if convert_to_utc else F.col("wall")
    offset = F.lit(0) if convert_to_utc else F.col("offset_seconds")
    stamped = recorded.where(F.col("instant").isNotNull()).select(
        "collection", "deployment_id", "file_index", "instant", "camera", dates.stamp_text(moment, offset).alias("_text")
    )
    location = naming.location_of(F.col("deployment_id"))
    return stamped.groupBy("collection", "deployment_id").agg(
        F.min_by("_text", F.struct("instant", "file_index")).alias("deploymentStart"),
        F.max_by("_text", F.struct("instant", "file_index")).alias("deploymentEnd"),
        F.min_by("camera", "file_index").alias("cameraModel"),
    ).select(
        "collection",
        F.col("deployment_id").alias("deploymentID"),
        location.alias("locationID"),
        "deploymentStart",
        "deploymentEnd",
        "cameraModel",
    )


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """New rows replace old rows with the same key; other old rows stay. Keys are unique in ``new``."""
    key = [key] if isinstance(key, str) else list(key)
    kept = old.join(new.select(*key), key, "left_anti")
    return new.unionByName(kept.select(new.columns))


def prepare_deployments(
    metadata: DataFrame,
    *,
    zone: str,
    existing: DataFrame | None = None,
    collections: Iterable[str] | None = None,
    deployments: Iterable[str] | None = None,
    extensions: Iterable[str] = schema.MEDIA_EXTENSIONS,
    overwrite: bool = False,
    ignore_dst: bool = False,
    convert_to_utc: bool = True,
    tags: Mapping[str, str | int] | None = None,
    ascii_names: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Every media file with its archive name, dates and camera, and with ``tags`` its metadata record.

    Files without a readable date have no archive name; :func:`copy_errors` reports them. Deployments
    in ``existing`` (collection, deployment_id) are skipped unless ``overwrite``.
    """
    wanted = metadata.where(
        filters.in_list(F.col("collection"), collections)
        & filters.in_list(F.col("deployment"), deployments, ignore_case=True)
        & filters.in_list(naming.extension(F.col("rel_path")), extensions)
    )
    # The slug needs Python for non-ASCII names, so it is computed once per deployment.
    keys = ["collection", "deployment"]
    names = wanted.select(*keys).distinct().withColumn(
        "deployment_id", naming.slug(F.col("deployment"), ascii_input=ascii_names)
    )
    if existing is not None and not overwrite:
        names = names.join(existing.select("collection", "deployment_id"), ["collection", "deployment_id"], "left_anti")
    placed = numbered_files(wanted.join(names, keys), sizes=wanted, chunk_rows=chunk_rows)
    recorded = recorded_media(placed, zone, ignore_dst=ignore_dst)
    moment = F.col("instant").cast("timestamp_ntz") if convert_to_utc else F.col("wall")
    new_name = naming.archive_name(F.col("deployment_id"), moment, F.col("file_index"), F.col("rel_path"))
    result = recorded.withColumn("archive_name", new_name)
    if tags is not None:
        offset = F.lit(0) if convert_to_utc else F.col("offset_seconds")
        record = metadata_record(
            camera=F.col("camera"),
            recorded=dates.stamp_text(moment, offset),
            mime=F.col("mime_type"),
            identifier_hash=F.col("identifier_hash"),
            source_hash=F.col("source_hash"),
            **tags,
        )
        result = result.withColumn("tags", record)
    return result


def copy_errors(prepared: DataFrame) -> DataFrame:
    message = F.concat(F.col("rel_path"), F.lit(": no valid date found in metadata"))
    return emit(
        prepared, [finding(F.col("instant").isNull(), F.col("deployment_id"), "copy error", "error", message)]
    )


def preparation_findings(
    prepared: DataFrame, targets: DataFrame, existing: DataFrame, *, overwrite: bool = False
) -> DataFrame:
    """Skipped targets, files without date, and one success per deployment with an exported file."""
    exported = prepared.groupBy("collection", "deployment_id").agg(F.count("instant").alias("_copied"))
    done = emit(
        exported, [finding(F.col("_copied") > 0, F.col("deployment_id"), "deployment exported", "success")]
    )
    blocked = existing_targets(targets, existing, overwrite=overwrite)
    return blocked.unionByName(copy_errors(prepared)).unionByName(done)


# --- registration ---


def log_rows(recorded: DataFrame) -> DataFrame:
    """Field-log rows of new deployments: first and last wall time of their media."""
    span = recorded.where(F.col("wall").isNotNull()).groupBy("collection", "deployment").agg(
        F.min("wall").alias("_start"), F.max("wall").alias("_end")
    )

    def cells(moment: str, day: str, time: str) -> list[Column]:
        return [
            F.date_format(moment, "yyyy:MM:dd").alias(day),
            F.date_format(moment, "HH:mm:ss").alias(time),
        ]

    return span.select(
        "collection",
        F.col("deployment").alias("Deployment"),
        *cells("_start", "StartDate", "StartTime"),
        *cells("_end", "EndDate", "EndTime"),
    )


def _name_key(column: str) -> Column:
    return F.upper(F.trim(column))


def insert_if_absent(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with the new rows whose names it does not hold in any letter case. Blank names go."""
    held = log.where(F.trim("Deployment") != "")
    keys = held.select("collection", _name_key("Deployment").alias("_name")).distinct()
    fresh = new.withColumn("_name", _name_key("Deployment")).join(keys, ["collection", "_name"], "left_anti")
    return held.select(new.columns).unionByName(fresh.select(new.columns))


def registration_findings(log: DataFrame, new: DataFrame) -> DataFrame:
    keys = log.select("collection", _name_key("Deployment").alias("_name")).distinct()
    rows = new.withColumn("_name", _name_key("Deployment")).join(
        keys.withColumn("_held", F.lit(True)), ["collection", "_name"], "left"
    )
    held, who = F.col("_held").isNotNull(), F.col("Deployment")
    return emit(
        rows,
        [
            finding(held, who, "csv_log", "error", F.lit("Deployment already in the log; no row was added.")),
            finding(~held, who, "csv_log", "success", F.lit("Row added to the log.")),
        ],
    )


def register_deployments(
    metadata: DataFrame, log: DataFrame, *, zone: str, ignore_dst: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The field log with rows for new deployments, and the findings of doing so."""
    recorded = recorded_media(metadata, zone, ignore_dst=ignore_dst)
    new = log_rows(recorded)
    undated = recorded.groupBy("deployment").agg(F.count("instant").alias("_dated"))
    message = F.lit("None of the files has a date.")
    missing = emit(undated, [finding(F.col("_dated") == 0, F.col("deployment"), "csv_log", "error", message)])
    return insert_if_absent(log, new), registration_findings(log, new).unionByName(missing)
