"""Validation rules and the two check jobs. Every rule yields findings rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens import schema
from fieldlens.functions import dates, filters, naming
from fieldlens.operators.findings import emit, finding
from fieldlens.plans.ordered import ordered_rows
from fieldlens.session import stored


def _c() -> Column:
    return F.col("collection")


def _d() -> Column:
    return F.col("deployment")


def _id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


# --- names ---


def check_collection_names(collections: DataFrame) -> DataFrame:
    """One finding per collection: its name has the fixed form, or not."""
    ok = naming.collection_name_ok(_c())
    action = "validate_collection_names"
    wrong = F.concat(F.lit("Collection '"), _c(), F.lit("' is not named R and four digits."))
    return emit(
        collections.select("collection"),
        [finding(ok, _c(), action, "success"), finding(~ok, _c(), action, "error", wrong)],
    )


def check_deployment_names(
    deployments: DataFrame,
    locations: DataFrame | None = None,
    *,
    validate_locations: bool = True,
    legacy: bool = False,
) -> DataFrame:
    """Name findings of deployments with at least one file.

    ``deployments`` holds (collection, deployment, n_files). The first failing test of form, collection
    prefix and location decides; a wrong prefix adds a second finding under the bare name. By default
    the collection code (text before an underscore) is compared and the location is everything after
    the first dash in any letter case; ``legacy`` compares the whole collection name, takes the text
    up to the second dash and leaves the case of known locations alone.
    """
    location = F.lower(naming.location_of(_d(), legacy=legacy))
    code = _c() if legacy else F.substring_index(_c(), "_", 1)
    prefix = naming.name_prefix(_d())
    prefix_ok = F.lower(prefix) == F.lower(code)
    rows = deployments.where("n_files > 0").select(
        "collection", "deployment", location.alias("_location")
    )
    location_ok = F.lit(True)
    if validate_locations and locations is not None:
        known = F.col("location_id") if legacy else F.lower("location_id")
        known = locations.select(known.alias("_location")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "_location", "left")
        location_ok = F.coalesce("_known", F.lit(False))
    action, who = "validate_deployment_names", _id(_c(), _d())
    form_ok = naming.deployment_name_ok(_d())
    form_message = F.lit(
        "Expected a name like CODE-NAME_SUFFIX."
    )
    prefix_message = F.concat(F.lit("Name should begin with "), code)
    location_message = F.concat(
        F.lit("Unknown location '"), F.col("_location"), F.lit("'.")
    )
    bare_message = F.concat(
        F.lit("Prefix "), prefix, F.lit(" is not that of collection "), _c()
    )
    return emit(
        rows,
        [
            finding(~form_ok, who, action, "error", form_message),
            finding(form_ok & ~prefix_ok, who, action, "error", prefix_message),
            finding(form_ok & prefix_ok & ~location_ok, who, action, "error", location_message),
            finding(form_ok & prefix_ok & location_ok, who, action, "success", F.lit("Name accepted.")),
            finding(~prefix_ok, _d(), action, "error", bare_message),
        ],
        keep=["collection", "deployment"],
    )


def check_collections(
    collections: DataFrame,
    deployments: DataFrame,
    locations: DataFrame | None = None,
    *,
    only: Iterable[str] | None = None,
    validate_locations: bool = True,
    legacy: bool = False,
) -> DataFrame:
    """All name findings of collections and their deployments."""
    wanted = filters.in_list(_c(), only)
    named = check_collection_names(collections.where(wanted))
    placed = check_deployment_names(
        deployments.where(wanted), locations, validate_locations=validate_locations, legacy=legacy
    )
    return named.unionByName(placed.select(named.columns))


# --- field log ---


def check_log_headers(headers: DataFrame) -> DataFrame:
    """Header findings of field logs, from (collection, header), the raw first lines."""
    clean = F.regexp_replace("header", "^\ufeff", "")
    rows = headers.withColumn("_fields", F.split(F.regexp_replace(clean, r"[\r\n]", ""), ","))
    names = F.transform("_fields", lambda c: F.regexp_replace(c, '^"|"$', ""))
    rows = rows.withColumn("_fields", names)
    required = F.array(*[F.lit(f) for f in schema.LOG_FIELDS])
    missing = F.array_except(required, F.col("_fields"))
    repeated = F.array_sort(
        F.array_distinct(
            F.filter("_fields", lambda c: F.size(F.filter("_fields", lambda d: d == c)) > 1)
        )
    )
    empty = F.coalesce(F.trim(clean) == "", F.lit(True))
    return emit(
        rows,
        [
            finding(empty, _c(), "log header", "error", F.lit("Header is empty")),
            finding(
                ~empty & (F.size(repeated) > 0), _c(), "log header", "error",
                F.concat(F.lit("Columns named twice: "), F.array_join(repeated, ", ")),
            ),
            finding(
                ~empty & (F.size(missing) > 0), _c(), "log header", "error",
                F.concat(F.lit("Columns not there: "), F.array_join(missing, ", ")),
            ),
        ],
    )


def missing_columns(headers: DataFrame) -> DataFrame:
    """Required columns that the headers (collection, header) lack: collection, name."""
    required = F.array(*[F.lit(f) for f in schema.LOG_FIELDS])
    rows = headers.where("header <> ''")
    return rows.select("collection", F.explode(F.array_except(required, F.split("header", ","))).alias("name"))


def repeated_columns(headers: DataFrame) -> DataFrame:
    """Columns that a header names more than once: collection, name, n."""
    names = headers.where("header <> ''").select("collection", F.explode(F.split("header", ",")).alias("name"))
    return names.groupBy("collection", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def empty_folders(deployments: DataFrame) -> DataFrame:
    """Deployment folders without a file, from (collection, deployment, n_files)."""
    return deployments.where("n_files = 0").select("collection", "deployment")


def read_log_rows(log: DataFrame) -> DataFrame:
    """Trimmed cells and parsed times of log rows (collection, row_number, five text columns)."""
    cells = {f: F.trim(F.coalesce(f, F.lit(""))) for f in schema.LOG_FIELDS}
    return log.withColumns(cells).withColumns(
        {
            "deployment": F.col("Deployment"),
            "expected_start": dates.log_time(F.col("StartDate"), F.col("StartTime")),
            "expected_end": dates.log_time(F.col("EndDate"), F.col("EndTime")),
        }
    )


def log_faults(log: DataFrame) -> DataFrame:
    """Log rows with ``fault``: the first rule each breaks, or null.

    A name that occurs again in its collection counts as repeated on every row but the first. The
    first rows come from an aggregate, so a name repeated very often is not sorted in one task.
    """
    rows = read_log_rows(log)
    complete = F.forall(F.array(*schema.LOG_FIELDS), lambda c: c != "")
    repeated = (
        rows.where(complete)
        .groupBy("collection", F.col("deployment"))
        .agg(F.min("row_number").alias("_first_row"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    rows = rows.join(repeated, ["collection", "deployment"], "left")
    fault = (
        F.when(~complete, "missing value")
        .when(F.col("row_number") > F.col("_first_row"), "duplicate deployment")
        .when(F.col("expected_start").isNull() | F.col("expected_end").isNull(), "invalid datetime")
        .when(F.col("expected_start") >= F.col("expected_end"), "start not before end")
    )
    return rows.withColumn("fault", fault).drop("_first_row")


def check_log_rows(log: DataFrame) -> DataFrame:
    """One finding per faulty log row, identified by collection and row number."""
    return _fault_findings(log_faults(log))


def _fault_findings(faults: DataFrame) -> DataFrame:
    broken = faults.where(F.col("fault").isNotNull())
    who = _id(_c(), F.col("row_number").cast("string"))
    return broken.select(
        "collection",
        "row_number",
        who.alias("identifier"),
        F.lit("read log").alias("action"),
        F.lit("error").alias("status"),
        F.concat_ws(" ", F.col("fault"), F.col("deployment")).alias("message"),
    )


def first_log_fault(log: DataFrame) -> DataFrame:
    """The fault a strict reader would stop at: the first by row number per collection."""
    broken = log_faults(log).where(F.col("fault").isNotNull())
    return broken.groupBy("collection").agg(
        F.min("row_number").alias("row_number"), F.min_by("fault", "row_number").alias("fault")
    )


def valid_log(log: DataFrame) -> DataFrame:
    return _without_fault(log_faults(log))


def _without_fault(faults: DataFrame) -> DataFrame:
    return faults.where(F.col("fault").isNull()).select("collection", "deployment", "expected_start", "expected_end")


def collections_without_log(collections: DataFrame, logs: DataFrame) -> DataFrame:
    missing = collections.select("collection").distinct().join(
        logs.select("collection").distinct(), "collection", "left_anti"
    )
    message = F.concat(F.lit("Field log is missing: "), _c(), F.lit("_FileTimestampLog.csv"))
    return emit(missing, [finding(F.lit(True), _c(), "check filetimestamplog", "error", message)])


def logged_without_folder(log: DataFrame, deployments: DataFrame) -> DataFrame:
    """Deployments the log names for which there is no folder. Unlogged folders are not reported."""
    keys = ["collection", "deployment"]
    missing = log.select(keys).distinct().join(deployments.select(keys).distinct(), keys, "left_anti")
    message = F.concat(F.lit("No folder for deployment '"), _d(), F.lit("'"))
    return emit(missing, [finding(F.lit(True), _id(_c(), _d()), "missing deployment", "error", message)], keep=keys)


# --- media dates ---


def _hours(value: float) -> Column:
    return F.make_dt_interval(hours=F.lit(int(value)), secs=F.lit((value % 1) * 3600).cast("decimal(18,6)"))


def media_findings(
    media: DataFrame,
    log: DataFrame,
    *,
    tolerance_hours: float = 1,
    extensions: Iterable[str] = schema.MEDIA_EXTENSIONS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Metadata, order and range findings of the media of logged deployments.

    ``media`` holds (collection, deployment, rel_path, taken, error). Files are taken in natural path
    order. A file with an error is reported and otherwise ignored, though it counts for the first and
    last position. The date is compared with the nearest earlier file without an error; when that
    file has no date there is nothing to compare with. One window pass serves all three rules.
    """
    named = media.where(filters.in_list(naming.extension(F.col("rel_path")), extensions))
    dated = named.join(log, ["collection", "deployment"]).withColumn(
        "_key", naming.natural_key(F.col("rel_path"))
    )
    rows = ordered_rows(
        dated, ["collection", "deployment"], ["_key", "rel_path"], sizes=named, chunk_rows=chunk_rows
    ).extend(
        position="position",
        total="_files",
        previous_where={"_previous": (F.col("taken"), F.col("error").isNull())},
    )
    taken, tolerance = F.col("taken"), _hours(tolerance_hours)
    start, end = F.col("expected_start"), F.col("expected_end")
    first = F.col("position") == 1
    last = ~first & (F.col("position") == F.col("_files"))
    low = F.when(last, end - tolerance).otherwise(start - tolerance)
    high = F.when(first, start + tolerance).otherwise(end + tolerance)
    readable = F.col("error").isNull()
    file_name = naming.base_name(F.col("rel_path"))
    who = _id(_c(), _d(), file_name)
    return emit(
        rows.result(),
        [
            finding(~readable, who, "gather_metadata", "error", F.concat(F.lit("Metadata could not be read: "), F.col("error"))),
            finding(
                readable & (taken < F.col("_previous")), who, "date order", "error",
                F.concat(F.lit("Image '"), file_name, F.lit("' is older than the one before it.")),
            ),
            finding(
                readable & ~taken.between(low, high), who, "image date out of range", "error",
                F.concat(F.lit("Image '"), file_name, F.lit("' was taken outside the logged dates")),
            ),
        ],
        keep=["collection", "deployment", "rel_path"],
    )


def validated_deployments(log: DataFrame, deployments: DataFrame, errors: DataFrame) -> DataFrame:
    """A success finding for every logged deployment with a folder and no error of any kind."""
    keys = ["collection", "deployment"]
    clean = (
        log.select(keys)
        .join(deployments.select(keys).distinct(), keys, "left_semi")
        .join(errors.select(keys).distinct(), keys, "left_anti")
    )
    message = F.concat(F.lit("Deployment '"), _d(), F.lit("' passed all checks."))
    return emit(
        clean, [finding(F.lit(True), _id(_c(), _d()), "deployment validated", "success", message)], keep=keys
    )


def check_deployments(
    deployments: DataFrame,
    log: DataFrame,
    media: DataFrame,
    *,
    collections: Iterable[str] | None = None,
    only: Sequence[str] | None = None,
    tolerance_hours: float = 1,
    extensions: Iterable[str] = schema.MEDIA_EXTENSIONS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """All findings of the field log, the folders it names and the dates of their media.

    deployments: (collection, deployment), one row per folder; log: raw log rows with collection and
    row_number; media: (collection, deployment, rel_path, taken, error). Log and folders are read and
    judged once and stored as narrow tables, which all findings are taken from.
    """
    wanted = filters.in_list(_c(), collections)
    deployments, log, media = deployments.where(wanted), log.where(wanted), media.where(wanted)
    named = filters.in_list(_d(), only)
    keys, columns = ["collection", "deployment"], ["identifier", "action", "status", "message"]
    faults = log_faults(log).select(*keys, "row_number", "expected_start", "expected_end", "fault")
    faults = stored(faults, "log-faults")
    deployments = stored(deployments.select(keys).distinct(), "folders")
    logged = _without_fault(faults).where(named)
    no_log = collections_without_log(deployments, faults)
    bad_rows = _fault_findings(faults)
    missing = logged_without_folder(logged, deployments)
    dated = media_findings(
        media.where(named), logged, tolerance_hours=tolerance_hours, extensions=extensions, chunk_rows=chunk_rows
    )
    # The findings are few; stored, they serve twice and the media are read and sorted once.
    dated = stored(dated, "media-findings")
    valid = validated_deployments(logged, deployments, dated.select(keys))
    parts = [no_log, bad_rows, missing, dated, valid]
    result = parts[0].select(columns)
    for part in parts[1:]:
        result = result.unionByName(part.select(columns))
    return result


# --- remaining rules ---


def existing_targets(prepared: DataFrame, existing: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """Deployments whose target already holds files and must not be overwritten.

    Both tables hold (collection, deployment_id): a target lies in its collection's folder.
    """
    keys = ["collection", "deployment_id"]
    blocked = prepared.select(keys).distinct()
    if overwrite:
        blocked = blocked.where(F.lit(False))
    else:
        blocked = blocked.join(existing.select(keys).distinct(), keys, "left_semi")
    dep = F.col("deployment_id")
    message = F.concat(F.lit("Target '"), dep, F.lit("' already exists and overwrite is off."))
    return emit(blocked, [finding(F.lit(True), dep, "existing deployment", "error", message)])


def without_timestamps(media: DataFrame) -> DataFrame:
    """Deployments none of whose media has a valid date."""
    counted = media.groupBy("deployment_id").agg(F.count("taken").alias("_dated"))
    message = F.lit("None of the files has a date.")
    return emit(
        counted, [finding(F.col("_dated") == 0, F.col("deployment_id"), "csv_log", "error", message)]
    )


def nothing_to_package(collections: DataFrame, resources: DataFrame) -> DataFrame:
    """Collections without a single file to package."""
    empty = collections.select("collection").distinct().join(
        resources.select("collection").distinct(), "collection", "left_anti"
    )
    message = F.lit("There is no file to package")
    return emit(empty, [finding(F.lit(True), _c(), "deployment exported", "error", message)])


def allowed_values(df: DataFrame, column: str, allowed: Iterable[str], identifier: str) -> DataFrame:
    """Findings for cells outside an allowed set."""
    value = F.col(column)
    message = F.concat(F.lit(f"{column} has the unknown value "), value)
    wrong = F.coalesce(~value.isin(list(allowed)), F.lit(False))
    return emit(df, [finding(wrong, F.col(identifier).cast("string"), "allowed values", "error", message)])


