"""Queries on naming rules, field logs and deployment checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import naming
from fieldlens.operators import rules as R
from fieldlens.workload.registry import SQL_VIEWS, query

TOLERANCE = 72
_FINDING = ["identifier", "action", "status", "message"]

SQL_VIEWS["folder_tests"] = """SELECT *, regexp_full_match(deployment, '[Rr][0-9]{4}-([0-9A-Za-z_-]+)(_.+)?') AS form_ok,
    lower(split_part(deployment, '-', 1)) = lower(split_part(collection, '_', 1)) AS prefix_ok,
    CASE WHEN contains(deployment, '-') THEN lower(regexp_extract(deployment, '^[^-]*-(.*)$', 1)) ELSE '' END AS location
    FROM folders WHERE n_files > 0"""
SQL_VIEWS["folder_checks"] = """SELECT f.*, l.location_id IS NOT NULL AS location_ok FROM folder_tests f
    LEFT JOIN locations l ON lower(l.location_id) = f.location"""
SQL_VIEWS["name_findings"] = """SELECT collection, deployment, collection || ':' || deployment AS identifier,
      'validate_deployment_names' AS action,
      CASE WHEN form_ok AND prefix_ok AND location_ok THEN 'success' ELSE 'error' END AS status,
      CASE WHEN NOT form_ok THEN 'Expected a name like CODE-NAME_SUFFIX.'
           WHEN NOT prefix_ok THEN 'Name should begin with ' || split_part(collection, '_', 1)
           WHEN NOT location_ok THEN 'Unknown location ''' || location || '''.'
           ELSE 'Name accepted.' END AS message
    FROM folder_checks
    UNION ALL SELECT collection, deployment, deployment, 'validate_deployment_names', 'error',
      'Prefix ' || split_part(deployment, '-', 1) || ' is not that of collection ' || collection
    FROM folder_checks WHERE NOT prefix_ok"""
SQL_VIEWS["collection_findings"] = """SELECT collection AS identifier, 'validate_collection_names' AS action,
      CASE WHEN regexp_full_match(collection, 'R[0-9]{4}(_.+)?') THEN 'success' ELSE 'error' END AS status,
      CASE WHEN regexp_full_match(collection, 'R[0-9]{4}(_.+)?') THEN NULL
           ELSE 'Collection ''' || collection || ''' is not named R and four digits.' END AS message
    FROM (SELECT DISTINCT collection FROM folders) c"""


def _log_views(prefix: str, source: str) -> None:
    def moment(side: str) -> str:
        return f"try_strptime(trim({side}Date) || ' ' || trim({side}Time), '%Y:%m:%d %H:%M:%S')"

    SQL_VIEWS[f"{prefix}_parsed"] = f"""SELECT collection, row_number, trim(Deployment) AS deployment,
        {moment('Start')} AS expected_start, {moment('End')} AS expected_end,
        trim(Deployment) <> '' AND trim(StartDate) <> '' AND trim(StartTime) <> '' AND trim(EndDate) <> ''
          AND trim(EndTime) <> '' AS complete FROM {source}"""
    SQL_VIEWS[f"{prefix}_ranked"] = f"""SELECT *, CASE WHEN complete THEN row_number() OVER
        (PARTITION BY collection, deployment, complete ORDER BY row_number) ELSE 1 END AS nth FROM {prefix}_parsed"""
    SQL_VIEWS[f"{prefix}_faults"] = f"""SELECT *, CASE WHEN NOT complete THEN 'missing value'
        WHEN nth > 1 THEN 'duplicate deployment'
        WHEN expected_start IS NULL OR expected_end IS NULL THEN 'invalid datetime'
        WHEN expected_start >= expected_end THEN 'start not before end' END AS fault FROM {prefix}_ranked"""
    SQL_VIEWS[f"{prefix}_valid"] = (
        f"SELECT collection, deployment, expected_start, expected_end FROM {prefix}_faults WHERE fault IS NULL"
    )


_log_views("raw", "raw_log")
_log_views("own", "field_log")

SQL_VIEWS["shot_files"] = """SELECT s.*, try_strptime(taken_text, '%Y:%m:%d %H:%M:%S') AS taken,
    regexp_extract(rel_path, '[^/]*$') AS file_name FROM shots s WHERE rel_path NOT LIKE '%.txt'"""
SQL_VIEWS["shot_places"] = """SELECT f.*, l.expected_start, l.expected_end,
    row_number() OVER (PARTITION BY f.deployment ORDER BY f.media_id) AS position,
    count(*) OVER (PARTITION BY f.deployment) AS files
    FROM shot_files f JOIN own_valid l ON f.collection = l.collection AND f.deployment = l.deployment"""
SQL_VIEWS["shot_previous"] = """SELECT *, lag(taken) OVER (PARTITION BY deployment ORDER BY media_id) AS previous
    FROM shot_places WHERE error IS NULL"""
SQL_VIEWS["metadata_findings"] = """SELECT collection, deployment, collection || ':' || deployment || ':' || file_name AS identifier,
    'gather_metadata' AS action, 'error' AS status, 'Metadata could not be read: ' || error AS message
    FROM shot_places WHERE error IS NOT NULL"""
SQL_VIEWS["order_findings"] = """SELECT collection, deployment, collection || ':' || deployment || ':' || file_name AS identifier,
    'date order' AS action, 'error' AS status, 'Image ''' || file_name || ''' is older than the one before it.' AS message
    FROM shot_previous WHERE taken < previous"""
_low = f"""CASE WHEN position > 1 AND position = files THEN expected_end ELSE expected_start END - INTERVAL {TOLERANCE} HOUR"""
_high = f"""CASE WHEN position = 1 THEN expected_start ELSE expected_end END + INTERVAL {TOLERANCE} HOUR"""
SQL_VIEWS["range_findings"] = f"""SELECT collection, deployment, collection || ':' || deployment || ':' || file_name AS identifier,
    'image date out of range' AS action, 'error' AS status, 'Image ''' || file_name || ''' was taken outside the logged dates' AS message
    FROM shot_places WHERE error IS NULL AND taken IS NOT NULL AND (taken < {_low} OR taken > {_high})"""
SQL_VIEWS["media_findings"] = (
    "SELECT * FROM metadata_findings UNION ALL SELECT * FROM order_findings UNION ALL SELECT * FROM range_findings"
)
SQL_VIEWS["missing_findings"] = """SELECT collection, deployment, collection || ':' || deployment AS identifier,
    'missing deployment' AS action, 'error' AS status, 'No folder for deployment ''' || deployment || '''' AS message
    FROM own_valid WHERE (collection, deployment) NOT IN (SELECT (collection, deployment) FROM media)"""
SQL_VIEWS["validated_findings"] = """SELECT collection, deployment, collection || ':' || deployment AS identifier,
    'deployment validated' AS action, 'success' AS status, 'Deployment ''' || deployment || ''' passed all checks.' AS message
    FROM own_valid WHERE (collection, deployment) IN (SELECT (collection, deployment) FROM media)
      AND (collection, deployment) NOT IN (SELECT (collection, deployment) FROM media_findings)"""
_F = "identifier, action, status, message"


def _collections(t):
    return t.folders.select("collection").distinct()


def _own_media_findings(t):
    return R.media_findings(t.taken, R.valid_log(t.field_log), tolerance_hours=TOLERANCE)


def _folders(t):
    return t.media.select("collection", "deployment").distinct()


@query("v1_collection_names", f"SELECT {_F} FROM collection_findings")
def _(t):
    return R.check_collection_names(_collections(t))


@query(
    "v2_deployment_form",
    "SELECT deployment, regexp_full_match(deployment, '[Rr][0-9]{4}-([0-9A-Za-z_-]+)(_.+)?') AS form_ok FROM folders",
)
def _(t):
    return t.folders.select("deployment", naming.deployment_name_ok(F.col("deployment")).alias("form_ok"))


@query("v3_deployment_prefix", f"SELECT {_F} FROM name_findings WHERE message LIKE '%collection%' OR message LIKE '%start with%'")
def _(t):
    found = R.check_deployment_names(t.folders, t.locations)
    return found.where("message LIKE '%collection%' OR message LIKE '%start with%'").select(_FINDING)


@query("v4_deployment_location", f"SELECT {_F} FROM name_findings")
def _(t):
    return R.check_deployment_names(t.folders, t.locations).select(_FINDING)


@query(
    "v4_deployment_location_legacy",
    """SELECT identifier, status FROM (SELECT collection || ':' || deployment AS identifier, CASE WHEN form_ok
         AND lower(split_part(deployment, '-', 1)) = lower(collection)
         AND lower(split_part(deployment, '-', 2)) IN (SELECT location_id FROM locations) THEN 'success' ELSE 'error' END AS status
         FROM folder_tests
       UNION ALL SELECT deployment, 'error' FROM folder_tests WHERE lower(split_part(deployment, '-', 1)) <> lower(collection)) x""",
)
def _(t):
    return R.check_deployment_names(t.folders, t.locations, legacy=True).select("identifier", "status")


@query(
    "v5_empty_folders",
    "SELECT collection, deployment FROM folders WHERE n_files = 0",
)
def _(t):
    return R.empty_folders(t.folders)


@query(
    "j3_known_locations",
    """SELECT f.collection, f.deployment, coalesce(l.pk, -1) AS location_pk FROM folder_tests f LEFT JOIN locations l
       ON lower(l.location_id) = f.location""",
)
def _(t):
    key = F.lower(naming.location_of(F.col("deployment"))).alias("_location")
    rows = t.folders.where("n_files > 0").select("collection", "deployment", key)
    known = t.locations.select(F.lower("location_id").alias("_location"), F.col("pk").alias("location_pk"))
    return rows.join(known, "_location", "left").drop("_location").na.fill(-1)


@query("p1_check_collections", f"SELECT {_F} FROM collection_findings UNION ALL SELECT {_F} FROM name_findings")
def _(t):
    return R.check_collections(_collections(t), t.folders, t.locations)


@query(
    "v6_log_headers",
    """WITH h AS (SELECT collection, header, string_split(header, ',') AS names FROM headers),
       x AS (SELECT collection, header, list_filter(['Deployment', 'StartDate', 'StartTime', 'EndDate', 'EndTime'],
                    lambda r: NOT list_contains(names, r)) AS missing,
                    list_sort(list_distinct(list_filter(names, lambda n: len(list_filter(names, lambda m: m = n)) > 1))) AS repeated FROM h)
       SELECT collection AS identifier, 'log header' AS action, 'error' AS status, 'Header is empty' AS message FROM x WHERE header = ''
       UNION ALL SELECT collection, 'log header', 'error', 'Columns named twice: ' || array_to_string(repeated, ', ')
         FROM x WHERE header <> '' AND len(repeated) > 0
       UNION ALL SELECT collection, 'log header', 'error', 'Columns not there: ' || array_to_string(missing, ', ')
         FROM x WHERE header <> '' AND len(missing) > 0""",
)
def _(t):
    return R.check_log_headers(t.headers)


_HEADER_NAMES = "SELECT collection, unnest(string_split(header, ',')) AS name FROM headers WHERE header <> ''"


@query(
    "u1_missing_columns",
    f"""SELECT c.collection, r.name FROM (SELECT DISTINCT collection FROM headers WHERE header <> '') c,
       (SELECT unnest(['Deployment', 'StartDate', 'StartTime', 'EndDate', 'EndTime']) AS name) r
       WHERE (c.collection, r.name) NOT IN (SELECT (collection, name) FROM ({_HEADER_NAMES}) n)""",
)
def _(t):
    return R.missing_columns(t.headers)


@query(
    "u2_repeated_columns",
    f"SELECT collection, name, count(*) AS n FROM ({_HEADER_NAMES}) n GROUP BY collection, name HAVING count(*) > 1",
)
def _(t):
    return R.repeated_columns(t.headers)


def _fault_query(name: str, fault: str):
    @query(name, f"SELECT collection, row_number, deployment FROM raw_faults WHERE fault = '{fault}'")
    def _(t):
        rows = R.log_faults(t.raw_log).where(F.col("fault") == fault)
        return rows.select("collection", "row_number", "deployment")


_fault_query("v7_missing_values", "missing value")
_fault_query("v8_repeated_deployments", "duplicate deployment")
_fault_query("v9_invalid_datetimes", "invalid datetime")
_fault_query("v10_start_before_end", "start not before end")


@query(
    "v10_first_fault",
    """SELECT collection, min(row_number) AS row_number, arg_min(fault, row_number) AS fault FROM raw_faults
       WHERE fault IS NOT NULL GROUP BY collection""",
)
def _(t):
    return R.first_log_fault(t.raw_log)


_LOGLESS = """SELECT collection AS identifier, 'check filetimestamplog' AS action, 'error' AS status,
       'Field log is missing: ' || collection || '_FileTimestampLog.csv' AS message"""


@query(
    "v11_collections_without_log",
    f"{_LOGLESS} FROM (SELECT DISTINCT collection FROM collections EXCEPT SELECT collection FROM field_log) c",
)
def _(t):
    return R.collections_without_log(t.collections, t.field_log)


@query("v12_logged_without_folder", f"SELECT {_F} FROM missing_findings")
def _(t):
    return R.logged_without_folder(R.valid_log(t.field_log), _folders(t)).select(_FINDING)


@query(
    "j4_log_with_folders",
    """SELECT l.collection, l.deployment, coalesce(m.n_files, 0) AS n_files FROM own_valid l LEFT JOIN
       (SELECT collection, deployment, count(*) AS n_files FROM media GROUP BY collection, deployment) m
       ON l.collection = m.collection AND l.deployment = m.deployment""",
)
def _(t):
    counts = t.media.groupBy("collection", "deployment").agg(F.count(F.lit(1)).alias("n_files"))
    logged = R.valid_log(t.field_log).select("collection", "deployment")
    return logged.join(counts, ["collection", "deployment"], "left").na.fill(0)


@query("v13_unreadable_metadata", f"SELECT {_F} FROM metadata_findings")
def _(t):
    return _own_media_findings(t).where("action = 'gather_metadata'").select(_FINDING)


@query("v14_chronology", f"SELECT {_F} FROM order_findings")
def _(t):
    return _own_media_findings(t).where("action = 'date order'").select(_FINDING)


@query("v15_date_range", f"SELECT {_F} FROM range_findings")
def _(t):
    return _own_media_findings(t).where("action = 'image date out of range'").select(_FINDING)


@query("v16_validated_deployments", f"SELECT {_F} FROM validated_findings")
def _(t):
    logged = R.valid_log(t.field_log)
    return R.validated_deployments(logged, _folders(t), _own_media_findings(t)).select(_FINDING)


@query(
    "p2_check_deployments",
    f"""SELECT {_F} FROM media_findings UNION ALL SELECT {_F} FROM missing_findings
       UNION ALL SELECT {_F} FROM validated_findings
       UNION ALL SELECT collection || ':' || CAST(row_number AS varchar), 'read log', 'error', fault || ' ' || deployment
         FROM own_faults WHERE fault IS NOT NULL
       UNION ALL SELECT {_F} FROM ({_LOGLESS} FROM (SELECT DISTINCT collection FROM media EXCEPT
         SELECT collection FROM field_log) c) n""",
)
def _(t):
    return R.check_deployments(_folders(t), t.field_log, t.taken, tolerance_hours=TOLERANCE)


@query(
    "w4_previous_date",
    "SELECT media_id, previous FROM shot_previous",
)
def _(t):
    from fieldlens.plans.ordered import ordered_rows

    logged = R.valid_log(t.field_log).select("collection", "deployment")
    rows = t.taken.where("rel_path NOT LIKE '%.txt'").join(logged, ["collection", "deployment"])
    keyed = rows.withColumn("_key", naming.natural_key(F.col("rel_path")))
    found = ordered_rows(keyed, ["collection", "deployment"], ["_key", "rel_path"], sizes=t.media).extend(
        previous_where={"previous": (F.col("taken"), F.col("error").isNull())}
    )
    return found.result().where("error IS NULL").select("media_id", "previous")


@query("w5_positions", "SELECT media_id, position, files FROM shot_places")
def _(t):
    from fieldlens.plans.ordered import ordered_rows

    logged = R.valid_log(t.field_log).select("collection", "deployment")
    rows = t.taken.where("rel_path NOT LIKE '%.txt'").join(logged, ["collection", "deployment"])
    keyed = rows.withColumn("_key", naming.natural_key(F.col("rel_path")))
    found = ordered_rows(keyed, ["collection", "deployment"], ["_key", "rel_path"], sizes=t.media)
    return found.extend(position="position", total="files").result().select("media_id", "position", "files")


@query(
    "v17_existing_targets",
    """SELECT d AS identifier, 'existing deployment' AS action, 'error' AS status,
         'Target ''' || d || ''' already exists and overwrite is off.' AS message
       FROM (SELECT DISTINCT collection, lower(deployment) AS d FROM media) m
       WHERE (collection, d) IN (SELECT (collection, lower(Deployment)) FROM field_log)""",
)
def _(t):
    targets = t.media.select("collection", F.lower("deployment").alias("deployment_id"))
    existing = t.field_log.select("collection", F.lower("Deployment").alias("deployment_id"))
    return R.existing_targets(targets, existing)


@query(
    "v18_without_timestamps",
    """SELECT rel_path AS identifier, 'csv_log' AS action, 'error' AS status,
         'None of the files has a date.' AS message
       FROM shot_files GROUP BY rel_path HAVING count(taken) = 0""",
)
def _(t):
    rows = t.taken.where("rel_path NOT LIKE '%.txt'").withColumn("deployment_id", F.col("rel_path"))
    return R.without_timestamps(rows)


@query(
    "v20_nothing_to_package",
    """SELECT collection AS identifier, 'deployment exported' AS action, 'error' AS status,
         'There is no file to package' AS message
       FROM (SELECT collection FROM collections EXCEPT SELECT collection FROM media WHERE file_name NOT LIKE '%.txt') c""",
)
def _(t):
    from fieldlens.operators.packaging import resources

    return R.nothing_to_package(t.collections, resources(t.media.withColumn("name", F.col("file_name"))))


@query(
    "t17_allowed_types",
    """SELECT CAST(obs_id AS varchar) AS identifier, 'allowed values' AS action, 'error' AS status,
         'observation_type has the unknown value ' || observation_type AS message FROM obs
       WHERE observation_type NOT IN ('animal', 'human', 'vehicle', 'black', 'unclassified', 'unknown')""",
)
def _(t):
    from fieldlens.schema import OBSERVATION_TYPES

    return R.allowed_values(t.obs, "observation_type", OBSERVATION_TYPES, "obs_id")
