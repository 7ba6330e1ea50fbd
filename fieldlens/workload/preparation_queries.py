"""Queries on archive preparation, registration and the scalar functions behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import dates, naming, parsing
from fieldlens.operators import preparation as P
from fieldlens.plans.gated import gated_preparation
from fieldlens.workload.registry import SQL_VIEWS, query

ZONE = "Europe/Madrid"

SQL_VIEWS["date_choice"] = """SELECT *, coalesce(nullif(date_time_original, '0000:00:00 00:00:00'), create_date, file_modify_date) AS chosen
    FROM meta"""
SQL_VIEWS["date_parts"] = """SELECT *, regexp_extract(chosen, '^[0-9:]+ [0-9:]+') AS wall_text, CASE WHEN chosen LIKE '%+02:00' THEN 7200
      WHEN chosen LIKE '%+0100' THEN 3600 END AS given FROM date_choice"""
# The zone's rules for the year of the derived dates: one hour ahead of UTC, two in summer.
SQL_VIEWS["date_walls"] = """SELECT *, try_strptime(regexp_extract(chosen, '^[0-9]+:[0-9]+:[0-9]+ [0-9]+:[0-9]+:[0-9]+'), '%Y:%m:%d %H:%M:%S') AS wall
    FROM date_parts"""
SQL_VIEWS["recorded"] = """SELECT *, coalesce(given, CASE WHEN wall >= TIMESTAMP '2024-03-31 03:00:00'
        AND wall < TIMESTAMP '2024-10-27 03:00:00' THEN 7200 ELSE 3600 END) AS by_rules, coalesce(given, 3600) AS standard
    FROM date_walls"""
SQL_VIEWS["instants"] = """SELECT *, wall - to_seconds(by_rules) AS instant, wall - to_seconds(standard) AS instant_standard FROM recorded"""
_CAMERA = """CASE WHEN starts_with(lower(trim(coalesce(model, '(unknown)'))), lower(trim(coalesce(make, '(unknown)'))))
    THEN lower(trim(coalesce(model, '(unknown)')))
    ELSE lower(trim(coalesce(make, '(unknown)'))) || ' ' || lower(trim(coalesce(model, '(unknown)'))) END"""
SQL_VIEWS["placed_files"] = f"""SELECT *, lower(deployment) AS deployment_id, {_CAMERA} AS camera,
    row_number() OVER (PARTITION BY collection, deployment ORDER BY media_id) AS file_index
    FROM instants WHERE rel_path NOT LIKE '%.txt'"""
SQL_VIEWS["archive_files"] = """SELECT *, upper(deployment_id || '__' || strftime(instant_standard, '%Y%m%d') || '_' || CAST(file_index AS varchar)
      || CASE lower(regexp_extract(rel_path, '\\.[^.]+$')) WHEN '.jpg' THEN '.jpeg' ELSE lower(regexp_extract(rel_path, '\\.[^.]+$')) END) AS archive_name
    FROM placed_files"""
SQL_VIEWS["summaries"] = """SELECT collection, deployment_id AS "deploymentID", regexp_extract(deployment_id, '^[^-]*-(.*)$', 1) AS "locationID",
      strftime(min(instant_standard), '%Y-%m-%dT%H:%M:%S+0000') AS "deploymentStart",
      strftime(max(instant_standard), '%Y-%m-%dT%H:%M:%S+0000') AS "deploymentEnd",
      arg_min(camera, file_index) FILTER (instant_standard IS NOT NULL) AS "cameraModel"
    FROM placed_files GROUP BY collection, deployment_id HAVING count(instant_standard) > 0"""


def _prepared(t, **options):
    return P.prepare_deployments(t.meta, zone=ZONE, ignore_dst=True, ascii_names=True, **options)


def _recorded(t, ignore_dst):
    return P.recorded_media(t.meta, ZONE, ignore_dst=ignore_dst)


@query(
    "t3_recorded_date",
    "SELECT media_id, chosen, wall FROM date_walls",
)
def _(t):
    text = dates.recorded_text(F.col("date_time_original"), F.col("create_date"), F.col("file_modify_date"))
    rows = _recorded(t, False).withColumn("chosen", text)
    return rows.select("media_id", "chosen", "wall")


@query(
    "t3_without_fallback",
    """SELECT media_id, coalesce(nullif(date_time_original, '0000:00:00 00:00:00'), create_date) AS chosen FROM meta""",
)
def _(t):
    return t.meta.select("media_id", dates.recorded_text(F.col("date_time_original"), F.col("create_date")).alias("chosen"))


@query(
    "t4_zone_rules",
    "SELECT media_id, instant, CAST(coalesce(CASE WHEN wall IS NOT NULL THEN by_rules END, -1) AS bigint) AS offset_seconds FROM instants",
)
def _(t):
    rows = _recorded(t, False)
    offset = F.coalesce("offset_seconds", F.lit(-1)).alias("offset_seconds")
    return rows.select("media_id", F.col("instant").cast("timestamp_ntz").alias("instant"), offset)


@query(
    "t4_standard_time",
    "SELECT media_id, instant_standard AS instant FROM instants",
)
def _(t):
    return _recorded(t, True).select("media_id", F.col("instant").cast("timestamp_ntz").alias("instant"))


@query(
    "t5_utc_text",
    "SELECT media_id, strftime(instant_standard, '%Y-%m-%dT%H:%M:%S+0000') AS recorded_utc FROM instants",
)
def _(t):
    moment = F.col("instant").cast("timestamp_ntz")
    return _recorded(t, True).select("media_id", dates.stamp_text(moment, F.lit(0)).alias("recorded_utc"))


@query("t6_camera_model", f"SELECT media_id, {_CAMERA} AS camera FROM meta")
def _(t):
    return t.meta.select("media_id", parsing.camera_model(F.col("make"), F.col("model")).alias("camera"))


@query("t7_archive_names", "SELECT media_id, archive_name FROM archive_files")
def _(t):
    return _prepared(t).select("media_id", "archive_name")


@query(
    "t8_metadata_record",
    """SELECT media_id, 'CT (' || camera || ' FIELD)' AS creator, strftime(instant_standard, '%Y-%m-%dT%H:%M:%S+0000') AS date,
         mime_type AS format, 'FIELD:' || sha1(rel_path) AS identifier, 'FIELD:' || sha1(props) AS source, 'Lab' AS publisher,
         '© Owner, 2024. All rights reserved.' AS rights,
         'This image was taken at Somewhere, as part of the FIELD project.' AS coverage, 'true' AS marked, 'Owner' AS owner,
         'https://creativecommons.org/licenses/by-nc/4.0/' AS statement FROM archive_files""",
)
def _(t):
    tags = {"project": "FIELD", "owner": "Owner", "publisher": "Lab", "coverage": "Somewhere", "year": 2024}
    hashed = t.meta.withColumns({"identifier_hash": F.sha1("rel_path"), "source_hash": F.sha1("props")})
    rows = P.prepare_deployments(hashed, zone=ZONE, ignore_dst=True, ascii_names=True, tags=tags)
    names = {
        "creator": "XMP-dc:Creator", "date": "XMP-dc:Date", "format": "XMP-dc:Format",
        "identifier": "XMP-dc:Identifier", "source": "XMP-dc:Source", "publisher": "XMP-dc:Publisher",
        "rights": "XMP-dc:Rights", "coverage": "XMP-dc:Coverage", "marked": "XMP-xmpRights:Marked",
        "owner": "XMP-xmpRights:Owner", "statement": "XMP-xmpRights:WebStatement",
    }
    return rows.select("media_id", *[F.col("tags")[tag].alias(n) for n, tag in names.items()])


@query(
    "t9_location_id",
    "SELECT deployment, CASE WHEN contains(deployment, '-') THEN regexp_extract(deployment, '^[^-]*-(.*)$', 1) ELSE '' END AS location_id FROM folders",
)
def _(t):
    return t.folders.select("deployment", naming.location_of(F.col("deployment")).alias("location_id"))


@query(
    "t1_slug",
    """SELECT name, regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'),
         '^[-_]+|[-_]+$', '', 'g') AS slug FROM (SELECT deployment || ' / ' || collection || ' #1_' AS name FROM folders) n""",
)
def _(t):
    named = t.folders.selectExpr("deployment || ' / ' || collection || ' #1_' AS name")
    return named.select("name", naming.slug(F.col("name"), ascii_input=True).alias("slug"))


@query(
    "t1_slug_any_script",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'),
         '^[-_]+|[-_]+$', '', 'g') AS slug FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", naming.slug(F.col("text"), allow_unicode=False).alias("slug"))


@query(
    "t2_content_hash",
    """SELECT doc_id, sha1(text) AS hash, '/' || substr(sha1(text), 1, 2) || '/' || substr(sha1(text), 3, 2) || '/' || sha1(text) AS hash_path
       FROM documents""",
)
def _(t):
    digest = F.sha1(F.col("text").cast("binary"))
    return t.documents.select("doc_id", digest.alias("hash"), naming.content_path(digest).alias("hash_path"))


@query(
    "t23_iso_dates",
    """SELECT entry_uuid, try_strptime(rtrim(created_at, 'Z'), ['%Y-%m-%dT%H:%M:%S.%g', '%Y-%m-%dT%H:%M:%S']) AS created FROM entries""",
)
def _(t):
    return t.entries.select("entry_uuid", dates.iso_time(F.col("created_at")).alias("created"))


@query(
    "t24_repaired_text",
    "SELECT doc_id, text AS repaired FROM documents",
)
def _(t):
    # Text whose UTF-8 bytes are read as Latin-1 is what the repair undoes.
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.documents.select("doc_id", parsing.repaired_text(broken).alias("repaired"))


@query(
    "t26_set_names_and_codes",
    """SELECT c_custkey, c_name || '_' || CAST(c_custkey AS varchar) || '_' || c_mktsegment || '_' || CAST(c_nationkey AS varchar) || '_2024-05' AS set_name,
         printf('R%04d', c_custkey) AS code, upper(printf('R%04d', c_custkey) || '-' || c_name) AS place_code FROM customer""",
)
def _(t):
    c = t.customer
    name = naming.subject_set_name(c.c_name, c.c_custkey, c.c_mktsegment, c.c_nationkey, F.lit("2024-05"))
    return c.select(
        "c_custkey",
        name.alias("set_name"),
        naming.revision_code(c.c_custkey).alias("code"),
        naming.revision_code(c.c_custkey, c.c_name).alias("place_code"),
    )


@query(
    "a2_deployment_span",
    """SELECT deployment_id, min(instant_standard) AS first_taken, max(instant_standard) AS last_taken FROM placed_files
       GROUP BY deployment_id""",
)
def _(t):
    moment = F.col("instant").cast("timestamp_ntz")
    return _prepared(t).groupBy("deployment_id").agg(F.min(moment).alias("first_taken"), F.max(moment).alias("last_taken"))


@query("a3_deployment_camera", 'SELECT "deploymentID", "cameraModel" FROM summaries')
def _(t):
    return P.deployment_summary(_prepared(t)).select("deploymentID", "cameraModel")


@query(
    "a18_copied_files",
    "SELECT deployment_id, count(instant_standard) AS copied FROM placed_files GROUP BY deployment_id",
)
def _(t):
    return _prepared(t).groupBy("deployment_id").agg(F.count("instant").alias("copied"))


SQL_VIEWS["old_summaries"] = """SELECT printf('R%04d', s_suppkey % 5 + 1) AS collection, lower(printf('R%04d-LOC_%03d', s_suppkey % 5 + 1, s_suppkey)) AS "deploymentID", 'old' AS "locationID",
    'old' AS "deploymentStart", 'old' AS "deploymentEnd", s_name AS "cameraModel" FROM supplier
    UNION ALL SELECT 'R0001', 'kept-' || n_name, 'old', 'old', 'old', 'none' FROM nation"""


def _old_summaries(t):
    first = t.supplier.selectExpr(
        "printf('R%04d', s_suppkey % 5 + 1) AS collection",
        "lower(printf('R%04d-LOC_%03d', s_suppkey % 5 + 1, s_suppkey)) AS deploymentID", "'old' AS locationID",
        "'old' AS deploymentStart", "'old' AS deploymentEnd", "s_name AS cameraModel",
    )
    more = t.nation.selectExpr("'R0001'", "'kept-' || n_name AS deploymentID", "'old'", "'old'", "'old'", "'none'")
    return first.union(more)


@query(
    "j5_summary_upsert",
    """SELECT * FROM summaries UNION ALL SELECT * FROM old_summaries
       WHERE (collection, "deploymentID") NOT IN (SELECT (collection, "deploymentID") FROM summaries)""",
)
def _(t):
    return P.upsert(_old_summaries(t), P.deployment_summary(_prepared(t)), ["collection", "deploymentID"])


@query("p3_prepare_deployments", "SELECT collection, deployment_id, file_index, archive_name, camera, instant_standard AS taken FROM archive_files")
def _(t):
    taken = F.col("instant").cast("timestamp_ntz").alias("taken")
    return _prepared(t).select("collection", "deployment_id", "file_index", "archive_name", "camera", taken)


@query("p3_deployments_table", "SELECT * FROM summaries")
def _(t):
    return P.deployment_summary(_prepared(t))


def _two_collections(t):
    """The media once more under other collections, so every deployment name occurs in two."""
    return t.meta.unionByName(t.meta.withColumn("collection", F.concat(F.lit("S"), "collection")))


@query(
    "p3_equal_names_in_collections",
    """SELECT * FROM summaries UNION ALL SELECT 'S' || collection, COLUMNS(* EXCLUDE (collection)) FROM summaries""",
)
def _(t):
    return P.deployment_summary(P.prepare_deployments(_two_collections(t), zone=ZONE, ignore_dst=True, ascii_names=True))


@query(
    "j5_upsert_in_collections",
    """SELECT * FROM old_summaries WHERE (collection, "deploymentID") NOT IN (SELECT ('S' || collection, "deploymentID") FROM summaries)
       UNION ALL SELECT 'S' || collection, COLUMNS(* EXCLUDE (collection)) FROM summaries""",
)
def _(t):
    new = P.deployment_summary(_prepared(t)).withColumn("collection", F.concat(F.lit("S"), "collection"))
    return P.upsert(_old_summaries(t), new, ["collection", "deploymentID"])


@query(
    "p3_preparation_findings",
    """WITH blocked AS (SELECT DISTINCT collection, lower(deployment) AS d FROM meta
         WHERE (collection, lower(deployment)) IN (SELECT (collection, "deploymentID") FROM old_summaries)),
       done AS (SELECT * FROM placed_files WHERE (collection, deployment_id) NOT IN (SELECT (collection, d) FROM blocked))
       SELECT d AS identifier, 'existing deployment' AS action, 'error' AS status,
         'Target ''' || d || ''' already exists and overwrite is off.' AS message FROM blocked
       UNION ALL SELECT deployment_id, 'copy error', 'error', rel_path || ': no valid date found in metadata' FROM done WHERE instant_standard IS NULL
       UNION ALL SELECT deployment_id, 'deployment exported', 'success', NULL FROM done GROUP BY collection, deployment_id HAVING count(instant_standard) > 0""",
)
def _(t):
    existing = _old_summaries(t).selectExpr("collection", "deploymentID AS deployment_id")
    targets = t.meta.select("collection", F.lower("deployment").alias("deployment_id"))
    return P.preparation_findings(_prepared(t, existing=existing), targets, existing)


SQL_VIEWS["new_rows"] = """SELECT collection, deployment AS "Deployment", strftime(min(wall), '%Y:%m:%d') AS "StartDate",
      strftime(min(wall), '%H:%M:%S') AS "StartTime", strftime(max(wall), '%Y:%m:%d') AS "EndDate", strftime(max(wall), '%H:%M:%S') AS "EndTime"
    FROM recorded WHERE wall IS NOT NULL GROUP BY collection, deployment"""
SQL_VIEWS["lower_log"] = """SELECT printf('R%04d', s_suppkey % 5 + 1) AS collection, lower(printf('R%04d-LOC_%03d', s_suppkey % 5 + 1, s_suppkey)) AS "Deployment",
    'd' AS "StartDate", 't' AS "StartTime", 'd' AS "EndDate", 't' AS "EndTime" FROM supplier"""


def _lower_log(t):
    return t.supplier.selectExpr(
        "printf('R%04d', s_suppkey % 5 + 1) AS collection",
        "lower(printf('R%04d-LOC_%03d', s_suppkey % 5 + 1, s_suppkey)) AS Deployment",
        "'d' AS StartDate", "'t' AS StartTime", "'d' AS EndDate", "'t' AS EndTime",
    )


_HELD = """(collection, upper("Deployment")) IN (SELECT (collection, upper("Deployment")) FROM lower_log)"""


@query("j6_insert_if_absent", f"SELECT * FROM lower_log UNION ALL SELECT * FROM new_rows WHERE NOT {_HELD}")
def _(t):
    return P.insert_if_absent(_lower_log(t), P.log_rows(_recorded(t, True)))


@query(
    "p6_register_deployments",
    f"""SELECT "Deployment" AS identifier, 'csv_log' AS action, CASE WHEN {_HELD} THEN 'error' ELSE 'success' END AS status,
         CASE WHEN {_HELD} THEN 'Deployment already in the log; no row was added.' ELSE 'Row added to the log.' END AS message FROM new_rows""",
)
def _(t):
    _, findings = P.register_deployments(t.meta, _lower_log(t), zone=ZONE, ignore_dst=True)
    return findings


@query(
    "p11_gated_preparation",
    """WITH places AS (SELECT collection, deployment FROM (SELECT DISTINCT collection, deployment FROM media) m),
       bad AS (SELECT DISTINCT collection FROM places WHERE lower(regexp_extract(deployment, '^[^-]*-(.*)$', 1)) NOT IN
         (SELECT lower(location_id) FROM known_places)),
       good AS (SELECT * FROM validated_findings WHERE collection NOT IN (SELECT collection FROM bad)),
       own AS (SELECT * FROM placed_files WHERE (collection, deployment) IN (SELECT (collection, deployment) FROM good))
       SELECT a.collection, a.deployment_id, a.archive_name FROM archive_files a
       WHERE (a.collection, a.deployment) IN (SELECT (collection, deployment) FROM own)""",
)
def _(t):
    folders = t.media.groupBy("collection", "deployment").agg(F.count(F.lit(1)).alias("n_files"))
    known = t.customer.selectExpr("printf('LOC_%03d', c_custkey) AS location_id")
    rows = gated_preparation(
        folders.select("collection"), folders, t.field_log, t.taken, t.meta, zone=ZONE, locations=known,
        tolerance_hours=72, ascii_names=True,
    )
    return rows.select("collection", "deployment_id", "archive_name")


SQL_VIEWS["known_places"] = "SELECT printf('LOC_%03d', c_custkey) AS location_id FROM customer"
