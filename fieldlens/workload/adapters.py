"""Domain tables derived row by row from the given tables.

Every expression is written once and read by Spark and by the checking SQL alike.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_CHOICES = ("NOANIMAL", "HUMANORVEHICLE", "OTHERSPECIES", "REDDEER", "WILDBOAR", "REDFOX", "BIRD", "MYSTERY")


def _choice(i: int) -> str:
    cases = " ".join(f"WHEN {n} THEN '{c}'" for n, c in enumerate(_CHOICES))
    return f"CASE (l_suppkey + {i}) % 8 {cases} END"


def _annotations() -> str:
    answers = (
        "CASE l_returnflag WHEN 'N' THEN '\"HOWMANY\":\"many\"' WHEN 'A' THEN '' "
        "ELSE '\"HOWMANY\":\"' || CAST(CAST(l_quantity AS int) AS string) || '\"' END"
    )
    values = " || ".join(
        f"CASE WHEN l_linenumber % 5 > {i} THEN '{',' if i else ''}{{\"choice\":\"' || {_choice(i)} || "
        f"'\",\"answers\":{{' || {answers} || '}},\"filters\":{{}}}}' ELSE '' END"
        for i in range(4)
    )
    text = f"'[{{\"task\":\"T0\",\"value\":[' || {values} || ']}}]'"
    return f"CASE WHEN l_suppkey % 2 = 0 THEN {text} ELSE replace({text}, '\"', chr(39)) END"


_COLLECTION = "printf('R%04d', user_id % 5 + 1)"
_DEPLOYMENT = "printf('R%04d-LOC_%03d', user_id % 5 + 1, user_id)"
_EXT = "CASE event_id % 11 WHEN 0 THEN '.txt' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' ELSE '.JPG' END"
_FILE = f"printf('IMG_%d', event_id) || {_EXT}"
_PATH = f"printf('DCIM/%d/', 98 + CAST(floor(event_id / 4000) AS bigint)) || {_FILE}"
_MIME = "CASE event_id % 11 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/png' WHEN 2 THEN 'video/mp4' ELSE 'image/jpeg' END"
_EXIF = (
    "printf('2024:%02d:%02d %02d:%02d:%02d', event_id % 12 + 1, day(ts) % 28 + 1, hour(ts), minute(ts), "
    "CAST(second(ts) AS int))"
)
_SHOT = (
    "printf('2024:%02d:%02d %02d:%02d:%02d', month(ts), day(ts), "
    "CASE WHEN user_id % 4 = 1 THEN (hour(ts) + event_id % 7) % 24 ELSE hour(ts) END, minute(ts), CAST(second(ts) AS int))"
)
_DATE = "replace(CAST(CAST(o_orderdate AS date) AS string), '-', ':')"
_CREATED = (
    "CAST(CAST(o_orderdate AS date) AS string) || "
    "printf('T%02d:%02d:%02d', o_orderkey % 24, o_orderkey % 60, o_custkey % 60) || "
    "CASE WHEN o_orderkey % 2 = 1 THEN '.250Z' ELSE 'Z' END"
)
_LOG_COLLECTION = "printf('R%04d', c_custkey % 5 + 1)"
_LINE_KEY = "CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) || '-' || CAST(l_suppkey AS string) || '-' || CAST(CAST(round(l_extendedprice * 100) AS bigint) AS string)"
_WORKFLOW = "CASE l_orderkey % 3 WHEN 0 THEN '29186' WHEN 1 THEN '17553' ELSE '29187' END"
_SUBJECT_FILE = (
    "CASE WHEN l_linenumber = 7 THEN 'R0034-LOC__20250101_' || CAST(l_orderkey AS string) || '.JPG' "
    "ELSE CAST(l_orderkey AS string) || '_x_R0001-LOC_001_x_IMG_1.JPG' END"
)

# view -> (table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "media": (
        "events",
        {
            "media_id": "event_id",
            "collection": _COLLECTION,
            "deployment": _DEPLOYMENT,
            "deployment_id": _DEPLOYMENT,
            "ts": "ts",
            "rel_path": _PATH,
            "file_name": _FILE,
            "size": "CAST(1000 + event_id % 5000 AS bigint)",
            "file_public": "event_id % 10 <> 0",
            "private_human": "event_id % 17 = 0",
            "private_vehicle": "event_id % 19 = 0",
            "mime_type": _MIME,
        },
    ),
    "obs": (
        "events",
        {
            "obs_id": "event_id",
            "media_id": "event_id - event_id % 3",
            "observation_type": "CASE event_type WHEN 'error' THEN 'human' WHEN 'signup' THEN 'unclassified' "
            "WHEN 'view' THEN 'animal' WHEN 'click' THEN 'blank' ELSE 'vehicle' END",
            "tags": "event_type || '-' || CAST(event_id % 4 AS string)",
            "observed_at": "ts",
        },
    ),
    "meta": (
        "events",
        {
            "media_id": "event_id",
            "collection": _COLLECTION,
            "deployment": _DEPLOYMENT,
            "rel_path": _PATH,
            "mime_type": _MIME,
            "date_time_original": f"CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN "
            f"'0000:00:00 00:00:00' WHEN event_id % 13 = 0 THEN {_EXIF} || '+02:00' ELSE {_EXIF} END",
            "create_date": f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE {_EXIF} END",
            "file_modify_date": f"CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE {_EXIF} || '+0100' END",
            "make": "CASE user_id % 4 WHEN 0 THEN 'Reconyx' WHEN 1 THEN ' Browning' WHEN 2 THEN 'Bushnell' END",
            "model": "CASE user_id % 4 WHEN 0 THEN 'Reconyx HP2X' WHEN 1 THEN 'BTC-8E ' WHEN 3 THEN 'X1' END",
            "props": "props",
        },
    ),
    "shots": (
        "events",
        {
            "media_id": "event_id",
            "collection": _COLLECTION,
            "deployment": _DEPLOYMENT,
            "rel_path": _PATH,
            "taken_text": f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE {_SHOT} END",
            "error": "CASE WHEN event_id % 23 = 0 AND user_id % 3 = 0 THEN 'unreadable' END",
        },
    ),
    "field_log": (
        "customer",
        {
            "collection": _LOG_COLLECTION,
            "row_number": "c_custkey + 2",
            "Deployment": "printf('R%04d-LOC_%03d', c_custkey % 5 + 1, c_custkey)",
            "StartDate": "printf('2024:01:%02d', c_custkey % 5 + 1)",
            "StartTime": "printf('%d:%02d:00', c_custkey % 24, c_custkey % 60)",
            "EndDate": "printf('2024:01:%02d', 28 + c_custkey % 4)",
            "EndTime": "printf('%02d:30:00', c_custkey % 24)",
        },
    ),
    "raw_log": (
        "orders",
        {
            "collection": "printf('R%04d', o_custkey % 5 + 1)",
            "row_number": "o_orderkey + 2",
            "Deployment": "printf('R%04d-LOC_%d', o_custkey % 5 + 1, o_orderkey - o_orderkey % 3)",
            "StartDate": f"CASE o_orderkey % 20 WHEN 0 THEN ' ' WHEN 1 THEN '2024-09-04' ELSE {_DATE} END",
            "StartTime": "printf('%d:%02d:00', o_orderkey % 24, o_orderkey % 60)",
            "EndDate": "CASE WHEN o_orderkey % 7 = 0 THEN '1990:01:01' ELSE printf('2010:01:%02d', o_orderkey % 28 + 1) END",
            "EndTime": "'08:00:00'",
        },
    ),
    "headers": (
        "customer",
        {
            "collection": "printf('R%04d', c_custkey)",
            "header": "CASE c_custkey % 5 WHEN 0 THEN 'Deployment,StartDate,StartTime' "
            "WHEN 1 THEN 'Deployment,StartDate,StartTime,EndDate,EndTime,EndTime' WHEN 2 THEN '' "
            "WHEN 3 THEN 'a,a,b,b' ELSE 'Deployment,StartDate,StartTime,EndDate,EndTime,Notes' END",
        },
    ),
    "folders": (
        "customer",
        {
            "collection": "CASE c_custkey % 50 WHEN 7 THEN 'X12' WHEN 8 THEN 'R0004_extra' "
            "ELSE printf('R%04d', c_custkey % 5 + 1) END",
            "deployment": "CASE c_custkey % 7 "
            "WHEN 1 THEN printf('r%04d-loc_%03d', c_custkey % 5 + 1, c_custkey % 40) "
            "WHEN 2 THEN printf('R%d-LOC_%03d', c_custkey % 5 + 1, c_custkey) "
            "WHEN 3 THEN printf('R%04d-LOC_%03d', c_custkey % 5 + 2, c_custkey % 40) "
            "WHEN 4 THEN printf('R%04d-LOC %d', c_custkey % 5 + 1, c_custkey) "
            "WHEN 5 THEN printf('R%04d-LOC_%03d_X', c_custkey % 5 + 1, c_custkey % 40) "
            "WHEN 6 THEN printf('R%04d', c_custkey % 5 + 1) "
            "ELSE printf('R%04d-LOC_%03d', c_custkey % 5 + 1, c_custkey % 40) END",
            "n_files": "c_custkey % 9",
        },
    ),
    "locations": (
        "nation",
        {
            "pk": "n_nationkey",
            "location_id": "printf('LOC_%03d', n_nationkey)",
            "research_project": "n_regionkey",
        },
    ),
    "files": (
        "documents",
        {
            "collection": "'R_' || lang",
            "deployment": "source",
            "name": "printf('doc_%d', doc_id) || CASE WHEN doc_id % 29 = 0 THEN '.txt' ELSE '.jpg' END",
            "file": "printf('doc_%d', doc_id) || CASE WHEN doc_id % 29 = 0 THEN '.txt' ELSE '.jpg' END",
            "mime_type": "'image/jpeg'",
            "file_width": "CAST(640 + doc_id % 100 AS int)",
            "file_height": "CAST(480 + doc_id % 100 AS int)",
            "file_size": "n_chars",
        },
    ),
    "export": (
        "lineitem",
        {
            "classification_id": _LINE_KEY,
            "user_name": "'user' || CAST(l_partkey AS string)",
            "user_id": "CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(l_partkey AS string) END",
            "workflow_id": _WORKFLOW,
            "workflow_name": "CASE WHEN l_orderkey % 2 = 0 THEN 'mountain, \"north\"' ELSE 'plain' END",
            "workflow_version": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE '3.1' END",
            "subject_ids": "CASE l_linenumber % 3 WHEN 0 THEN CAST(l_orderkey AS string) "
            "WHEN 1 THEN '[' || CAST(l_orderkey AS string) || ']' "
            "ELSE '[' || chr(39) || CAST(l_orderkey AS string) || chr(39) || ']' END",
            "subject_data": "'{\"' || CAST(l_orderkey AS string) || '\":{' || CASE WHEN l_returnflag = 'R' THEN "
            "'\"retired\":{\"retirement_reason\":\"classification_count\"},' ELSE '' END || "
            "CASE WHEN l_suppkey % 3 = 0 THEN '\"Filename\":\"' ELSE '\"filename\":\"' END || "
            f"{_SUBJECT_FILE} || '\"}}}}'",
            "annotations": _annotations(),
        },
    ),
    "id_cells": (
        "orders",
        {
            "cell_id": "o_orderkey",
            "text": "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS string) "
            "WHEN 1 THEN printf('%d, %d', o_custkey, o_orderkey) WHEN 2 THEN printf('[\"%d\",\"%d\"]', o_custkey, o_orderkey) "
            "WHEN 3 THEN printf('%d;%d', o_custkey, o_orderkey) WHEN 4 THEN '' ELSE printf('id %d', o_custkey) END",
        },
    ),
    "entries": (
        "orders",
        {
            "entry_uuid": "printf('e%d', o_orderkey)",
            "site_raw": "CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE printf('S%02d', o_custkey % 20) END",
            "session_raw": "o_orderpriority",
            "created_at": f"CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {_CREATED} END",
            "reading": "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS string) WHEN 1 THEN printf('%d.5', o_custkey) "
            "WHEN 2 THEN 'full' ELSE NULL END",
        },
    ),
    "findings": (
        "events",
        {
            "run_id": "CAST(user_id % 10 AS string)",
            "identifier": "CAST(user_id AS string)",
            "action": "event_type",
            "status": "CASE WHEN value > 20 AND user_id % 10 <> 3 OR user_id % 10 = 4 THEN 'success' ELSE 'error' END",
            "message": "props",
            "ts": "ts",
        },
    ),
    "runs": ("nation", {"run_id": "CAST(n_nationkey AS string)"}),
    "packages": (
        "documents",
        {
            "file_name": "printf('package_7_20240101000000_R0001_r0001-loc_%d_part%03d', CAST(floor(doc_id / 2) AS bigint) % 20, CAST(floor(doc_id / 2) AS bigint)) || "
            "CASE WHEN doc_id % 2 = 0 THEN '.yaml' WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.zip' END",
            "bytes": "n_chars",
        },
    ),
    "transfers": (
        "lineitem",
        {
            "file": f"'f-' || {_LINE_KEY}",
            "remote": "'/archive/' || CAST(l_suppkey AS string)",
            "size": "CAST(round(l_extendedprice * 1000) AS bigint)",
        },
    ),
    "subjects": (
        "pages",
        {
            "id": "page_id",
            "display_name": "CASE WHEN page_id % 4 = 0 THEN NULL ELSE printf('Page %d', page_id) END",
            "file_name": "printf(' IMG_%d.JPG ', page_id)",
            "origin": "url",
            "subject_set_id": "page_id % 12",
        },
    ),
    "candidates": (
        "orders",
        {
            "candidate": "o_orderkey",
            "id": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END",
            "name": "CASE o_orderkey % 3 WHEN 1 THEN printf('PAGE %d', o_custkey) WHEN 2 THEN printf('img_%d.jpg', o_custkey) END",
            "origin": "CAST(NULL AS string)",
        },
    ),
    "subject_sets": (
        "customer",
        {
            "id": "c_custkey",
            "display_name": "printf('set %d', c_custkey - c_custkey % 2)",
            "first_link": "CAST(100 + c_nationkey AS bigint)",
            "second_link": "CAST(100 + c_custkey % 25 AS bigint)",
            "n_subjects": "c_custkey % 50",
        },
    ),
    "workflows": (
        "nation",
        {"id": "CAST(100 + n_nationkey AS bigint)", "display_name": "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_name END"},
    ),
    "exports": (
        "supplier",
        {
            "entity_id": "CAST(95 + s_suppkey AS bigint)",
            "updated_at": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE printf('2024-02-%02dT10:%02d:00Z', s_suppkey % 28 + 1, s_suppkey % 60) END",
            "created_at": "CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 6 = 3 THEN 'yesterday' ELSE printf('2024-01-%02dT09:00:00Z', s_suppkey % 28 + 1) END",
        },
    ),
    "events_text": (
        "events",
        {
            "event": f"CASE event_type WHEN 'error' THEN 'deployment_start:' WHEN 'signup' THEN 'deployment_complete:' "
            f"ELSE 'file_progress:' END || {_COLLECTION} || ':' || {_DEPLOYMENT} || ':' || {_FILE}",
            "count": "1 + event_id % 3",
        },
    ),
    "requests": (
        "customer",
        {
            "research_project": "CAST(c_custkey % 7 AS int)",
            "classification_project": "CAST(c_nationkey AS int)",
            "collection": "c_custkey",
        },
    ),
    "project_collections": (
        "supplier",
        {"pk": "s_suppkey", "classification_project": "s_nationkey"},
    ),
    "deployments": (
        "customer",
        {
            "pk": "c_custkey",
            "deployment_id": "printf('r%04d-B-loc_%d', c_nationkey, c_custkey)",
        },
    ),
    "collections": (
        "nation",
        {
            "pk": "n_nationkey",
            "collection": "CASE WHEN n_nationkey % 2 = 0 THEN printf('R%04d', n_nationkey) ELSE printf('R%04d-B', n_nationkey) END",
        },
    ),
    "media_paths": (
        "events",
        {
            "path": f"'/data/' || {_COLLECTION} || '/' || {_DEPLOYMENT} || CASE WHEN event_id % 4 = 0 THEN '/' || {_FILE} ELSE '/' || {_PATH} END",
            "size": "CAST(1000 + event_id % 5000 AS bigint)",
        },
    ),
}


# Views whose cells cost much more than reading their rows.
_COSTLY = {"export", "shots", "meta"}


def view_sql(name: str) -> str:
    table, columns = VIEWS[name]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"


class Tables:
    """The given tables and the domain views over them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A given table dealt out by its first columns, before the cells of a view are built from it.

        Building and parsing cells costs far more than this shuffle of plain columns, and the files of a
        table may hold very unequal numbers of rows, or one row group.
        """
        rows = self.table(name)
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *rows.columns[:2])

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            table, columns = VIEWS[name]
            rows = self.spread(table) if name in _COSTLY else self.table(table)
            return rows.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def taken(self) -> DataFrame:
        from pyspark.sql import functions as F

        from fieldlens.functions import dates

        return self.shots.withColumn("taken", dates.metadata_wall_time(F.col("taken_text")))


def with_views(sql: str, extra: dict[str, str]) -> str:
    """A checking query preceded by the views it names, in the order they need each other."""
    bodies = {name: view_sql(name) for name in VIEWS} | extra
    # A name counts as used only in table position, so equally named columns do not matter.
    used: dict[str, str] = {}

    def add(text: str, owner: str = "") -> None:
        for name in bodies:
            if name in used or name == owner:
                continue
            if re.search(rf"(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                add(bodies[name], name)
                used.setdefault(name, bodies[name])

    add(sql)
    recursive = "RECURSIVE " if any(name.startswith("recurse_") for name in used) else ""
    views = ", ".join(f"{name} AS ({body})" for name, body in used.items())
    if sql.lstrip().upper().startswith("WITH"):
        rest = sql.lstrip()[4:].lstrip()
        if rest.upper().startswith("RECURSIVE"):
            rest, recursive = rest[9:].lstrip(), "RECURSIVE "
        return f"WITH {recursive}{views + ', ' if views else ''}{rest}"
    return f"WITH {recursive}{views} {sql}" if views else sql
