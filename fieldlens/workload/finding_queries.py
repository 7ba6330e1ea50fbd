"""Queries on findings, stored reports and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators import findings as N
from fieldlens.operators import progress
from fieldlens.session import scratch_path
from fieldlens.sources import sinks, tables
from fieldlens.workload.registry import SQL_VIEWS, query

SQL_VIEWS["run_totals"] = """SELECT run_id, count(*) FILTER (status = 'error') AS total_errors,
      count(*) FILTER (status = 'success') AS total_successes, min(ts) AS start_time, max(ts) AS end_time,
      count(DISTINCT identifier) AS unique_identifiers, count(DISTINCT action) AS unique_actions FROM findings GROUP BY run_id"""
_STATUS = """CASE WHEN total_successes > 0 AND total_errors = 0 THEN 'success' WHEN total_errors > 0 AND total_successes = 0 THEN 'failed'
    WHEN total_errors > 0 AND total_successes > 0 THEN 'partial' ELSE 'empty' END"""


@query(
    "a11_report_status",
    f"""SELECT run_id, status, status = 'success' AS is_success, status = 'failed' AS is_failed, status = 'partial' AS is_partial,
         status = 'empty' AS is_empty FROM (SELECT r.run_id, coalesce({_STATUS}, 'empty') AS status
         FROM runs r LEFT JOIN run_totals f ON f.run_id = r.run_id) s""",
)
def _(t):
    return N.summarise(t.findings, t.runs).select(
        "run_id", "status", "is_success", "is_failed", "is_partial", "is_empty"
    )


@query(
    "a12_report_summary",
    """SELECT run_id, total_errors, total_successes, start_time, end_time,
         round(date_diff('microsecond', start_time, end_time) / 1000000, 6) AS duration_seconds FROM run_totals""",
)
def _(t):
    rows = N.summarise(t.findings)
    return rows.select(
        "run_id", "total_errors", "total_successes", "start_time", "end_time",
        F.round("duration_seconds", 6).alias("duration_seconds"),
    )


@query(
    "a13_dashboard",
    f"SELECT run_id, total_successes, total_errors, unique_identifiers, unique_actions, {_STATUS} AS status FROM run_totals",
)
def _(t):
    return N.dashboard(t.findings)


@query(
    "a14_action_counts",
    """SELECT run_id, action, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'error') AS errors
       FROM findings GROUP BY run_id, action""",
)
def _(t):
    return N.action_counts(t.findings)


@query("a15_actions", "SELECT DISTINCT action FROM findings")
def _(t):
    return N.actions(t.findings)


def _halves(t):
    """Two overlapping reports; the first one holds some entries twice."""
    errors = t.findings.where("status = 'error'")
    return errors.unionAll(errors.where("action = 'view'")), t.findings.where("action <> 'view' OR status = 'success'")


_FIRST = """SELECT * FROM findings WHERE status = 'error' UNION ALL SELECT * FROM findings WHERE status = 'error' AND action = 'view'"""
_MERGED = f"""SELECT 'merged' AS run_id, identifier, action, status, message, ts FROM ({_FIRST}) a
    UNION ALL SELECT 'merged', identifier, action, status, message, min(ts) FROM findings i WHERE (action <> 'view' OR status = 'success')
      AND NOT EXISTS (SELECT 1 FROM ({_FIRST}) h WHERE h.identifier = i.identifier AND h.action = i.action AND h.status = i.status
        AND h.message IS NOT DISTINCT FROM i.message)
    GROUP BY identifier, action, status, message"""


def _merged(t):
    return N.merge(*_halves(t), run_id="merged")


@query("a16_report_merge", _MERGED)
def _(t):
    return _merged(t)


@query(
    "a16_merged_span",
    "SELECT 'merged' AS run_id, min(ts) AS start_time, max(ts) AS end_time FROM findings WHERE status = 'error' OR action <> 'view' OR status = 'success'",
)
def _(t):
    spans = [N.summarise(part).select("run_id", "start_time", "end_time") for part in _halves(t)]
    return N.merged_span(*spans, run_id="merged")


@query("u5_report_union", f"SELECT identifier, count(*) AS n_entries FROM ({_MERGED}) m GROUP BY identifier")
def _(t):
    return _merged(t).groupBy("identifier").agg(F.count(F.lit(1)).alias("n_entries"))


@query("u6_identifier_union", "SELECT DISTINCT run_id, identifier FROM findings")
def _(t):
    return N.identifiers(t.findings)


@query("f13_by_action", "SELECT run_id, identifier, status, message FROM findings WHERE action = 'signup'")
def _(t):
    return N.by_action(t.findings, "signup").select("run_id", "identifier", "status", "message")


_CATALOGUE = f"SELECT run_id, start_time, end_time, total_errors, total_successes, {_STATUS} AS status FROM run_totals"


@query("s14_report_catalogue", _CATALOGUE)
def _(t):
    return tables.report_catalogue(t.findings)


@query(
    "s14_report_files",
    f"""SELECT start_time, end_time, CASE WHEN ascii(right(run_id, 1)) % 2 = 0 THEN 'error loading' ELSE {_STATUS} END AS status
        FROM run_totals""",
)
def _(t):
    # One file of JSON lines per run, every other one with a line that was broken off.
    lines = t.findings.select("run_id", F.to_json(F.struct("run_id", "identifier", "action", "status", "message", "ts"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))
    odd = t.findings.select("run_id").distinct().where(F.ascii(F.expr("right(run_id, 1)")) % 2 == 0)
    path = scratch_path(t.spark, "report-files")
    broken = odd.select("run_id", F.lit('{"run_id": "1", "sta').alias("value"))
    every = lines.unionByName(broken).withColumnRenamed("run_id", "run")
    every.repartition("run").write.partitionBy("run").text(path)
    rows = tables.report_catalogue_json(t.spark, path)
    return rows.select(F.col("start_time").cast("timestamp_ntz"), F.col("end_time").cast("timestamp_ntz"), "status")


@query("o5_reports_newest_first", f"SELECT *, row_number() OVER (ORDER BY end_time DESC, run_id) AS place FROM ({_CATALOGUE}) c")
def _(t):
    from fieldlens.plans.ordered import ordered_rows

    newest = tables.report_catalogue(t.findings).withColumn("_age", -F.unix_micros(F.col("end_time").cast("timestamp")))
    rows = ordered_rows(newest, [], ["_age", "run_id"]).extend(position="place")
    return rows.result().drop("_age")


@query("o4_latest_report", "SELECT arg_max(run_id, (ts, run_id)) AS run_id, max(ts) AS end_time FROM findings")
def _(t):
    return tables.latest_report(t.findings)


@query(
    "f16_old_reports",
    f"""SELECT run_id FROM ({_CATALOGUE}) c WHERE end_time < TIMESTAMP '2024-02-01 23:00:00' - INTERVAL 1 DAY""",
)
def _(t):
    now = F.lit("2024-02-01 23:00:00").cast("timestamp_ntz")
    return tables.reports_older_than(tables.report_catalogue(t.findings), 1, now).select("run_id")


@query(
    "f16_listed_reports",
    f"SELECT run_id FROM ({_CATALOGUE}) c WHERE status <> 'failed'",
)
def _(t):
    catalogue = tables.report_catalogue(t.findings)
    return tables.listed_reports(catalogue.withColumn("archived", F.col("status") == "failed")).select("run_id")


@query(
    "s11_report_store",
    "SELECT run_id, identifier, action, status, message, ts FROM findings",
)
def _(t):
    path = scratch_path(t.spark, "reports")
    rows = t.findings.withColumns(
        {"extra": F.create_map().cast("map<string,string>"), "ts": F.col("ts").cast("timestamp")}
    )
    sinks.write_findings(rows, path)
    back = tables.read_reports(t.spark, path)
    return back.select("run_id", "identifier", "action", "status", "message", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("p12_findings_algebra", f"SELECT action, count(*) AS n_entries, count(DISTINCT identifier) AS n_identifiers FROM ({_MERGED}) m GROUP BY action")
def _(t):
    return _merged(t).groupBy("action").agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_distinct("identifier").alias("n_identifiers")
    )


SQL_VIEWS["event_parts"] = """SELECT split_part(event, ':', 1) AS kind, split_part(event, ':', 2) AS collection,
    split_part(event, ':', 3) AS deployment, count AS amount FROM events_text"""
ROLL_UP = """SELECT collection, deployment, CAST(coalesce(sum(amount) FILTER (kind = 'deployment_start'), 0) AS bigint) AS total,
      CAST(coalesce(sum(amount) FILTER (kind = 'file_progress'), 0) AS bigint) AS advanced,
      CAST(coalesce(sum(amount) FILTER (kind = 'deployment_complete'), 0) AS bigint) AS completed
    FROM event_parts GROUP BY collection, deployment"""


@query("a17_progress", ROLL_UP)
def _(t):
    return progress.roll_up(t.events_text)
