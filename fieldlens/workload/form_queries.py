"""Queries on field forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import filters, parsing
from fieldlens.operators import forms as O
from fieldlens.session import scratch_path
from fieldlens.sources import sinks, tables
from fieldlens.workload.registry import SQL_VIEWS, query

SQL_VIEWS["dated_entries"] = """SELECT *, try_strptime(rtrim(created_at, 'Z'), ['%Y-%m-%dT%H:%M:%S.%g', '%Y-%m-%dT%H:%M:%S']) AS created
    FROM entries"""
SQL_VIEWS["aliases"] = "SELECT printf('S%02d', n_nationkey) AS site, n_name AS alias FROM nation"
SQL_VIEWS["raw_sites"] = """SELECT *, CASE WHEN trim(site_raw) = '' THEN 'UNKNOWN_SITE_' || upper(substr(sha1(entry_uuid), 1, 12))
      ELSE trim(site_raw) END AS raw_site, session_raw AS session FROM dated_entries"""
SQL_VIEWS["keyed_entries"] = """SELECT e.*, coalesce(a.alias, e.raw_site) AS site FROM raw_sites e LEFT JOIN aliases a ON a.site = e.raw_site"""
SQL_VIEWS["spans"] = """SELECT site, session, min(created) AS started, arg_min(created_at, (created, created_at)) AS first_entry,
      arg_max(created_at, (created, created_at)) AS last_entry
    FROM keyed_entries WHERE created IS NOT NULL GROUP BY site, session"""


def _aliases(t):
    return t.nation.selectExpr("printf('S%02d', n_nationkey) AS site", "n_name AS alias")


def _keyed(t):
    return O.group_keys(t.entries, "site_raw", "session_raw", _aliases(t))


@query("j13_site_aliases", "SELECT entry_uuid, site FROM keyed_entries")
def _(t):
    return _keyed(t).select("entry_uuid", "site")


@query("t22_unknown_keys", "SELECT entry_uuid, raw_site AS site FROM raw_sites")
def _(t):
    return O.group_keys(t.entries, "site_raw", "session_raw").select("entry_uuid", "site")


@query("a4_session_spans", "SELECT site, session, first_entry, last_entry FROM spans")
def _(t):
    return O.session_spans(_keyed(t)).select("site", "session", "first_entry", "last_entry")


@query(
    "a20_site_session_entries",
    """SELECT entry_uuid, site, session, row_number() OVER (PARTITION BY site, session ORDER BY created NULLS FIRST, entry_uuid) AS place
       FROM keyed_entries""",
)
def _(t):
    nested = O.nested_entries(_keyed(t), ["entry_uuid"], page_rows=100)
    rows = nested.select("site", "session", F.inline("entries"))
    return rows.select("entry_uuid", "site", "session", F.col("position").alias("place"))


@query(
    "o3_entries_by_date",
    """SELECT entry_uuid, created, row_number() OVER (PARTITION BY site, session ORDER BY created NULLS FIRST, entry_uuid) AS position
       FROM keyed_entries""",
)
def _(t):
    return O.grouped_entries(_keyed(t)).select("entry_uuid", "created", "position")


@query(
    "w8_field_sheet_starts",
    """SELECT site, session, first_entry, last_entry, lag(last_entry) OVER (ORDER BY started, site, session) AS new_start FROM spans""",
)
def _(t):
    return O.field_sheet(_keyed(t))


@query(
    "p10_field_sheet_by_site",
    """SELECT site, session, first_entry, last_entry,
         lag(last_entry) OVER (PARTITION BY site ORDER BY started, site, session) AS new_start FROM spans""",
)
def _(t):
    return O.field_sheet(_keyed(t), partition_by=["site"])


_NUMBER = """CASE WHEN regexp_full_match(reading, '\\s*[+-]?([0-9]+|[0-9]+\\.[0-9]*|\\.[0-9]+)\\s*') THEN CAST(reading AS double) END"""


@query(
    "f7_filter_expressions",
    f"""SELECT entry_uuid, site_raw, reading FROM entries WHERE site_raw IN ('S01', 'S02', 'S07') AND coalesce({_NUMBER} > 320, false)""",
)
def _(t):
    kept = filters.apply_filters(t.entries, ["site_raw==S01 OR S02 OR S07", "reading>320"])
    return kept.select("entry_uuid", "site_raw", "reading")


@query(
    "f7_inequalities",
    f"""SELECT entry_uuid FROM entries WHERE coalesce({_NUMBER} <> 12.5, true) AND coalesce(session_raw >= '3', false)
       AND coalesce(site_raw <> 'S01', true)""",
)
def _(t):
    return filters.apply_filters(t.entries, ["reading!=12.5", "session_raw>=3-", "site_raw!=S01"]).select("entry_uuid")


@query("f10_field_projection", "SELECT entry_uuid, reading, CAST(NULL AS varchar) AS weather FROM entries")
def _(t):
    return filters.project(t.entries, ["entry_uuid", "reading", "weather"])


@query(
    "u4_mandatory_fields",
    "SELECT created_at, entry_uuid, reading FROM entries",
)
def _(t):
    return O.select_entries(t.entries, fields=["reading", "entry_uuid"], mandatory=["entry_uuid", "created_at"])


@query(
    "t20_list_cells",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE c_name || ':::' || c_mktsegment END AS cell FROM customer",
)
def _(t):
    lists = t.customer.selectExpr(
        "c_custkey", "slice(array(c_name, c_mktsegment), 1, CAST(c_custkey % 3 AS int)) AS cell"
    )
    return O.text_cells(lists)


@query(
    "t21_first_or_blank",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS cell FROM customer",
)
def _(t):
    lists = t.customer.selectExpr(
        "c_custkey", "slice(array(c_name, c_mktsegment), 1, CAST(c_custkey % 3 AS int)) AS cell"
    )
    return lists.select("c_custkey", parsing.first_or_blank(F.col("cell")).alias("cell"))


def _pages(t):
    """The entries as stored pages of at most 1000, the form platform's page size."""
    entry = F.struct("entry_uuid", "site_raw", "session_raw", "created_at", "reading")
    numbered = t.entries.withColumn("page", F.floor(F.expr("CAST(substr(entry_uuid, 2) AS bigint)") / 1000) + 1)
    pages = numbered.groupBy("page").agg(F.struct(F.collect_list(entry).alias("entries")).alias("data"))
    path = scratch_path(t.spark, "form-pages")
    meta = F.struct(F.col("page").cast("int").alias("current_page"), F.lit(0).alias("last_page"))
    pages.select(meta.alias("meta"), "data").write.json(path)
    text = "struct<entry_uuid:string,site_raw:string,session_raw:string,created_at:string,reading:string>"
    return tables.read_form_pages(t.spark, path, text)


@query("s5_form_pages", "SELECT entry_uuid, site_raw, session_raw, created_at, reading FROM entries")
def _(t):
    return O.entries_of_pages(_pages(t))


@query(
    "s5_incomplete_pages",
    """WITH p AS (SELECT DISTINCT CAST(floor(CAST(substr(entry_uuid, 2) AS bigint) / 1000) + 1 AS int) AS page FROM entries),
         kept AS (SELECT page FROM p WHERE page % 3 <> 2)
       SELECT page, 'error' AS reason FROM kept WHERE page % 6 = 0
       UNION ALL SELECT CAST(n AS int), 'missing' FROM (SELECT unnest(range(1, (SELECT max(page) FROM p) + 1)) AS n) r
         WHERE n NOT IN (SELECT page FROM kept)""",
)
def _(t):
    # Every third page got lost on the way, and some came back as errors.
    pages = _pages(t)
    last = pages.agg(F.max("meta.current_page")).first()[0]
    number = F.col("meta.current_page")
    failed = F.when(number % 6 == 0, F.array(F.struct(F.lit("rate limit").alias("title"))))
    got = pages.where(number % 3 != 2).withColumns(
        {"errors": failed, "meta": F.struct(number.alias("current_page"), F.lit(last).alias("last_page"))}
    )
    return O.incomplete_pages(got)


@query("u8_concatenated_pages", "SELECT count(*) AS n_entries, count(DISTINCT entry_uuid) AS n_ids FROM entries")
def _(t):
    return O.entries_of_pages(_pages(t)).agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_distinct("entry_uuid").alias("n_ids")
    )


_UNION = """SELECT '' AS c_mktsegment, coalesce(created_at, '') AS created_at, entry_uuid AS id, coalesce(reading, '') AS reading FROM entries
    UNION ALL SELECT c_mktsegment, '', c_name, '' FROM customer"""


def _two_forms(t):
    first = t.entries.selectExpr("entry_uuid AS id", "created_at", "reading")
    return [first, t.customer.selectExpr("c_name AS id", "c_mktsegment")]


@query("u7_key_union", _UNION)
def _(t):
    return sinks.entry_rows(_two_forms(t))


@query("s7_entries_csv", _UNION)
def _(t):
    path = scratch_path(t.spark, "entries-csv")
    sinks.write_entries(_two_forms(t), path)
    columns = "c_mktsegment string, created_at string, id string, reading string"
    return t.spark.read.schema(columns).option("header", "true").csv(path).na.fill("")
