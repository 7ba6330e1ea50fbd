"""Field-form entries: sites, sessions and the field sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import dates, filters, parsing
from fieldlens.plans.ordered import ordered_rows
from fieldlens.session import stored


def entries_of_pages(pages: DataFrame) -> DataFrame:
    """All entries of the pages of a form; a page with errors fails the job.

    pages: (errors array<struct<title>>, data struct<entries array<struct>>).
    """
    failed = F.col("errors").isNotNull() & (F.size("errors") > 0)
    checked = pages.withColumn(
        "_entries",
        F.when(failed, F.raise_error(F.col("errors")[0]["title"]).cast(pages.select("data.entries").schema[0].dataType))
        .otherwise(F.col("data.entries")),
    )
    return checked.select(F.inline("_entries"))


def text_cells(entries: DataFrame) -> DataFrame:
    """List cells as text."""
    lists = [f.name for f in entries.schema if f.dataType.typeName() == "array"]
    return entries.withColumns({name: parsing.joined_cell(F.col(name)) for name in lists})


def select_entries(
    entries: DataFrame,
    filter_texts: Sequence[str] = (),
    fields: Sequence[str] = (),
    mandatory: Sequence[str] = (),
) -> DataFrame:
    """Entries that meet all filters, with the named fields and, among named ones, the mandatory ones."""
    kept = filters.apply_filters(text_cells(entries), filter_texts)
    return filters.project(kept, list(dict.fromkeys([*fields, *mandatory]))) if fields else kept


def incomplete_pages(pages: DataFrame) -> DataFrame:
    """What is missing from the pages of a form (errors, meta): form pages not delivered, or with errors.

    Pages are complete when every number from 1 to the last page is there and none reports an error.
    Returns page and reason; the last page number is the largest any page names.
    """
    numbers = pages.select(
        F.col("meta.current_page").alias("page"), F.col("meta.last_page").alias("last"),
        (F.size(F.coalesce("errors", F.array().cast("array<struct<title:string>>"))) > 0).alias("failed"),
    )
    last = numbers.agg(F.max("last").alias("last")).select(F.explode(F.sequence(F.lit(1), "last")).alias("page"))
    absent = last.join(numbers.where("NOT failed").select("page"), "page", "left_anti")
    failed = numbers.where("failed").select("page", F.lit("error").alias("reason"))
    return absent.join(failed.select("page"), "page", "left_anti").select("page", F.lit("missing").alias("reason")).unionAll(failed)


def group_keys(
    entries: DataFrame,
    site_field: str,
    session_field: str,
    aliases: DataFrame | None = None,
    *,
    entry_id: str = "entry_uuid",
) -> DataFrame:
    """Entries with ``site`` and ``session`` keys and the parsed ``created``.

    A site alias replaces the raw name. Blank keys become a key of their own, from the entry's id.
    aliases: (site, alias), one row per site.
    """

    def key(raw: Column, prefix: str) -> Column:
        clean = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
        return F.when(clean == "", parsing.unknown_key(prefix, F.col(entry_id))).otherwise(clean)

    rows = entries.withColumns(
        {
            "site": key(F.col(site_field), "UNKNOWN_SITE"),
            "session": key(F.col(session_field), "UNKNOWN_SES"),
            "created": dates.iso_time(F.col("created_at")),
        }
    )
    if aliases is None:
        return rows
    named = aliases.select(F.col("site").alias("_site"), F.col("alias").alias("_alias"))
    joined = rows.join(named, rows["site"] == named["_site"], "left")
    return joined.withColumn("site", F.coalesce("_alias", "site")).drop("_site", "_alias")


def grouped_entries(
    keyed: DataFrame, *, entry_id: str = "entry_uuid", chunk_rows: int | None = None
) -> DataFrame:
    """Entries numbered by date inside site and session; entries without a date come first."""
    rows = ordered_rows(keyed, ["site", "session"], ["created", entry_id], chunk_rows=chunk_rows)
    return rows.extend(position="position").result()


def nested_entries(
    keyed: DataFrame, fields: Sequence[str], *, entry_id: str = "entry_uuid", page_rows: int = 10_000,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Site, session and a sorted list of entries, in pages of bounded length."""
    placed = grouped_entries(keyed, entry_id=entry_id, chunk_rows=chunk_rows)
    return (
        placed.withColumn("page", F.floor((F.col("position") - 1) / page_rows) + 1)
        .groupBy("site", "session", "page")
        .agg(F.sort_array(F.collect_list(F.struct("position", *fields))).alias("entries"))
    )


# Spans in a chunk of an order over all sites, so that no task holds all of them.
SHEET_CHUNK = 100_000


def session_spans(keyed: DataFrame) -> DataFrame:
    """First and last creation text per site and session; groups without any date are dropped."""
    return (
        keyed.where(F.col("created").isNotNull())
        .groupBy("site", "session")
        .agg(
            F.min("created").alias("started"),
            F.min_by("created_at", F.struct("created", "created_at")).alias("first_entry"),
            F.max_by("created_at", F.struct("created", "created_at")).alias("last_entry"),
        )
    )


def field_sheet(
    keyed: DataFrame, *, partition_by: Sequence[str] = (), chunk_rows: int | None = None
) -> DataFrame:
    """Spans in order of their start with the end of the span before as ``new_start``.

    The order is over all sites unless ``partition_by`` names columns. An order over all is cut into chunks of
    ``chunk_rows`` spans, SHEET_CHUNK unless given; spans of a part are only where ``chunk_rows`` is given. They are
    stored then, so the entries are aggregated once.
    """
    spans = session_spans(keyed)
    if not partition_by:
        chunk_rows = chunk_rows or SHEET_CHUNK
    if chunk_rows is not None:
        spans = stored(spans, "spans")
    order = ["started", "site", "session"]
    rows = ordered_rows(spans, partition_by, order, chunk_rows=chunk_rows)
    result = rows.extend(previous={"new_start": F.col("last_entry")}).result()
    return result.select("site", "session", "first_entry", "last_entry", "new_start")
