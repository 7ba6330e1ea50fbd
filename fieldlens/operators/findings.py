"""Findings: what every check reports, and the report algebra over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("identifier", "action", "status", "message")


def finding(
    when: Column, identifier: Column, action: str, status: str, message: Column | None = None
) -> Column:
    """A finding that holds where a condition does."""
    return F.when(
        when,
        F.struct(
            identifier.alias("identifier"),
            F.lit(action).alias("action"),
            F.lit(status).alias("status"),
            (F.lit(None).cast("string") if message is None else message).alias("message"),
        ),
    )


def emit(df: DataFrame, candidates: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """All findings of all rules in one pass over the rows; ``keep`` names columns to carry along."""
    held = F.array_compact(F.array(*candidates))
    return df.select(*keep, F.inline(held))


def _is(status: str) -> Column:
    return F.col("status") == status


def report_status(errors: Column, successes: Column) -> Column:
    """success, failed, partial or empty, from whether there are errors and successes."""
    return (
        F.when(successes & ~errors, "success")
        .when(errors & ~successes, "failed")
        .when(errors & successes, "partial")
        .otherwise("empty")
    )


def summarise(findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run: status, its four tests, totals, first and last time, duration.

    With ``runs``, a table of all run ids, runs without findings show as empty.
    """
    counted = findings.groupBy("run_id").agg(
        F.count_if(_is("error")).alias("total_errors"),
        F.count_if(_is("success")).alias("total_successes"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
    )
    if runs is not None:
        counted = runs.join(counted, "run_id", "left").na.fill(
            0, ["total_errors", "total_successes"]
        )
    status = report_status(F.col("total_errors") > 0, F.col("total_successes") > 0)
    counted = counted.withColumn("status", status)
    tests = {f"is_{name}": F.col("status") == name for name in ("success", "failed", "partial", "empty")}
    seconds = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / 1_000_000
    return counted.withColumns({**tests, "duration_seconds": seconds})


def dashboard(findings: DataFrame) -> DataFrame:
    """Totals, distinct identifiers and actions and the status per run."""
    return (
        findings.groupBy("run_id")
        .agg(
            F.count_if(_is("success")).alias("total_successes"),
            F.count_if(_is("error")).alias("total_errors"),
            F.count_distinct("identifier").alias("unique_identifiers"),
            F.count_distinct(F.when(F.col("action") != "", F.col("action"))).alias("unique_actions"),
        )
        .withColumn("status", report_status(F.col("total_errors") > 0, F.col("total_successes") > 0))
    )


def action_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id", "action").agg(
        F.count_if(_is("success")).alias("successes"), F.count_if(_is("error")).alias("errors")
    )


def actions(findings: DataFrame) -> DataFrame:
    """Sorted distinct action names."""
    return findings.where(F.col("action") != "").select("action").distinct().orderBy("action")


def by_action(findings: DataFrame, action: str) -> DataFrame:
    return findings.where(F.col("action") == action)


def merge(target: DataFrame, *incoming: DataFrame, run_id: str, order: str = "ts") -> DataFrame:
    """Reports merged into one, which bears ``run_id``.

    All entries of ``target`` stay, equal ones too. Of the incoming entries those that it holds are
    skipped, and of equal ones the earliest by ``order`` is taken. Entries are equal when all columns but
    the run and ``order`` are: null equals null, and maps are compared by their sorted entries. Partial
    aggregation removes most repeats before the shuffle, however often one repeats.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [target.limit(0), *incoming])
    maps = [f.name for f in stacked.schema if isinstance(f.dataType, T.MapType)]
    keys = [c for c in stacked.columns if c not in (order, "run_id")]
    entries = {c: F.array_sort(F.map_entries(c)) for c in maps}
    fresh = stacked.withColumns(entries).groupBy(*keys).agg(F.min(order).alias(order))
    whole = stacked.limit(0).unionByName(target, allowMissingColumns=True)
    held = whole.withColumns(entries).select(*[F.col(c).alias(f"_held_{c}") for c in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in keys])
    added = fresh.join(held, same, "left_anti").withColumns({c: F.map_from_entries(c) for c in maps})
    run = F.lit(run_id).alias("run_id")
    columns = [run if c == "run_id" else F.col(c) for c in stacked.columns]
    return whole.select(*columns).unionAll(added.select(*columns))


def merged_span(*summaries: DataFrame, run_id: str) -> DataFrame:
    """Start and end of the merged report: earliest start, latest end."""
    stacked = reduce(DataFrame.unionByName, summaries)
    return stacked.agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).select(
        F.lit(run_id).alias("run_id"), "start_time", "end_time"
    )


def identifiers(findings: DataFrame) -> DataFrame:
    """Identifiers that have errors or successes."""
    return findings.select("run_id", "identifier").distinct()


def as_run(findings: DataFrame, run_id: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Findings in the declared schema, as one run."""
    pairs = [part for key, value in (extra or {}).items() for part in (F.lit(key), value.cast("string"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return findings.select(
        F.lit(run_id).alias("run_id"),
        *COLUMNS,
        details.alias("extra"),
        F.current_timestamp().alias("ts"),
    )
