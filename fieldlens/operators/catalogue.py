"""Lookups over the platforms' entity tables: projects, workflows, subject sets, subjects, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import parsing


def sets_of_workflow(subject_sets: DataFrame, workflow_id: int | str) -> DataFrame:
    """Subject sets linked to a workflow; links are compared as text."""
    links = F.transform("workflow_links", lambda x: x.cast("string"))
    return subject_sets.where(F.array_contains(links, str(workflow_id)))


def exists_by_name(entities: DataFrame, name: str) -> DataFrame:
    """One row that tells whether an entity with the name exists."""
    return entities.where(F.col("display_name") == name).agg((F.count(F.lit(1)) > 0).alias("exists"))


def with_exports(entities: DataFrame, exports: DataFrame, key: str = "id") -> DataFrame:
    return entities.join(exports.select(F.col("entity_id").alias(key)), key, "left_semi")


def export_freshness(workflows: DataFrame, exports: DataFrame) -> DataFrame:
    """Last export date per workflow: updated, else created, else a dash.

    Dates that parse are rewritten as ``YYYY-MM-DD HH:MM:SS``, others stay as they are.
    """
    text = F.coalesce(F.nullif(F.col("updated_at"), F.lit("")), F.nullif(F.col("created_at"), F.lit("")))
    shown = F.coalesce(F.date_format(text.try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), text, F.lit("-"))
    dated = exports.select(F.col("entity_id").alias("id"), shown.alias("_date"))
    name = F.coalesce("display_name", F.lit("—"))
    joined = workflows.join(dated, "id", "left")
    return joined.select("id", name.alias("display_name"), F.coalesce("_date", F.lit("-")).alias("last_export"))


def _normalised(text: Column) -> Column:
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def subject_keys(subjects: DataFrame) -> DataFrame:
    """Subjects with the normalised name and origin they are recognised by."""
    # A key with a blank value counts as absent.
    metadata = F.map_filter("metadata", lambda _, value: value != "")
    named = F.coalesce(
        F.nullif(F.col("display_name"), F.lit("")), parsing.first_key(metadata, parsing.SUBJECT_NAME_KEYS)
    )
    origin = parsing.first_key(metadata, ("origin", "Origin"))
    return subjects.withColumns({"_name": _normalised(named), "_origin": _normalised(origin)})


def subjects_present(candidates: DataFrame, subjects: DataFrame) -> DataFrame:
    """Candidates whose id, name or origin equals that of a subject.

    candidates: (candidate, id, name, origin), any of them null. The three equalities are three hash
    joins against distinct keys, not one join on an OR, which would compare every pair.
    """
    known = subject_keys(subjects)

    keyed = candidates.withColumns(
        {"_name": _normalised(F.col("name")), "_origin": _normalised(F.col("origin"))}
    )
    found = [
        keyed.join(known.select(key).distinct(), key, "left_semi").select("candidate")
        for key in ("id", "_name", "_origin")
    ]
    return found[0].union(found[1]).union(found[2]).distinct()


def get_or_create(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Id per wanted name: the first existing one, else a new row without id."""
    first = existing.groupBy("display_name").agg(F.min("id").alias("id"))
    joined = wanted.select("display_name").distinct().join(first, "display_name", "left")
    return joined.withColumn("created", F.col("id").isNull())


def reference_check(
    requests: DataFrame, research: DataFrame, classification: DataFrame, collections: DataFrame
) -> DataFrame:
    """First broken link of (research project, classification project, collection), or ``ok``."""
    r = research.select(F.col("pk").alias("research_project")).distinct().withColumn("_r", F.lit(True))
    c = classification.select(F.col("pk").alias("classification_project"), "research_project")
    k = collections.select(F.col("pk").alias("collection"), "classification_project")
    joined = (
        requests.join(r, "research_project", "left")
        .join(c.distinct().withColumn("_c", F.lit(True)), ["classification_project", "research_project"], "left")
        .join(k.distinct().withColumn("_k", F.lit(True)), ["collection", "classification_project"], "left")
    )
    outcome = (
        F.when(F.col("_r").isNull(), "no research project")
        .when(F.col("_c").isNull(), "no classification project")
        .when(F.col("_k").isNull(), "no collection")
        .otherwise("ok")
    )
    return joined.select("research_project", "classification_project", "collection", outcome.alias("outcome"))


def fan_out_counts(subject_sets: DataFrame) -> DataFrame:
    """Subject sets and linked subjects per workflow."""
    linked = subject_sets.select(F.explode("workflow_links").alias("workflow_id"), "id", "n_subjects")
    return linked.groupBy("workflow_id").agg(
        F.count_distinct("id").alias("n_subject_sets"), F.sum("n_subjects").alias("n_subjects")
    )


def attribute_keys(subjects: DataFrame, column: str) -> DataFrame:
    """Distinct keys of a map column over all subjects."""
    return subjects.select(F.explode(F.map_keys(column)).alias("key")).distinct()


def task_preview(tasks: DataFrame, shown: int = 10) -> DataFrame:
    """First options of every task and how many more there are."""
    return tasks.select(
        "task_id",
        F.slice("answers", 1, shown).alias("preview"),
        F.greatest(F.size("answers") - shown, F.lit(0)).alias("more"),
    )
