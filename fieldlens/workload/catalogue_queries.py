"""Queries on the platforms' entity tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators import catalogue as K
from fieldlens.sources import tables
from fieldlens.workload.registry import SQL_VIEWS, query

SQL_VIEWS["set_links"] = """SELECT id, first_link AS workflow_id, n_subjects FROM subject_sets
    UNION SELECT id, second_link, n_subjects FROM subject_sets"""


def _sets(t):
    links = F.array_distinct(F.array("first_link", "second_link")).alias("workflow_links")
    return t.subject_sets.select("id", "display_name", "n_subjects", links)


def _subjects(t):
    metadata = F.create_map(F.lit("Filename"), F.col("file_name"), F.lit("origin"), F.col("origin"))
    return t.subjects.select("id", "display_name", "subject_set_id", metadata.alias("metadata"))


@query("f12_sets_of_workflow", "SELECT id FROM subject_sets WHERE first_link = 107 OR second_link = 107")
def _(t):
    return K.sets_of_workflow(_sets(t), 107).select("id")


@query("f14_exists_by_name", "SELECT count(*) > 0 AS \"exists\" FROM subject_sets WHERE display_name = 'set 42'")
def _(t):
    return K.exists_by_name(t.subject_sets, "set 42")


@query("f14_by_id", "SELECT id, display_name FROM subject_sets WHERE id = 7")
def _(t):
    return t.subject_sets.where("id = 7").select("id", "display_name")


@query("f15_with_exports", "SELECT id FROM workflows WHERE id IN (SELECT entity_id FROM exports)")
def _(t):
    return K.with_exports(t.workflows, t.exports).select("id")


@query(
    "t28_export_freshness",
    """SELECT w.id, coalesce(w.display_name, '—') AS display_name, coalesce(strftime(try_strptime(coalesce(e.updated_at, e.created_at),
         '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M:%S'), e.updated_at, e.created_at, '-') AS last_export
       FROM workflows w LEFT JOIN exports e ON e.entity_id = w.id""",
)
def _(t):
    return K.export_freshness(t.workflows, t.exports)


@query(
    "j7_subjects_present",
    """SELECT DISTINCT c.candidate FROM candidates c WHERE c.id IN (SELECT id FROM subjects)
       OR lower(trim(c.name)) IN (SELECT lower(trim(coalesce(display_name, file_name))) FROM subjects)
       OR lower(trim(c.origin)) IN (SELECT lower(trim(origin)) FROM subjects)""",
)
def _(t):
    return K.subjects_present(t.candidates, _subjects(t))


@query(
    "j15_reference_check",
    """SELECT q.research_project, q.classification_project, q.collection, CASE WHEN r.r_regionkey IS NULL THEN 'no research project'
         WHEN n.n_nationkey IS NULL THEN 'no classification project' WHEN c.pk IS NULL THEN 'no collection' ELSE 'ok' END AS outcome
       FROM requests q LEFT JOIN region r ON r.r_regionkey = q.research_project
       LEFT JOIN nation n ON n.n_nationkey = q.classification_project AND n.n_regionkey = q.research_project
       LEFT JOIN project_collections c ON c.pk = q.collection AND c.classification_project = q.classification_project""",
)
def _(t):
    research = t.region.selectExpr("r_regionkey AS pk")
    classification = t.nation.selectExpr("n_nationkey AS pk", "n_regionkey AS research_project")
    return K.reference_check(t.requests, research, classification, t.project_collections)


@query(
    "j16_get_or_create",
    """SELECT w.display_name, coalesce(e.id, -1) AS id, e.id IS NULL AS created
       FROM (SELECT DISTINCT printf('set %d', o_custkey) AS display_name FROM orders) w
       LEFT JOIN (SELECT display_name, min(id) AS id FROM subject_sets GROUP BY display_name) e ON e.display_name = w.display_name""",
)
def _(t):
    wanted = t.orders.selectExpr("printf('set %d', o_custkey) AS display_name")
    return K.get_or_create(t.subject_sets, wanted).na.fill(-1, ["id"])


@query(
    "a21_fan_out_counts",
    "SELECT workflow_id, count(DISTINCT id) AS n_subject_sets, CAST(sum(n_subjects) AS bigint) AS n_subjects FROM set_links GROUP BY workflow_id",
)
def _(t):
    return K.fan_out_counts(_sets(t))


@query(
    "a21_set_sizes",
    """SELECT s.subject_set_id, count(*) AS n_subjects FROM subjects s GROUP BY s.subject_set_id""",
)
def _(t):
    return _subjects(t).groupBy("subject_set_id").agg(F.count(F.lit(1)).alias("n_subjects"))


@query(
    "a21_links_per_set",
    "SELECT id, CAST(count(DISTINCT workflow_id) AS int) AS n_workflows FROM set_links GROUP BY id",
)
def _(t):
    return _sets(t).select("id", F.size("workflow_links").alias("n_workflows"))


@query(
    "a22_attribute_keys",
    "SELECT DISTINCT substr(part, 1, strpos(part, '=') - 1) AS key FROM (SELECT unnest(string_split(split_part(split_part(url, '?', 2), '#', 1), '&')) AS part "
    "FROM pages) p WHERE contains(part, '=')",
)
def _(t):
    # The pages' own query parameters as the attribute map.
    asked = F.split_part(F.split_part(F.col("url"), F.lit("?"), F.lit(2)), F.lit("#"), F.lit(1))
    pairs = F.filter(F.split(asked, "&"), lambda p: p.contains("="))
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    # One key may occur twice in an address; the map needs distinct keys.
    attributes = F.map_from_arrays(F.array_distinct(names), F.array_distinct(names))
    return K.attribute_keys(t.pages.select(attributes.alias("metadata")), "metadata")


@query(
    "o8_task_preview",
    """SELECT c_custkey AS task_id, least(c_custkey % 25, 10) AS n_shown, CAST(greatest(c_custkey % 25 - 10, 0) AS int) AS more,
         CASE WHEN c_custkey % 25 > 0 THEN c_name || '-1' ELSE '' END AS first_option FROM customer""",
)
def _(t):
    options = F.expr(
        "CASE WHEN c_custkey % 25 > 0 THEN transform(sequence(1, CAST(c_custkey % 25 AS int)), i -> c_name || '-' || i) "
        "ELSE CAST(array() AS array<string>) END"
    )
    shown = K.task_preview(t.customer.select(F.col("c_custkey").alias("task_id"), options.alias("answers")))
    first = F.coalesce(F.try_element_at("preview", F.lit(1)), F.lit("")).alias("first_option")
    return shown.select("task_id", F.size("preview").cast("bigint").alias("n_shown"), "more", first)


@query(
    "s4_entity_tables",
    """SELECT 'supplier' AS entity, CAST(s_suppkey AS bigint) AS id, s_name AS name FROM supplier
       UNION ALL SELECT 'customer', CAST(c_custkey AS bigint), c_name FROM customer
       UNION ALL SELECT 'nation', CAST(n_nationkey AS bigint), n_name FROM nation""",
)
def _(t):
    declared = {
        "supplier": "s_suppkey bigint, s_name string",
        "customer": "c_custkey bigint, c_name string",
        "nation": "n_nationkey int, n_name string",
    }
    parts = [
        tables.read_table(t.spark, f"{t.folder}/{name}.parquet", columns).toDF("id", "name").select(
            F.lit(name).alias("entity"), F.col("id").cast("bigint").alias("id"), "name"
        )
        for name, columns in declared.items()
    ]
    return parts[0].union(parts[1]).union(parts[2])
