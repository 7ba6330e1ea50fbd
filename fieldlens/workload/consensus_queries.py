"""Queries on classification exports and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import parsing
from fieldlens.operators import consensus as C
from fieldlens.workload.registry import SQL_VIEWS, query

_CHOICE = """CASE (l_suppkey + i) % 8 WHEN 0 THEN 'NOANIMAL' WHEN 1 THEN 'HUMANORVEHICLE' WHEN 2 THEN 'OTHERSPECIES'
    WHEN 3 THEN 'REDDEER' WHEN 4 THEN 'WILDBOAR' WHEN 5 THEN 'REDFOX' WHEN 6 THEN 'BIRD' ELSE 'MYSTERY' END"""

SQL_VIEWS["classified"] = """SELECT l_orderkey AS sid, l_orderkey % 3 AS rule, l_linenumber % 5 AS k, e.workflow_id,
      e.workflow_id || ':' || e.workflow_name || ':' || coalesce(e.workflow_version, '') AS workflow_key,
      e.classification_id, e.user_name, e.user_id, l_suppkey, l_returnflag, l_quantity,
      CASE WHEN l_linenumber = 7 THEN printf('R0034-LOC__20250101_%d.JPG', l_orderkey)
           ELSE printf('%d_x_R0001-LOC_001_x_IMG_1.JPG', l_orderkey) END AS subject_name,
      CASE WHEN l_linenumber <> 7 THEN CAST(l_orderkey AS varchar) END AS media_id,
      l_returnflag = 'R' AS retired
    FROM lineitem JOIN export e ON e.classification_id =
      printf('%d-%d-%d-%d-', l_orderkey, l_linenumber, l_partkey, l_suppkey) || CAST(CAST(round(l_extendedprice * 100) AS bigint) AS varchar)"""
SQL_VIEWS["chosen"] = f"""SELECT *, {_CHOICE} AS choice, CASE l_returnflag WHEN 'N' THEN 'many'
      WHEN 'R' THEN CAST(CAST(l_quantity AS int) AS varchar) END AS howmany
    FROM (SELECT *, unnest(range(k)) AS i FROM classified) c"""
SQL_VIEWS["named"] = """SELECT *, CASE choice WHEN 'NOANIMAL' THEN 'blank' WHEN 'HUMANORVEHICLE' THEN 'human'
      WHEN 'OTHERSPECIES' THEN 'animal' WHEN 'REDDEER' THEN 'Cervus elaphus' WHEN 'WILDBOAR' THEN 'Sus scrofa'
      WHEN 'REDFOX' THEN 'Vulpes vulpes' WHEN 'BIRD' THEN CASE WHEN rule = 2 THEN 'unknown' ELSE 'Aves' END
      ELSE CASE WHEN rule = 2 THEN 'unknown' ELSE choice END END AS taxon FROM chosen"""
SQL_VIEWS["k_votes"] = """SELECT workflow_id, workflow_key, sid, media_id, rule, k, count(*) AS n FROM classified
    WHERE rule = 2 OR k BETWEEN 1 AND 3 GROUP BY ALL"""
SQL_VIEWS["k_modes"] = """SELECT *, max(n) OVER (PARTITION BY workflow_key, sid, media_id) AS top FROM k_votes"""
SQL_VIEWS["majorities"] = """SELECT workflow_id, workflow_key, sid, media_id, max(CASE WHEN k <= 3 THEN k END) AS k_majority
    FROM k_modes WHERE n = top GROUP BY ALL"""
SQL_VIEWS["species"] = """SELECT workflow_id, workflow_key, sid, media_id, taxon, count(*) AS votes,
      min((classification_id, i)) AS first_vote,
      CAST(ceil(median(CASE WHEN regexp_full_match(howmany, '[0-9]+') THEN CAST(howmany AS bigint) END)) AS bigint) AS individuals
    FROM named WHERE rule = 2 OR k BETWEEN 1 AND 3 GROUP BY workflow_id, workflow_key, sid, media_id, taxon"""


def _top(legacy: bool) -> str:
    keep = "true" if legacy else "NOT (m.k_majority > 1 AND s.taxon = 'blank')"
    return f"""SELECT s.*, m.k_majority, row_number() OVER (PARTITION BY s.workflow_key, s.sid, s.media_id
          ORDER BY s.votes DESC, s.first_vote) AS rank
        FROM species s JOIN majorities m ON s.workflow_key = m.workflow_key AND s.sid = m.sid
          AND s.media_id IS NOT DISTINCT FROM m.media_id
        WHERE m.k_majority IS NOT NULL AND {keep}"""


SQL_VIEWS["ranked_species"] = _top(False)
SQL_VIEWS["kept_species"] = "SELECT * FROM ranked_species WHERE rank <= greatest(1, k_majority + 1)"
SQL_VIEWS["confident"] = """SELECT *, coalesce(votes / (votes + lead(votes) OVER
      (PARTITION BY workflow_key, sid, media_id ORDER BY rank)), 1.0) AS confidence FROM kept_species"""
SQL_VIEWS["decided"] = """SELECT *, CASE WHEN taxon IN ('Homo sapiens', 'human') THEN 'human'
      WHEN taxon IN ('vehicle', 'blank', 'unclassified', 'unknown') THEN taxon ELSE 'animal' END AS observation_type,
      CASE WHEN taxon IN ('vehicle', 'blank', 'unclassified', 'unknown', 'animal', 'human') THEN '' ELSE taxon END AS scientific_name
    FROM confident"""
SQL_VIEWS["flat_values"] = "SELECT workflow_key, sid, classification_id, i, choice FROM chosen"

_SUBJECT = "workflow_key, sid, coalesce(media_id, '-') AS media_id"


def _classified(t):
    return C.classification_table(t.export)


def _pairs(t):
    return parsing.choice_rows(_classified(t), "annotations", ["sid", "workflow_id", "classification_id"])


def _tally(t):
    return C.tally(_classified(t))


def _keyed(df, *columns):
    return df.select("workflow_key", "sid", F.coalesce("media_id", F.lit("-")).alias("media_id"), *columns)


@query(
    "p8_classification_table",
    """SELECT classification_id, user_name, user_id, workflow_key, sid, media_id, subject_name, retired,
         CASE WHEN retired THEN 'classification_count' END AS retirement_reason FROM classified""",
)
def _(t):
    return _classified(t).select(
        "classification_id", "user_name", "user_id", "workflow_key", "sid", "media_id", "subject_name", "retired",
        "retirement_reason",
    )


@query(
    "a5_workflow_summary",
    """SELECT workflow_key, count(*) AS total_rows, count(*) FILTER (retired) AS retired_rows,
         count(DISTINCT sid) AS distinct_subjects, count(DISTINCT CASE WHEN retired THEN sid END) AS retired_subjects,
         round(100 * count(DISTINCT CASE WHEN retired THEN sid END) / count(DISTINCT sid), 6) AS retired_pct
       FROM classified GROUP BY workflow_key""",
)
def _(t):
    return C.workflow_summary(_classified(t)).withColumn("retired_pct", F.round("retired_pct", 6))


@query(
    "a6_classifications_per_subject",
    f"SELECT {_SUBJECT}, count(*) AS n_classifications FROM classified GROUP BY workflow_key, sid, media_id",
)
def _(t):
    return _keyed(C.classifications_per_subject(_classified(t)), "n_classifications")


@query(
    "a7_k_majority",
    f"SELECT {_SUBJECT}, CAST(coalesce(k_majority, -1) AS bigint) AS k_majority FROM majorities",
)
def _(t):
    return _keyed(C.k_majority(_tally(t)), F.coalesce("k_majority", F.lit(-1)).cast("bigint").alias("k_majority"))


@query("a8_species_votes", f"SELECT {_SUBJECT}, taxon, votes FROM species")
def _(t):
    return _keyed(_tally(t).where("kind = 'taxon'"), F.col("value").alias("taxon"), F.col("n").alias("votes"))


@query("a9_individuals", f"SELECT {_SUBJECT}, taxon, coalesce(individuals, -1) AS individuals FROM species")
def _(t):
    rows = _tally(t).where("kind = 'taxon'")
    return _keyed(rows, F.col("value").alias("taxon"), F.coalesce("individuals", F.lit(-1)).alias("individuals"))


@query(
    "a10_choice_histogram",
    "SELECT workflow_key, sid, choice, count(*) AS n FROM flat_values GROUP BY workflow_key, sid, choice",
)
def _(t):
    return C.choice_histogram(_classified(t)).drop("first_seen")


@query(
    "a10_majority_choice",
    """SELECT workflow_key, sid, choice AS majority_choice, n FROM (
         SELECT *, row_number() OVER (PARTITION BY workflow_key, sid ORDER BY n DESC, first_seen) AS place FROM (
           SELECT workflow_key, sid, choice, count(*) AS n, min((classification_id, i)) AS first_seen
           FROM flat_values GROUP BY workflow_key, sid, choice) h) r WHERE place = 1""",
)
def _(t):
    return C.majority_choice(C.choice_histogram(_classified(t)))


@query("w6_top_species", f"SELECT {_SUBJECT}, taxon, votes, rank FROM kept_species")
def _(t):
    return _keyed(C.top_species(_tally(t)), "taxon", "votes", "rank")


@query("w7_confidence", f"SELECT {_SUBJECT}, taxon, round(confidence, 9) AS confidence FROM confident")
def _(t):
    return _keyed(C.top_species(_tally(t)), "taxon", F.round("confidence", 9).alias("confidence"))


@query(
    "o6_top_choice_and_taxa",
    f"SELECT {_SUBJECT}, taxon FROM kept_species WHERE rank = 1",
)
def _(t):
    return _keyed(C.top_species(_tally(t)).where("rank = 1"), "taxon")


@query(
    "t17_observation_types",
    f"SELECT {_SUBJECT}, rank, observation_type, scientific_name FROM decided",
)
def _(t):
    return _keyed(C.decisions(_classified(t)), "rank", "observation_type", "scientific_name")


@query(
    "t18_confidence_comment",
    f"""SELECT {_SUBJECT}, rank, 'Automatically classified by volunteers for subject ' || CAST(sid AS varchar) ||
         ' with confidence ' || printf('%.2f', round_even(confidence, 2)) AS comments FROM decided""",
)
def _(t):
    return _keyed(C.decisions(_classified(t)), "rank", "comments")


@query(
    "t17_decisions_legacy",
    """WITH kept AS (SELECT * FROM ranked_all WHERE rank <= greatest(1, k_majority + 1)),
       typed AS (SELECT *, CASE WHEN taxon = 'Homo sapiens' THEN 'human'
           WHEN taxon IN ('vehicle', 'blank', 'unclassified', 'unknown') THEN taxon ELSE 'animal' END AS observation_type FROM kept),
       judged AS (SELECT *, bool_or(observation_type = 'blank') OVER (PARTITION BY workflow_key, sid, media_id) AS rejected FROM typed)
       SELECT workflow_key, sid, coalesce(media_id, '-') AS media_id, rank, observation_type,
         CASE WHEN taxon IN ('vehicle', 'blank', 'unclassified', 'unknown', 'animal') THEN '' ELSE taxon END AS scientific_name
       FROM judged WHERE NOT rejected""",
)
def _(t):
    return _keyed(C.decisions(_classified(t), legacy=True), "rank", "observation_type", "scientific_name")


SQL_VIEWS["raw_species"] = """SELECT workflow_id, workflow_key, sid, media_id, CASE WHEN rule = 2 THEN choice ELSE taxon END AS taxon,
      count(*) AS votes, min((classification_id, i)) AS first_vote FROM named
    WHERE rule = 2 OR k BETWEEN 1 AND 3 GROUP BY ALL"""
SQL_VIEWS["ranked_all"] = _top(True).replace("FROM species s", "FROM raw_species s")

SQL_VIEWS["media_ids"] = "SELECT DISTINCT CAST(media_id AS varchar) AS media_id, obs_id FROM obs"
SQL_VIEWS["first_tags"] = (
    "SELECT CAST(media_id AS varchar) AS media_id, arg_min(tags, obs_id) AS tags FROM obs GROUP BY media_id"
)


@query(
    "j2_decision_fan_out",
    """SELECT d.workflow_key, d.sid, d.media_id, d.rank, o.obs_id, d.scientific_name, f.tags,
         'Automatically classified by volunteers in workflow ' || d.workflow_key || ' for subject ' || CAST(d.sid AS varchar) AS comments
       FROM decided d JOIN media_ids o ON d.media_id = o.media_id JOIN first_tags f ON f.media_id = d.media_id""",
)
def _(t):
    rows = C.fan_out(C.decisions(_classified(t)), t.obs, classified_by="engine", copied=["tags"])
    return rows.select("workflow_key", "sid", "media_id", "rank", "obs_id", "scientific_name", "tags", "comments")


@query(
    "p9_consensus_observations",
    """SELECT d.sid, o.obs_id, d.observation_type, d.scientific_name, coalesce(d.individuals, -1) AS count,
         'engine' AS classified_by, 'human' AS classification_method
       FROM decided d JOIN media_ids o ON d.media_id = o.media_id""",
)
def _(t):
    rows = C.consensus_observations(t.export, t.obs, classified_by="engine")
    return rows.select(
        "sid", "obs_id", "observation_type", "scientific_name", F.coalesce("count", F.lit(-1)).alias("count"),
        "classified_by", "classification_method",
    )


@query(
    "j2_fan_out_findings",
    """SELECT 'subject:' || CAST(d.sid AS varchar) AS identifier, 'getting_decision' AS action, 'success' AS status,
         'Observation added to media ' || d.media_id || ': ' || coalesce(d.scientific_name, 'no taxon') AS message
       FROM decided d JOIN media_ids o ON d.media_id = o.media_id""",
)
def _(t):
    return C.fan_out_findings(C.consensus_observations(t.export, t.obs, classified_by="engine"))


@query(
    "v19_undecided_subjects",
    """WITH own_subjects AS (SELECT DISTINCT workflow_key, sid, media_id FROM classified),
       tagged AS (SELECT s.*, s.media_id IN (SELECT media_id FROM media_ids) AS observed,
           EXISTS (SELECT 1 FROM majorities m WHERE m.workflow_key = s.workflow_key AND m.sid = s.sid
             AND m.media_id IS NOT DISTINCT FROM s.media_id AND m.k_majority IS NOT NULL
             AND EXISTS (SELECT 1 FROM kept_species d WHERE d.workflow_key = s.workflow_key AND d.sid = s.sid
               AND d.media_id IS NOT DISTINCT FROM s.media_id)) AS decided FROM own_subjects s)
       SELECT 'subject:' || CAST(sid AS varchar) AS identifier, 'get_observations' AS action, 'error' AS status,
         'Media without observations: ' || coalesce(media_id, 'None') AS message FROM tagged WHERE NOT coalesce(observed, false)
       UNION ALL SELECT 'subject:' || CAST(sid AS varchar), 'getting_decision', 'error', 'Undecided subject ' || CAST(sid AS varchar)
       FROM tagged WHERE observed AND NOT decided""",
)
def _(t):
    classified = _classified(t)
    return C.undecided(classified, C.decisions(classified), t.obs)


@query(
    "v21_rows_without_subject",
    """SELECT CAST(cell_id AS varchar) AS identifier, 'read export' AS action, 'error' AS status, 'No subject id could be read' AS message
       FROM id_cells WHERE text = ''""",
)
def _(t):
    cells = t.id_cells.select(F.col("cell_id").cast("string").alias("classification_id"), F.col("text").alias("subject_ids"))
    return C.rows_without_subject(cells)


@query(
    "t10_subject_ids",
    """SELECT cell_id, CAST(regexp_replace(part, '[^0-9]', '', 'g') AS bigint) AS sid FROM (
         SELECT cell_id, unnest(string_split_regex(text, '[,;]')) AS part FROM id_cells) p
       WHERE regexp_replace(part, '[^0-9]', '', 'g') <> ''""",
)
def _(t):
    return t.id_cells.select("cell_id", F.explode(parsing.subject_ids(F.col("text"))).alias("sid"))


@query(
    "t10_subject_ids_legacy",
    """SELECT cell_id, CAST(regexp_replace(part, '[^0-9]', '', 'g') AS bigint) AS sid FROM (
         SELECT cell_id, unnest(string_split(text, ',')) AS part FROM id_cells) p
       WHERE regexp_replace(part, '[^0-9]', '', 'g') <> ''""",
)
def _(t):
    return t.id_cells.select("cell_id", F.explode(parsing.subject_ids(F.col("text"), legacy=True)).alias("sid"))


def task_values(parsed):
    """Type of the values of one task."""
    return parsed.schema["a"].dataType.elementType["value"].dataType


@query(
    "t11_tolerant_annotations",
    """SELECT c.classification_id, 1 AS n_tasks, CAST(any_value(c.k) AS int) AS n_values,
         coalesce(string_agg(h.choice || ':' || coalesce(h.howmany, '-'), ',' ORDER BY h.i), '') AS answers
       FROM classified c LEFT JOIN chosen h ON h.classification_id = c.classification_id GROUP BY c.classification_id""",
)
def _(t):
    parsed = t.export.select("classification_id", parsing.annotations(F.col("annotations")).alias("a"))
    values = F.flatten(F.transform("a", lambda task: F.coalesce(task["value"], F.array().cast(task_values(parsed)))))
    answer = F.transform(
        "values",
        lambda v: F.concat(v["choice"], F.lit(":"), F.coalesce(F.try_element_at(v["answers"], F.lit("HOWMANY")), F.lit("-"))),
    )
    return parsed.select("classification_id", F.size("a").alias("n_tasks"), values.alias("values")).select(
        "classification_id", "n_tasks", F.size("values").alias("n_values"), F.array_join(answer, ",").alias("answers")
    )


@query("t12_subject_names", "SELECT classification_id, subject_name FROM classified")
def _(t):
    return _classified(t).select("classification_id", "subject_name")


@query("t13_media_ids", "SELECT classification_id, coalesce(media_id, '-') AS media_id FROM classified")
def _(t):
    return _classified(t).select("classification_id", F.coalesce("media_id", F.lit("-")).alias("media_id"))


@query(
    "t14_retirement",
    "SELECT classification_id, retired, CASE WHEN retired THEN 'classification_count' END AS retirement_reason FROM classified",
)
def _(t):
    return _classified(t).select("classification_id", "retired", "retirement_reason")


@query(
    "t15_choice_answer_pairs",
    "SELECT classification_id, CAST(i AS int) AS pos, choice, coalesce(howmany, '-') AS howmany FROM chosen",
)
def _(t):
    rows = _pairs(t)
    howmany = F.try_element_at("answers", F.lit("HOWMANY"))
    return rows.select("classification_id", "pos", "choice", F.coalesce(howmany, F.lit("-")).alias("howmany"))


@query(
    "t25_annotation_labels",
    """SELECT c.classification_id, CASE WHEN c.k = 0 THEN 'invalid'
         ELSE h.choice || coalesce(' (' || h.howmany || ')', '') END AS label
       FROM classified c LEFT JOIN chosen h ON h.classification_id = c.classification_id AND h.i = 0""",
)
def _(t):
    label = parsing.annotation_label(parsing.annotations(F.col("annotations")))
    return t.export.select("classification_id", label.alias("label"))


@query(
    "t29_whole_numbers",
    """SELECT classification_id, CAST(i AS int) AS pos, coalesce(CASE WHEN regexp_full_match(howmany, '[0-9]+') THEN CAST(howmany AS bigint) END, -1) AS n
       FROM chosen""",
)
def _(t):
    rows = _pairs(t)
    n = parsing.whole_number(F.try_element_at("answers", F.lit("HOWMANY")))
    return rows.select("classification_id", "pos", F.coalesce(n, F.lit(-1)).alias("n"))


@query(
    "j8_members_of_subject_set",
    "SELECT classification_id, sid FROM classified WHERE sid IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def _(t):
    members = t.orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey AS sid")
    return C.classification_table(t.export, subjects=members).select("classification_id", "sid")


@query(
    "x4_subject_predicate",
    "SELECT classification_id, sid FROM classified WHERE sid > 1000",
)
def _(t):
    return C.classification_table(t.export, keep_subject=F.col("sid") > 1000).select("classification_id", "sid")


@query(
    "x5_exploded_choices",
    "SELECT sid, choice, count(*) AS n FROM chosen GROUP BY sid, choice",
)
def _(t):
    return _pairs(t).groupBy("sid", "choice").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j14_choice_taxa",
    "SELECT classification_id, CAST(i AS int) AS pos, choice, taxon FROM named",
)
def _(t):
    rows = _pairs(t).drop("sid", "answers")
    # The dimension holds the fixed choice tables, 66 rows.
    joined = rows.join(F.broadcast(C.taxa_table(t.spark)), ["workflow_id", "choice"], "left")
    other = F.when(F.col("workflow_id") == "29187", "unknown").otherwise(F.col("choice"))
    return joined.select("classification_id", "pos", "choice", F.coalesce("taxon", other).alias("taxon"))


@query(
    "x1_extracted_votes",
    f"SELECT {_SUBJECT}, workflow_id, taxon, votes FROM species",
)
def _(t):
    rows = C.tally(_classified(t), C.RULES).where("kind = 'taxon'")
    return _keyed(rows, "workflow_id", F.col("value").alias("taxon"), F.col("n").alias("votes"))


@query(
    "x2_user_voting_rule",
    """SELECT workflow_key, sid, coalesce(media_id, '-') AS media_id, taxon AS winner, votes FROM (
         SELECT *, row_number() OVER (PARTITION BY workflow_key, sid, media_id ORDER BY votes DESC, taxon) AS place
         FROM species) s WHERE place = 1""",
)
def _(t):
    import pandas as pd

    def most_voted(pdf: pd.DataFrame) -> pd.DataFrame:
        taxa = pdf[pdf["kind"] == "taxon"].sort_values(["n", "value"], ascending=[False, True])
        taxa = taxa.drop_duplicates(["workflow_key", "sid", "media_id"])
        return taxa.rename(columns={"value": "winner", "n": "votes"})[
            ["workflow_key", "sid", "media_id", "winner", "votes"]
        ]

    schema = "workflow_key string, sid bigint, media_id string, winner string, votes bigint"
    return _keyed(C.decisions_by_user_rule(_tally(t), most_voted, schema), "winner", "votes")


@query(
    "x3_rules_by_workflow",
    "SELECT workflow_id, count(*) AS n_decisions, count(DISTINCT sid) AS n_subjects FROM decided GROUP BY workflow_id",
)
def _(t):
    decided = C.decisions(_classified(t), C.RULES)
    return decided.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("n_decisions"), F.count_distinct("sid").alias("n_subjects")
    )
