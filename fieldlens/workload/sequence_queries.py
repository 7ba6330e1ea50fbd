"""Queries on media, observations and image sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import filters, naming
from fieldlens.operators import sequences as S
from fieldlens.workload.registry import SQL_VIEWS, query

GAP = 86_400  # a day: the given events are sparser than a camera's images
IMAGES = 3

SQL_VIEWS["wanted"] = (
    "SELECT * FROM media WHERE file_public AND NOT private_human AND NOT private_vehicle AND ts IS NOT NULL"
)
SQL_VIEWS["obs_types"] = (
    "SELECT media_id, bool_or(observation_type = 'human') AS human, count(*) AS n_observations FROM obs "
    "WHERE observation_type <> '' AND observation_type <> 'unclassified' GROUP BY media_id"
)


def _sequence_views(prefix: str, source: str) -> None:
    SQL_VIEWS[f"{prefix}_gaps"] = (
        "SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 86400 SECOND THEN 1 ELSE 0 END "
        f"AS opens FROM {source} WINDOW w AS (PARTITION BY deployment_id ORDER BY ts, media_id)"
    )
    SQL_VIEWS[f"{prefix}_seqs"] = (
        "SELECT *, CAST(sum(opens) OVER (PARTITION BY deployment_id ORDER BY ts, media_id ROWS UNBOUNDED PRECEDING) "
        f"AS bigint) AS seq_id FROM {prefix}_gaps"
    )


SQL_VIEWS["joined_media"] = "SELECT w.*, o.human FROM wanted w JOIN obs_types o ON w.media_id = o.media_id"
_sequence_views("all", "media")
_sequence_views("joined", "joined_media")
SQL_VIEWS["joined_lasts"] = "SELECT *, max(seq_id) OVER (PARTITION BY deployment_id) AS last_seq FROM joined_seqs"
SQL_VIEWS["middle_kept"] = (
    "SELECT * FROM joined_lasts WHERE NOT (seq_id > 1 AND seq_id < last_seq AND human)"
)


def _sampled(source: str) -> str:
    return f"""WITH placed AS (
        SELECT *, row_number() OVER (PARTITION BY deployment_id, seq_id ORDER BY ts, media_id) - 1 AS pos,
               count(*) OVER (PARTITION BY deployment_id, seq_id) AS seq_length FROM {source})
      SELECT deployment_id, seq_id, CAST(pos AS bigint) AS pos, CAST(seq_length AS bigint) AS seq_length, media_id, ts,
             CAST(media_id AS varchar) || '_x_' || deployment_id || '_x_' || file_name AS label_name
      FROM placed WHERE seq_length <= {IMAGES} OR pos IN (
        SELECT CAST(round_even(i * ((seq_length - 1) / {IMAGES - 1}.0), 0) AS bigint) FROM range({IMAGES}) r(i))"""


def _joined(t):
    wanted = S.public_media(t.media).where("ts IS NOT NULL")
    return S.media_with_observations(wanted, S.classified(t.obs))


def _blacklist(t):
    return t.supplier.selectExpr("printf('R%04d-LOC_%03d', s_suppkey % 5 + 1, s_suppkey) AS deployment_id")


def _numbered(df):
    rows = S.ordered_rows(df, ["deployment_id"], ["ts", "media_id"])
    return S.number_sequences(rows, GAP)


_COLUMNS = ["deployment_id", "seq_id", "pos", "seq_length", "media_id", "ts"]


@query("p7_select_sequences", _sampled("middle_kept"))
def _(t):
    return S.select_sequences(t.media, t.obs, max_interval=GAP, n_images=IMAGES)


@query("w1_gap_sessions", "SELECT deployment_id, media_id, ts, seq_id FROM all_seqs")
def _(t):
    return S.gap_sequences(t.media, GAP).select("deployment_id", "media_id", "ts", "seq_id")


@query("w2_middle_human_filter", "SELECT deployment_id, seq_id, media_id FROM middle_kept")
def _(t):
    rows = S.drop_middle_humans(_numbered(_joined(t)))
    return rows.result().select("deployment_id", "seq_id", "media_id")


@query(
    "w3_even_sampling",
    f"SELECT deployment_id, seq_id, pos, seq_length, media_id, ts FROM ({_sampled('all_seqs')}) s",
)
def _(t):
    return S.sample_sequences(_numbered(t.media), IMAGES).result().select(_COLUMNS)


@query(
    "w10_leading_differences",
    """WITH d AS (SELECT deployment_id, media_id, ts, value, row_number() OVER w AS position,
            sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY deployment_id ORDER BY ts, media_id
            ROWS UNBOUNDED PRECEDING) AS over FROM (SELECT m.*, e.value FROM media m JOIN events e ON e.event_id = m.media_id) x
            WINDOW w AS (PARTITION BY deployment_id ORDER BY ts, media_id))
       SELECT deployment_id, media_id, CAST(position AS bigint) AS position, over = 0 AS is_leading FROM d""",
)
def _(t):
    rows = t.events.selectExpr(
        "printf('R%04d-LOC_%03d', user_id % 5 + 1, user_id) AS deployment_id", "event_id AS media_id", "ts", "value"
    )
    marked = S.leading_within(rows, ["deployment_id"], ["ts", "media_id"], "value", 30)
    return marked.select("deployment_id", "media_id", "position", "is_leading")


@query(
    "o2_media_by_time",
    """SELECT deployment_id, media_id, ts, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, media_id) AS place
       FROM media WHERE ts IS NOT NULL""",
)
def _(t):
    rows = S.ordered_rows(t.media.where("ts IS NOT NULL"), ["deployment_id"], ["ts", "media_id"])
    return rows.extend(position="place").result().select("deployment_id", "media_id", "ts", "place")


@query(
    "j1_media_with_observations",
    """SELECT m.media_id, m.deployment_id, o.n_observations, o.types FROM media m JOIN (
         SELECT media_id, count(*) AS n_observations, string_agg(DISTINCT observation_type, ',' ORDER BY observation_type) AS types
         FROM obs WHERE observation_type <> '' AND observation_type <> 'unclassified' GROUP BY media_id) o
       ON m.media_id = o.media_id""",
)
def _(t):
    joined = S.media_with_observations(t.media, S.classified(t.obs))
    return joined.select("media_id", "deployment_id", "n_observations", F.array_join("observations", ",").alias("types"))


@query(
    "a1_observation_types",
    "SELECT media_id, observation_type, count(*) AS n FROM obs GROUP BY media_id, observation_type",
)
def _(t):
    return S.observation_types(t.obs)


@query(
    "a1_list_valued_types",
    """SELECT media_id, observation_type, count(*) AS n FROM (SELECT media_id, unnest([observation_type, tags]) AS observation_type
       FROM obs) o GROUP BY media_id, observation_type""",
)
def _(t):
    lists = t.obs.select("media_id", F.array("observation_type", "tags").alias("observation_type"))
    return S.observation_types(S.one_type_per_row(lists))


@query(
    "f8_classified_observations",
    "SELECT obs_id, observation_type FROM obs WHERE observation_type <> '' AND observation_type <> 'unclassified'",
)
def _(t):
    return S.classified(t.obs).select("obs_id", "observation_type")


@query("f9_public_media", "SELECT media_id FROM media WHERE file_public AND NOT private_human AND NOT private_vehicle")
def _(t):
    return S.public_media(t.media).select("media_id")


@query(
    "f11_deployment_blacklist",
    """SELECT m.media_id, m.deployment_id FROM media m
       WHERE m.deployment_id NOT IN (SELECT printf('R%04d-LOC_%03d', s_suppkey % 5 + 1, s_suppkey) FROM supplier)""",
)
def _(t):
    return S.without_blacklisted(t.media, _blacklist(t)).select("media_id", "deployment_id")


@query(
    "f11_skipped_deployments",
    """SELECT count(*) AS skipped FROM (SELECT DISTINCT deployment_id FROM media
       WHERE deployment_id IN (SELECT printf('R%04d-LOC_%03d', s_suppkey % 5 + 1, s_suppkey) FROM supplier)) s""",
)
def _(t):
    own = t.media.select("deployment_id").distinct()
    return own.join(_blacklist(t), "deployment_id", "left_semi").agg(F.count(F.lit(1)).alias("skipped"))


@query(
    "u3_media_without_observations",
    "SELECT media_id FROM media EXCEPT SELECT media_id FROM obs",
)
def _(t):
    return S.media_without_observations(t.media, t.obs).select("media_id")


@query(
    "j12_collection_deployments",
    """SELECT c.collection, d.deployment_id FROM deployments d JOIN collections c
       ON starts_with(lower(d.deployment_id), lower(c.collection) || '-')""",
)
def _(t):
    return S.collection_deployments(t.deployments, t.collections).select("collection", "deployment_id")


@query(
    "a18_sequence_totals",
    """SELECT deployment_id, count(DISTINCT seq_id) AS n_sequences, count(*) AS n_images
       FROM all_seqs GROUP BY deployment_id""",
)
def _(t):
    sequences = S.gap_sequences(t.media, GAP).groupBy("deployment_id")
    return sequences.agg(F.max("seq_id").alias("n_sequences"), F.count(F.lit(1)).alias("n_images"))


@query(
    "t19_label_names",
    """SELECT media_id, CAST(media_id AS varchar) || '_x_' || deployment_id || '_x_' || file_name AS label_name,
         'https://archive.example/:media:' || CAST(media_id AS varchar) AS external_id,
         'https://archive.example/storage/resource/media/' || CAST(media_id AS varchar) || '/pfile/' AS preview,
         'https://archive.example/storage/resource/media/' || CAST(media_id AS varchar) || '/file/' AS link,
         'https://archive.example/storage/resource/media/' || CAST(media_id AS varchar) || '/tfile/' AS thumbnail
       FROM media""",
)
def _(t):
    media_id = F.col("media_id")
    label = naming.label_name(media_id, F.col("deployment_id"), F.col("file_name"))
    urls = naming.media_urls("https://archive.example/", media_id)
    return t.media.select("media_id", label.alias("label_name"), *[v.alias(k) for k, v in urls.items()])


@query(
    "f1_collections_in_list",
    "SELECT media_id, collection FROM media WHERE collection IN ('R0001', 'R0003')",
)
def _(t):
    wanted = filters.in_list(F.col("collection"), ["R0001", "R0003"])
    return t.media.where(wanted).select("media_id", "collection")


@query(
    "f2_deployments_in_list",
    "SELECT media_id, deployment FROM media WHERE lower(deployment) IN ('r0002-loc_006', 'r0003-loc_007')",
)
def _(t):
    wanted = filters.in_list(F.col("deployment"), ["R0002-loc_006", "r0003-LOC_007"], ignore_case=True)
    return t.media.where(wanted).select("media_id", "deployment")


@query(
    "f3_media_extensions",
    """SELECT media_id, lower(regexp_extract(file_name, '(\\.[^.]+)$', 1)) AS ext FROM media
       WHERE lower(regexp_extract(file_name, '(\\.[^.]+)$', 1))
         IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.mp4', '.mpeg', '.mov', '.avi')""",
)
def _(t):
    from fieldlens.schema import MEDIA_EXTENSIONS

    ext = naming.extension(F.col("file_name"))
    return t.media.where(filters.in_list(ext, MEDIA_EXTENSIONS)).select("media_id", ext.alias("ext"))


@query(
    "f4_mime_whitelist",
    """SELECT media_id, mime_type, mime_type IN ('image/png', 'image/jpeg', 'image/gif', 'image/webp', 'video/mp4',
       'video/mpeg', 'video/quicktime', 'video/x-msvideo') AS is_valid FROM media""",
)
def _(t):
    return t.media.select("media_id", "mime_type", filters.known_mime_type(F.col("mime_type")).alias("is_valid"))


@query("f5_equality_filters", "SELECT media_id FROM media WHERE collection = 'R0002' AND mime_type = 'image/png'")
def _(t):
    return t.media.where(filters.equalities(["collection = R0002", "mime_type=image/png"])).select("media_id")


@query("f6_id_list", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (3, 14, 15, 92) GROUP BY user_id")
def _(t):
    ids = filters.id_list("3, 14 15,92")
    return t.events.where(filters.in_list(F.col("user_id"), ids)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w11_ordinal",
    """SELECT media_id, deployment, row_number() OVER (PARTITION BY deployment
         ORDER BY media_id) AS file_index FROM media""",
)
def _(t):
    from fieldlens.operators.preparation import numbered_files

    return numbered_files(t.media).select("media_id", "deployment", "file_index")


@query(
    "o1_natural_order",
    """SELECT deployment, rel_path, row_number() OVER (PARTITION BY deployment
         ORDER BY CAST(regexp_extract(rel_path, 'DCIM/([0-9]+)', 1) AS bigint),
                  CAST(regexp_extract(rel_path, 'IMG_([0-9]+)', 1) AS bigint)) AS place FROM media""",
)
def _(t):
    keyed = t.media.select("deployment", "rel_path").withColumn("_key", naming.natural_key(F.col("rel_path")))
    rows = S.ordered_rows(keyed, ["deployment"], ["_key", "rel_path"]).extend(position="place")
    return rows.result().drop("_key")
